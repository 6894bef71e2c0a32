"""Nulls, ties, repeated rows, empty tables, clashing names and split blocks of the training-data operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, html, licenses, near_copies, pii, simhash, toxicity, urls, warc

CLASH = ("host", "path", "rule", "verdict", "n_words", "n_hit", "labels", "score", "pii_base", "canonical", "block", "full", "found", "valid")


def wide(spark, rows, schema):
    """The rows with a column of each clashing name."""
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.mark.parametrize("block", [1, 2, 100])
def test_urls_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(urls, "BLOCK_RULES", block)
    rules = [("allow", "net", "/"), ("block", "net", "/"), ("allow", "a.b.de", "/"), ("block", "b.de", "/x/"), ("block", "de", "/"), ("allow", "b.de", "/x/y/")]
    values = ["http://x.net/", "http://a.b.de/x/", "http://b.de/x/y/z", "http://b.de/x/y", "http://c.de/", "http://ade/", None]
    found = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(wide(spark, [(v,) for v in values * 2], "url string"), rules).collect()}
    assert found == {"http://x.net/": ("net/", "block"), "http://a.b.de/x/": ("a.b.de/", "allow"), "http://b.de/x/y/z": ("b.de/x/y/", "allow"),
                     "http://b.de/x/y": ("b.de/x/", "block"), "http://c.de/": ("de/", "block"), "http://ade/": (None, "allow"), None: (None, "allow")}


def test_url_sweep_equals_brute_force():
    draw = random.Random(5)
    host = lambda: ".".join(draw.choice("abc") for _ in range(draw.randint(1, 4)))
    path = lambda: "/" + "".join(draw.choice("xy/") for _ in range(draw.randint(0, 4)))
    rules = list({(h, p): ("block" if draw.random() < 0.5 else "allow", h, p) for h, p in ((host(), path()) for _ in range(80))}.values())
    hosts, paths = [host() for _ in range(400)], [path() for _ in range(400)]
    found = urls.sweep([urls.reversed_key(h) for h in hosts], paths, urls._sorted_rules(rules))
    for h, p, f in zip(hosts, paths, found):
        fit = [(len(rh + rp), len(rh), rh + rp, v) for v, rh, rp in rules if ("." + h).endswith("." + rh) and p.startswith(rp)]
        assert (f and (f[0], f[1])) == (max(fit)[2:] if fit else None)


def test_warc_edges(spark):
    schema = "record_id long, type string, url string, time long, digest string, headers map<string,string>"
    rows = [(1, "response", "http://a.de/x", 10, "d", {"ETag": "1"}), (2, "response", "http://a.de/x", 10, "d", {"ETag": "2"}), (3, "revisit", "http://a.de/x", 10, "d", None),
            (4, "revisit", None, 11, "d", None), (5, "revisit", "http://a.de/x", None, "d", None), (3, "revisit", "http://a.de/x", 10, "d", None)]
    found = warc.resolve_revisits(wide(spark, rows, schema))
    assert sorted((r["record_id"], r["resolved_id"]) for r in found.collect() if r["type"] == "revisit") == [(3, 2), (3, 2), (4, None), (5, None)]
    assert found.columns.count("valid") == 1 and found.first()["canonical"] == 7
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_near_copies_without_a_common_band_are_linked(spark):
    """Two texts of similarity 8 / 10 that share none of the bands."""
    draw = random.Random(17627)
    words = [f"w{draw.randrange(10**6)}" for _ in range(14)]
    texts = {1: " ".join(words), 2: " ".join(words[:12]), 3: " ".join(words[:11])}
    one, other = (near_copies.shingles(texts[i]) for i in (1, 2))
    assert not (near_copies.bands(one) == near_copies.bands(other)).any()
    found = {r["doc_id"]: r["root"] for r in near_copies.group_near_copies(spark.createDataFrame([(1, texts[1]), (2, texts[2])], "doc_id long, text string")).collect()}
    assert found[1] == found[2]
    # the third is similar to the second alone (7 / 8)
    found = {r["doc_id"]: r["root"] for r in near_copies.group_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(found) == 3 and len(set(found.values())) == 1


@pytest.mark.parametrize("common", [0, 3])
def test_prefixes_alone_find_all_near_copies(spark, monkeypatch, common):
    """Without any common band the groups equal brute force, whichever shingles come last."""
    import numpy as np
    import pandas as pd

    def apart(texts):
        rows = []
        for text in texts:
            found = near_copies.shingles(text)
            node = near_copies._node(found)
            rows.append((node, len(found), np.array([node], np.int64)))
        return pd.DataFrame(rows, columns=["node", "n_shingles", "bands"])

    monkeypatch.setattr(near_copies, "_sketch", apart)
    monkeypatch.setattr(near_copies, "COMMON_DOCS", common)
    draw = random.Random(3)
    line, texts = [f"c{i}" for i in range(12)], []
    for _ in range(40):
        base = [f"v{draw.randrange(10**6)}" for _ in range(draw.choice([1, 5, 8, 60, 120, 200]))] + line * draw.randint(0, 2)
        for _ in range(draw.randint(1, 4)):
            edited = list(base)
            for _ in range(draw.randint(0, 3)):
                at = draw.randrange(len(edited))
                edited[at:at + 1] = draw.choice([[], [f"e{draw.randrange(10**6)}"], [edited[at], "more"]]) or edited[:1]
            texts.append(" ".join(edited))
    rows = list(enumerate(texts + ["", None]))
    found = {r["doc_id"]: r["root"] for r in near_copies.group_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(root(i), set()).add(i)
    made = {}
    for i, name in found.items():
        made.setdefault(name, set()).add(i)
    assert sorted(map(sorted, made.values())) == sorted(map(sorted, groups.values())) and 30 < len(groups) < len(rows) - 20


def test_simhash_large_components_and_null_ids(spark, monkeypatch):
    base = 0x0F0F_1234_5678_9ABC
    values = [base ^ (1 << b) for b in range(40)] + [base]
    texts = {i: str(i) for i in range(len(values))}
    monkeypatch.setattr(simhash, "_fingerprints", lambda s: __import__("pandas").Series([values[int(t)] if t and t.isdigit() else 0 for t in s], dtype="int64"))
    rows = [(i, t) for i, t in texts.items()] * 3 + [(None, "x"), (900, None), (None, None)]
    for part in (0.001, 1.0):
        monkeypatch.setattr(simhash, "HOT_PART", part)
        found = [(r["doc_id"], r["component_id"]) for r in simhash.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sorted(found, key=str) == sorted([(i, 0) for i in texts] * 3 + [(None, 900)] * 2 + [(900, 900)], key=str)


@pytest.mark.parametrize("part", [0.001, 0.05, 1.0])
def test_components_of_hubs_and_chains(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "HOT_PART", part)
    draw = random.Random(5)
    pairs = [(500, n) for n in range(400, 480)] + [(900, n) for n in range(901, 980)] + [(n, n + 1) for n in range(1000, 1040)]
    pairs += [(1040, 2000), (7, 7), *[(2000, n) for n in range(2001, 2060)], *[(draw.randrange(3000, 3300), draw.randrange(3000, 3300)) for _ in range(120)]]
    least = {n: n for p in pairs for n in p}
    for _ in least:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs + pairs[:9], "a long, b long")).collect()}
    alone = {a for a, b in pairs if a == b} - {n for a, b in pairs if a != b for n in (a, b)}
    assert found == {n: r for n, r in least.items() if n not in alone and n != r}


def test_clashing_names_and_empty_tables(spark):
    docs = wide(spark, [(1, "under the mit license a@b.de"), (1, "under the mit license a@b.de"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "under the mit license a")], "item_id long, text string")
    marked = decontamination.mark_contamination(docs, items).select("doc_id", "n_words", "n_hit", "labels").collect()
    assert sorted(map(str, map(tuple, marked))) == sorted(map(str, [(1, 7, 5, 7), (1, 7, 5, 7), (None, 0, 0, 7)]))
    assert decontamination.mark_contamination(docs.limit(0), items).count() == 0 and decontamination.mark_contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert {r["labels"] for r in licenses.scan_licenses(docs).collect()} == {"mit", ""} and licenses.scan_licenses(docs).columns.count("score") == 1
    assert pii.find_pii(docs, (pii.BoostedTrees(), {})).columns.count("pii_base") == 1
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).columns.count("score") == 1
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


#: What real notices say, and the labels that the method must find in them.
NOTICES = [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("GNU General Public License, version 2, as published by the Free Software Foundation", "gpl-2"), ("Released under the GPLv3.", "gpl-3"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), ("a Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa"),
    ("Creative Commons Attribution-NonCommercial-NoDerivs 2.0 Generic License", "cc-by-nc-nd"), ("see https://creativecommons.org/licenses/by-nc-sa/4.0/ for licenses", "cc-by-nc-sa"), ("Text: CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3"),
    ("Use of this source code is governed by a BSD-style license", "bsd-3"), ("Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
    ("made available under the terms of the Eclipse Public License 2.0", "epl-2"), ("Licensed under the EUPL v1.2", "eupl"), ("under the Server Side Public License", "sspl"), ("all rights reserved", "all-rights-reserved"),
    ("The committee published a report on the weather.", ""), ("a license to drive is available from the office", ""),
]


def test_licenses_of_real_notices(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in NOTICES)), "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(rows).collect()}
    for i, (text, labels) in enumerate(NOTICES):
        assert set(filter(None, labels.split(","))) <= set(filter(None, found[i][0].split(","))), (text, found[i])
        if not labels:
            assert found[i] == ("", 0.0), text


def test_license_rules_gate_rank_and_contain(spark, monkeypatch):
    rules = [("short", "alpha", "alpha beta", 9, 0.5), ("long", "alpha", "alpha beta gamma", 1, 0.6), ("low", "delta", "delta", 1, 0.9), ("high", "delta", "delta", 2, 0.2), ("gated", "absent", "delta", 9, 1.0), ("tie", "delta", "delta", 2, 0.3)]
    monkeypatch.setattr(licenses, "rules", lambda: rules)
    rows = spark.createDataFrame([(1, "license alpha beta gamma"), (2, "license alpha beta delta delta"), (3, "license epsilon")], "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(rows).collect()}
    assert found == {1: ("long", 0.6), 2: ("high,short,tie", 0.5), 3: ("", 0.0)}


def test_pii_thresholds_of_kinds_and_planted_spans(spark):
    import numpy as np

    kinds = np.array([4] * 100 + [8] * 100 + [9] * 5)
    p = np.array([0.9] * 50 + [0.5] * 50 + [0.9] * 50 + [0.5] * 50 + [0.9] * 5)
    truth = np.array([1.0] * 50 + [0.0] * 50 + [1.0] * 100 + [0.0] * 5)
    found = pii.calibrate(p, truth, kinds)
    assert 0.5 < found["secret"] <= 0.9 and found["local"] <= 0.5 and found["disguised"] == found[""]
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fitted, draw = pii.fit(corpus), random.Random(8)
    token = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ0123456789") for _ in range(n))
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    planted = [f"set {k} {v} {token(draw.randint(12, 40))}" for k in ("token", "api_key", "password") for v in ("=", ":") for _ in range(10)]
    planted += [f"the digest {hexes(draw.choice((32, 40, 64)))} was kept" for _ in range(30)] + [f"call 0{draw.randint(20, 99)} {draw.randint(1000, 9999)} {draw.randint(1000, 9999)} now" for _ in range(20)]
    clean = [f"the {w} of the town was a matter of {k} days and {n} people, see page {n}" for w in ("secret", "token", "key") for k in (3, 14) for n in (12, 2024, 150)]
    caught = sum(bool(pii.select_spans(t, *fitted)[1]) for t in planted)
    wrong = sum(bool(pii.select_spans(t, *fitted)[1]) for t in clean)
    print("planted", len(planted), "caught", caught, "clean", len(clean), "touched", wrong)
    assert caught >= 0.9 * len(planted) and not wrong


def test_pii_trees_come_from_all_candidates(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    trees, thresholds = pii.fit(corpus)
    # the same texts under other ids and in other partitions
    again, same = pii.fit(corpus.select((F.col("doc_id") * 7 + 1_000_003).alias("doc_id"), "text").repartition(5, "text"))
    assert trees.trees and (again.trees, again.bias, same) == (trees.trees, trees.bias, thresholds)
    assert pii.candidates("a ſecret: k7Lm2x9Q4") == [("secret", 10, 19)] and not pii.candidates("no word of it")
