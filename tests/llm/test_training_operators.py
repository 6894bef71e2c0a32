"""Training-data operators against brute force on small tables with nulls, empty, long, repeated and tied rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import (
    decontamination, fingerprints, html, licenses, packing, pii, simhash, toxicity, urls, warc)

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n int, fp long, words int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(80).collect()]
    odd = [
        None, "", " \n\t ", "one", "under the MIT license", "cc by nc cc by nc", "word " * 30_000, real[3][1], real[3][1] + " more",
        "Mail a.b@c.de, +49 30 1234567 89, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.1. token = \"7c72db563d7f6e50cec0\"",
        "1.2.3.4.5.6.7.8 @@x@y.z @ a@b a@b.c", "9" * 20_000, "a" * 50_000, "İstanbul ÄÖ é 😀 under the mit license 😀",
        "apache license version 2.0 Licensed under the Apache License, Version 2.0 all rights reserved",
    ]
    rows = real + [(1000 + i, t) for i, t in enumerate(odd)]
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 0.5) for i, t in rows], SCHEMA).repartition(3).cache()


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_simhash(docs):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    expected = {i: brute(t) for i, t in texts(docs).items()}
    ids = sorted(expected)
    group = {i: i for i in ids}
    for _ in ids:
        changed = False
        for a in ids:
            for b in ids:
                if (expected[a] ^ expected[b]).bit_count() <= 4 and group[b] > group[a]:
                    group[b], changed = group[a], True
        if not changed:
            break
    found = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.group_near_duplicates(docs).collect()}
    assert found == {i: (expected[i], group[i]) for i in ids}


def test_simhash_links_span_components_in_split_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 10)
    values = [(k * 0x9E3779B97F4A7C15 & (2**63 - 1)) ^ (1 << b) for k in range(6) for b in range(0, 60, 4)]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in set(values)], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert len({roots.get(v, v) for v in values}) == 6


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    words = [" ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest()[:6] for k in range(60)) for i in range(5)]
    rows = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (8, words[4]), (8, words[4]), (None, words[4]), (None, words[0])]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    expected = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (8, words[4])]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_pipeline_drops_near_copies(spark, monkeypatch):
    import random

    import corpus_pipeline
    from tidewatch.llm import near_copies

    draw, texts = random.Random(3), []
    for _ in range(12):
        words = [f"w{draw.randrange(9999)}" for _ in range(100)]
        texts += [" ".join(words)]
        for _ in range(4):
            at = draw.randrange(100)
            texts.append(" ".join(words[:at] + [f"x{draw.randrange(9999)}"] + words[at + 1:]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i:i + 5]) for i in range(96)} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    expected = sorted({min(k for k in range(len(texts)) if group[k] == g) for g in group})
    for part in (near_copies.PART_SHINGLES, 150):
        monkeypatch.setattr(near_copies, "PART_SHINGLES", part)
        found = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
        assert sorted(r["doc_id"] for r in found) == expected and len(expected) < len(texts) / 3


def test_decontamination(spark, docs):
    real = texts(docs)
    items = [(1, " ".join(real[0].split()[:20])), (2, "one"), (3, None), (4, "!!"), (5, " ".join(real[3].split()[4:17])), (5, "one")]
    found = {r["doc_id"]: r for r in decontamination.mark_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    form = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return form.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))

    for doc_id, text in real.items():
        w, hit, names = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(13, len(iw))
            windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add(str(item))
        r = found[doc_id]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    once = sorted(map(tuple, decontamination.mark_contamination(docs.select("doc_id", "text"), items).drop("text").collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 400)
    assert once == sorted(map(tuple, decontamination.mark_contamination(docs.select("doc_id", "text"), items).drop("text").collect()))


def test_decontamination_by_items_without_id(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    frame = spark.createDataFrame([(1, f"a {passage} b"), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage)], "item_id string, text string")
    found = decontamination.mark_contamination(frame, items).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in found] == [(13, 0, True), (0, 0, False)]


def test_pii_base_spans(docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for text in texts(docs).values():
        if text is None or len(text) > 15_000:
            continue
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        expected = [("email", *m.span()) for m in email.finditer(text)]
        expected += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        expected += [("card", *m.span()) for m in card.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        expected += [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(text) == expected


def test_pii_selects_secrets_and_redacts(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = pii.fit(corpus)
    text = "ask a@b.de about token = \"7c72db563d7f6e50cec00950f7bab1f2223b6afd\" now"
    row = pii.redact(spark.createDataFrame([(1, text, 9)], "doc_id long, text string, pii_base int"), fitted).first()
    assert "a@b.de" not in row["text"] and "7c72db" not in row["text"] and row["pii_base"] == 9
    assert pii.redact(spark.createDataFrame([(1, None)], "doc_id long, text string"), fitted).first()["text"] is None


def test_pii_takes_whole_values(spark):
    jwt = ".".join(hashlib.sha256(str(i).encode()).hexdigest() * 3 for i in range(3))
    key, local = hashlib.sha512(b"x").hexdigest() * 2, "very.long.name" * 9
    spans = lambda t: {t[a:b] for _, a, b in pii.candidates(t)}
    assert jwt in spans(f"token={jwt} end") and key in spans(f"see {key}.") and f"{local} [at] host [dot] org" in spans(f"to {local} [at] host [dot] org.")
    label = lambda kind, before, span, after="": pii._weak_label(before + span + after, kind, len(before), len(before + span))
    assert label("secret", "password = ", "k7Lm2x9Q") and label("secret", "pwd: \"", "tigerlily", "\"") and label("secret", "secret: ", "tigerlilyhouse", "\n")
    assert not label("secret", "the secret: ", "patience", " and time") and not label("secret", "password: ", "********")
    assert label("local", "at ", "212-555-0199") and label("local", "phone ", "55 12 34 56") and not label("local", "on ", "2024-01-15")
    fitted = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rows = [(1, f"token={jwt} end"), (2, f"key {key} end"), (3, "password = k7Lm2x9Q end")]
    found = pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), fitted).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == ["token=[SECRET] end", "key [KEY] end", "password = [SECRET] end"]


def test_fingerprints(spark, docs):
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edits(docs).collect()}
    real = {i: t or "" for i, t in texts(docs).items()}
    order = sorted(real, reverse=True)
    shingles = lambda t: {tuple(w[i:i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    errors = []
    for k, i in enumerate(order):
        text, following = real[i], real[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(text.split()) >= 40:
            errors.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
        assert len(r["fingerprint"]) == 256
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.25
    assert found[3]["fingerprint"] == found[1007]["fingerprint"] and found[1000]["fingerprint"] == found[1001]["fingerprint"]
    assert fingerprints.fingerprint_with_edits(docs.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_fingerprints_of_repeated_null_and_single_ids(spark, partitions):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [(5, "e" * 9, "x"), (5, "b" * 8, "x"), (5, "b" * 8, "x"), (9, "n" * 7, "x"), (1, "a" * 10, "x"), (-3, None, "x"), (None, "z" * 6, "x"), (2**40, "t" * 3, "x")]
    found = fingerprints.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()
    expected = ["e" * 5 + "a" * 4, "b" * 4 + "a" * 4, "b" * 4 + "a" * 4, "n" * 4 + "b" * 3, "a" * 5, "", "z" * 3, "t" * 2 + "n"]
    assert sorted(r["edited_sha256"] for r in found) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in expected)
    assert [r["near_next"] for r in found if r["doc_id"] is None] == [None]
    one = fingerprints.fingerprint_with_edits(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in one] == [(hashlib.sha256(b"abab").hexdigest(), 1.0)]
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_licenses(docs):
    form = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.scan_licenses(docs).collect():
        w = form.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert len(licenses.rules()) > 200


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts(docs).items()}
    pieces = pd.DataFrame([r.asDict() for r in packing.pack(docs).collect()])
    for doc_id, group in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in group.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc_id])
            assert p.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[doc_id][at:at + p.length]))
            at += p.length
        assert at == len(ids[doc_id])
    sizes = pieces.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 2048 and set(pieces["doc_id"]) == set(ids)
    padded = sum(2048 - n for n in sizes if n & (n - 1))
    assert padded < 0.02 * sizes.sum()
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]


def test_packing_encodes_pieces_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["don't x\x1c'll É ﬁ ΑΣ Σ İ a\u200db \x85 c, é, 'x',", "it's\x0b'S x́ ́a a,b,, a., ).", "<|startoftext|>a <|endoftext|>", " \n", "", "a\xa0b\u3000c,",
           "日本語 テスト123abc_--'re,", "a;;, ; ., , ,, ,a don't. don't's, 1, 2,3", "ÀÉÎ×÷Þß ŸÿŒ x" + "́", "a" * 63 + " " + "b" * 64 + " " + "é" * 40,
           "12é3_$5.a\x7f b\x00c 'tis", "x" * 5_000 + "," + "9" * 300]
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.merges
    corpus = [x for x in pd.read_parquet(f"{DIR}/documents.parquet")["text"].head(60) if x]
    for texts_ in (odd, odd[::-1], odd[:3], corpus, [x * 2 for x in odd]):
        assert [e.tolist() for e in encoder.encode(texts_)] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts_]


def test_urls(spark):
    values = [None, "", "x.net/a", "http://a.net", "http://a.NET/", "https://b.example.net/en/x?q", "http://example.com/de/", "http://notexample.com/de/x",
              "http://x.org/fr/#a", "http://x.org/frx", "ftp://:///", "http://spam-farm.example.org/en", "http://net/"]
    found = urls.judge_urls(spark.createDataFrame([(i, v, "r") for i, v in enumerate(values)], "page_id long, url string, other string"))
    pages = pd.DataFrame({"page_id": range(len(values)), "url": values})
    expected = duckdb.sql(urls.OP9_SQL).df()
    columns = ["page_id", "host", "path", "rule", "verdict"]
    clean = lambda df: [tuple(None if pd.isna(v) else v for v in r) for r in df[columns].sort_values("page_id").itertuples(index=False)]
    assert len(pages) and clean(found.toPandas()) == clean(expected)
    assert urls.judge_urls(spark.createDataFrame([(1, "http://a.de/")], "page_id long, url string"), []).first()["verdict"] == "allow"


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><li>menu</li></nav><!-- x -->"
        "<div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>First<br><p>Second\n line</p><div class='comments'>no</div></article><footer>f</footer></body>")
    assert html.main_text(page) == "Head & more\nFirst\nSecond line"
    assert html.main_text(None) == "" == html.main_text("")
    assert html.main_text("<body><div id='sidebar'>s</div><p>only</p><form>f</form>") == "only"


def _anonymous(n: int) -> str:
    """A page whose tags tell nothing: what is its article shows only beside other pages of its host."""
    menu = "".join(f"<div class='r'><a href='/{n}{k}'>link {n} {k}</a></div>" for k in range(3 + n % 2))
    paragraphs = "".join(f"<div class='t'>word{n} <i>text</i> {k} and more of the story number {n * 7 + k}</div>" for k in range(2 + n % 3))
    note = "<div class='z'><div class='y'>seen by some</div></div>" if n % 2 else ""
    return f"<html><body><div class='a'>{menu}</div><div class='b'>Our site</div>{note}<div class='c'><div class='h'>Title {n}</div>{paragraphs}</div><div class='d'>page {n}</div></body></html>"


def test_html_wrapper_decides_pages_without_telling_tags(spark):
    wrapper = html.infer_wrapper([_anonymous(n) for n in range(6)])
    text = html.expression(wrapper)
    assert '"Our site")' in text and "div.c/div.t:#)+" in text and "seen by some" in text and ")?" in text
    assert html.region(wrapper) == "html/body/div.c" and html.region([]) is None
    rows = [(n, f"http://h.de/{n}", _anonymous(n), "x", "y") for n in range(6)] + [(6, "http://h.de/6", "<body><p>another form</p></body>", "x", "y"), (7, None, "<p>alone</p>", "x", "y"),
            (8, "http://h.de/8", None, "x", "y"), (0, "http://h.de/0", _anonymous(0), "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, region string")
    found = [(r["page_id"], r["text"], r["region"]) for r in html.extract_text(frame).collect()]
    expected = {n: "\n".join([f"Title {n}"] + [f"word{n} text {k} and more of the story number {n * 7 + k}" for k in range(2 + n % 3)]) for n in range(6)} | {6: "another form", 7: "alone", 8: ""}
    assert sorted(found) == sorted((i, expected[i], "y") for i, *_ in rows) and html.extract_text(frame.limit(0)).count() == 0
    # the plain rules alone would take the menus and notes too
    assert html.main_text(_anonymous(1)) != expected[1]


def test_html_wrappers_come_from_all_pages(spark):
    # few long stories among many short notes: eight pages of the host show none of them
    note = lambda n: f"<div class='n'>note {n}</div>"
    story = lambda n: f"<div class='m'>Our menu</div><div class='c'><div class='h'>Title {n}</div><div class='t'>{'long story ' * 200}{n}</div></div>"
    rows = [(n, f"http://h.de/{n}", f"<html><body>{story(n) if n % 40 == 0 else note(n)}</body></html>") for n in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    learned = html.learn_wrappers(frame)
    assert {r["path"]: (r["texts"], r["n"], r["total"]) for r in learned.collect()} == {
        "html/body/div.n": (390, 390, 400), "html/body/div.m": (1, 10, 400), "html/body/div.c/div.h": (10, 10, 400), "html/body/div.c/div.t": (10, 10, 400)}
    assert [tuple(r) for r in html.host_regions(learned).collect()] == [("h.de", "html/body/div.c")]
    found = {r["page_id"]: r["text"] for r in html.extract_text(frame).collect()}
    assert found[40] == f"Title 40\n{'long story ' * 200}40" and found[1] == "note 1" and len(found) == 400


def test_html_aligned_pages_in_spark_agree_with_those_at_hand(spark, monkeypatch):
    assert html.align("abcd", "bd") == {0: 1, 1: 3} and html.align("xhxp", "hxp") == {0: 1, 1: 2, 2: 3} and html.align("", "a") == {} == html.align("a", "")
    assert html.places("ad", "abbcd") == [(0, True, 0, 0), (1, False, 0, 0), (1, False, 1, 1), (1, False, 0, 2), (1, True, 0, 0)]
    draw = random.Random(5)
    for _ in range(300):
        x, y = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 12))) for _ in range(2)]
        pairs = sorted(html.align(x, y).items())
        assert all(y[k] == x[i] for k, i in pairs) and [i for _, i in pairs] == sorted({i for _, i in pairs})
    # one stray menu and one cut page do not make slots of what all other pages share, and copies count once
    pages = [_anonymous(n) for n in range(30)] + [_anonymous(3)] * 50
    pages += [pages[0].replace("Our site", "Our other site " * 20), "<html><body><div class='a'></div></body></html>", "", "<html><body><div class='b'>Our site</div></body></html>"]
    expected = html.infer_wrapper(pages)
    assert html.region(expected) == "html/body/div.c"
    rows = [(f"http://h.de/{n}", p) for n, p in enumerate(pages)] + [("http://two.de/", _anonymous(1)), ("http://two.de/", _anonymous(2)), ("http://two.de/", _anonymous(2)), (None, None)]
    fields = ("path", "texts", "chars", "frame", "many", "optional")
    for held, parts, size in ((1, 7, 0), (100_000, 2, 1 << 20)):
        monkeypatch.setattr(html, "HELD", held)
        monkeypatch.setattr(html, "BROADCAST_BYTES", size)
        learned = html.learn_wrappers(spark.createDataFrame(rows, "url string, html string").repartition(parts).withColumn("page_id", F.lit(1)))
        found = learned.orderBy("host", "at", "own", "gap", "path", "nth").withColumn("optional", F.col("n") < F.col("total")).collect()
        assert {r["host"] for r in found} == {"h.de"}
        assert [(r["path"], r["texts"] > 1, *[r[c] for c in fields[2:]]) for r in found] == [(t["path"], t["slot"], *[t[c] for c in fields[2:]]) for t in expected]
        assert [tuple(r) for r in html.host_regions(learned).collect()] == [("h.de", "html/body/div.c")]


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").union(spark.createDataFrame([(9999, None, None)], "page_id long, url string, html string"))
    rows = {r["page_id"]: r for r in html.extract_text(pages).collect()}
    assert rows[9999]["text"] == "" and len(rows) == pages.count()
    for page_id, r in rows.items():
        if page_id != 9999:
            article = re.search(r"(?s)<article>(.*?)</article>", r["html"]).group(1)
            plain = re.sub(r"\s+", "", re.sub(r"<[^>]*>", "", article))
            import html as entities

            assert re.sub(r"\s+", "", r["text"]) == re.sub(r"\s+", "", entities.unescape(plain))


def test_warc(spark):
    rows = [
        (1, "response", "http://a.de/x", 10, "d1", {"ETag": "e1", "Server": "s", "Date": "1"}),
        (2, "revisit", "https://www.A.de:443/x/#f", 7500, "d1", {"Date": "2", "Server": "t"}),
        (3, "revisit", "http://a.de/x", 5, "d1", {}), (4, "revisit", "http://a.de/x", 20, "d9", {"ETag": "e1"}),
        (5, "revisit", "http://a.de/x", 20, None, {"ETag": "e1"}), (6, "revisit", None, None, None, None), (7, "response", "http://a.de/x", 8000, "d2", None)]
    found = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(
        rows, "record_id long, type string, url string, time long, digest string, headers map<string,string>")).collect()}
    assert found[2]["resolved_id"] == 1 and found[2]["merged_headers"] == {"etag": "e1", "server": "s", "date": "2"}
    assert [found[i]["resolved_id"] for i in (3, 4, 5, 6, 7)] == [None, None, 1, None, None]


def test_warc_matches_sql(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").toPandas()
    expected = sorted(map(str, (tuple(None if pd.isna(v) else str(v) if isinstance(v, str) else int(v) for v in r)
                                for r in duckdb.sql(warc.OP3_SQL).df()[["record_id", "resolved_id", "etag"]].itertuples(index=False))))
    found = sorted(map(str, (tuple(r) for r in warc.op3_warc(spark, DIR).select("record_id", "resolved_id", "etag").collect())))
    assert len(pages) and found == expected


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.op10_toxicity(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    right = ((found["predicted"] == 1) & (found["toxic"] == 1)).sum()
    assert right / max(1, (found["predicted"] == 1).sum()) > 0.9 and right / (found["toxic"] == 1).sum() > 0.8


def test_deobfuscation(spark):
    rows = [(i, "the idiot and the moron are stupid people of the town", None) for i in range(300)]
    model = toxicity.character_model(spark.createDataFrame(rows, "doc_id long, text string, x int"))
    restorer = toxicity.Restorer(model)
    assert "idiot" in restorer.words("an 1d10t here") and "moron" in restorer.words("m.o.r.o.n")
    assert "stupid" in restorer.words("s t u p i d") and "idiot" in restorer.words("iiiidiooot")
    assert restorer.words(None) == [] == restorer.words("")


def test_deobfuscation_of_any_length(spark):
    rows = [(i, "you are an idiot and a moron and the people of the town are stupid", None) for i in range(300)]
    model = toxicity.character_model(spark.createDataFrame(rows, "doc_id long, text string, x int"))
    restorer = toxicity.Restorer(model)
    assert {"you", "idiot"} <= set(restorer.words("y o u i d i o t"))
    assert {"idiot", "moron", "stupid"} <= set(restorer.words(" ".join("youareanidiotandamoronandthepeoplearestupid")))
    assert {"idiot", "moron"} <= set(restorer.words(".".join("youareanidiotandamoronandthepeopleofthetown")))
    assert "idiot" in restorer.words("i" * 60 + "d" * 50 + "iot") and restorer.words("m o r o n   i d i o t")[-2:] == ["moron", "idiot"]
    folder = "/root/testdata/sf0.1"
    fitted = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    plain = "a report on the idiot and the moron with a stupid loser of the town and disgusting trash"
    disguised = [" ".join(plain.replace(" ", "")), ".".join(plain.replace(" ", "")), "y o u i d i o t , w o r t h l e s s m o r o n , p a t h e t i c t r a s h"]
    frame = spark.createDataFrame(list(enumerate(disguised)), "doc_id long, text string")
    assert toxicity.score_toxicity(frame, fitted).where("score >= 0.5").count() == 3


def test_viterbi_equals_exhaustive_search(spark):
    import itertools

    rows = [(i, "the idiot and the moron are stupid people of this town and shit happens to an asshole", None) for i in range(300)]
    model = toxicity.character_model(spark.createDataFrame(rows, "doc_id long, text string, x int"))

    def brute(token):
        options = []
        for at, char in enumerate(token):
            again = at > 0 and token[at - 1] == char
            arcs = [(char, 0.0)] if char in toxicity._CODES else []
            arcs += [(c, -0.5) for c in toxicity.LEET.get(char, "")]
            if char in "!|+(":
                arcs.append(("", toxicity.DROPPED if 0 < at < len(token) - 1 and not again else -0.5))
            elif char not in toxicity._CODES and char not in toxicity.LEET:
                arcs.append(("", -0.5))
            if again:
                arcs.append(("", toxicity.REPEAT if char in toxicity._CODES or char in "!|+(" else toxicity.DROPPED))
            options.append(arcs)
        best = {}
        for path in itertools.product(*options):
            word = "".join(c for c, _ in path)
            codes = [toxicity.BLANK, toxicity.BLANK, *(toxicity._CODES[c] for c in word)] + ([toxicity.BLANK] if word else [])
            score = sum(c for _, c in path) + sum(model[x, y, z] for x, y, z in zip(codes, codes[1:], codes[2:]))
            best[word] = max(score, best.get(word, -1e9))
        return max(best.values()), best

    for token in ("1d10t", "sh!t", "a55hole", "st|_|p1d", "mm00rr", "$h1t", "x", "!!", "t0wn!"):
        top, every = brute(token)
        assert every[toxicity.decode(token, model)] == pytest.approx(top), token
    assert toxicity.decode("sh!t", model) == "shit" and toxicity.decode("a55hole", model) == "asshole"
    restorer = toxicity.Restorer(model, {"the": -1.0}, {"stupid": 1.0})
    assert "stupid" in restorer.words("the st upid town") and "stupid" not in toxicity.Restorer(model, {"upid": -1.0}, {"stupid": 1.0}).words("st upid")


def test_decoding_restores_held_out_documents(spark):
    """Held-out toxic documents with their lexicon words disguised: scores with the decoder and without."""
    import random

    folder, draw = "/root/testdata/sf0.1", random.Random(4)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fitted = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where("toxic = 1 and crc32(cast(doc_id as string)) % 5 = 0 and length(text) < 4000").select("doc_id", "text").collect()
    lexicon = {w for w in fitted["weights"] if w.isalpha() and len(w) > 3}
    leet = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$"})

    def disguise(word):
        bare = word.strip(".,")
        if bare.lower() not in lexicon:
            return word
        return draw.choice([bare.translate(leet), " ".join(bare), ".".join(bare), bare[0] + bare[1] * 5 + bare[2:]])

    rows = [(r["doc_id"], " ".join(disguise(w) for w in r["text"].split(" "))) for r in held]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    caught = toxicity.score_toxicity(frame, fitted).where("score >= 0.5").count()
    weights, beta = fitted["weights"], fitted["beta"]
    plain = 0
    for _, text in rows:
        x = toxicity._evidence([w.strip(".,") for w in text.lower().split()], weights, {})
        plain += beta[0] + sum(b * v for b, v in zip(beta[1:], x)) >= 0
    print(len(rows), caught, plain)
    assert len(rows) >= 20 and caught >= 0.85 * len(rows) and plain <= 0.5 * len(rows)


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Words that five labelled documents of folds 1 to 3 have, the least for the vocabulary, among more than 20,000 labelled rows."""
    ids = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)][::200][:100]
    names = ["qu" + "abcdefghij"[n] * 2 + "ox" for n in range(10)]
    rare = {i: names[n // 5] for n, i in enumerate(ids[:50])}
    rows = [(i, f"plain words {rare.get(i, 'here')}" + (" grumblehead" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(40_000)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]))
    fitted = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert set(names) <= set(fitted["vocabulary"]) and "grumblehead" in fitted["weights"]
    scored = toxicity.score_toxicity(table.where("doc_id < 80"), fitted).withColumn("said", (F.col("score") >= 0.5).cast("int"))
    assert scored.where("said <> toxic").count() == 0


def test_toxicity_shuffles_texts_the_same_way_for_few_labels(spark, docs, monkeypatch):
    """A broadcast of few labels would be a shuffle of the texts for many, so that the disk used would grow faster than the input."""
    plans, real = [], toxicity.cut

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(toxicity, "cut", kept)
    toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert len(plans) == 2 and all(p.count("ShuffledHashJoin") == 1 and "Broadcast" not in p and "SortMergeJoin" not in p for p in plans)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert simhash.group_near_duplicates(none).count() == 0 and packing.pack(none).count() == 0
    assert pii.find_pii(none, pii.fit(none)).count() == 0 and licenses.scan_licenses(none).count() == 0
    fitted = toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score_toxicity(docs, fitted).where("score > 0.01").count() == 0


def _shortest(items) -> str:
    """The shortest text that a parsed regular expression of the license rules matches."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "BRANCH":
            out += min((_shortest(b) for b in arg[1]), key=len)
        elif op == "SUBPATTERN":
            out += _shortest(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += _shortest(arg[2]) * arg[0]
        elif op == "IN":
            kind, value = arg[0]
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else "a"
        elif op in ("NOT_LITERAL", "ANY"):
            out += "a"
        elif op not in ("AT", "ASSERT", "ASSERT_NOT"):
            raise ValueError(op)
    return out


def test_every_license_rule_fires_on_its_shortest_text(spark):
    made = [(label, _shortest(re._parser.parse(form))) for label, _, form, _, _ in licenses.rules()]
    df = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(made)], "doc_id int, wanted string, text string")
    found = licenses.scan_licenses(df).where("score = 0 or labels = ''").select("wanted", "text").collect()
    assert found == []
