"""URL filter by a sort-merge range join of reversed-host keys.

A host with its labels reversed and a blank after each sorts directly after every domain it belongs to, so
a rule's host is an interval of keys. Each batch of URLs is sorted and swept once against the sorted rules, leaping over
rules between two keys; a stack holds the rules whose intervals contain the current key, nested from the widest to the
narrowest. Of those whose path is a prefix of the URL's, the longest (host and path) wins; of equally long ones that of
the longer host; of one rule listed with both verdicts, block. Rules go to the tasks in blocks of at most BLOCK_RULES,
one block a stage, so no broadcast grows with their number; the result does not depend on the blocks.

A null URL or one without ``://`` has empty host and path and meets no rule; texts of any length are read whole. Without
a rule, hosts with a label part among BLOCKED_WORDS are blocked and all others allowed. Repeated rows stay; an empty
table gives an empty result; further columns are kept as they are, but for those named like the results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table

BLOCK_RULES = 500_000
#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BLOCKED_WORDS = (
    "adult", "bet", "betting", "bingo", "casino", "cialis", "crack", "escort", "gambling", "jackpot", "keygen", "loan", "lottery", "malware", "payday", "phish",
    "phishing", "pills", "poker", "porn", "replica", "roulette", "scam", "sex", "slots", "spam", "viagra", "warez", "xxx")
SPAM = rf"(^|[.-])({'|'.join(BLOCKED_WORDS)})([.-]|$)"
_BEST = "struct<rule:string,verdict:string,size:int,host_size:int>"


_RANKED = "struct<size:int,host_size:int,rule:string,verdict:string>"


def reversed_key(host: str) -> str:
    return " ".join(reversed(host.split("."))) + " "


def _sorted_rules(rules: list[tuple[str, str, str]]) -> list[tuple[str, dict, list[int]]]:
    """(key, verdict by path, lengths of paths from the longest) of each host, by key."""
    grouped: dict[str, dict[str, tuple[str, str]]] = {}
    for verdict, host, path in rules:
        paths = grouped.setdefault(reversed_key(host), {})
        paths[path] = (host + path, "block" if "block" in (verdict, paths.get(path, (None, verdict))[1]) else verdict)
    return [(key, paths, sorted({len(p) for p in paths}, reverse=True)) for key, paths in sorted(grouped.items())]


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, dict, list[int]]]) -> list[tuple | None]:
    """For every key, swept in sorted order, (rule, verdict, length, length of its host) of the longest rule fitting its path."""
    best: list[tuple | None] = [None] * len(keys)
    names = [r[0] for r in rules]
    stack: list[tuple] = []
    at = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        end = bisect_right(names, key, at)
        step = key.find(" ", len(stack[-1][0]) if stack else 0) + 1
        while step and at < end:  # the labels below the top of the stack, each an interval that may begin here
            place = bisect_left(names, key[:step], at, end)
            if place < end and names[place] == key[:step]:
                stack.append(rules[place])
                at = place + 1
            step = key.find(" ", step) + 1
        at = end
        path = paths[i]
        for name, by_path, lengths in stack:
            for n in lengths:
                if path[:n] in by_path and len(path) >= n:
                    rule, verdict = by_path[path[:n]]
                    found = (len(rule), len(rule) - n, rule, verdict)
                    best[i] = max(best[i] or found, found)
                    break
    return [b and (b[2], b[3], b[0], b[1]) for b in best]


def _matcher(shared):
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = sweep([reversed_key(h) for h in hosts], paths.tolist(), shared.value)
            yield pd.DataFrame([f or (None, None, None, None) for f in found], columns=["rule", "verdict", "size", "host_size"]).astype({"size": "Int32", "host_size": "Int32"})

    return match


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """All columns of pages, host, path, rule and verdict; rules are (verdict, host, path)."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    judged = pages.select("*", host.alias("__host"), path.alias("__path"), F.lit(None).cast(_RANKED).alias("__best"))
    for start in range(0, len(rules), BLOCK_RULES):
        if start:
            judged = cut(judged)  # so that no task holds two blocks
        shared = pages.sparkSession.sparkContext.broadcast(_sorted_rules(rules[start:start + BLOCK_RULES]))
        found = F.pandas_udf(_matcher(shared), _BEST)(F.col("__host"), F.col("__path"))
        judged = judged.withColumn("__found", found)
        # of one rule in two blocks, block comes after allow and so is the greater
        ranked = F.when(F.col("__found.rule").isNotNull(), F.struct(*[F.col(f"__found.{c}").alias(c) for c in ("size", "host_size", "rule", "verdict")]))
        judged = judged.withColumn("__best", F.greatest(F.col("__best"), ranked)).drop("__found")
    verdict = F.coalesce(F.col("__best.verdict"), F.when(F.col("__host").rlike(SPAM), "block").otherwise("allow"))
    made = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.rule"), "verdict": verdict}
    return judged.select(*[c for c in pages.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP9_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '{SPAM}') THEN 'block' ELSE 'allow' END AS verdict FROM v
"""
