"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of 13 words (a shorter item is one window). Words are ordered by rarity in
the corpus; since a window must be contained whole, its prefix is its single rarest word. A document
position joins where its word is some window's prefix and the window, laid so that the words meet, lies
inside the document (positional and length bounds); equality of all its words is then verified.

Items go to the tasks in blocks of at most BLOCK_WORDS words (one longer item is a block of its own), one block a stage:
a block of that size is an index of about 100 MB, and neither the driver nor a task holds two. Hits of several blocks are
merged per document.

Null or empty text has no words and is clean; texts of any length are read whole. Items without words never match.
Repeated rows give repeated results; repeated items count once per item_id. Items with a null item_id count for the
words hit, not for the items. Of words equally rare in a window the smallest is its prefix. An empty table gives an
empty result. Further columns are kept, but for those named like the results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import alnum_words, cut, sha, table

WINDOW = 13
BLOCK_WORDS = 250_000


def _blocks(items: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, words = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        found = alnum_words(row["text"])
        if block and words + len(found) > BLOCK_WORDS:
            yield block
            block, words = [], 0
        if found:
            block.append((row["i"], found))
            words += len(found)
    if block:
        yield block


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences in all documents of the words of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, total = shared.value, Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(w for w in alnum_words(text) if w in wanted)
        yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})

    rows = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def _index(block: list[tuple[str | None, list[bytes]]], counts: dict[bytes, int]) -> tuple[dict, dict]:
    """prefix word -> places (offset, length) to lay a window; window -> its items."""
    prefixes: dict[bytes, set[tuple[int, int]]] = {}
    windows: dict[bytes, set[str]] = {}
    for item, words in block:
        length = min(WINDOW, len(words))
        for at in range(len(words) - length + 1):
            window = words[at:at + length]
            rarest = min(range(length), key=lambda k: (counts.get(window[k], 0), window[k], k))
            prefixes.setdefault(window[rarest], set()).add((rarest, length))
            windows.setdefault(b" ".join(window), set()).update([] if item is None else [item])
    return {w: sorted(p) for w, p in prefixes.items()}, windows


def _match(words: list[bytes], prefixes: dict, windows: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit intervals [start, end) and the items found."""
    spans, items = [], set()
    for at, word in enumerate(words):
        for offset, length in prefixes.get(word, ()):
            start = at - offset
            if start >= 0 and start + length <= len(words):
                found = windows.get(b" ".join(words[start:start + length]))
                if found is not None:
                    items |= found
                    spans.append((start, start + length))
    return _merge(spans), items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


_SPANS = "array<struct<a:long,b:long>>"
_HITS = f"struct<n_words:long,spans:{_SPANS},items:array<string>>"
_FOUND = "struct<n_hit:long,n_items:long,items_sha256:string>"


def _apply(docs: DataFrame, prefixes: dict, windows: dict, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((prefixes, windows))

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        prefixes, windows = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                words = alnum_words(text)
                spans, items = _match(words, prefixes, windows)
                rows.append((len(words), [{"a": a, "b": b} for a, b in spans], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return docs.withColumn(name, F.pandas_udf(find, _HITS)(F.col("text")))


def _summary(spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows = []
    for found, names in zip(spans, items):
        hit = _merge([(s["a"], s["b"]) for s in found])
        rows.append((sum(b - a for a, b in hit), len(names), sha(",".join(sorted(names)))))
    return pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256"])


def mark_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All columns of docs, n_words, n_hit, n_items, items_sha256 and contaminated."""
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    marked, spans, items_found, done = docs, F.array().cast(_SPANS), F.array().cast("array<string>"), 0
    for block in _blocks(items):
        if done:
            marked = cut(marked)  # so that no task holds two blocks
        counts = word_counts(docs, {w for _, words in block for w in words})
        marked = _apply(marked, *_index(block, counts), "__now")
        before = (F.col("__spans"), F.col("__items")) if done else (spans, items_found)
        marked = marked.select(*docs.columns, F.col("__now.n_words").alias("__n"), F.concat(before[0], F.col("__now.spans")).alias("__spans"),
                               F.array_union(before[1], F.col("__now.items")).alias("__items"))
        done += 1
    if not done:
        marked = _apply(marked, {}, {}, "__now").select(*docs.columns, F.col("__now.n_words").alias("__n"), spans.alias("__spans"), items_found.alias("__items"))
    marked = marked.withColumn("__found", F.pandas_udf(_summary, _FOUND)(F.col("__spans"), F.col("__items")))
    hit, words = F.col("__found.n_hit"), F.col("__n")
    return marked.select(
        *docs.columns, words.alias("n_words"), hit.alias("n_hit"), F.col("__found.n_items").alias("n_items"),
        F.col("__found.items_sha256").alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= words)).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
