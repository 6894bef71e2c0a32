"""SimHash near-duplicates found with BK-trees over shards.

Distinct fingerprints are dealt to shards by every pair out of six bit blocks: two fingerprints that
differ in at most four bits agree on at least two blocks, so each link lies in some shard. Every shard
is searched with a BK-tree (children keyed by their distance to the parent); it emits only links that
join two of its components, so a group of n copies gives at most n - 1 of them. Shards above
SHARD_ROWS are split by salt and searched part against part, which loses no link.

Null or empty text has fingerprint zero and links like any other. Equal texts share a fingerprint; texts of any length
are read whole. Repeated rows stay, a null doc_id is in its component but never names it (a component of null ids alone has
a null name), and of tied ids the smallest names it. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import blank_words, cut, table

RADIUS = 4
SHINGLE_WORDS = 4
#: Fingerprints of one search; larger shards are split into salted parts.
SHARD_ROWS = 20_000
#: Keys with more than this part of all rows (links counted from both ends) are joined by broadcast: fewer than its inverse.
HOT_PART = 0.001
#: Widths of the six bit blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Bitwise majority of the XXH64 (seed 42) of the word shingles, as an unsigned integer."""
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    last = max(1, len(words) - width + 1)
    stops = ends[width - 1:] - 1 if len(words) >= width else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), stops.tolist())), np.uint64, last)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, last, 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def _links(left: list[tuple[int, int]], both: bool) -> Iterator[tuple[int, int]]:
    """Links of one shard that join its components; (value, part) rows, only across parts unless both."""
    values = [v & 0xFFFFFFFFFFFFFFFF for v, _ in left]
    parts = [p for _, p in left]
    parent = list(range(len(values)))
    children: list[dict[int, int]] = [{} for _ in values]
    groups = 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        groups += 1
        stack = [0] if i else []
        while stack and (groups > 1):
            at = stack.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= RADIUS and (both or parts[at] != parts[i]):
                a, b = root(at), root(i)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    groups -= 1
                    yield left[i][0], left[at][0]
            stack += [c for d, c in children[at].items() if abs(d - distance) <= RADIUS]
        if i:
            at = 0
            while True:
                distance = (values[at] ^ value).bit_count()
                if distance not in children[at]:
                    children[at][distance] = i
                    break
                at = children[at][distance]


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard; a shard can go on over several batches and has a bounded size."""
    held, key = [], None

    def flush() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        return list(_links(held, key[1] == key[2]))

    for batch in batches:
        out = []
        rows = zip(batch["shard"], batch["low"], batch["high"], batch["fp"], batch["part"])
        for shard, low, high, fp, part in rows:
            if (shard, low, high) != key:
                out += flush()
                held, key = [], (shard, low, high)
            held.append((fp, part))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    yield pd.DataFrame(flush(), columns=["a", "b"], dtype="int64")


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long) that span the same components as all links."""
    starts = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
    keys = []
    for n, (x, y) in enumerate(combinations(range(len(BLOCKS)), 2)):
        block = [F.shiftrightunsigned("fp", starts[k]).bitwiseAND((1 << BLOCKS[k]) - 1) for k in (x, y)]
        keys.append(F.lit(n << 22) + block[0] * (1 << BLOCKS[y]) + block[1])
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, "shard")
    pieces = F.ceil(F.col("n") / SHARD_ROWS).cast("int")
    dealt = dealt.withColumn("pieces", pieces).withColumn(
        "part", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("fp"), F.col("pieces"))).otherwise(0).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    dealt = dealt.select(
        "shard", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "part")
    return (
        dealt.repartition("shard", "low", "high")
        .sortWithinPartitions("shard", "low", "high", "fp")
        .mapInPandas(_search, "a long, b long")
    )


def _with_least(edges: DataFrame, limit: float) -> DataFrame:
    """edges (u, v) and m, the least of u and all its v; nodes of more than limit edges, of which there are few, meet theirs by broadcast."""
    low = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    hubs = F.broadcast(low.where(F.col("n") > limit).select("u", "m"))
    others = low.where(F.col("n") <= limit).select("u", "m")
    return edges.join(hubs, "u").union(edges.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes: rounds of large and small stars until the forest is flat."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    previous, n_edges = None, edges.count()
    while True:
        limit = 2 * n_edges * HOT_PART
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())  # else the plan of a round repeats that of its first half
        small = _with_least(large, limit).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = cut(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if tuple(state) == previous:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        previous, n_edges = tuple(state), state["n"]


def group_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id reachable) of every row."""
    marked = cut(docs.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(near_links(distinct.select("fp")))
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    linked = cut(linked)
    least = cut(linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")).where("members > 1"))
    limit = marked.count() * HOT_PART
    # large components, of which there are few, by broadcast; a fingerprint alone in its component needs no join
    large = F.broadcast(least.where(F.col("members") > limit).select("root", F.col("component_id").alias("large_id")))
    rest = linked.join(large, "root", "left")
    small = least.where(F.col("members") <= limit).select("root", "component_id")
    joined = rest.where("large_id is null").join(small, "root", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id"))
    named = cut(rest.where("large_id is not null").select("fp", "n", F.col("large_id").alias("component_id")).unionByName(joined))
    hot = F.broadcast(named.where(F.col("n") > limit).select("fp", "component_id"))
    rest = marked.join(hot.select("fp"), "fp", "left_anti").join(named.select("fp", "component_id"), "fp")
    return marked.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
