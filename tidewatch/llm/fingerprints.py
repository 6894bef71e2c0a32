"""One-permutation MinHash fingerprints with DataFrame functions only.

The five-word shingles of a text are hashed once; the low seven bits of a hash choose one of 128 bins and
the rest is its value. Every bin keeps its least value. An empty bin i borrows from the full bin j with
the least hash of (i, j): a random probing order per bin (optimal densification) that is the same for all
texts. The low eight bits of every bin are packed as hex. The share of equal bins, less the 1/256 that
agree by chance, estimates the Jaccard similarity.

Null or empty text is one empty shingle; a text of fewer than five words is one shingle; texts of any length are
read whole. Repeated rows stay; a repeated doc_id is one place in the order of documents, represented by its least
text (so ties are settled). A null doc_id has no next document: the edited text then keeps the first half alone
and near_next is null. A single document is its own next one. An empty table gives an empty result. Ids are
integers. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import table

BINS = 128
WORDS = 5
KEPT_BITS = 8
#: Ranges of doc_id for each shuffle partition: several, so that partitions come out even.
PARTS = 4


def _let(value: Column, body) -> Column:
    """Binds an expression to a lambda variable, so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _bins(words: Column) -> Column:
    """The words' bins, densified, each (bin << 56 | value), in order."""

    def shingles(w: Column) -> Column:
        return F.when(
            F.size(w) >= WORDS,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))),
                        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])),
        ).otherwise(F.array(F.xxhash64(F.array_join(w.cast("array<string>"), " "))))

    def placed(h: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    def dense(full: Column) -> Column:
        every = F.array(*[F.lit(n).cast("long") for n in range(BINS)])
        empty = F.array_except(every, F.transform(full, lambda x: F.shiftright(x, 56)))
        lent = F.transform(empty, lambda i: F.shiftleft(i, 56).bitwiseOR(
            F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(i, F.shiftright(x, 56)).alias("o"), x.alias("x"))))["x"]
            .bitwiseAND(F.lit((1 << 56) - 1))))
        return F.when(F.size(full) == BINS, full).otherwise(F.sort_array(F.concat(full, lent)))

    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.transform(shingles(w), placed))
    return _let(_let(F.sort_array(hashed), least), dense)


def minhash(text: Column) -> Column:
    """Packed fingerprint of a text: two hex digits for each of 128 bins."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    low = F.lit((1 << KEPT_BITS) - 1).cast("long")
    return F.lower(F.array_join(F.transform(_bins(words), lambda x: F.lpad(F.hex(x.bitwiseAND(low)), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for agreement by chance."""
    at = F.array(*[F.lit(1 + 2 * n) for n in range(BINS)])
    same = F.size(F.filter(at, lambda p: F.substring(a, p, F.lit(2)) == F.substring(b, p, F.lit(2))))
    chance = 1.0 / (1 << KEPT_BITS)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))))


def _tops(docs: DataFrame) -> list[int]:
    """Greatest doc_id of each of PARTS x spark.sql.shuffle.partitions ranges of about equal rows; ids alone are shuffled."""
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id").repartitionByRange(parts, "doc_id")
    rows = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("top")).collect()  # one row a range
    return sorted(r["top"] for r in rows)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with part, its range of ids, and extra: the top document of each range comes also to the range above, that
    of the last one to the first."""
    tops = _tops(docs)
    width = max(1, math.isqrt(len(tops)))
    groups = [tops[at:at + width] for at in range(0, len(tops), width)]
    outer = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    group = F.size(F.filter(outer, lambda t: t < F.col("doc_id")))
    beneath = F.size(F.filter(F.get(inner, F.col("group")), lambda t: t < F.col("doc_id")))
    placed = docs.withColumn("group", group).withColumn("part", F.col("group") * width + beneath)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    above = F.struct(((F.col("part") + 1) % max(1, len(tops))).alias("part"), F.lit(True).alias("extra"))
    is_top = F.get(F.get(inner, F.col("group")), F.col("part") % width) == F.col("doc_id")
    return placed.select("doc_id", "text", F.inline(F.when(is_top, F.array(own, above)).otherwise(F.array(own))))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of their edited forms, see the query's contract.

    Texts are shuffled once, by range of doc_id; inside a range a running window hands each row the least text
    of the next smaller id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = _placed(docs.where("doc_id is not null")).repartition("part")
    order = Window.partitionBy("part").orderBy(F.desc("extra"), F.asc("doc_id"), F.desc("text"))
    after = F.struct(F.lead("doc_id").over(order).alias("id"), F.lead("extra").over(order).alias("extra"))
    least = F.when((after["id"] != F.col("doc_id")) | (after["extra"] != F.col("extra")) | after["id"].isNull(), F.struct("text", "fp"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = placed.withColumn("fp", minhash(F.col("text"))).withColumn("least", least)
    linked = marked.withColumn("next", F.last("least", ignorenulls=True).over(before)).where("not extra").select(
        "doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))
    none = F.lit(None).cast("string")
    linked = linked.unionByName(docs.where("doc_id is null").select("doc_id", "text", minhash(F.col("text")).alias("fp"), none.alias("next_text"), none.alias("next_fp")))
    half = "cast(floor(n_chars / 2) as int)"
    edited = linked.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr(
        f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(coalesce(next_text, ''), 1, {half}))"))
    marked = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        minhash(F.col("edited")).alias("edited_fingerprint"), "next_fp")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
