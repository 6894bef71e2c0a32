"""Hard-negative mining by rotated one-bit codes with deterministic score intervals.

A vector o is rotated and coded by the signs of its components. With b the unit vector of the signs, the stored alignment
is o.b, and o = (o.b) b + r. The residual r gets a rotation, a code and an alignment of its own, STAGES times; the size of the
last residual is stored. For an anchor q, each q.b is read from popcounts of the code with the bit planes of the rotated and
quantized q, whose error is known. So q.o lies within

    sum over stages of (o.b)(q.b)  +-  ( sum over stages of |o.b| |e| + |q| |r| )

by Cauchy-Schwarz, e being the quantization error. Rows whose interval cannot reach the result are left out, all others are
scored by whole numbers, so that results are exact.

Rows are dealt by hash into groups of at most about GROUP_ROWS, every anchor goes to every group, and a task holds one group and
streams the anchors past it; a group returns at most a few rows for an anchor, of which the best are kept by a window per
anchor. Nothing is broadcast or collected. Work is anchors times rows, which the task asks for.

Rows with a null label, a null vector, or a null or non-finite component take no part. A shorter vector counts as if zeros
followed. Rows with a null key are no anchors and come last among equal scores. Repeated rows are merged with their number before
they are dealt and count as often as they occur, as anchors too. No rows or no anchors give an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table
from tidewatch.llm.vectors import binary, bit_planes, scaled_rows, unpacked

SCALE = 256
POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
STAGES, PLANES, SEED = 4, 6, 20
GROUP_ROWS = 65_536
#: Pairs of anchor and row that are estimated at once.
BLOCK_PAIRS = 1 << 20
#: How whole components are stored.
WHOLE = "<i4"
LAST_KEY = np.iinfo(np.int64).max
#: Relative slack of the intervals for the rounding of their own arithmetic.
SLACK = 1e-9


def rotations(dims: int) -> np.ndarray:
    """One random rotation per stage, the same at every call."""
    random = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(random.standard_normal((dims, dims)))[0] for _ in range(STAGES)])


def encode(rows: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, stages, words) and measures of whole vectors: an alignment per stage and the size of the last residual."""
    rest, dims = rows.astype(np.float64), rows.shape[1]
    codes, measures = np.empty((len(rows), len(turns), dims // 64), dtype=np.uint64), np.empty((len(rows), len(turns) + 1))
    for s, turn in enumerate(turns):
        signs = rest @ turn.T >= 0
        codes[:, s] = bit_planes(signs.astype(np.int64), 1)[:, 0]
        unit = np.where(signs, 1.0, -1.0) @ turn / np.sqrt(dims)
        measures[:, s] = (rest * unit).sum(axis=1)
        rest = rest - measures[:, s, None] * unit
    measures[:, -1] = np.linalg.norm(rest, axis=1)
    return codes, measures


class Anchors:
    """Whole vectors of anchors with the bit planes of their rotations."""

    def __init__(self, rows: np.ndarray, turns: np.ndarray):
        self.rows, dims = rows, rows.shape[1]
        turned = np.einsum("sij,aj->asi", turns, rows.astype(np.float64))
        self.low = turned.min(axis=2)
        self.step = (turned.max(axis=2) - self.low) / ((1 << PLANES) - 1)
        levels = np.rint((turned - self.low[..., None]) / np.where(self.step == 0, 1.0, self.step)[..., None]).astype(np.int64)
        seen = self.low[..., None] + self.step[..., None] * levels
        self.error = np.linalg.norm(turned - seen, axis=2)
        self.total, self.root = seen.sum(axis=2), np.sqrt(dims)
        self.planes = bit_planes(levels.reshape(-1, dims), PLANES).reshape(len(rows), len(turns), PLANES, dims // 64)
        self.norm = np.linalg.norm(rows.astype(np.float64), axis=1)

    def intervals(self, at: np.ndarray, codes: np.ndarray, measures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of some anchors with some rows."""
        n = len(self.rows[at])
        middle, width = np.zeros((n, len(codes))), self.norm[at, None] * measures[None, :, -1]
        size = self.norm[at, None] * np.abs(measures).sum(axis=1)[None, :]
        for s in range(codes.shape[1]):
            ones, weighted = np.zeros(len(codes)), np.zeros((n, len(codes)), dtype=np.int64)
            for w in range(codes.shape[2]):
                word = codes[:, s, w]
                ones += np.bitwise_count(word)
                for j in range(PLANES):
                    weighted += np.bitwise_count(self.planes[at, s, j, w, None] & word[None, :]).astype(np.int64) << j
            # signs are 2 c - 1 for code bits c, so that their product with the quantized anchor is
            product = 2 * (self.low[at, s, None] * ones[None, :] + self.step[at, s, None] * weighted) - self.total[at, s, None]
            middle += measures[None, :, s] * product / self.root
            width = width + np.abs(measures[None, :, s]) * self.error[at, s, None]
        width = width + SLACK * (size + 1)
        return middle - width, middle + width


class Rows:
    """A group of rows, sorted by label."""

    def __init__(self, batches: list[pa.RecordBatch]):
        all_rows = pa.Table.from_batches(batches).combine_chunks()
        label = all_rows.column("label").to_numpy()
        all_rows = all_rows.take(pa.array(np.argsort(label, kind="stable")))
        self.label = all_rows.column("label").to_numpy()
        key = all_rows.column("key")
        self.key, self.no_key = key.fill_null(LAST_KEY).to_numpy(), np.asarray(key.is_null().to_numpy(), dtype=bool)
        self.hash, self.copies = all_rows.column("hash").to_numpy(), all_rows.column("copies").to_numpy()
        self.rows = unpacked(all_rows.column("vector"), WHOLE).astype(np.int64)
        self.codes = unpacked(all_rows.column("code"), "<u8").reshape(len(self.rows), STAGES, -1)
        self.measures = unpacked(all_rows.column("measures"), "<f8")

    def ranges(self, label: int, same: bool) -> list[tuple[int, int]]:
        """Where rows of the label, or of all others, lie."""
        a, b = np.searchsorted(self.label, [label, label + 1])
        return [(a, b)] if same else [(0, a), (b, len(self.label))]

    def best(self, found: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Positions within found of the n highest scores, ties by key, then vector."""
        if len(found) > 4 * n:  # only what reaches the n-th score need be sorted
            keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        else:
            keep = np.arange(len(found))
        rows = found[keep]
        order = np.lexsort((self.hash[rows], self.key[rows], self.no_key[rows], -scores[keep]))
        return keep[order[:n]]


def _nth_greatest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest value of each row, or least infinity where there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]


def _blocks(rows: Rows, anchors: Anchors, members: np.ndarray, label: int, same: bool):
    """Anchors of one label against the rows of that label, or of all others: (anchor, rows of the range, least, greatest score)."""
    for a, b in rows.ranges(label, same):
        if a == b:
            continue
        step = max(1, BLOCK_PAIRS // (b - a))
        for i in range(0, len(members), step):
            at = members[i:i + step]
            low, high = anchors.intervals(at, rows.codes[a:b], rows.measures[a:b])
            yield at, a, low, high


def _positives(rows: Rows, anchors: Anchors, label: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor the n best rows of its label in the group, itself included."""
    for kind in np.unique(label):
        for at, start, low, high in _blocks(rows, anchors, np.flatnonzero(label == kind), kind, True):
            reach = high >= _nth_greatest(low, n)[:, None]
            for k, anchor in enumerate(at):
                found = start + np.flatnonzero(reach[k])
                scores = rows.rows[found] @ anchors.rows[anchor]
                chosen = rows.best(found, scores, n)
                yield anchor, found[chosen], scores[chosen]


def _negatives(rows: Rows, anchors: Anchors, label: np.ndarray, wanted: list[list[int]], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each anchor and each of its positives' scores the n best rows of other labels in the band below that score."""
    for kind in np.unique(label):
        for at, start, low, high in _blocks(rows, anchors, np.flatnonzero(label == kind), kind, False):
            for k, anchor in enumerate(at):
                bands = [(-(-LEAST_PERCENT * p // 100), p) for p in wanted[anchor]]  # least whole score that is enough
                open_rows = np.zeros(len(low[k]), dtype=bool)
                for least, most in bands:
                    can = (high[k] >= least) & (low[k] <= most)
                    sure = low[k][(low[k] >= least) & (high[k] <= most)]
                    if len(sure) >= n:
                        can &= high[k] >= np.partition(sure, len(sure) - n)[len(sure) - n]
                    open_rows |= can
                found = start + np.flatnonzero(open_rows)
                scores = rows.rows[found] @ anchors.rows[anchor]
                for place, (least, most) in enumerate(bands):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    chosen = inside[rows.best(found[inside], scores[inside], n)]
                    yield anchor, place, found[chosen], scores[chosen]


def prepare(df: DataFrame, dims: int, vector: str, key: str, label: str, scale: int) -> DataFrame:
    """Rows that take part, merged: key, label, whole vector, its hash, number of copies, codes and measures."""
    width, turns = max(64, -(-dims // 64) * 64), None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = scaled_rows(batch.column(2), scale, width)
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), binary(rows[ok].astype(WHOLE))], names=["key", "label", "vector"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal turns
        turns = rotations(width) if turns is None else turns
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unpacked(batch.column("vector"), WHOLE)
            codes, measures = encode(rows, turns)
            arrays = [*batch.columns, binary(codes.reshape(len(rows), -1)), binary(measures)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "code", "measures"])

    given = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    given = given.where("label is not null and vector is not null").mapInArrow(whole, "key long, label long, vector binary")
    merged = given.groupBy("key", "label", "vector").agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64("vector"))
    return merged.mapInArrow(coded, merged.selectExpr("*", "vector as code", "vector as measures").schema)


_OWNER = ("anchor_key", "anchor_hash", "anchor_label")
_FOUND = "anchor_key long, anchor_hash long, anchor_label long, place int, key long, hash long, copies long, score long"


def _search(rows: DataFrame, anchors: DataFrame, groups: int, n: int, negatives: bool) -> DataFrame:
    """The best rows of each group for every anchor; of the anchors' own label, or of others in the bands of `wanted`.

    Within a partition a group's rows come before the anchors, which stream past it.
    """
    columns = ("key", "label", "hash", "copies", "vector", "code", "measures")
    dealt = rows.select(F.pmod(F.xxhash64("key", "hash"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), *columns, F.lit(None).cast("array<long>").alias("wanted"))
    wanted = F.col("wanted") if negatives else F.lit(None).cast("array<long>")
    copied = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "key", "label", "hash", "copies", "vector",
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("measures"), wanted.alias("wanted"))
    both = dealt.unionByName(copied).repartition("g").sortWithinPartitions("g", "kind")

    def results(batch: pa.RecordBatch, held: Rows) -> Iterator[pa.RecordBatch]:
        vectors = unpacked(batch.column("vector"), WHOLE).astype(np.int64)
        label, keys, hashes = (batch.column(c).to_numpy() for c in ("label", "key", "hash"))
        ready, out = Anchors(vectors, rotations(vectors.shape[1])), []
        if negatives:
            asked = batch.column("wanted").to_pylist()
            out = [(a, np.full(len(f), p), f, s) for a, p, f, s in _negatives(held, ready, label, asked, n) if len(f)]
        else:
            out = [(a, np.zeros(len(f), dtype=np.int64), f, s) for a, f, s in _positives(held, ready, label, n)]
        if out:
            owner = np.repeat([a for a, *_ in out], [len(f) for *_, f, _ in out])
            found = np.concatenate([f for *_, f, _ in out])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[owner]), pa.array(hashes[owner]), pa.array(label[owner]), pa.array(np.concatenate([p for _, p, *_ in out]).astype(np.int32)),
                pa.array(held.key[found], mask=held.no_key[found]), pa.array(held.hash[found]), pa.array(held.copies[found]), pa.array(np.concatenate([s for *_, s in out]))],
                names=[*_OWNER, "place", "key", "hash", "copies", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, held = None, [], None
        for batch in batches:
            marks = batch.column("g").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), marks[a] // 2
                if now != group:
                    group, waiting, held = now, [], None
                if marks[a] % 2 == 0:
                    waiting.append(part)
                elif waiting or held:
                    if held is None:
                        held, waiting = Rows(waiting), []
                    yield from results(part, held)

    return both.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of each owner by score, key and vector, copies counted one by one; rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"), "hash")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = found.withColumn("before", before).where(F.col("before") < n)
    return rows.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(n))))).drop("before")


def mine_negatives(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", anchor: str = "key % 100 = 0",
    positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id and both scores.

    anchor is a condition on the columns key and label of the rows that take part.
    """
    known = df.agg(F.max(F.size(vector)).alias("dims"), F.count("*").alias("n")).first()
    rows = cut(prepare(df, max(known["dims"] or 0, 1), vector, key, label, scale))
    session = df.sparkSession
    groups = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-known["n"] // GROUP_ROWS))
    anchors = rows.where(F.expr(anchor) & F.col("key").isNotNull())
    owner = F.struct(*[F.col(c) for c in _OWNER])
    near = _search(rows, anchors, groups, positives + 1, False)
    itself = (F.col("key") == F.col("anchor_key")) & (F.col("hash") == F.col("anchor_hash"))
    near = near.withColumn("copies", F.when(itself, F.col("copies") - 1).otherwise(F.col("copies"))).where("copies > 0")
    chosen = _ranked(near, list(_OWNER), positives)
    lists = chosen.groupBy(owner.alias("owner")).agg(F.array_sort(F.collect_list(F.struct("rank", "key", "score"))).alias("positives"))  # few
    lists = lists.select("owner.*", "positives")
    named = [F.col("key") == F.col("anchor_key"), F.col("hash") == F.col("anchor_hash"), F.col("label") == F.col("anchor_label")]
    ready = cut(anchors.join(lists, named).withColumn("wanted", F.array_distinct("positives.score")))
    found = _search(rows, ready, groups, negatives, True)
    best = _ranked(found, [*_OWNER, "place"], negatives)
    pairs = ready.select(*_OWNER, F.col("copies").alias("anchors"), "wanted", F.inline("positives")).select(
        *_OWNER, "anchors", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"), F.expr("cast(array_position(wanted, score) - 1 as int)").alias("place"))
    result = pairs.join(best, [*_OWNER, "place"])
    return result.select(
        F.col("anchor_key").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), F.explode(F.sequence(F.lit(1).cast("long"), "anchors")).alias("copy")).drop("copy")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


OP12_SQL = f"""WITH kept AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.k, a.vec_id AS anchor_id, b.k AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM kept a JOIN kept b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.k, p.other ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id,
    p.score AS positive_score, n.score AS negative_score FROM positives p JOIN scores n ON p.k = n.k AND NOT n.same
    AND {LEAST_PERCENT} * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= {NEGATIVES}"""
