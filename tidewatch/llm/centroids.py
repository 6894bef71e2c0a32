"""Centroid clustering over bit planes: integer k-means whose dot products are weighted popcounts.

A kept vector of 64 whole components is stored once as its bit planes, one 64-bit word each: word i holds bit i of all
components in two's complement, so that plane i weighs 2^i and the last one -2^i. The dot product of vector and centroid is
the sum over pairs of planes of weight times popcount(plane AND plane), and distances follow from it exactly.

The packed vectors are written to the shared folder and every round reads them: a task sums its vectors by cluster over its whole
partition, so that a round shuffles at most k rows a task and brings k rows of sums to the driver, whatever the size of a cluster.

Vectors of another length, null vectors and vectors with a null or non-finite component are left out. Repeated rows count as
often as they occur; a row without id is assigned too and can start a centroid only after all rows with one. Of equal hashes
the lesser planes come first. Fewer kept vectors than k make fewer centroids, none an empty result. Nearest ties go to the
smaller number. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table
from tidewatch.llm.vectors import LIMIT, binary, bit_planes, scaled_rows

DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64


def pack(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """The key and the planes (packed words, lowest first) of every kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = scaled_rows(batch.column(1), scale, DIMS)
            rows, keys = rows[ok], batch.column(0).filter(pa.array(ok))
            count = int(np.maximum(rows, ~rows).max(initial=0)).bit_length() + 1
            yield pa.RecordBatch.from_arrays([keys, binary(bit_planes(rows, count)[:, :, 0])], names=["key", "planes"])

    given = df.where(F.size(vector) == DIMS).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return given.mapInArrow(run, given.select("key", F.lit(b"").alias("planes")).schema)


def planes_of(values: pa.Array) -> np.ndarray:
    """Planes of a batch as (rows, planes); the sign plane of a row with fewer ones is repeated."""
    data = values.to_pylist()
    width = max(map(len, data), default=8)
    return np.frombuffer(b"".join(d + d[-8:] * ((width - len(d)) // 8) for d in data), dtype="<u8").reshape(len(data), width // 8)


def weights(count: int) -> np.ndarray:
    """Weights of planes: powers of two, the last negative."""
    out = np.left_shift(np.int64(1), np.arange(count, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def dot_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows of left with all rows of right, both planes."""
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for i, a in enumerate(weights(left.shape[1])):
        for j, b in enumerate(weights(right.shape[1])):
            total += a * b * np.bitwise_count(left[:, i, None] & right[None, :, j])
    return total


def square_norms(planes: np.ndarray) -> np.ndarray:
    w, total = weights(planes.shape[1]), np.zeros(len(planes), dtype=np.int64)
    for i in range(len(w)):
        for j in range(len(w)):
            total += w[i] * w[j] * np.bitwise_count(planes[:, i] & planes[:, j])
    return total


def components(planes: np.ndarray) -> np.ndarray:
    """Whole components of packed vectors, as (rows, 64)."""
    out = np.zeros((len(planes), DIMS), dtype=np.int64)
    for i, w in enumerate(weights(planes.shape[1])):
        out += w * np.unpackbits(np.ascontiguousarray(planes[:, i:i + 1]).view(np.uint8), axis=1, bitorder="little")
    return out


def _centroid_planes(centroids: list[list[int]]) -> np.ndarray:
    return bit_planes(np.array(centroids, dtype=np.int64).reshape(-1, DIMS), LIMIT.bit_length() + 1)[:, :, 0]


def nearest(planes: np.ndarray, centroids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance less the vector's own square, of each packed vector."""
    partial = sizes[None, :] - 2 * dot_products(planes, centroids)
    cluster = partial.argmin(axis=1)
    return cluster, partial[np.arange(len(planes)), cluster]


def _trimmed(planes: np.ndarray) -> np.ndarray:
    """Planes without repeated sign planes."""
    count = planes.shape[1]
    while count > 1 and np.array_equal(planes[:, count - 1], planes[:, count - 2]):
        count -= 1
    return planes[:, :count]


def first_centroids(packed: DataFrame, k: int = K) -> list[list[int]]:
    """The k packed vectors with the smallest sha256 of `1:` and their key, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    chosen = packed.orderBy(F.asc_nulls_last(order), "planes").limit(k).collect()
    return [components(planes_of(pa.array([bytes(r["planes"])])))[0].tolist() for r in chosen]


def next_centroids(packed: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    fixed = _trimmed(_centroid_planes(centroids))
    sizes = square_norms(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(fixed), DIMS), dtype=np.int64), np.zeros(len(fixed), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                planes = planes_of(batch.column(0))
                cluster, _ = nearest(planes, fixed, sizes)
                rows = components(planes)
                for c in np.unique(cluster):
                    sums[c] += rows[cluster == c].sum(axis=0)
                counts += np.bincount(cluster, minlength=len(fixed))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fixed))), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = packed.select("planes").mapInArrow(run, "cluster long, n long, sums array<long>").where("n > 0")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(DIMS)]).alias("sums"))
    out = [list(c) for c in centroids]
    for row in totals.collect():  # at most k rows
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def assign(packed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """key, cluster and squared distance of every packed vector."""
    fixed = _trimmed(_centroid_planes(centroids))
    sizes = square_norms(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                planes = planes_of(batch.column(1))
                cluster, partial = nearest(planes, fixed, sizes)
                arrays = [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(partial + square_norms(planes))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "cluster", "distance"])

    return packed.mapInArrow(run, packed.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema)


def cluster_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """The key, cluster and distance of every kept vector, and the final centroids."""
    packed = cut(pack(df, vector, key, scale))
    centroids = first_centroids(packed, k)
    for _ in range(rounds):
        centroids = next_centroids(packed, centroids)
    return assign(packed, centroids), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    named = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    totals = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select(  # k rows
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """The assignment to centroids n - 1 and, but for the last, centroids n."""
    near = f"""a{n} AS (SELECT k, vec_id, v, cluster, distance FROM (
        SELECT i.k, i.vec_id, i.v, c.cluster, list_inner_product(i.v, i.v) - 2 * list_inner_product(i.v, c.v) + list_inner_product(c.v, c.v) AS distance FROM ints i, c{n - 1} c)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, cluster) = 1)"""
    if n > ROUNDS:
        return near
    return near + f""", m{n} AS (SELECT cluster, list(x ORDER BY p) AS v FROM (
        SELECT cluster, p, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{n}) GROUP BY cluster, p) GROUP BY cluster),
    c{n} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n - 1} c LEFT JOIN m{n} m USING (cluster))"""


OP13_SQL = f"""WITH ints AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM ints ORDER BY cluster LIMIT {K}),
{", ".join(_round_sql(n) for n in range(1, ROUNDS + 2))},
shas AS (SELECT cluster, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS + 1} JOIN shas USING (cluster)"""
