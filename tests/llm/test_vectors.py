"""Centroid clustering and hard-negative mining against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import centroids, negatives, vectors

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, score long, hash string"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "h") for i, v, label in rows], SCHEMA).repartition(3)


def random_rows(n, dims=64, size=0.4, seed=3, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-size, size) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def odd_rows():
    rows = random_rows(220)
    rows += [rows[100], rows[100], rows[5], rows[7], rows[7]]  # repeated rows, of an anchor too
    rows += [(900, rows[3][1], rows[3][2]), (2000, [0.0] * 64, 1), (2001, [1.0] * 64, 1), (2002, [-1.0] * 64, None), (None, rows[9][1], 2)]
    rows += [(3000, None, 1), (3001, [0.1] * 63 + [None], 1), (3002, [0.1] * 63 + [NAN], 2), (3003, [INF] * 64, 0), (3004, [], 0), (3005, [0.5] * 20, 1)]
    return rows


def floats(rows):
    """The rows as the float column stores them."""
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_bit_planes_give_exact_dot_products():
    rng = np.random.default_rng(1)
    for top in (1, 7, 300, vectors.LIMIT - 1):
        a, b = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (9, 64))
        pa_, pb = (vectors.bit_planes(x, int(top).bit_length() + 1)[:, :, 0] for x in (a, b))
        assert np.array_equal(centroids.dot_products(pa_, pb), a @ b.T)
        assert np.array_equal(centroids.square_norms(pa_), (a * a).sum(axis=1))
        assert np.array_equal(centroids.components(pa_), a)
        assert np.array_equal(centroids.dot_products(centroids._trimmed(pb), centroids._trimmed(pb)), b @ b.T)


def test_planes_of_batches_with_different_counts_agree():
    small, large = np.full((1, 64), -1), np.full((1, 64), 900)
    packed = [vectors.bit_planes(small, 1)[:, :, 0].tobytes(), vectors.bit_planes(large, 11)[:, :, 0].tobytes()]
    assert centroids.components(centroids.planes_of(pa.array(packed))).tolist() == [[-1] * 64, [900] * 64]


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in floats(rows) if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middles = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for c, members in groups.items():
            middles[c] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((i, *place(v)[::-1]) for i, v in kept), key=str), middles


@pytest.mark.parametrize("rows", [odd_rows(), random_rows(5), [(i, [0.25] * 64, 0) for i in range(20)]], ids=["odd", "few", "equal"])
def test_clusters_against_brute_force(spark, rows):
    found, middles = centroids.cluster_vectors(frame(spark, rows))
    expected, wanted = brute_clusters(rows, 16, 3)
    assert sorted(((r["key"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == expected
    assert middles == wanted


def test_clusters_of_nothing(spark):
    found, middles = centroids.cluster_vectors(frame(spark, [(1, None, 0)]))
    assert found.count() == 0 and middles == []


def test_components_that_do_not_fit_fail(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(frame(spark, [(1, [1e30] * 64, 0)]))[0].count()


def brute_negatives(rows):
    kept = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(floats(rows))
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, v in kept:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, other) for m, j, other, w in kept if m != n]
        for minus, none, j, _, _ in sorted(s for s in scored if s[4] == label)[:5]:
            band = sorted(s for s in scored if s[4] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus)[:5]
            out += [(i, None if none else j, rank, None if b[1] else b[2], -minus, -b[0]) for rank, b in enumerate(band, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [odd_rows(), random_rows(300, dims=100, labels=2), random_rows(120, dims=3, size=1.0), [(100 * i, [0.5, 0.25], i % 2) for i in range(30)],
                                  random_rows(240, labels=1)], ids=["odd", "wide", "narrow", "tied", "one_label"])
def test_negatives_against_brute_force(spark, rows):
    found = negatives.mine_negatives(frame(spark, rows))
    got = sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect()), key=str)
    assert got == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert negatives.mine_negatives(frame(spark, [(100, None, 0)])).count() == 0
    assert negatives.mine_negatives(frame(spark, random_rows(50)[1:])).count() == 0


def test_intervals_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(0, 0.125, (2000, 64))).astype(np.int64)
    turns = negatives.rotations(64)
    codes, measures = negatives.encode(rows, turns)
    anchors = negatives.Anchors(rows[:20], turns)
    low, high = anchors.intervals(np.arange(20), codes, measures)
    scores = rows[:20] @ rows.T
    assert (low <= scores).all() and (scores <= high).all()
    reach = high >= negatives._nth_greatest(low, 6)[:, None]
    assert reach.mean() < 0.5  # more than half of the rows need no whole score


@pytest.mark.parametrize("name", ["op12_negatives", "op13_centroids"])
def test_queries_against_sql(spark, name):
    from tidewatch.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    expected, found = con.execute(ORACLES[name]).df(), QUERIES[name](spark, DIR).toPandas()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns and len(found)
    assert sorted(found[columns].itertuples(index=False, name=None)) == sorted(expected[columns].itertuples(index=False, name=None))
