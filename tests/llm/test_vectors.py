"""Vector codes and centroid clusters against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest

from velograph.llm import op11_codes, op12_centroids
from velograph.llm.op11_codes import Coding
from velograph.llm.op12_centroids import Clustering

RNG = np.random.default_rng(5)


def _plain_nearest(x, entries):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in entries] for v in x]
    return [min(range(len(entries)), key=lambda k: (r[k], k)) for r in d], [min(r) for r in d]


def _table(spark, rows):
    """Two vectors in three are near copies of one; nulls, odd lengths and numbers, ties and repeated rows among them."""
    odd = [(None, 1, [0.5] * 8), (900, None, None), (901, 2, []), (902, 2, [1.0] * 7), (903, 3, [None] + [1.0] * 7), (904, 3, [float("nan")] + [0.0] * 7), (905, 3, [float("inf")] + [0.0] * 7), (906, None, [1e30] + [-1e30] * 7), (907, None, [0.0] * 8), (907, None, [0.0] * 8)]
    return spark.createDataFrame(rows + odd, "vec_id bigint, label int, embedding array<float>").selectExpr("*", "'own' AS code", "1 AS own", "2 AS k0", "3 AS x")


def _rows(n):
    base = RNG.normal(size=8)
    return [(int(k), int(k % 3) if k % 5 else None, [float(v) for v in (base + RNG.normal(size=8) * 0.01 if k % 3 else RNG.normal(size=8) * 2)]) for k in RNG.permutation(n)]


def _kept(df):
    whole = [r for r in df.collect() if r.embedding is not None and len(r.embedding) == 8 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    return whole, [[int(np.floor(256 * min(max(v, -op11_codes.LIMIT), op11_codes.LIMIT))) for v in r.embedding] for r in whole]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8, 13])
def test_nearest_is_exact_and_ties_go_to_the_lower_index(width):
    for scale in (3, 200, 1 << 26):
        x, e = RNG.integers(-scale, scale, (300, width)), RNG.integers(-scale, scale, (17, width))
        e[9] = e[4]
        at, away, taken = op11_codes.nearest(x, e)
        want, far = _plain_nearest(x, e)
        assert at.tolist() == want and away.tolist() == far and taken <= 300 * 18


def test_bounds_filter_entries():
    """Entries in groups of like ones, as in codebooks: few exact distances are left."""
    e = RNG.integers(-500, 500, (64, 8))
    x = e[RNG.integers(0, 64, 1000)] + RNG.integers(-4, 5, (1000, 8))
    assert op11_codes.nearest(x, e)[2] < 1000 * 64 / 4


def test_codes(spark):
    how = Coding(dims=8, parts=4, entries=6, rounds=3, rows=16)
    df = _table(spark, _rows(120)).repartition(5)
    rows, x = _kept(df)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].vec_id is None, rows[i].vec_id or 0, rows[i].embedding))
    books = [[x[i][2 * p : 2 * p + 2] for i in order[:6]] for p in range(4)]
    for n in range(4):
        at = [_plain_nearest([v[2 * p : 2 * p + 2] for v in x], books[p]) for p in range(4)]
        if n < 3:
            for p in range(4):
                for k in range(6):
                    mine = [v[2 * p : 2 * p + 2] for v, a in zip(x, at[p][0], strict=True) if a == k]
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else books[p][k]
    found = op11_codes.fit(df, how)
    assert found.tolist() == books
    assert op11_codes.digest(found) == hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    got = op11_codes.compress(df, found, how)
    assert set(got.columns) == {*df.columns, "error"}
    want = [(r.vec_id, "".join(f"{at[p][0][i]:02x}" for p in range(4)), sum(at[p][1][i] for p in range(4))) for i, r in enumerate(rows)]
    assert sorted(map(str, ((r.vec_id, r.code, r.error) for r in got.collect()))) == sorted(map(str, want))
    assert op11_codes.decoded(want[0][1], found).shape == (8,)


@pytest.mark.parametrize("clusters,rounds", [(1, 2), (2, 3), (7, 4), (24, 6), (500, 1)])
def test_clusters(spark, clusters, rounds):
    how = Clustering(dims=8, clusters=clusters, rounds=rounds, rows=50)
    df = _table(spark, _rows(200)).repartition(3)
    rows, x = _kept(df)
    digest = lambda i: ("g" if rows[i].vec_id is None else hashlib.sha256(f"2:{rows[i].vec_id}".encode()).hexdigest(), rows[i].embedding)
    c = [x[i] for i in sorted(range(len(rows)), key=digest)[:clusters]]
    for n in range(rounds + 1):
        at, away = _plain_nearest(x, c)
        if n < rounds:
            for k in range(len(c)):
                mine = [v for v, a in zip(x, at, strict=True) if a == k]
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else c[k]
    got = op12_centroids.cluster(df, how, keep=("vec_id", "own"))
    assert got.centroids.tolist() == c
    assert sorted((str(r.k0), r.own, r.away) for r in got.rows.collect()) == sorted((str(r.vec_id), a, d) for r, a, d in zip(rows, at, away, strict=True))
    assert got.inertia == [sum(d for a, d in zip(at, away, strict=True) if a == k) for k in range(len(c))]


def test_bounds_save_scans(spark):
    """Vectors in tight groups: few of them are rescanned once centroids settle."""
    centers = RNG.normal(size=(20, 8)) * 4
    rows = [(k, 0, [float(v) for v in centers[k % 20] + RNG.normal(size=8) * 0.05]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = op12_centroids.cluster(df, Clustering(dims=8, clusters=20, rounds=6))
    assert got.rescanned[0] == 0 and got.rescanned[-1] < 60


def test_empty(spark, tmp_path):
    for rows in ([], [(1, 1, None), (2, None, [float("nan")] * 64)]):
        spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert op11_codes.op11_vector_codes(spark, str(tmp_path)).collect() == []
        assert op12_centroids.op12_centroid_clusters(spark, str(tmp_path)).collect() == []


def test_label_error_of_null_labels(spark, tmp_path):
    rows = [(k, (None, 4, 5)[k % 3], [float(v) for v in RNG.normal(size=64)]) for k in range(90)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_codes.op11_vector_codes(spark, str(tmp_path)).toPandas()
    assert len(got) == 90
    for k in range(3):
        mine = got[got.vec_id % 3 == k]
        assert (mine.label_error == mine.error.sum()).all()
