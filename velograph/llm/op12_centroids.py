"""Centroid clustering with Drake's adaptive bounds.

Beside its centroid, each vector keeps the numbers of the next nearest ones in order, a lower bound of the distance to each,
and one remainder bound for all others. When centroids move, a bound falls by its centroid's way, the remainder by the
longest way of all. The exact distance to the own centroid is the upper bound. What lies surely beyond it needs no look: if all
bounds do, the vector stays; if the remainder does, only the first of the stored centroids, up to the last that may be
as near, are measured and put in order anew; else all are rescanned. How many bounds are stored is adapted: from a quarter of
the centroids down to the most that the last round needed, an eighth at least.

Bounds are numbers lowered by more than their rounding, and certify by strict order alone; distances decide as exact integers,
ties to the smaller number. So clusters are those of a full scan.

A round reads the vectors with their bounds, and writes them again to the shared folder, a map without a shuffle: work
that is lost with an executor is done again from there. New centroids are sums by cluster, added up in the tasks first; the driver
gets a row for each centroid, and centroids are the only thing that is sent to tasks.

A component x counts as floor(256 x), beyond -2^18 and 2^18 as these, so that a distance fits a long. Rows whose vector is
null, of another length than `dims`, or has a null or non-finite component are dropped. Centroids start as the vectors
with the smallest hashes of their ids, null ids last, equal ids by their vectors; fewer vectors than `clusters` give fewer
centroids. Repeated rows come back once each. An empty table gives an empty one. A sum of distances that no long holds is
null. Of other columns those of `keep` come back, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common
from velograph.llm.op11_codes import integers, whole
from velograph.sources import files


@dataclass(frozen=True)
class Clustering:
    dims: int = 64
    clusters: int = 40
    rounds: int = 5
    seed: str = "2"
    rows: int = 2048
    """Rows compared at once."""


@dataclass
class Bounds:
    """Of each vector: its centroid, the squared distance to it, the next nearest ones with their lower bounds, and the
    lower bound of the rest."""

    own: np.ndarray
    away: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, as exact integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 20:  # every sum stays below 2^53
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)


def _below(square: np.ndarray) -> np.ndarray:
    """A number surely not over the root."""
    return np.sqrt(square.astype(float)) * (1 - 1e-12)


def scanned(x: np.ndarray, c: np.ndarray, keep: int) -> Bounds:
    """By all distances; the bounds of the `keep` next ones, and of the rest."""
    d = _squares(x, c)
    order = np.argsort(d, axis=1, kind="stable")  # ties to the smaller number
    sorted_ = np.take_along_axis(d, order, axis=1)
    rest = _below(sorted_[:, keep + 1]) if keep + 1 < len(c) else np.full(len(x), np.inf)
    return Bounds(order[:, 0], sorted_[:, 0], order[:, 1 : keep + 1], _below(sorted_[:, 1 : keep + 1]), rest)


def moved(x: np.ndarray, c: np.ndarray, way: np.ndarray, old: Bounds, keep: int) -> tuple[Bounds, int, int]:
    """Bounds after the centroids went each its way; how many stored ones any vector needed, and how many were rescanned."""
    b = old.near.shape[1]
    own, near = old.own.copy(), old.near.copy()
    lower = (old.lower - way[near]) * (1 - 1e-12) - 1e-9
    rest = (old.rest - way.max(initial=0)) * (1 - 1e-12) - 1e-9
    away = ((x - c[own]) ** 2).sum(axis=1)
    upper = np.sqrt(away.astype(float)) * (1 + 1e-12)
    # The least bound from each place on; a vector needs the places up to the last that may be as near.
    later = np.minimum.accumulate(np.concatenate([lower, rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    need = (later <= upper[:, None]).sum(axis=1)
    for m in range(1, b + 1):
        at = np.flatnonzero(need == m)
        if not len(at):
            continue
        names = np.concatenate([own[at, None], near[at, :m]], axis=1)
        d = np.stack([((x[at] - c[names[:, k]]) ** 2).sum(axis=1) for k in range(m + 1)], axis=1)
        order = np.lexsort((names, d), axis=1)
        names, d = np.take_along_axis(names, order, axis=1), np.take_along_axis(d, order, axis=1)
        own[at], away[at], near[at, :m] = names[:, 0], d[:, 0], names[:, 1:]
        lower[at, :m] = _below(d[:, 1:])
    again = np.flatnonzero(need == b + 1)
    if len(again):
        new = scanned(x[again], c, b)
        own[again], away[again], near[again], lower[again], rest[again] = new.own, new.away, new.near, new.lower, new.rest
    if keep < b:  # what is stored no longer belongs to the rest
        rest = np.minimum(rest, lower[:, keep:].min(axis=1))
    return Bounds(own, away, near[:, :keep], lower[:, :keep], rest), int(need[need <= b].max(initial=0)), len(again)


_STATE = "x array<int>, own int, away bigint, near array<int>, lower array<double>, rest double, need int, rescanned boolean"


def starting(df: DataFrame, how: Clustering, vector: str = "embedding", row_id: str = "vec_id") -> np.ndarray:
    """The vectors of the smallest hashes; as many as clusters, so few for the driver."""
    place = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col(row_id).cast("string")), 256)
    rows = df.where(whole(vector, how.dims)).select(place.alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(how.clusters).collect()
    return integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), how.dims)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32) if a.shape[1] else np.zeros(len(a) + 1, np.int32), pa.array(a.reshape(-1), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _round(df: DataFrame, c: np.ndarray, how: Clustering, keep: int, carried: int, way: np.ndarray | None = None, stored: int = 0) -> DataFrame:
    """Rows of df (the carried columns, then x alone or the state) with their state by the centroids c."""
    schema = df.schema[:carried].toDDL() + ", " if carried else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, how.rows):
                batch = whole_batch.slice(a, how.rows)
                state = batch.columns[carried:]
                x = _matrix(state[0], how.dims).astype(np.int64) if way is not None else integers(state[0], how.dims)
                if way is None:
                    b, need, again = scanned(x, c, keep), 0, np.zeros(len(x), bool)
                else:
                    own, away, rest = (state[k].to_numpy(zero_copy_only=False) for k in (1, 2, 5))
                    old = Bounds(own.astype(np.int64), away, _matrix(state[3], stored).astype(np.int64), _matrix(state[4], stored), rest)
                    b, need, n_again = moved(x, c, way, old, keep)
                    again = np.arange(len(x)) < n_again  # as many true as were rescanned
                columns = [_lists(x.astype(np.int32), pa.int32()), pa.array(b.own, pa.int32()), pa.array(b.away), _lists(b.near.astype(np.int32), pa.int32()), _lists(b.lower, pa.float64()), pa.array(b.rest), pa.array(np.full(len(x), need), pa.int32()), pa.array(again)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *columns], names=names)

    names = [f"k{i}" for i in range(carried)] + [f.split()[0] for f in _STATE.split(", ")]
    return common.map_arrow(df, run, schema + _STATE)


@dataclass
class Clusters:
    """rows: the kept columns (as k0, k1, ...) with own and away; centroids; inertia by cluster."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int | None]
    rescanned: list[int]


def cluster(df: DataFrame, how: Clustering = Clustering(), vector: str = "embedding", row_id: str = "vec_id", keep: tuple[str, ...] = ("vec_id",)) -> Clusters:
    spark = df.sparkSession
    c = starting(df, how, vector, row_id)
    k = len(c)
    rows = df.where(whole(vector, how.dims)).select(*[F.col(name).alias(f"k{i}") for i, name in enumerate(keep)], F.col(vector).alias("x"))
    if not k:
        empty = spark.createDataFrame([], rows.drop("x").schema).withColumns({"own": F.lit(0), "away": F.lit(0).cast("bigint")})
        return Clusters(empty, c, [], [])
    top = files.scratch(spark, "clusters")
    stored = kept = min(max(1, k // 4), k - 1)
    state, way, rescans = rows, None, []
    for n in range(how.rounds + 1):
        new = _round(state, c, how, kept, len(keep), way, stored)
        new.write.option("compression", "zstd").parquet(f"{top}/{n}")
        state = spark.read.schema(new.schema).parquet(f"{top}/{n}")
        if n:
            files.remove(spark, f"{top}/{n - 1}")
        stored = kept
        figures = [F.count("*").alias("n"), F.max("need").alias("need"), F.count_if("rescanned").alias("again"), F.try_sum("away").alias("away")]
        sums = [] if n == how.rounds else [F.sum(F.col("x")[d].cast("bigint")).alias(f"s{d}") for d in range(how.dims)]
        found = state.groupBy("own").agg(*figures, *sums).collect()  # a row for each centroid at most
        rescans.append(sum(r.again for r in found))
        if n < how.rounds:
            old, c = c, c.copy()
            for r in found:
                c[r.own] = [s // r.n for s in r[5:]]
            way = np.sqrt(((c - old) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12)
            if n:
                kept = min(kept, max(1, k // 8, max(r.need for r in found)))
    inertia: list[int | None] = [0] * k
    for r in found:
        inertia[r.own] = r.away
    return Clusters(state.select(*[f"k{i}" for i in range(len(keep))], "own", "away"), c, inertia, rescans)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    of = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("own")] if values else F.lit(None).cast(kind)
    total = None if None in found.inertia or sum(found.inertia) >= 1 << 63 else sum(found.inertia)
    return found.rows.select(F.col("k0").alias("vec_id"), F.col("own").alias("cluster"), F.col("away").alias("distance"), of(found.inertia, "bigint").alias("cluster_inertia"), F.lit(total).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def _oracle(how: Clustering = Clustering()) -> str:
    """The same in SQL, by all distances."""
    k = how.clusters
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{how.seed}:' || vec_id::VARCHAR), vec_id) - 1 AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {how.dims} AND len([v FOR v IN embedding IF isfinite(v)]) = {how.dims})",
        f"x AS MATERIALIZED (SELECT r, i, floor(256 * embedding[i]::DOUBLE)::BIGINT AS v FROM kept, range(1, {how.dims + 1}) AS t(i))",
        f"c0 AS MATERIALIZED (SELECT r AS c, i, v AS w FROM x WHERE r < {k})",
    ]
    for n in range(how.rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(d * {k} + c) AS m FROM (SELECT x.r, q.c, sum((x.v - q.w) * (x.v - q.w)) AS d FROM x JOIN c{n} q ON x.i = q.i GROUP BY x.r, q.c) GROUP BY r)")
        if n < how.rounds:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(s.w, o.w) AS w FROM c{n} o LEFT JOIN (SELECT m % {k} AS c, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS w FROM a{n} JOIN x ON a{n}.r = x.r GROUP BY 1, 2) s ON o.c = s.c AND o.i = s.i)")
    steps.append(f"q AS (SELECT vec_id, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance FROM a{how.rounds} a JOIN kept ON kept.r = a.r)")
    steps.append(f"h AS (SELECT c::INT AS cluster, sha256(string_agg(w::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{how.rounds} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT vec_id, q.cluster, distance, (sum(distance) OVER (PARTITION BY q.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM q JOIN h ON h.cluster = q.cluster"


ORACLE_SQL = _oracle()
