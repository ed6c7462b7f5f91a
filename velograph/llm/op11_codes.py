"""Vector compression into codebook indexes, with entries filtered by segment-mean lower bounds.

A vector is cut into equal parts, and each part is coded by the nearest entry of its place's codebook. For two pieces of m
numbers with sums a, b and residual norms r, s (the length of what is left when the mean is taken off), the squared distance
is at least (a - b)^2 / m + (r - s)^2; over blocks these bounds add up. They are taken from coarse (the whole part) to
fine (blocks of two); an entry whose bound lies over the exact distance of the one with the least coarse bound can't be the
nearest, and goes. Bounds are lowered by more than their rounding can be, so the filter loses no entry; what survives gets
its exact distance in integers, ties to the lower index.

Codebooks are fitted on all rows: each round's sums are added up in the tasks and once more by Spark, so the driver gets a
row for each entry of a codebook, whatever the input. Nothing else is shuffled but sums by label.

A component x counts as floor(256 x), beyond -2^18 and 2^18 as these, so that a distance fits a long. Rows whose vector is
null, of another length than `dims`, or has a null or non-finite component are dropped. Starting entries are those of the
smallest ids, null ids last, equal ids by their vectors; with fewer rows than entries, codebooks are shorter. Repeated rows
come back once each. An empty table gives an empty one, with the digest of no entries. Null labels are one label; a label's
error that no long holds is null. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

#: Beyond these a component counts as the nearest of them.
LIMIT = float(1 << 18)


@dataclass(frozen=True)
class Coding:
    dims: int = 64
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    rows: int = 4096
    """Rows compared at once."""

    def __post_init__(self):
        if self.dims % self.parts or not 1 <= self.entries <= 256:
            raise ValueError("parts must divide dims, and an index must fit two hex digits")


def whole(vector: str, dims: int) -> Column:
    """True for a vector of that length whose components are all finite."""
    return (F.size(vector) == dims) & F.forall(vector, lambda x: F.abs(x) < F.lit(float("inf")))


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of whole vectors, a row each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(256 * np.clip(x, -LIMIT, LIMIT)).astype(np.int64)


def _levels(width: int) -> list[np.ndarray]:
    """Where blocks start, from one block to blocks of two."""
    out, blocks = [], 1
    while blocks == 1 or width // blocks >= 2:
        out.append(np.array([width * k // blocks for k in range(blocks)]))
        blocks *= 2
    return out


def _features(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block: the sum over the root of its width, and the residual norm."""
    m = np.diff(np.append(starts, x.shape[1]))
    s, q = np.add.reduceat(x, starts, axis=1), np.add.reduceat(x * x, starts, axis=1)
    return s / np.sqrt(m), np.sqrt((m * q - s * s) / m)  # exact integers until the roots


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the nearest entry and its squared distance, both of integers; and how many distances were taken."""
    n, k = len(x), len(entries)
    slack = 1e-9 + 1e-12 * ((x * x).sum(1).astype(float)[:, None] + (entries * entries).sum(1).astype(float))
    levels = [(_features(x, s), _features(entries, s)) for s in _levels(x.shape[1])]
    (a, r), (b, s) = levels[0]
    bound = (a - b.T) ** 2 + (r - s.T) ** 2
    first = bound.argmin(axis=1)
    best = ((x - entries[first]) ** 2).sum(axis=1)
    i, j = np.nonzero(bound - slack <= best[:, None])
    for (a, r), (b, s) in levels[1:]:
        keep = ((a[i] - b[j]) ** 2 + (r[i] - s[j]) ** 2).sum(axis=1) - slack[i, j] <= best[i]
        i, j = i[keep], j[keep]
    exact = np.full((n, k), np.iinfo(np.int64).max)
    exact[i, j] = ((x[i] - entries[j]) ** 2).sum(axis=1)
    at = exact.argmin(axis=1)  # the first of the smallest
    return at, exact[np.arange(n), at], n + len(i)


def assign(x: np.ndarray, books: np.ndarray, how: Coding) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances of every part, a row for each vector. books: part, entry, position."""
    width = how.dims // how.parts
    at, away = np.zeros((len(x), how.parts), np.int64), np.zeros((len(x), how.parts), np.int64)
    for a in range(0, len(x), how.rows):
        for p in range(how.parts):
            at[a : a + how.rows, p], away[a : a + how.rows, p], _ = nearest(x[a : a + how.rows, p * width : (p + 1) * width], books[p])
    return at, away


def starting(df: DataFrame, how: Coding, vector: str = "embedding", row_id: str = "vec_id") -> np.ndarray:
    """Codebooks of the rows with the smallest ids; as many as entries, so few for the driver."""
    rows = df.where(whole(vector, how.dims)).select(F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("i"), "v").limit(how.entries).collect()
    x = integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), how.dims)
    return x.reshape(len(rows), how.parts, how.dims // how.parts).transpose(1, 0, 2)


def refined(df: DataFrame, books: np.ndarray, how: Coding, vector: str = "embedding") -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts, as it was if it has none."""
    width, k = how.dims // how.parts, books.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(how.parts * k, np.int64), np.zeros((how.parts * k, width), np.int64)
        for batch in batches:
            x = integers(batch.column(0), how.dims)
            at = (assign(x, books, how)[0] + np.arange(how.parts) * k).reshape(-1)
            order = np.argsort(at, kind="stable")
            new = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(new):
                total[at[order][new]] += np.add.reduceat(x.reshape(-1, width)[order], new, axis=0)
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": pa.array(count[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    parts = common.map_arrow(df.where(whole(vector, how.dims)).select(vector), sums, "slot int, n bigint, total array<bigint>")
    exact = [F.sum(F.col("total")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(width)]
    out = books.copy()
    for row in parts.groupBy("slot").agg(F.sum("n").alias("n"), *exact).collect():  # parts x entries rows at most
        out[row.slot // k, row.slot % k] = [int(s) // row.n for s in row[2:]]
    return out


def fit(df: DataFrame, how: Coding = Coding(), vector: str = "embedding", row_id: str = "vec_id") -> np.ndarray:
    """Codebooks by part, entry and position, of all rows of df."""
    books = starting(df, how, vector, row_id)
    for _ in range(how.rounds if books.size else 0):
        books = refined(df, books, how, vector)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(books: np.ndarray, how: Coding, vector: str = "embedding") -> Column:
    """code and error of whole vectors: two hex digits a part, and the sum of the squared distances."""
    common.ship(SparkSession.active())

    def run(batches):
        for batch in batches:
            at, away = assign(integers(batch, how.dims), books, how)
            yield pa.StructArray.from_arrays([pa.array([bytes(r).hex() for r in at.astype(np.uint8)], pa.string()), pa.array(away.sum(axis=1))], ["code", "error"])

    run.__annotations__ = common.ARRAY_ITERATOR
    return F.arrow_udf(run, "struct<code: string, error: bigint>")(F.col(vector))


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))]) / 256


def compress(df: DataFrame, books: np.ndarray, how: Coding = Coding(), vector: str = "embedding", names: tuple[str, str] = ("code", "error")) -> DataFrame:
    """df's whole vectors with their code and error; its other columns stay, but those of these names."""
    (tag,) = common.fresh(df, "coded")
    kept = df.where(whole(vector, how.dims))
    if not books.size:
        return kept.withColumns({names[0]: F.lit(""), names[1]: F.lit(0).cast("bigint")})
    return kept.withColumn(tag, coded(books, how, vector)).withColumns({names[0]: F.col(f"{tag}.code"), names[1]: F.col(f"{tag}.error")}).drop(tag)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = Coding()
    df = common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = fit(df, how)
    rows = common.written(compress(df, books, how).select("vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key"), "code", "error"), "codes")
    sums = common.cut(rows.groupBy("key").agg(F.try_sum("error").alias("label_error")))
    out = common.looked_up(rows, sums, "key", "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(how: Coding = Coding()) -> str:
    """The same in SQL, by all distances."""
    w = how.dims // how.parts
    away = " + ".join(f"(x.y[{d}] - c.c[{d}]) * (x.y[{d}] - c.c[{d}])" for d in range(1, w + 1))
    floors = ", ".join(f"((sum(y[{d}]) - ((sum(y[{d}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for d in range(1, w + 1))
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings WHERE len(embedding) = {how.dims} AND len([v FOR v IN embedding IF isfinite(v)]) = {how.dims})",
        f"x AS MATERIALIZED (SELECT r, p, [floor(256 * v::DOUBLE)::BIGINT FOR v IN embedding[p * {w} + 1 : p * {w} + {w}]] AS y FROM kept, range(0, {how.parts}) AS t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r AS e, y AS c FROM x WHERE r < {how.entries})",
    ]
    for k in range(how.rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.y) AS y, min(({away}) * {how.entries} + c.e) AS m FROM x JOIN c{k} c ON x.p = c.p GROUP BY x.r, x.p)")
        if k < how.rounds:
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT p, m % {how.entries} AS e, [{floors}] AS c FROM a{k} GROUP BY 1, 2) n ON o.p = n.p AND o.e = n.e)")
    steps.append(f"q AS (SELECT kept.vec_id, kept.label, string_agg(printf('%02x', (m % {how.entries})::BIGINT), '' ORDER BY p) AS code, sum(m // {how.entries})::BIGINT AS error FROM a{how.rounds} a JOIN kept ON kept.r = a.r GROUP BY kept.r, kept.vec_id, kept.label)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{how.rounds}) AS codebooks_sha256 FROM q"


ORACLE_SQL = _oracle()
