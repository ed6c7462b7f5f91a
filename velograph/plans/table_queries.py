"""Queries on the driver's tables: lineitem as a distribution over cells, events as iterations, embeddings as blocks.

A cell of lineitem is a species (flag and status), a line number and a supplier; its velocity is the discount and its magnetic
moment the tax, both in hundredths; f is the quantity. All of it grows with the tables."""

from __future__ import annotations

import contextlib
from decimal import Decimal

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.config import Run
from velograph.functions.exact import exact_total
from velograph.functions.numeric import fixed, ieee_div, pad_to
from velograph.operators import digests, distribution, exchange, moments, placement, quadrature, tiles, verify, zorder
from velograph.plans import timing
from velograph.plans.diagnostics import Diagnostics
from velograph.plans.registry import query, rounded
from velograph.sources import buckets, files, footers, generate, versions
from velograph.streaming import incremental

CELL = ("species", "i1", "i2")
#: Extents of the hundredths of discounts and taxes.
EXTENTS = {"iv": 11, "im": 9}


def points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A row of lineitem as a point: species, i1, i2, iv, im, and its quantity as f, and more of its columns; the scan reads no others."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    return t.select(F.concat("l_returnflag", "l_linestatus").alias("species"), (F.col("l_linenumber") - 1).cast("int").alias("i1"), F.col("l_suppkey").alias("i2"), hundredths("l_discount").alias("iv"), hundredths("l_tax").alias("im"), F.col("l_quantity").alias("f"), *more)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution: f summed at every point that has rows."""
    return points(spark, sf_dir).groupBy(*CELL, "iv", "im").agg(F.sum("f").alias("f"))


def weighted(f: DataFrame) -> DataFrame:
    """f with vpar, and with w by the trapezoid rule on the fixed axes of hundredths."""
    half = lambda c, n: F.when(F.col(c).isin(0, n - 1), 0.005).otherwise(0.01)
    return f.withColumns({"vpar": F.col("iv") / 100.0, "w": half("iv", EXTENTS["iv"]) * half("im", EXTENTS["im"])})


def extents(f: DataFrame, *names: str) -> dict[str, int]:
    """The extent of each index: one row for the driver."""
    row = f.agg(*[F.max(n).alias(n) for n in names]).first()
    return {n: (row[n] if row[n] is not None else -1) + 1 for n in names}


_POINTS = "(SELECT l_returnflag || l_linestatus AS species, (l_linenumber - 1)::INT AS i1, l_suppkey AS i2, round(l_discount * 100)::INT AS iv, round(l_tax * 100)::INT AS im, l_quantity AS f FROM lineitem)"
_F = f"(SELECT species, i1, i2, iv, im, sum(f) AS f FROM {_POINTS} GROUP BY ALL)"
_W = f"(SELECT *, iv / 100.0::DOUBLE AS vpar, (CASE WHEN iv IN (0, 10) THEN 0.005 ELSE 0.01 END)::DOUBLE * (CASE WHEN im IN (0, 8) THEN 0.005 ELSE 0.01 END)::DOUBLE AS w FROM {_F})"
_MOMENTS = f"""(WITH p AS (SELECT * FROM {_W}), g AS (SELECT species, i1, i2, sum(w * f) AS m0, sum(w * f * vpar) / sum(w * f) AS u FROM p GROUP BY ALL)
 SELECT p.species, p.i1, p.i2, any_value(m0) AS density, any_value(u) AS mean_velocity, sum(w * f * (vpar - u) * (vpar - u)) / any_value(m0) AS temperature
 FROM p JOIN g ON p.species = g.species AND p.i1 = g.i1 AND p.i2 = g.i2 GROUP BY p.species, p.i1, p.i2)"""
_ROUNDED = f"SELECT species, i1, i2, round(density, 12) + 0.0 AS density, round(mean_velocity, 12) + 0.0 AS mean_velocity, round(temperature, 12) + 0.0 AS temperature FROM {_MOMENTS}"


# --- contiguous exchange ---------------------------------------------------------------------------------


def _plan_sql(a: str, b: str, parts: int) -> str:
    """Balanced boxes over two axes, as operators.placement has them; at one index a bin below 1,025 indices."""
    return f"""WITH r AS (SELECT {a}::BIGINT AS a, {b}::BIGINT AS b FROM {_POINTS}), w AS (SELECT (max(b) + 1 + 1023) // 1024 AS w FROM r),
h AS (SELECT a, count(*) AS n, min(b) AS lo, max(b) AS hi FROM r GROUP BY a),
g AS (SELECT *, sum(n) OVER (ORDER BY a) - n AS before, sum(n) OVER () AS t FROM h),
k AS (SELECT *, n * {parts} > t AS heavy, before * {parts} // t AS run, sum((n * {parts} > t)::INT) OVER (ORDER BY a) AS passed FROM g),
h2 AS (SELECT k.a, r.b // w.w AS bb, count(*) AS n, min(r.b) AS lo, max(r.b) AS hi, any_value((k.n * {parts} + t - 1) // t) AS pieces FROM r JOIN k ON k.a = r.a AND k.heavy, w GROUP BY 1, 2),
k2 AS (SELECT *, (sum(n) OVER (PARTITION BY a ORDER BY bb) - n) * pieces // sum(n) OVER (PARTITION BY a) AS run FROM h2),
boxes AS (SELECT min(a) AS at_1, 0 AS at_2, min(a) AS a0, max(a) AS a1, min(lo) AS b0, max(hi) AS b1, sum(n) AS n FROM k WHERE NOT heavy GROUP BY run, passed
 UNION ALL SELECT a, min(bb), a, a, min(lo), max(hi), sum(n) FROM k2 GROUP BY a, run)
SELECT (row_number() OVER (ORDER BY at_1, at_2) - 1)::INT AS part, a0 AS start_1, b0 AS start_2, a1 - a0 + 1 AS extent_1, b1 - b0 + 1 AS extent_2, n::BIGINT AS n FROM boxes"""


def _flat_ranges(f: DataFrame) -> DataFrame:
    at = lambda c, k: F.col(c)[k].alias(f"{c[:-1]}_{k + 1}")
    return f.select("part", at("starts", 0), at("starts", 1), at("extents", 0), at("extents", 1), "n")


@query(_plan_sql("i1", "i2", 16))
def lineitem_contiguous_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem put into partitions by line number and supplier: what each partition then has, measured on it."""
    f = points(spark, sf_dir)
    plan = placement.balanced_plan(f, extents(f, "i1", "i2"), 16)
    return _flat_ranges(placement.filled_ranges(placement.contiguous(f, plan), ("i1", "i2")))


@query(_plan_sql("iv", "im", 24))
def lineitem_contiguous_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From slabs of space to slabs of velocity: the ranges of discount and tax that each partition has in the end."""
    f = points(spark, sf_dir)
    slabs = placement.transpose(f, extents(f, "i1", "i2"), 8)
    return _flat_ranges(placement.filled_ranges(placement.transpose(slabs, EXTENTS, 24), ("iv", "im")))


@query(f"SELECT species, i1, i2, sum(f) AS total, count(*)::BIGINT AS n FROM {_F} GROUP BY ALL")
def lineitem_contiguous_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution after a contiguous exchange to velocity and back, summed by cell."""
    f = cells(spark, sf_dir)
    back = placement.transpose(placement.transpose(f, EXTENTS, 8), extents(f, "i1", "i2"), 8)
    return back.groupBy(*CELL).agg(F.sum("f").alias("total"), F.count("*").alias("n"))


# --- co-located tables -------------------------------------------------------------------------------------


@query(_ROUNDED)
def lineitem_bucketed_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by two passes of f stored in buckets by cell: neither f nor its sums are shuffled."""
    name = buckets.write_bucketed(cells(spark, sf_dir), CELL, 8, "lineitem_f")
    return rounded(buckets.moments_of(weighted(spark.table(name)), CELL), *moments.ALL, digits=12)


@query(
    f"""WITH m AS ({_ROUNDED}), d AS (SELECT density, mean_velocity, temperature, density + CASE WHEN i1 = 2 AND i2 % 7 = 3 THEN 0.25 ELSE 0 END AS wrong FROM m)
SELECT 'density' AS variable, count(*)::BIGINT AS n, 0::BIGINT AS n_nan, round(max(abs(density - wrong)), 6) + 0.0 AS max_abs_error FROM d
UNION ALL SELECT v, count(*), 0, 0.0 FROM d, (VALUES ('mean_velocity'), ('temperature')) AS t(v) GROUP BY v"""
)
def lineitem_bucketed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by two passes against stored ones of one pass with some wrong densities, bucket by bucket."""
    f = weighted(spark.table(buckets.write_bucketed(cells(spark, sf_dir), CELL, 8, "lineitem_f")))
    wrong = F.when((F.col("i1") == 2) & (F.col("i2") % 7 == 3), 0.25).otherwise(0.0)
    stored = buckets.write_bucketed(moments.one_pass(f, CELL, 0.05).withColumn("density", F.col("density") + wrong), CELL, 8, "lineitem_moments")
    found = buckets.compare(buckets.moments_of(f, CELL), spark.table(stored), CELL)
    return rounded(found.select("variable", "n", "n_nan", "max_abs_error"), "max_abs_error", digits=6)


# --- boxes over many axes -----------------------------------------------------------------------------------

_BOX = ({"i1": 1, "i2": 10, "iv": 3, "im": 2}, {"i1": 2, "i2": 40, "iv": 4, "im": 3})


@query(f"SELECT species, i1, i2, iv, im, f FROM {_F} WHERE " + " AND ".join(f"{c} BETWEEN {a} AND {a + _BOX[1][c] - 1}" for c, a in _BOX[0].items()))
def lineitem_zorder_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box over four axes of the distribution stored in Z-order."""
    f, top = cells(spark, sf_dir), files.scratch(spark, "zorder")
    zorder.write_clustered(f, extents(f, "i1", "i2") | EXTENTS, top, 8)
    return zorder.read_box(spark, top, *_BOX)


# --- sums in any order ---------------------------------------------------------------------------------------


@query(_ROUNDED)
def lineitem_exact_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of exact sums, straight from lineitem's rows however they are split."""
    return rounded(moments.moments(weighted(points(spark, sf_dir)), keys=CELL, method="exact", about=0.05), *moments.ALL, digits=12)


@query("SELECT l_returnflag || l_linestatus AS species, (sum((l_extendedprice * 100)::HUGEINT) / 100.0::DOUBLE)::DOUBLE AS total, count(*)::BIGINT AS n FROM (SELECT l_returnflag, l_linestatus, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem) GROUP BY 1")
def lineitem_exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices summed without rounding, against whole cents."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("species")).agg(exact_total(F.col("l_extendedprice")).alias("total"), F.count("*").alias("n"))
    return rounded(sums, "total", digits=2)


# --- moments that grow with arriving files --------------------------------------------------------------------


@query(
    "SELECT event_type, user_id, count(*)::BIGINT AS n, round(avg(value), 9) + 0.0 AS mean, round(stddev_pop(value), 9) + 0.0 AS spread FROM events GROUP BY ALL"
)
def events_incremental_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by event type and user, taken in file by file as they arrive."""
    t, top = spark.read.parquet(f"{sf_dir}/events.parquet"), files.scratch(spark, "incremental")
    t.repartitionByRange(6, "ts").write.parquet(f"{top}/arriving")
    incremental.run(spark, f"{top}/arriving", t.schema, f"{top}/state", f"{top}/progress", ("event_type", "user_id"), "value", files_per_batch=2).awaitTermination()
    state = incremental.state(spark, f"{top}/state").select("event_type", "user_id", "n", "mean", F.sqrt("variance").alias("spread"))
    return rounded(state, "mean", "spread")


@query(
    f"""WITH p AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS iteration, l_returnflag || l_linestatus AS species, l_linenumber - 1 AS i1, (CASE WHEN round(l_discount * 100) IN (0, 10) THEN 0.005 ELSE 0.01 END)::DOUBLE * (CASE WHEN round(l_tax * 100) IN (0, 8) THEN 0.005 ELSE 0.01 END)::DOUBLE * l_quantity AS wf, round(l_discount * 100) / 100 AS v FROM lineitem),
g AS (SELECT iteration, species, i1, sum(wf) AS m0, sum(wf * v) / sum(wf) AS u FROM p GROUP BY ALL)
SELECT p.iteration, p.species, p.i1, round(any_value(m0), 9) + 0.0 AS density, round(any_value(u), 12) + 0.0 AS mean_velocity, round(sum(wf * (v - u) * (v - u)) / any_value(m0), 12) + 0.0 AS temperature
FROM p JOIN g ON p.iteration = g.iteration AND p.species = g.species AND p.i1 = g.i1 GROUP BY p.iteration, p.species, p.i1"""
)
def lineitem_in_situ_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by iteration, which is the month of shipping: all iterations are one plan."""
    f = weighted(points(spark, sf_dir, "l_shipdate")).withColumn("iteration", (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int"))
    return rounded(rounded(moments.moments(f, keys=("iteration", "species", "i1"), about=0.05), "density"), "mean_velocity", "temperature", digits=12)


# --- own diagnostics, tiles, digests ---------------------------------------------------------------------------


@query(f"SELECT species, i1, i2, quantile_cont(f, 0.25) AS middle_low, quantile_cont(f, 0.75) AS middle_high, round(median(vpar * f), 9) + 0.0 AS flux_median, count(*)::BIGINT AS flux_n FROM {_W} GROUP BY species, i1, i2")
def lineitem_cell_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two diagnostics of a user's own, in numpy, on every cell's block."""
    own = Diagnostics()
    own.register("middle", ("f",), "low double, high double", EXTENTS["iv"] * EXTENTS["im"])(lambda f: np.quantile(f, [0.25, 0.75]))
    own.register("flux", ("vpar", "f"), "median double, n bigint", EXTENTS["iv"] * EXTENTS["im"])(lambda v, f: (float(np.median(v * f)), len(f)))
    return rounded(own.run(weighted(cells(spark, sf_dir)), CELL, order=("iv", "im")), "flux_median")


@query(
    "SELECT vec_id // 128 AS block, (i - 1)::INT AS dim, count(*)::BIGINT AS n, round(sum(x), 4) + 0.0 AS total, round(sum(x * pos), 3) + 0.0 AS placed "
    "FROM (SELECT vec_id, i, embedding[i]::DOUBLE AS x, row_number() OVER (PARTITION BY vec_id // 128, i ORDER BY vec_id) AS pos FROM embeddings, range(1, 65) AS t(i)) GROUP BY 1, 2"
)
def embeddings_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors turned into dimension-major blocks: each dimension's values, summed, and summed by place."""
    t = tiles.to_tiles(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64, block=128)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    x = F.transform("values", lambda v: v.cast("double"))
    rows = tiles.dimensions(t).select("block", "dim", F.size("ids").cast("bigint").alias("n"), add(x).alias("total"), add(F.transform(x, lambda v, k: v * (k + 1))).alias("placed"))
    return rounded(rounded(rows, "total", digits=4), "placed", digits=3)


@query("SELECT vec_id, len(embedding)::INT AS dims, array_to_string([(v * 1e6)::BIGINT FOR v IN embedding], ',') AS numbers FROM (SELECT vec_id, [floor(v::DOUBLE * 4096) / 1e6 FOR v IN embedding] AS embedding FROM embeddings)")
def embeddings_tiles_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors turned into tiles and back, all their numbers in order."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    back = tiles.from_tiles(tiles.to_tiles(t, "vec_id", "embedding", 64, block=100, width=24), "vec_id", "embedding")
    return back.select("vec_id", F.size("embedding").alias("dims"), F.array_join(F.transform("embedding", lambda v: F.floor(v.cast("double") * 4096).cast("string")), ",").alias("numbers"))


_CHANGED = "i1 = 2 AND i2 % 50 = 7 AND iv = 3"


@query(
    f"""WITH a AS (SELECT * FROM {_F}), b AS (SELECT species, i1, i2, iv, im, CASE WHEN {_CHANGED} THEN f + 1 ELSE f END AS f FROM a WHERE NOT (i1 = 4 AND i2 % 50 = 9 AND im = 0))
SELECT a.species, a.i1, a.i2, a.iv, a.im, a.f AS f_a, b.f AS f_b FROM a LEFT JOIN b ON a.species = b.species AND a.i1 = b.i1 AND a.i2 = b.i2 AND a.iv = b.iv AND a.im = b.im WHERE a.f IS DISTINCT FROM b.f"""
)
def lineitem_changed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the distribution and a copy with some points changed and others lost: found by digests of
    line numbers, then of their cells, and joined in the differing cells alone."""
    a = files.kept(cells(spark, sf_dir), "lineitem_f")
    changed = a.withColumn("f", F.when(F.expr(_CHANGED), F.col("f") + 1).otherwise(F.col("f")))
    b = files.kept(changed.where(~((F.col("i1") == 4) & (F.col("i2") % 50 == 9) & (F.col("im") == 0))), "lineitem_f")
    trees = [digests.leaves(t, ("i1", "i2", "species"), ("species", "i1", "i2", "iv", "im", "f")) for t in (a, b)]
    found = digests.differing(*trees, [("i1",), ("i1", "i2"), ("i1", "i2", "species")]).groups
    left, right = (digests.rows_of(t, found, found.columns) for t in (a, b))
    both = left.withColumnRenamed("f", "f_a").join(right.withColumnRenamed("f", "f_b"), [*CELL, "iv", "im"], "full_outer")
    return both.where(~F.col("f_a").eqNullSafe(F.col("f_b"))).select(*CELL, "iv", "im", "f_a", "f_b")


# --- sizes out of footers, figures while writing ----------------------------------------------------------------

_WHOLE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*)::BIGINT AS n, min({c})::BIGINT AS lo, max({c})::BIGINT AS hi FROM lineitem" for c in _WHOLE))
def lineitem_footer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows and the range of each index, out of the file's footers."""
    return footers.ranges(spark, f"{sf_dir}/lineitem.parquet", _WHOLE)


@query(f"SELECT count(*)::BIGINT AS n, round(sum(density), 6) + 0.0 AS total, count(*) FILTER (isnan(temperature))::BIGINT AS n_nan, max(i2) AS last FROM {_MOMENTS}")
def lineitem_observed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of lineitem's moments, taken by the job that writes them."""
    found = moments.moments(weighted(points(spark, sf_dir)), keys=CELL, about=0.05)
    figures = {"n": F.count("*"), "total": F.sum("density"), "n_nan": F.count_if(F.isnan("temperature")), "last": F.max("i2")}
    seen = files.write_observed(found, f"{files.scratch(spark, 'observed')}/moments", figures)
    return rounded(spark.createDataFrame([tuple(seen[k] for k in figures)], "n bigint, total double, n_nan bigint, last bigint"), "total", digits=6)


# --- the store, with versions -------------------------------------------------------------------------------------


@query(f"SELECT v::INT AS version, round(sum(density * CASE v WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END), 6) + 0.0 AS total, count(*)::BIGINT AS n FROM {_MOMENTS}, range(1, 4) AS t(v) GROUP BY v")
def lineitem_moments_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments written three times over: each version is as it was, and a writer that failed made none."""
    path = f"{files.scratch(spark, 'versions')}/moments"
    found = files.kept(moments.moments(weighted(points(spark, sf_dir)), ("density",), CELL), "moments")
    out = None
    for k in (1, 2, 3):
        if k == 3:
            with contextlib.suppress(PySparkException, Py4JJavaError):
                versions.write(found.withColumn("density", F.when(F.col("i1") == 6, F.raise_error(F.lit("no more"))).otherwise(F.col("density"))), path)
        number = versions.write(found.withColumn("density", F.col("density") * k), path)
        each = versions.read(spark, path, number).agg(F.sum("density").alias("total"), F.count("*").alias("n")).select(F.lit(number).alias("version"), "total", "n")
        out = each if out is None else out.unionByName(each)
    return rounded(out, "total", digits=6)


# --- the run's own operators, on lineitem's cells -------------------------------------------------------------------


@query(
    f"""WITH m AS (SELECT * FROM {_MOMENTS} WHERE temperature > 1e-9), p AS (SELECT * FROM {_W})
SELECT p.species, p.i1, p.i2, round(sum(w * abs(f - density * pow(2 * pi() * temperature, -1.5) * exp(-(0.5::DOUBLE * ((vpar - mean_velocity) * (vpar - mean_velocity) + im / 100.0::DOUBLE)) / temperature))), 6) + 0.0 AS distance
FROM p JOIN m ON p.species = m.species AND p.i1 = m.i1 AND p.i2 = m.i2 GROUP BY p.species, p.i1, p.i2"""
)
def lineitem_maxwellian_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each cell is from the Maxwellian of its own density, velocity and temperature."""
    f = files.kept(weighted(cells(spark, sf_dir)), "lineitem_f")
    own = moments.one_pass(f, CELL, 0.05).where("temperature > 1e-9")
    c = F.col
    g = distribution.maxwellian(c("vpar"), c("im") / 100.0, c("density"), c("temperature"), c("mean_velocity"))
    return rounded(f.join(own, list(CELL)).groupBy(*CELL).agg(F.sum(c("w") * F.abs(c("f") - g)).alias("distance")), "distance", digits=6)


@query(
    f"""WITH s AS (SELECT month(l_shipdate)::INT AS iteration, avg(l_discount) * 20 - 1 AS s2, avg(l_tax) * 25 - 1 AS s3 FROM lineitem GROUP BY 1), n AS (SELECT max(i1) + 1 AS n1, max(i2) + 1 AS n2 FROM {_F})
SELECT iteration, i1, round(sum(f * (1 + 0.1::DOUBLE * cos(2 * pi() * (i2 / n2::DOUBLE - s2)) * cos(2 * pi() * (i1 / n1::DOUBLE - s3)))), 4) + 0.0 AS total FROM {_F}, s, n GROUP BY iteration, i1"""
)
def lineitem_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution perturbed for each month, by shifts that the month's rows give; summed by line number. Cells are summed
    over velocity before, as the factor depends on space alone."""
    run, f, t = Run(), cells(spark, sf_dir), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shifts = t.groupBy(F.month("l_shipdate").alias("iteration")).agg((F.avg("l_discount") * 20 - 1).alias("shift_tor2"), (F.avg("l_tax") * 25 - 1).alias("shift_tor3"))
    n = extents(f, "i1", "i2")
    space = f.groupBy("i1", "i2").agg(F.sum("f").alias("f"))
    angle = lambda c, axis: F.col(c) / float(n[c]) * run.axes[axis].length
    spread = space.crossJoin(generate.small(shifts, 12))
    wave = distribution.factor(run, angle("i2", "tor2"), angle("i1", "tor3"), F.col("shift_tor2"), F.col("shift_tor3"))
    return rounded(spread.groupBy("iteration", "i1").agg(F.sum(F.col("f") * wave).alias("total")), "total", digits=4)


@query(f"SELECT species, i1, round(sum(w * (im / 100.0::DOUBLE * f)), 9) + 0.0 AS integral FROM {_W} GROUP BY species, i1")
def lineitem_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integrand of the user's own, over each line number's velocity space."""
    f = weighted(cells(spark, sf_dir))
    return rounded(quadrature.integrate(f, F.col("im") / 100.0 * F.col("f"), ("species", "i1")), "integral")


@query(
    f"""WITH m AS (SELECT species FROM {_MOMENTS}), v AS (SELECT unnest(['density', 'mean_velocity', 'temperature']) AS variable)
SELECT variable, count(*) FILTER (species <> 'AF')::BIGINT AS n, 0.0::DOUBLE AS max_abs_error, count(*) FILTER (species = 'AF')::BIGINT AS only_a, 0::BIGINT AS only_b FROM m, v GROUP BY variable"""
)
def lineitem_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments recomputed from the stored distribution against stored ones, whose velocity has another name and which lack
    a species: errors by variable, and the cells that either has alone."""
    top = files.scratch(spark, "verified")
    files.replace_and_warn(cells(spark, sf_dir), f"{top}/f", "species", "i1")
    f = weighted(versions.read(spark, f"{top}/f"))
    files.replace_and_warn(moments.one_pass(f, CELL, 0.05).where("species <> 'AF'").withColumnRenamed("mean_velocity", "velocity"), f"{top}/moments")
    stored = verify.rename_present(versions.read(spark, f"{top}/moments"), {"velocity": "mean_velocity", "speed": "mean_velocity"})
    again = moments.moments(f, keys=CELL, method="exact", about=0.05)
    errors = verify.by_variable(again, stored, CELL).select("variable", "n", F.round("max_abs_error", 9).alias("max_abs_error"))
    return errors.crossJoin(generate.small(verify.unmatched(again, stored, CELL), 1))


@query(f"SELECT species, i1, i2, iv, im, f FROM {_F} WHERE i1 BETWEEN 2 AND 3 AND i2 BETWEEN 5 AND 60 AND iv BETWEEN 4 AND 6")
def lineitem_stored_hyperslab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of the distribution stored by species and line number: the line number prunes folders, the rest is pushed down."""
    path = f"{files.scratch(spark, 'stored')}/f"
    files.replace_and_warn(cells(spark, sf_dir).repartition("species", "i1"), path, "species", "i1")
    return exchange.hyperslab(versions.read(spark, path), {"i1": 2, "i2": 5, "iv": 4}, {"i1": 2, "i2": 56, "iv": 3}).select(*CELL, "iv", "im", "f")


@query(_ROUNDED)
def lineitem_stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the distribution stored in block layout, an array of all 99 velocity points for each cell: no shuffle."""
    path = f"{files.scratch(spark, 'blocks')}/f"
    files.replace_and_warn(moments.to_dense_blocks(cells(spark, sf_dir), CELL, EXTENTS["iv"], EXTENTS["im"]), path)
    half = lambda n: [0.005 if k in (0, n - 1) else 0.01 for k in range(n)]
    w = [a * b for a in half(EXTENTS["iv"]) for b in half(EXTENTS["im"])]
    vpar = [k / 100.0 for k in range(EXTENTS["iv"]) for _ in range(EXTENTS["im"])]
    return rounded(moments.block_moments(versions.read(spark, path), w, vpar, CELL), *moments.ALL, digits=12)


@query(
    f"SELECT species AS sp, iv, im, count(*)::BIGINT AS n, sum(f) AS total, sum(f * pos) AS placed FROM (SELECT *, row_number() OVER (PARTITION BY species, iv, im ORDER BY i1, i2) AS pos FROM {_F}) GROUP BY ALL"
)
def lineitem_transposed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each velocity point's values as one array in the order of space; summed, and summed by place."""
    f = cells(spark, sf_dir).select(F.col("species").alias("sp"), "i1", "i2", F.lit(0).alias("i3"), "iv", "im", "f")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return exchange.transpose_blocks(f).select("sp", "iv", "im", F.size("f").cast("bigint").alias("n"), add("f").alias("total"), add(F.transform("f", lambda v, k: v * (k + 1))).alias("placed"))


@query(
    f"""WITH e AS (SELECT max(i2) + 1 AS n2 FROM {_F}), c AS (SELECT d, k, k * (n // s) + least(k, n % s) AS a, n // s + (k < n % s)::INT AS b FROM (SELECT 1 AS d, 7::BIGINT AS n, 2 AS s UNION ALL SELECT 2, n2, 4 FROM e), range(0, 4) AS r(k) WHERE k < s)
SELECT (x.k * 4 + y.k)::INT AS part, count(*)::BIGINT AS n, sum(f) AS total FROM {_F} q, c x, c y WHERE x.d = 1 AND y.d = 2 AND i1 BETWEEN x.a AND x.a + x.b - 1 AND i2 BETWEEN y.a AND y.a + y.b - 1 GROUP BY 1"""
)
def lineitem_local_submesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution restricted to each part of a plan that splits line numbers in two and suppliers in four."""
    f = cells(spark, sf_dir)
    plan = exchange.partition_plan(spark, [7, extents(f, "i2")["i2"]], [2, 4])
    inside = [F.col(c).cast("bigint").between(F.col("starts")[k], F.col("starts")[k] + F.col("extents")[k] - 1) for k, c in enumerate(("i1", "i2"))]
    return f.join(generate.small(plan, 8), inside[0] & inside[1]).groupBy("part").agg(F.count("*").alias("n"), F.sum("f").alias("total"))


@query("SELECT c AS column_name, c <> 'density' AS present, CASE WHEN c <> 'density' THEN count(*) ELSE 0 END::BIGINT AS n FROM lineitem, (VALUES ('l_tax'), ('l_shipdate'), ('density')) AS t(c) GROUP BY c")
def lineitem_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some columns the table has, and how many values; only those are read."""
    t, names = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_tax", "l_shipdate", "density")
    counts = t.agg(*[(F.count(n) if n in t.columns else F.lit(None).cast("bigint")).alias(n) for n in names])
    return counts.unpivot([], list(names), "column_name", "n").select("column_name", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "SELECT l_linenumber, count(*)::BIGINT AS n, count(*) FILTER (l_discount = 0)::BIGINT AS n_inf, round(sum(l_quantity / nullif(l_discount, 0)), 6) + 0.0 AS total FROM lineitem GROUP BY 1"
)
def lineitem_ieee_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by discounts, some of which are 0: infinities are counted, the others summed."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", ieee_div(F.col("l_quantity"), F.col("l_discount")).alias("q"))
    inf = F.col("q") == float("inf")
    return rounded(t.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(inf).alias("n_inf"), exact_total(F.when(~inf, F.col("q"))).alias("total")), "total", digits=6)


_LAPS = "(SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6::DOUBLE AS s FROM events)"


@query(
    f"WITH p AS (SELECT (row_number() OVER (ORDER BY event_type) - 1)::INT AS ord, event_type AS name, round(sum(s), 3) + 0.0 AS seconds FROM {_LAPS} WHERE s IS NOT NULL GROUP BY event_type), "
    "a AS (SELECT * FROM p UNION ALL SELECT count(*)::INT, 'total', round(sum(seconds), 3) + 0.0 FROM p) SELECT ord, name, seconds, rpad(name, 20, ' ') || ' ' || lpad(printf('%.6f', seconds), 20, ' ') AS line FROM a"
)
def events_timing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that users spend after each kind of event, as the table of a run's phases: through padded names and
    values, cut to the shorter (a name without a value is left over), and written as lines. A row for each kind of event."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Whole microseconds: seconds of an epoch, as doubles, are off by some 10^-7 each.
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)")
    laps = timing.durations(t.select("user_id", "event_type", F.struct("ts", "event_id").alias("ord"), at.alias("t")), by=("user_id",))
    seconds = F.round(F.sum(F.col("seconds").cast("decimal(20,0)")) * F.lit(Decimal("0.000001")), 3)
    phases = laps.groupBy(F.col("event_type").alias("name")).agg(seconds.alias("seconds")).withColumn("last", F.lit(False))
    rows = phases.unionByName(phases.agg(F.lit("total").alias("name"), F.sum("seconds").alias("seconds"), F.lit(True).alias("last")))
    packed = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("last", F.col("name").isNull().alias("no_name"), "name", F.col("seconds").cast("double").alias("seconds")))).alias("x"))
    names = F.concat(F.transform("x", lambda r: pad_to(r["name"], 32)), F.array(pad_to(F.lit("left over"), 32)))
    raw = packed.select(names.alias("timing_names"), F.transform("x", lambda r: r["seconds"]).alias("timing_values"))
    out = rounded(files.timing_rows(raw), "seconds", digits=3)
    return out.withColumn("line", F.concat(F.rpad("name", 20, " "), F.lit(" "), F.lpad(fixed(F.col("seconds")), 20, " ")))


@query(
    "SELECT vec_id, (i - 1)::INT AS pos, ((i - 1) // 8)::INT AS a, ((i - 1) % 8)::INT AS b, embedding[i]::DOUBLE AS f FROM embeddings, range(1, 65) AS t(i)"
)
def embeddings_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat vectors given the indices of an array of 8 by 8, a row for each element."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("raw"))
    return generate.labelled(t, "raw", [8, 8], ("a", "b"), keep=("vec_id",)).select("vec_id", (F.col("a") * 8 + F.col("b")).alias("pos"), "a", "b", "f")


def _axis_sql(column: str, axis: str) -> str:
    return f"SELECT '{axis}' AS axis, (row_number() OVER (ORDER BY h) - 1)::INT AS idx, h / 100.0::DOUBLE AS coord, round(0.5 * (coalesce(lead(h) OVER (ORDER BY h), h) - coalesce(lag(h) OVER (ORDER BY h), h)) / 100, 9) + 0.0 AS w, (count(*) OVER ())::BIGINT AS extent FROM (SELECT DISTINCT round({column} * 100)::INT AS h FROM lineitem)"


@query(f"{_axis_sql('l_discount', 'vpar')} UNION ALL {_axis_sql('l_tax', 'mu')}")
def lineitem_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes of the distinct discounts and taxes, with indices, weights and extents; both in one window over few points."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = t.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.round(F.col(c) * 100).cast("int").alias("h")) for a, c in (("vpar", "l_discount"), ("mu", "l_tax"))])).alias("p")).select("p.*").distinct()
    axis = pairs.select("axis", (F.row_number().over(Window.partitionBy("axis").orderBy("h")) - 1).alias("idx"), (F.col("h") / 100.0).alias("coord"))
    return rounded(quadrature.trapezoid_weights(axis), "w").withColumn("extent", F.count("*").over(Window.partitionBy("axis")))
