"""The registered queries: on the mesh of a configuration, and on the driver's tables; each with its SQL.

Moments are of the whole default mesh (5,898,240 points); queries that return a row for each point, and those
that write and read the store, are on smaller ones of the same kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.config import KINDS, Run, from_mapping, is_yaml
from velograph.functions.numeric import ieee_div, pad_to, steady
from velograph.operators import distribution, exchange, moments, quadrature, verify
from velograph.plans import simulate, table_queries, timing  # noqa: F401  (its queries are registered too)
from velograph.plans.events import Events
from velograph.plans.registry import ORACLES, QUERIES, query, rounded  # noqa: F401
from velograph.schemas import CELL, POINT
from velograph.sources import files, generate
from velograph.streaming import insitu

#: Axes of velocity as by default, few points in space: 2 x 7 x 8 x 8 x 16 x 10.
GRID = Run().with_cells(tor1=4, tor2=8, tor3=8)
FULL = Run()
#: For whole runs and the store: 2 x 4 x 2 x 2 x 6 x 5.
TINY = Run().with_cells(tor1=1, tor2=2, tor3=2, vpar=5, mu=4)
SHIFTS = [(1, 0.0, 0.0), (2, 0.25, -0.5), (3, -0.75, 0.125)]
#: Durations between fixed time points, in order.
TIME_POINTS = [("initialisation", 0.0), ("mpi_transpose", 1.25), ("fluid_moments", 3.5), ("gpu2cpu", 4.0), ("write", 4.0), ("end", 6.75)]


# --- SQL of the grid -------------------------------------------------------------------------------


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _points(run: Run, axis: str, index: str, coord: str) -> str:
    """A subquery of an axis's points, by the formulas of its kind."""
    a = run.axes[axis]
    lo, h, n = _num(a.lo), f"({_num(a.hi)} - {_num(a.lo)}) / {a.ncells}", len(a.points)
    if a.kind == "greville":
        value = f"CASE i WHEN 0 THEN {lo} WHEN 1 THEN {lo} + {h} / 3 WHEN {n - 2} THEN {_num(a.hi)} - {h} / 3 WHEN {n - 1} THEN {_num(a.hi)} ELSE {lo} + (i - 1) * {h} END"
    else:
        value = f"{lo} + i * ({h})"
    return f"(SELECT i::INT AS {index}, {value} AS {coord} FROM range(0, {n}) AS t(i))"


def _weights(run: Run, axis: str, index: str, coord: str, w: str) -> str:
    return f"(SELECT {index}, {coord}, 0.5::DOUBLE * (coalesce(lead({coord}) OVER (ORDER BY {index}), {coord}) - coalesce(lag({coord}) OVER (ORDER BY {index}), {coord})) AS {w} FROM {_points(run, axis, index, coord)})"


def _species_sql(run: Run) -> str:
    rows = ", ".join(f"({i}, '{s.name}', {_num(s.charge)}, {_num(s.mass)}, {_num(s.n_maxw)}, {_num(s.t_maxw)}, {_num(s.upar_maxw)})" for i, s in enumerate(run.species))
    return f"(SELECT * FROM (VALUES {rows}) AS t(sp, name, charge, mass, n_maxw, t_maxw, upar_maxw))"


def _shifts_sql() -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'({i}, {_num(a)}, {_num(b)})' for i, a, b in SHIFTS)}) AS t(iteration, shift_tor2, shift_tor3))"


def _f_sql(run: Run = GRID, species: str | None = None) -> str:
    """State 0 with its coordinates and weights; species: another subquery of them."""
    return f"""(SELECT sp, i1, i2, i3, v.iv, m.im, tor2, tor3, vpar, mu, wv * wm AS w,
  n_maxw * pow(2 * pi() * t_maxw, -1.5) * exp(-(0.5::DOUBLE * ((vpar - upar_maxw) * (vpar - upar_maxw) + mu)) / t_maxw) AS f
 FROM {species or _species_sql(run)} s, {_points(run, "tor1", "i1", "tor1")} a, {_points(run, "tor2", "i2", "tor2")} b, {_points(run, "tor3", "i3", "tor3")} c,
  {_weights(run, "vpar", "iv", "vpar", "wv")} v, {_weights(run, "mu", "im", "mu", "wm")} m)"""


def _factor_sql(run: Run = GRID) -> str:
    l2, l3 = run.axes["tor2"].length, run.axes["tor3"].length
    return f"(1 + {_num(run.eps)} * cos(2 * pi() * (tor2 / {_num(l2)} - shift_tor2)) * cos(2 * pi() * (tor3 / {_num(l3)} - shift_tor3)))"


def _moments_sql(source: str, keys: str) -> str:
    """Two passes over a source with w, f, vpar."""
    on = " AND ".join(f"p.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    of = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""WITH p AS (SELECT * FROM {source}), g AS (SELECT {keys}, sum(w * f) AS m0, sum(w * f * vpar) / sum(w * f) AS u FROM p GROUP BY {keys})
SELECT {of}, round(any_value(m0), 9) + 0.0 AS density, round(any_value(u), 9) + 0.0 AS mean_velocity, round(sum(w * f * (vpar - u) * (vpar - u)) / any_value(m0), 9) + 0.0 AS temperature
FROM p JOIN g ON {on} GROUP BY {of}"""


def _one(column: str, sql: str, keys: str) -> str:
    return f"SELECT {keys}, {column} FROM ({sql})"


_CELLS = "sp, i1, i2, i3"
_GRID_MOMENTS = _moments_sql(_f_sql(), _CELLS)
_FULL_MOMENTS = _moments_sql(_f_sql(FULL), _CELLS)


# --- tables of a configuration --------------------------------------------------------------------


@query(f"SELECT * FROM {_species_sql(GRID)}")
def species_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.species_table(spark, GRID)


@query(" UNION ALL ".join(f"SELECT '{n}' AS axis, idx, round(coord, 9) + 0.0 AS coord, {str(a.periodic).lower()} AS periodic FROM {_points(Run(), n, 'idx', 'coord')}" for n, a in Run().axes.items()))
def mesh_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generate.axis_table(spark, Run()), "coord")


@query(" UNION ALL ".join(f"SELECT '{n}' AS axis, i::INT AS idx, round({_num(a.lo)} + i * (({_num(a.hi)} - {_num(a.lo)}) / {a.ncells}), 9) + 0.0 AS breakpoint FROM range(0, {a.ncells + 1}) AS t(i)" for n, a in Run().axes.items()))
def mesh_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generate.breakpoint_table(spark, Run()), "breakpoint")


@query(f"SELECT name, extent::BIGINT AS extent FROM (VALUES ('species', 2), ('tor1', {15 + 3}), ('tor2', 32), ('tor3', 32), ('vpar', {15 + 1}), ('mu', {9 + 1})) AS t(name, extent)")
def mesh_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.extents_table(spark, Run()).where(F.size("extents") == 1).select("name", F.col("extents")[0].alias("extent"))


@query("SELECT sp::INT AS sp, i1::INT AS i1, count(*)::BIGINT AS n, sum(i2 + i3 + iv + im)::BIGINT AS s FROM range(0, 2) AS a(sp), range(0, 7) AS b(i1), range(0, 8) AS c(i2), range(0, 8) AS d(i3), range(0, 16) AS e(iv), range(0, 10) AS g(im) GROUP BY 1, 2")
def mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.mesh(spark, GRID).groupBy("sp", "i1").agg(F.count("*").alias("n"), F.sum(F.expr("CAST(i2 + i3 + iv + im AS BIGINT)")).alias("s"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS axis, idx, round(w, 9) + 0.0 AS w FROM {_weights(Run(), n, 'idx', 'coord', 'w')}" for n in ("tor1", "vpar", "mu")))
def trapezoid_weights_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quadrature.trapezoid_weights(generate.axis_table(spark, Run(), "tor1", "vpar", "mu")).select("axis", "idx", "w"), "w")


@query(f"SELECT iv, im, round(vpar, 9) + 0.0 AS vpar, round(mu, 9) + 0.0 AS mu, round(wv * wm, 9) + 0.0 AS w FROM {_weights(GRID, 'vpar', 'iv', 'vpar', 'wv')}, {_weights(GRID, 'mu', 'im', 'mu', 'wm')}")
def quadrature_weights_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quadrature.velocity_weights(spark, GRID), "vpar", "mu", "w")


@query(f"SELECT {_CELLS}, iv, im, round(f, 12) + 0.0 AS f FROM {_f_sql()}")
def maxwellian_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.initial(spark, GRID), "f", digits=12)


@query(f"SELECT iteration, {_CELLS}, iv, im, round(f * {_factor_sql()}, 12) + 0.0 AS f FROM {_f_sql()}, {_shifts_sql()}")
def perturb_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = distribution.perturb(distribution.initial(spark, GRID), spark, GRID, generate.shift_table(spark, SHIFTS), len(SHIFTS))
    return rounded(f, "f", digits=12)


# --- moments on the grid ---------------------------------------------------------------------------


def _weighted(spark: SparkSession) -> DataFrame:
    return quadrature.weighted(distribution.initial(spark, FULL), quadrature.velocity_weights(spark, FULL), 160)


@query(_one("density", _FULL_MOMENTS, _CELLS))
def moment_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.density(_weighted(spark)), "density")


@query(_one("mean_velocity", _FULL_MOMENTS, _CELLS))
def moment_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.mean_velocity(_weighted(spark)), "mean_velocity")


@query(_one("temperature", _FULL_MOMENTS, _CELLS))
def moment_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.temperature(_weighted(spark)), "temperature")


@query(_FULL_MOMENTS)
def fluid_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.moments_of(distribution.initial(spark, FULL), spark, FULL), *moments.ALL)


@query(_FULL_MOMENTS)
def fluid_moments_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.moments_of(distribution.initial(spark, FULL), spark, FULL, method="two_pass"), *moments.ALL)


@query(_FULL_MOMENTS)
def fluid_moments_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, vpar = moments.weight_arrays(quadrature.velocity_weights(spark, FULL))
    return rounded(moments.block_moments(moments.to_blocks(distribution.initial(spark, FULL)), w, vpar), *moments.ALL)


@query(f"SELECT {_CELLS}, round(sum(w * (mu * f)), 9) + 0.0 AS integral FROM {_f_sql(FULL)} GROUP BY {_CELLS}")
def custom_integrand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quadrature.integrate(_weighted(spark), lambda f: F.col("mu") * F.col("f")), "integral")


def _states_sql(run: Run) -> str:
    return f"""(SELECT 0 AS iteration, {_CELLS}, vpar, w, f FROM {_f_sql(run)}
 UNION ALL SELECT iteration, {_CELLS}, vpar, w, f * {_factor_sql(run)} AS f FROM {_f_sql(run)}, {_shifts_sql()})"""


@query(_moments_sql(_states_sql(FULL), f"iteration, {_CELLS}"))
def insitu_moments_by_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(FULL.axes, FULL.species, n_iterations=len(SHIFTS) + 1)
    return rounded(simulate.in_situ(spark, run, generate.shift_table(spark, SHIFTS)), *moments.ALL)


# --- exchange --------------------------------------------------------------------------------------


@query(f"SELECT {_CELLS}, iv, im, round(f, 12) + 0.0 AS f FROM {_f_sql()}")
def transpose_v2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exchange.transpose_v2d(distribution.initial(spark, GRID)), "f", digits=12)


@query(f"SELECT {_CELLS}, iv, im, round(f, 12) + 0.0 AS f FROM {_f_sql()}")
def transpose_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exchange.transpose_back(exchange.transpose_v2d(exchange.spatial_split(distribution.initial(spark, GRID)))), "f", digits=12)


@query(f"SELECT sp, iv, im, p::INT AS pos, round(x[p + 1], 12) + 0.0 AS f FROM (SELECT sp, iv, im, list(f * {_factor_sql()} ORDER BY i1, i2, i3) AS x FROM {_f_sql()}, {_shifts_sql()} WHERE iteration = 2 GROUP BY sp, iv, im), range(0, 448) AS t(p)")
def transpose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = simulate.state(spark, GRID, generate.shift_table(spark, SHIFTS), 2)
    return rounded(exchange.transpose_blocks(f).select("sp", "iv", "im", F.posexplode("f").alias("pos", "f")), "f", digits=12)


_BOX = ({"sp": 1, "i1": 2, "i2": 1, "i3": 4, "iv": 3, "im": 0}, {"sp": 1, "i1": 3, "i2": 5, "i3": 4, "iv": 10, "im": 10})


@query(f"SELECT {_CELLS}, iv, im, round(f, 12) + 0.0 AS f FROM {_f_sql()} WHERE " + " AND ".join(f"{c} BETWEEN {a} AND {a + _BOX[1][c] - 1}" for c, a in _BOX[0].items()))
def hyperslab_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exchange.hyperslab(distribution.initial(spark, GRID), *_BOX), "f", digits=12)


@query(
    "WITH c AS (SELECT d, k, (k * (n // s) + least(k, n % s))::BIGINT AS a, (n // s + (k < n % s)::INT)::BIGINT AS b FROM (VALUES (1, 18, 4), (2, 32, 2), (3, 32, 3)) AS t(d, n, s), range(0, 4) AS r(k) WHERE k < s) "
    "SELECT (x.k * 6 + y.k * 3 + z.k)::INT AS part, x.a AS start_1, y.a AS start_2, z.a AS start_3, x.b AS extent_1, y.b AS extent_2, z.b AS extent_3 FROM c x, c y, c z WHERE x.d = 1 AND y.d = 2 AND z.d = 3"
)
def partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = exchange.partition_plan(spark, [18, 32, 32], [4, 2, 3])
    return p.select("part", *[F.col("starts")[k].alias(f"start_{k + 1}") for k in range(3)], *[F.col("extents")[k].alias(f"extent_{k + 1}") for k in range(3)])


# --- checks and timings ----------------------------------------------------------------------------


def _bumped(m: DataFrame) -> DataFrame:
    """Moments as if one had been stored wrong: the temperature of one cell, by a quarter."""
    wrong = (F.col("sp") == 1) & (F.col("i1") == 3) & (F.col("i2") == 2) & (F.col("i3") == 1)
    return m.withColumn("temperature", F.col("temperature") + F.when(wrong, 0.25).otherwise(0.0))


_BUMP = "CASE WHEN sp = 1 AND i1 = 3 AND i2 = 2 AND i3 = 1 THEN 0.25 ELSE 0.0 END"
#: Differences of the moments and those stored wrong, stacked; the SQL's moments are rounded, so these are to 9 digits.
_DIFFERENCES = f"""(SELECT variable, abs(a - b) AS d, abs(a - b) / abs(nullif(b, 0)) AS r FROM (WITH m AS ({_GRID_MOMENTS})
 SELECT 'density' AS variable, density AS a, density AS b FROM m UNION ALL SELECT 'mean_velocity', mean_velocity, mean_velocity FROM m
 UNION ALL SELECT 'temperature', temperature, temperature + {_BUMP} FROM m))"""
_ERRORS = "round(max(d) FILTER (NOT isnan(d)), 9) + 0.0 AS max_abs_error, round(max(r) FILTER (NOT isnan(r) AND r > 1e-9), 9) + 0.0 AS max_rel_error, count(*) FILTER (isnan(d))::BIGINT AS n_nan"


def _without_noise(df: DataFrame) -> DataFrame:
    """Relative errors that are rounding alone (the electrons' mean velocity is about 0) are left out."""
    return rounded(df.withColumn("max_rel_error", F.when(F.col("max_rel_error") > 1e-9, F.col("max_rel_error"))), "max_abs_error", "max_rel_error")


@query(f"SELECT {_ERRORS} FROM {_DIFFERENCES} WHERE variable <> 'mean_velocity'")
def verify_max_abs_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = distribution.initial(spark, GRID)
    stored = _bumped(simulate.moments_of(f, spark, GRID)).drop("mean_velocity")
    return _without_noise(verify.max_abs_error(simulate.moments_of(f, spark, GRID, method="two_pass"), stored))


@query(f"SELECT variable, count(*)::BIGINT AS n, {_ERRORS} FROM {_DIFFERENCES} WHERE variable <> 'mean_velocity' GROUP BY variable UNION ALL SELECT 'mean_velocity', count(*), max(d), NULL, 0 FROM {_DIFFERENCES} WHERE variable = 'mean_velocity'")
def verify_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = distribution.initial(spark, GRID)
    stored = _bumped(simulate.moments_of(f, spark, GRID))
    found = verify.by_variable(simulate.moments_of(f, spark, GRID, method="two_pass"), stored)
    return _without_noise(found.withColumn("max_rel_error", F.when(F.col("variable") != "mean_velocity", F.col("max_rel_error"))))


@query(f"WITH m AS ({_GRID_MOMENTS}) SELECT count(*) FILTER (sp <> 0)::BIGINT AS only_a, 0::BIGINT AS only_b FROM m")
def verify_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = simulate.moments_of(distribution.initial(spark, GRID), spark, GRID)
    return verify.unmatched(m, m.where("sp = 0"))


_TIME_SQL = ", ".join(f"({i}, '{n}', {_num(t)})" for i, (n, t) in enumerate(TIME_POINTS))


@query(
    f"WITH p AS (SELECT * FROM (VALUES {_TIME_SQL}) AS t(ord, name, t)), d AS (SELECT ord, name, lead(t) OVER (ORDER BY ord) - t AS seconds FROM p), "
    "a AS (SELECT * FROM d WHERE seconds IS NOT NULL UNION ALL SELECT 5, 'total', sum(seconds) FROM d) SELECT ord, name, seconds, rpad(name, 20, ' ') || ' ' || lpad(printf('%.6f', seconds), 15, ' ') AS line FROM a"
)
def timing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.createDataFrame([(i, n, t, 0) for i, (n, t) in enumerate(TIME_POINTS)], "ord int, name string, t double, run int")
    laps = timing.durations(points, by=("run",)).select("ord", "name", "seconds")
    rows = laps.unionByName(laps.agg(F.lit(len(TIME_POINTS) - 1).alias("ord"), F.lit("total").alias("name"), F.sum("seconds").alias("seconds")))
    # Through the interchange form, names padded to one width, and back.
    width = rows.select(F.max(F.length("name")) + 1).first()[0]
    packed = rows.orderBy("ord").groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", pad_to(F.col("name"), width).alias("b"), "seconds"))).alias("x"))
    raw = packed.select(F.transform("x", lambda r: r["b"]).alias("timing_names"), F.transform("x", lambda r: r["seconds"]).alias("timing_values"))
    return files.timing_rows(raw).withColumn("line", F.format_string("%-20s %15.6f", "name", "seconds"))


# --- the store: written, and read again -------------------------------------------------------------


def _values(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS t({names})"


def _stored_mesh(spark: SparkSession, run: Run = GRID) -> str:
    top = files.scratch(spark, "mesh")
    files.write_mesh(spark, run, top)
    return top


def _stored_f(spark: SparkSession, run: Run = GRID) -> str:
    top = files.scratch(spark, "fdistribu")
    files.write_distribution(distribution.initial(spark, run), run, top, dealt=True)
    return top


@query("SELECT 'input' AS kind, 'input.h5' AS name")
def stored_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(GRID.axes, GRID.species, file_name="input.h5")
    return files.read_file_names(spark, _stored_mesh(spark, run))


@query(f"SELECT sp, name, charge, mass FROM {_species_sql(GRID)}")
def stored_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_species(spark, _stored_mesh(spark)).select("sp", "name", "charge", "mass")


@query(" UNION ALL ".join(f"SELECT '{n}' AS axis, count(*)::BIGINT AS points FROM {_points(GRID, n, 'idx', 'coord')}" for n in GRID.axes))
def stored_axis_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the stored points, and from the stored extents, which must agree."""
    top = _stored_mesh(spark)
    extents = files.read_extents(spark, top)
    return spark.createDataFrame([(n, files.axis_size(spark, top, n)) for n in GRID.axes if extents[n] == [files.axis_size(spark, top, n)]], "axis string, points bigint")


@query(" UNION ALL ".join(f"SELECT '{n}' AS axis, idx, round(coord, 9) + 0.0 AS coord, {str(a.periodic).lower()} AS periodic FROM {_points(GRID, n, 'idx', 'coord')}" for n, a in GRID.axes.items() if n in ("tor1", "mu")))
def stored_axis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _stored_mesh(spark)
    return rounded(files.read_axis(spark, top, "tor1").unionByName(files.read_axis(spark, top, "mu")), "coord")


@query("SELECT 'vpar' AS axis, i::INT AS idx, round(-7.0::DOUBLE + i * (14.0::DOUBLE / 15), 9) + 0.0 AS breakpoint FROM range(0, 16) AS t(i)")
def stored_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(files.read_breakpoints(spark, _stored_mesh(spark), "vpar"), "breakpoint")


@query(f"SELECT {_CELLS}, iv, im, round(f, 12) + 0.0 AS f FROM {_f_sql()} WHERE " + " AND ".join(f"{c} BETWEEN {a} AND {a + _BOX[1][c] - 1}" for c, a in _BOX[0].items()))
def stored_hyperslab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of the stored distribution: two indices prune folders, the others go into the scan."""
    return rounded(files.read_distribution(spark, _stored_f(spark), *_BOX), "f", digits=12)


@query(f"SELECT i1, count(*)::BIGINT AS n, round(sum(f), 9) + 0.0 AS total FROM {_f_sql()} GROUP BY i1")
def stored_chunks_by_tor1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored distribution, a chunk for each index of tor1, which is a folder."""
    f = exchange.chunks_by(files.read_distribution(spark, _stored_f(spark)), "i1")
    return rounded(f.groupBy("i1").agg(F.count("*").alias("n"), F.sum("f").alias("total")), "total")


@query(_GRID_MOMENTS)
def stored_blocks_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of a distribution stored in block layout."""
    top = files.scratch(spark, "blocks")
    files.write_blocks(moments.to_blocks(distribution.initial(spark, GRID)), top)
    w, vpar = moments.weight_arrays(quadrature.velocity_weights(spark, GRID))
    return rounded(moments.block_moments(files.read_blocks(spark, top), w, vpar), *moments.ALL)


@query(f"SELECT {_CELLS}, iv, im, round(f, 12) + 0.0 AS f FROM {_f_sql(TINY)}")
def stored_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transposed distribution that a run in its first mode leaves."""
    top = files.scratch(spark, "run")
    simulate.simulate(spark, Run(TINY.axes, TINY.species, "mpi_transpose"), generate.shift_table(spark, SHIFTS), top)
    return rounded(files.read_transposed(spark, top), "f", digits=12)


@query(_moments_sql(_f_sql(TINY), _CELLS))
def stored_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments that a run leaves; an earlier run's in the same folder are replaced."""
    top = files.scratch(spark, "run")
    run = Run(TINY.axes, TINY.species, "mpi_transpose")
    files.write_moments(simulate.moments_of(distribution.initial(spark, GRID), spark, GRID), top)
    return rounded(simulate.simulate(spark, run, generate.shift_table(spark, SHIFTS), top), *moments.ALL)


@query(f"SELECT iteration, {_CELLS}, density, mean_velocity AS velocity, temperature FROM ({_moments_sql(_states_sql(TINY), f'iteration, {_CELLS}')}) WHERE iteration = 2")
def stored_in_situ_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last iteration's moments that a run in its second mode leaves."""
    top = files.scratch(spark, "run")
    simulate.simulate(spark, Run(TINY.axes, TINY.species, n_iterations=3), generate.shift_table(spark, SHIFTS), top)
    return rounded(files.read_in_situ(spark, top, last=True).select("iteration", *CELL, "density", "velocity", "temperature"), "density", "velocity", "temperature")


@query(_moments_sql(_states_sql(TINY), f"iteration, {_CELLS}"))
def stream_in_situ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of iterations that arrive as a stream of files, state 0 too."""
    top = files.scratch(spark, "stream")
    for k in range(4):
        rows = [(0, 0.5, 0.5)] if k == 0 else SHIFTS[k - 1 : k]
        generate.shift_table(spark, rows).coalesce(1).write.parquet(f"{top}/shifts", mode="append")
    insitu.run_stream(spark, TINY, f"{top}/shifts", top, f"{top}/progress").awaitTermination()
    return rounded(files.read_in_situ(spark, top).select("iteration", *CELL, *moments.ALL), *moments.ALL)


@query(_moments_sql(f"(SELECT * REPLACE (f * {_factor_sql(TINY)} AS f) FROM {_f_sql(TINY)}, {_shifts_sql()} WHERE iteration = 2)", _CELLS))
def stored_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments recomputed from the distribution that an in-situ run of two iterations leaves: state 2."""
    top, run = files.scratch(spark, "run"), Run(TINY.axes, TINY.species, n_iterations=2)
    simulate.simulate(spark, run, generate.shift_table(spark, SHIFTS), top)
    simulate.verify_run(spark, run, top)
    return rounded(files.read_moments(spark, top, "fluid_moments_verified"), *moments.ALL)


@query(f"WITH p AS ({_values(_TIME_SQL, 'ord, name, t')}) SELECT ord::INT AS ord, name, lead(t) OVER (ORDER BY ord) - t AS seconds FROM p QUALIFY seconds IS NOT NULL")
def stored_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings as written, over others written before."""
    top = files.scratch(spark, "timings")
    files.write_timing(spark, ["old"], [1.0], top)
    files.write_timing(spark, [n for n, _ in TIME_POINTS[:-1]], [b - a for (_, a), (_, b) in zip(TIME_POINTS, TIME_POINTS[1:], strict=False)], top)
    return files.timing_table(spark, top)


@query("SELECT i::INT AS ord, ['initialisation', 'mpi_transpose', 'fluid_moments', 'gpu2cpu', 'write', 'total'][i + 1] AS name, true AS positive, true AS adds_up FROM range(0, 6) AS t(i)")
def run_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases that a run times: each takes its time, and the total is their sum."""
    top = files.scratch(spark, "run")
    simulate.simulate(spark, Run(TINY.axes, TINY.species, "mpi_transpose"), generate.shift_table(spark, SHIFTS), top)
    rows = files.timing_table(spark, top)
    total = rows.select(F.sum(F.when(F.col("name") != "total", F.col("seconds"))).alias("s")).scalar()
    return rows.select("ord", "name", (F.col("seconds") > 0).alias("positive"), ((F.col("name") != "total") | (F.abs(F.col("seconds") - total) < 1e-6)).alias("adds_up"))


@query(_values("(0, 'ab', 1.0::DOUBLE), (1, 'c', 2.5::DOUBLE)", "ord, name, seconds"))
def timing_cut_to_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three padded names and two values: as many rows as the shorter has."""
    raw = spark.createDataFrame([([bytearray(b"ab\0\0"), bytearray(b"c\0\0\0"), bytearray(b"d\0\0\0")], [1.0, 2.5])], "timing_names array<binary>, timing_values array<double>")
    return files.timing_rows(raw)


@query(_values("('name', true), ('seconds', true), ('timing_values', false)", "dataset, present"))
def dataset_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = files.scratch(spark, "timings")
    files.write_timing(spark, ["a"], [1.0], top)
    columns = files.timing_table(spark, top).columns
    return spark.createDataFrame([(c, c in columns) for c in ("name", "seconds", "timing_values")], "dataset string, present boolean")


# --- settings, local ranges, events -----------------------------------------------------------------


@query("SELECT 'mpi_transpose' AS version, 3::INT AS n_iterations, 0.25::DOUBLE AS eps, -7.0::DOUBLE AS vpar_min, 7.0::DOUBLE AS vpar_max, 2::INT AS n_species")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of a parsed configuration."""
    mesh = {f"{key}_{part}": x for n, (_, _, key) in KINDS.items() for part, x in (("ncells", FULL.axes[n].ncells), ("min", FULL.axes[n].lo), ("max", FULL.axes[n].hi))}
    species = [{"name": s.name, "charge": s.charge, "mass": s.mass, "N_maxw": s.n_maxw, "T_maxw": s.t_maxw, "Upar_maxw": s.upar_maxw} for s in FULL.species]
    run = from_mapping({"SplineMesh": mesh, "SpeciesInfo": species, "Application": {"version": "mpi_transpose", "n_iterations": 3, "eps": 0.25}})
    return spark.createDataFrame([(run.version, run.n_iterations, run.eps, run.axes["vpar"].lo, run.axes["vpar"].hi, len(run.species))], "version string, n_iterations int, eps double, vpar_min double, vpar_max double, n_species int")


@query("SELECT path, regexp_matches(path, '\\.ya?ml$') AS accepted FROM (VALUES ('a.yaml'), ('b/c.yml'), ('d.json'), ('yaml')) AS t(path)")
def config_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, is_yaml(p)) for p in ("a.yaml", "b/c.yml", "d.json", "yaml")], "path string, accepted boolean")


@query("SELECT l AS line, i::INT AS ord FROM (SELECT unnest([repeat('=', 42), repeat(' ', 16) || 'velograph', repeat('=', 42), 'Number of kinetic species: 2', 'Grid sizes:', '  tor1: 18', '  tor2: 32', '  tor3: 32', '  vpar: 16', '  mu: 10', 'Performing in-situ-diagnostic', 'Number of iterations: 10']) AS l, unnest(range(0, 12)) AS i)")
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(simulate.opening(FULL))), "ord int, line string").select("line", "ord")


@query("SELECT (sp * 7 + i1)::INT AS part, sp::BIGINT AS start_sp, i1::BIGINT AS start_i1, 0::BIGINT AS start_im, 1::BIGINT AS extent_sp, 1::BIGINT AS extent_i1, 8::BIGINT AS extent_i2, 10::BIGINT AS extent_im FROM range(0, 2) AS a(sp), range(0, 7) AS b(i1)")
def local_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's own ranges, of a mesh dealt into planes of species and tor1."""
    r = exchange.local_ranges(generate.mesh(spark, GRID, 14))
    at = lambda c, n: F.col(c)[POINT.index(n)]
    return r.select("part", at("starts", "sp").alias("start_sp"), at("starts", "i1").alias("start_i1"), at("starts", "im").alias("start_im"), at("extents", "sp").alias("extent_sp"), at("extents", "i1").alias("extent_i1"), at("extents", "i2").alias("extent_i2"), at("extents", "im").alias("extent_im"))


@query("SELECT part, count(*)::BIGINT AS n FROM (SELECT (i2 // 4 * 2 + i3 // 4)::INT AS part FROM range(0, 2) AS a(sp), range(0, 7) AS b(i1), range(0, 8) AS c(i2), range(0, 8) AS d(i3), range(0, 160) AS e(v)) GROUP BY part")
def local_submesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh restricted to each part of a plan that splits tor2 and tor3 in two."""
    mesh, names = generate.mesh(spark, GRID), ("i2", "i3")
    plan = exchange.partition_plan(spark, [8, 8], [2, 2])
    inside = [F.col(n).cast("bigint").between(F.col("starts")[k], F.col("starts")[k] + F.col("extents")[k] - 1) for k, n in enumerate(names)]
    return mesh.join(generate.small(plan, 4), inside[0] & inside[1]).groupBy("part").agg(F.count("*").alias("n"))


@query(_values("(3::BIGINT, -1.0::DOUBLE)", "species, phony_dim_9"))
def renamed_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the names to change only those that are there."""
    t = spark.createDataFrame([(3, -1.0)], "phony_dim_0 bigint, phony_dim_9 double")
    return verify.rename_present(t, {"phony_dim_0": "species", "phony_dim_1": "tor1"})


@query("SELECT 10::BIGINT AS n, true AS inside, true AS again, 20::BIGINT AS n_distinct")
def random_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from [-1, 1), the same for the same seed."""
    drawn, twice = generate.random_shifts(spark, 10, 5), generate.random_shifts(spark, 10, 5)
    both = drawn.join(twice.select("iteration", F.col("shift_tor2").alias("a"), F.col("shift_tor3").alias("b")), "iteration")
    within = lambda c: (F.col(c) >= -1) & (F.col(c) < 1)
    return both.agg(F.count("*").alias("n"), F.bool_and(within("shift_tor2") & within("shift_tor3")).alias("inside"), F.bool_and((F.col("a") == F.col("shift_tor2")) & (F.col("b") == F.col("shift_tor3"))).alias("again"), (F.count_distinct("a") + F.count_distinct("b")).alias("n_distinct"))


@query(
    "SELECT ord::INT AS ord, event, n FROM (VALUES (0, 'Init', 0::BIGINT), (1, 'FluidMoments', 32), (2, 'own diagnostic', 32), (3, 'FluidMoments', 32), (4, 'own diagnostic', 32), (5, 'write_fluid_moments', 32)) AS t(ord, event, n)"
)
def events_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of two iterations hands to its hooks, in order, with the rows of each payload; two on one event."""
    seen: list[tuple[str, int]] = []
    events = Events()
    events.on("Init", lambda run: seen.append(("Init", 0)))
    events.on("FluidMoments", lambda iteration, moments: seen.append(("FluidMoments", moments.count())))
    events.on("FluidMoments", lambda iteration, moments: seen.append(("own diagnostic", moments.where(F.col("iteration") == iteration).count())))
    events.on("write_fluid_moments", lambda moments: seen.append(("write_fluid_moments", moments.count())))
    simulate.simulate(spark, Run(TINY.axes, TINY.species, n_iterations=2), generate.shift_table(spark, SHIFTS), files.scratch(spark, "run"), events)
    return spark.createDataFrame([(k, *x) for k, x in enumerate(seen)], "ord int, event string, n bigint")


# --- on the driver's tables ------------------------------------------------------------------------


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f on the cells of lineitem: species by flag and status, vpar by discount, mu by tax, space by line number."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    iv, im = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    return t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("species"), F.col("l_linenumber").cast("int").alias("i1"), iv.alias("iv"), im.alias("im")).agg(F.sum("l_quantity").alias("f"))


def _hundredths(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """The axis of a column's distinct hundredths, with its weights."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    points = t.select(F.round(F.col(column) * 100).cast("int").alias("idx")).distinct()
    axis = points.select(F.lit(column).alias("axis"), "idx", (F.col("idx") / 100.0).alias("coord"))
    return quadrature.trapezoid_weights(axis)


def _hundredths_sql(column: str) -> str:
    return f"(SELECT idx, x, 0.5::DOUBLE * (coalesce(lead(x) OVER (ORDER BY idx), x) - coalesce(lag(x) OVER (ORDER BY idx), x)) AS w FROM (SELECT DISTINCT round({column} * 100)::INT AS idx, round({column} * 100)::INT / 100.0::DOUBLE AS x FROM lineitem))"


_LINEITEM_F = "(SELECT l_returnflag || l_linestatus AS species, l_linenumber::INT AS i1, round(l_discount * 100)::INT AS iv, round(l_tax * 100)::INT AS im, sum(l_quantity) AS f FROM lineitem GROUP BY 1, 2, 3, 4)"
_LINEITEM_W = f"(SELECT species, i1, v.x AS vpar, v.w * m.w AS w, f FROM {_LINEITEM_F} q JOIN {_hundredths_sql('l_discount')} v ON q.iv = v.idx JOIN {_hundredths_sql('l_tax')} m ON q.im = m.idx)"
_LINEITEM_KEYS = "species, i1"
_LINEITEM_MOMENTS = _moments_sql(_LINEITEM_W, _LINEITEM_KEYS)


def _lineitem_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, m = _hundredths(spark, sf_dir, "l_discount"), _hundredths(spark, sf_dir, "l_tax")
    f = _lineitem(spark, sf_dir)
    f = f.join(v.select(F.col("idx").alias("iv"), F.col("coord").alias("vpar"), F.col("w").alias("wv")), "iv")
    f = f.join(m.select(F.col("idx").alias("im"), F.col("w").alias("wm")), "im")
    return f.select("species", "i1", "iv", "im", "vpar", (F.col("wv") * F.col("wm")).alias("w"), "f")


@query(f"SELECT idx, round(w, 9) + 0.0 AS w FROM {_hundredths_sql('l_discount')}")
def trapezoid_weights_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_hundredths(spark, sf_dir, "l_discount").select("idx", "w"), "w")


@query(f"SELECT idx, round(w, 9) + 0.0 AS w FROM {_hundredths_sql('l_tax')}")
def trapezoid_weights_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_hundredths(spark, sf_dir, "l_tax").select("idx", "w"), "w")


@query(_one("density", _LINEITEM_MOMENTS, _LINEITEM_KEYS))
def lineitem_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.density(_lineitem_weighted(spark, sf_dir), ("species", "i1")), "density")


@query(_one("mean_velocity", _LINEITEM_MOMENTS, _LINEITEM_KEYS))
def lineitem_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.mean_velocity(_lineitem_weighted(spark, sf_dir), ("species", "i1")), "mean_velocity")


@query(_one("temperature", _LINEITEM_MOMENTS, _LINEITEM_KEYS))
def lineitem_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.moments(_lineitem_weighted(spark, sf_dir), ("temperature",), ("species", "i1"), about=0.05), "temperature")


@query(_LINEITEM_MOMENTS)
def lineitem_fluid_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.moments(_lineitem_weighted(spark, sf_dir), keys=("species", "i1"), about=0.05), *moments.ALL)


@query(_LINEITEM_MOMENTS)
def lineitem_fluid_moments_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.moments(_lineitem_weighted(spark, sf_dir), keys=("species", "i1"), method="two_pass"), *moments.ALL)


_DENSE = f"SELECT s.species, c.i1, v.idx AS iv, m.idx AS im, coalesce(q.f, 0.0::DOUBLE)::DOUBLE AS f FROM (SELECT DISTINCT species FROM q) s, (SELECT DISTINCT i1 FROM q) c, {_hundredths_sql('l_discount')} v, {_hundredths_sql('l_tax')} m LEFT JOIN q ON q.species = s.species AND q.i1 = c.i1 AND q.iv = v.idx AND q.im = m.idx"


@query(f"WITH q AS {_LINEITEM_F} {_DENSE}")
def lineitem_dense_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f on the product of its own axes, 0 where no row falls."""
    f = _lineitem(spark, sf_dir)
    grid = f.select("species").distinct().crossJoin(f.select("i1").distinct()).crossJoin(f.select("iv").distinct()).crossJoin(f.select("im").distinct())
    return grid.join(f, ["species", "i1", "iv", "im"], "left").select("species", "i1", "iv", "im", F.coalesce("f", F.lit(0.0)).cast("double").alias("f"))


@query(
    "WITH p AS (SELECT vec_id, i - 1 AS k, embedding[i]::DOUBLE AS f FROM embeddings, range(1, 65) AS t(i)), q AS (SELECT vec_id, f * f AS f, (k - 31.5) / 31.5 AS x, (CASE WHEN k IN (0, 63) THEN 0.5 ELSE 1.0 END) / 31.5 AS w FROM p), "
    "g AS (SELECT vec_id, sum(w * f) AS m0, sum(w * f * x) / sum(w * f) AS u FROM q GROUP BY vec_id) "
    "SELECT q.vec_id, round(any_value(m0), 7) + 0.0 AS density, round(any_value(u), 7) + 0.0 AS mean_velocity, round(sum(w * f * (x - u) * (x - u)) / any_value(m0), 7) + 0.0 AS temperature FROM q JOIN g ON q.vec_id = g.vec_id GROUP BY q.vec_id"
)
def moments_block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the squared embedding over an axis from -1 to 1: nothing is shuffled."""
    n = 64
    x = [(k - (n - 1) / 2) / ((n - 1) / 2) for k in range(n)]
    w = [(0.5 if k in (0, n - 1) else 1.0) / ((n - 1) / 2) for k in range(n)]
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    blocks = t.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * v.cast("double")).alias("f"))
    return rounded(moments.block_moments(blocks, w, x, ("vec_id",)), *moments.ALL, digits=7)


@query(
    "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(sum(value), 4) + 0.0 AS density, round(sum(value * h) / sum(value), 7) + 0.0 AS mean_velocity FROM (SELECT event_type, ts, value, extract(hour FROM ts)::DOUBLE AS h FROM events) GROUP BY 1, 2"
)
def events_moments_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-situ diagnostics with the day as iteration: moments over the hour of day."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", F.hour("ts").cast("double").alias("h"))
    v = F.col("value")
    sums = t.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.sum(v).alias("density"), F.sum(v * F.col("h")).alias("m1"))
    out = sums.select("event_type", "day", "n", steady(F.col("density"), 4).alias("density"), ieee_div(F.col("m1"), F.col("density")).alias("mean_velocity"))
    return rounded(out, "mean_velocity", digits=7)


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(s), 3) + 0.0 AS total FROM (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6::DOUBLE AS s FROM events) WHERE s IS NOT NULL GROUP BY user_id")
def events_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations between the time points of each user."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.expr("CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts) AS DOUBLE) / 1e6")
    laps = timing.durations(t.select("user_id", F.struct("ts", "event_id").alias("ord"), at.alias("t")), by=("user_id",))
    return laps.groupBy("user_id").agg(F.count("*").alias("n"), steady(F.sum("seconds"), 3).alias("total"))


@query("SELECT a::DOUBLE AS a, b::DOUBLE AS b, CASE WHEN b <> 0 THEN a / b WHEN a > 0 THEN 'inf'::DOUBLE WHEN a < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS q FROM (VALUES (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)) AS t(a, b)")
def ieee_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    return t.select("a", "b", ieee_div(F.col("a"), F.col("b")).alias("q"))


@query(f"SELECT {_CELLS}, i AS pos, round(x[i + 1], 12) + 0.0 AS f FROM (SELECT {_CELLS}, list(f ORDER BY iv, im) AS x FROM {_f_sql()} WHERE i1 = 0 AND i2 = 0 AND i3 = 0 GROUP BY {_CELLS}), range(0, 160) AS t(i)".replace("i AS pos", "i::INT AS pos"))
def labelled_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat array given its indices again, and flattened once more."""
    f = exchange.hyperslab(distribution.initial(spark, GRID), {"i1": 0, "i2": 0, "i3": 0}, {"i1": 1, "i2": 1, "i3": 1})
    flat = f.groupBy().agg(F.array_sort(F.collect_list(F.struct(*POINT, "f"))).alias("x")).select(F.transform("x", lambda r: r["f"]).alias("raw"))
    long = generate.labelled(flat, "raw", [2, 1, 1, 1, 16, 10])
    return rounded(long.select(*CELL, (F.col("iv") * 10 + F.col("im")).cast("int").alias("pos"), "f"), "f", digits=12)


# --- runs that a table configures --------------------------------------------------------------------


_TABLE_SPECIES = """(SELECT (row_number() OVER (ORDER BY name) - 1)::INT AS sp, name, CASE WHEN name LIKE '%F' THEN -1.0 ELSE 1.0 END::DOUBLE AS charge, round(q, 6) + 0.0 AS mass, round(n / (SELECT count(*) FROM lineitem), 9) + 0.0 AS n_maxw, round(1 + 100 * v, 9) + 0.0 AS t_maxw, round(d * 20 - 1, 9) + 0.0 AS upar_maxw
 FROM (SELECT l_returnflag || l_linestatus AS name, count(*)::DOUBLE AS n, avg(l_quantity) AS q, avg(l_discount) AS d, var_pop(l_discount) AS v FROM lineitem GROUP BY 1))"""
_TABLE_SHIFTS = "(SELECT month(l_shipdate)::INT AS iteration, round(avg(l_discount) * 20 - 1, 9) AS shift_tor2, round(avg(l_tax) * 25 - 1, 9) AS shift_tor3 FROM lineitem GROUP BY 1)"


def _table_run(spark: SparkSession, sf_dir: str, version: str, n_iterations: int = 0) -> tuple[Run, DataFrame]:
    """A configuration with a species for each flag and status of lineitem, by its share of the rows and its discounts; and
    the shifts of each month. A row for each kind is what the driver gets."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kinds = t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.var_pop("l_discount").alias("v")).orderBy("name").collect()
    total = sum(r.n for r in kinds)
    species = [{"name": r.name, "charge": -1 if r.name.endswith("F") else 1, "mass": round(r.q, 6), "N_maxw": round(r.n / total, 9), "T_maxw": round(1 + 100 * r.v, 9), "Upar_maxw": round(r.d * 20 - 1, 9)} for r in kinds]
    mesh = {f"{key}_{part}": x for n, (_, _, key) in KINDS.items() for part, x in (("ncells", TINY.axes[n].ncells), ("min", TINY.axes[n].lo), ("max", TINY.axes[n].hi))}
    run = from_mapping({"SplineMesh": mesh, "SpeciesInfo": species, "Application": {"version": version, "n_iterations": n_iterations, "eps": TINY.eps}})
    months = t.groupBy(F.month("l_shipdate").alias("iteration")).agg(F.round(F.avg("l_discount") * 20 - 1, 9).alias("shift_tor2"), F.round(F.avg("l_tax") * 25 - 1, 9).alias("shift_tor3"))
    return run, months


@query(f"SELECT sp, name, charge, mass FROM {_TABLE_SPECIES}")
def lineitem_run_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species of a run that lineitem configures, as its store has them."""
    run, _ = _table_run(spark, sf_dir, "mpi_transpose")
    top = files.scratch(spark, "mesh")
    files.write_mesh(spark, run, top)
    return files.read_species(spark, top).select("sp", "name", "charge", "mass")


@query(_moments_sql(_f_sql(TINY, _TABLE_SPECIES), _CELLS))
def lineitem_run_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments that a run in its first mode leaves, of species that lineitem gives."""
    run, shifts = _table_run(spark, sf_dir, "mpi_transpose")
    return rounded(simulate.simulate(spark, run, shifts, files.scratch(spark, "run")), *moments.ALL)


@query(
    _moments_sql(
        f"(SELECT 0 AS iteration, {_CELLS}, vpar, w, f FROM {_f_sql(TINY, _TABLE_SPECIES)} UNION ALL SELECT iteration, {_CELLS}, vpar, w, f * {_factor_sql(TINY)} AS f FROM {_f_sql(TINY, _TABLE_SPECIES)}, {_TABLE_SHIFTS} WHERE iteration < 4)",
        f"iteration, {_CELLS}",
    )
)
def lineitem_run_in_situ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of a run's iterations in its second mode, with species and shifts that lineitem gives."""
    run, shifts = _table_run(spark, sf_dir, "in-situ-diagnostic", 4)
    top = files.scratch(spark, "run")
    simulate.simulate(spark, run, files.kept(shifts, "shifts"), top)
    return rounded(files.read_in_situ(spark, top).select("iteration", *CELL, *moments.ALL), *moments.ALL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all moments of the distribution of lineitem."""
    return lineitem_fluid_moments(spark, sf_dir)
