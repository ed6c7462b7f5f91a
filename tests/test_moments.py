import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velograph.config import Run, Species
from velograph.functions.numeric import ieee_div
from velograph.operators import distribution, moments, quadrature, verify
from velograph.plans import simulate
from velograph.sources import generate

TINY = Run().with_cells(tor1=1, tor2=2, tor3=2)
#: By independent arithmetic, on 16 x 10 points of velocity.
GOLDEN = {0: (0.3291947074984653, 0.0, 1.000000012660128), 1: (0.32917350779534565, 2.9997405626649556, 0.9990175465457137)}


def test_golden_values(spark):
    rows = simulate.moments_of(distribution.initial(spark, TINY), spark, TINY).collect()
    assert len(rows) == 2 * 4 * 2 * 2
    for r in rows:
        n, u, t = GOLDEN[r.sp]
        assert r.density == pytest.approx(n, rel=1e-12)
        assert r.mean_velocity == pytest.approx(u, rel=1e-12, abs=1e-14)
        assert r.temperature == pytest.approx(t, rel=1e-12)


def test_paths_agree(spark):
    f = distribution.initial(spark, TINY)
    one = simulate.moments_of(f, spark, TINY)
    two = simulate.moments_of(f, spark, TINY, method="two_pass")
    w, v = moments.weight_arrays(quadrature.velocity_weights(spark, TINY))
    block = moments.block_moments(moments.to_blocks(f), w, v)
    for other in (two, block):
        assert verify.max_abs_error(one, other).first().max_abs_error < 1e-12
    assert verify.unmatched(one, two).first().asDict() == {"only_a": 0, "only_b": 0}


def test_plans(spark):
    f = quadrature.weighted(distribution.initial(spark, TINY), quadrature.velocity_weights(spark, TINY), 160)
    plan = moments.one_pass(f)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    blocks = spark.range(1).select(F.lit(1).alias("k"), F.array(F.lit(1.0), F.lit(2.0)).alias("f"))
    assert "Exchange" not in moments.block_moments(blocks, [0.5, 0.5], [0.0, 1.0], ("k",))._jdf.queryExecution().executedPlan().toString()


def test_perturbation_scales_density_alone(spark):
    shifts = generate.shift_table(spark, [(1, 0.25, -0.5)])
    base = simulate.moments_of(distribution.initial(spark, TINY), spark, TINY)
    moved = simulate.moments_of(simulate.state(spark, TINY, shifts, 1), spark, TINY)
    cells = {(r.sp, r.i1, r.i2, r.i3): r for r in base.collect()}
    for r in moved.collect():
        b = cells[r.sp, r.i1, r.i2, r.i3]
        k = 1 + TINY.eps * math.cos(2 * math.pi * (r.i2 / 2 - 0.25)) * math.cos(2 * math.pi * (r.i3 / 2 + 0.5))
        assert r.density == pytest.approx(b.density * k, rel=1e-12)
        assert r.mean_velocity == pytest.approx(b.mean_velocity, abs=1e-12)
        assert r.temperature == pytest.approx(b.temperature, rel=1e-12)


def test_in_situ_states(spark):
    run = Run(TINY.axes, TINY.species, n_iterations=3)
    shifts = generate.random_shifts(spark, 3, 7)
    drawn = shifts.collect()
    assert [r.iteration for r in drawn] == [1, 2, 3] and all(-1 <= x < 1 for r in drawn for x in (r.shift_tor2, r.shift_tor3))
    found = simulate.in_situ(spark, run, generate.shift_table(spark, [tuple(r) for r in drawn]))
    assert sorted(r.iteration for r in found.select("iteration").distinct().collect()) == [0, 1, 2]
    zero = found.where("iteration = 0").drop("iteration")
    assert verify.max_abs_error(zero, simulate.moments_of(distribution.initial(spark, run), spark, run)).first().max_abs_error < 1e-12
    assert simulate.in_situ(spark, Run(TINY.axes, TINY.species, n_iterations=0), shifts).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=2, max_size=12, unique=True))
def test_weights(spark, points):
    xs = [p / 7 for p in sorted(points)]
    rows = [("a", i, x, False) for i, x in enumerate(xs)] + [("b", i, x, False) for i, x in enumerate(reversed(xs))]
    w = quadrature.trapezoid_weights(spark.createDataFrame(rows, "axis string, idx int, coord double, periodic boolean"))
    sums = {r.axis: r.s for r in w.groupBy("axis").agg(F.sum("w").alias("s")).collect()}
    assert sums["a"] == pytest.approx(xs[-1] - xs[0]) and sums["b"] == pytest.approx(xs[0] - xs[-1])
    linear = w.where("axis = 'a'").agg(F.sum(F.col("w") * (2 * F.col("coord") + 1)).alias("s")).first().s
    assert linear == pytest.approx(xs[-1] ** 2 - xs[0] ** 2 + xs[-1] - xs[0])


def test_axis_checks():
    for bad in ([1.0], [0.0, 0.0], [0.0, 1.0, 0.5], [0.0, float("nan")]):
        with pytest.raises(ValueError):
            quadrature.check_axis(bad)
    quadrature.check_axis([3.0, 1.0])


def test_nan_and_zero(spark):
    f = spark.createDataFrame([(0, 0.0, 1.0, 1.0), (0, 1.0, 1.0, float("nan")), (1, 0.0, 1.0, 0.0), (2, 2.0, 1.0, float("nan"))], "k int, vpar double, w double, f double")
    spread = {r.k: r for r in moments.one_pass(f, ("k",)).collect()}
    assert math.isnan(spread[0].density) and spread[1].density == 0 and math.isnan(spread[1].mean_velocity)
    skipped = {r.k: r for r in moments.one_pass(f, ("k",), skipna=True).collect()}
    assert skipped[0].density == 1 and skipped[2].density == 0
    q = spark.createDataFrame([(1.0, 0.0), (-1.0, -0.0), (0.0, 0.0), (None, 1.0), (6.0, 3.0)], "a double, b double").select(ieee_div(F.col("a"), F.col("b")).alias("q"))
    got = [r.q for r in q.collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 2


def test_scaling_of_species(spark):
    run = Run(TINY.axes, (Species("a", 1, 1, 1, 2, 0), Species("b", 1, 1, 5, 2, 0)))
    rows = {r.sp: r for r in simulate.moments_of(distribution.initial(spark, run), spark, run).collect()}
    assert rows[1].density == pytest.approx(5 * rows[0].density)
    assert rows[1].temperature == pytest.approx(rows[0].temperature) and abs(rows[0].mean_velocity) < 1e-14


def test_exact_sums_are_taken_where_rows_are_dealt_to(spark):
    """No task has partial sums of cells but its own; a cell of many rows has them, and all bits stay the same."""
    plan = moments.exact(spark.range(9).selectExpr("id AS k", "1D AS w", "1D AS f", "1D AS vpar"), ("k",))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    f = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 501).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("l"), F.lit(0.1).alias("w"), F.exp(F.col("id") / 300).alias("f"), F.sin("id").alias("vpar"))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(moments._exact(f, ("k", "l"), F.lit(0.5), False))
    for most in (100, 1 << 21):
        assert rows(moments.exact(f, ("k", "l"), 0.5, rows=most, bins=1024)) == want
    assert moments.exact(f, ("k", "l"), rows=100, bins=1024)._jdf.queryExecution().executedPlan().toString().count("Union") == 1
    assert moments.exact(f.limit(0), ("k", "l")).count() == 0
