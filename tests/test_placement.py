"""Contiguous exchange, co-located tables, Z-order, exact sums."""

import glob
import itertools
import math
import random
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from velograph.config import Run
from velograph.functions import exact
from velograph.operators import distribution, exchange, moments, placement, zorder
from velograph.plans import simulate, table_queries
from velograph.sources import buckets

SF = "/root/testdata/sf0.001"


def _skewed(spark, n=6000):
    """A third of all rows have i1 = 4; of the rest some axes are sparse."""
    k = F.col("id")
    i1 = F.when(k % 3 == 0, 4).otherwise((k * 7919 % 40)).cast("int")
    return spark.range(n).select(i1.alias("i1"), (k * 104729 % 97).cast("int").alias("i2"), (k % 5).cast("int").alias("i3"), k.cast("double").alias("f")).where("i1 <> 11")


AXES = {"i1": 40, "i2": 97, "i3": 5}


@pytest.mark.parametrize("parts", [1, 2, 7, 30])
def test_every_partition_is_its_box(spark, parts):
    f = _skewed(spark).repartition(5)
    plan = placement.balanced_plan(f, AXES, parts)
    placed = placement.contiguous(f, plan)
    found = {r.part: (tuple(r.starts), tuple(r.extents)) for r in exchange.local_ranges(placed, tuple(AXES)).collect()}
    assert found == {k: x for k, x in enumerate(zip(plan.starts, plan.extents, strict=True))}
    assert {(r.part, tuple(r.starts)) for r in plan.table(spark).collect()} == {(k, s) for k, (s, _) in found.items()}
    n = f.count()
    assert sum(plan.rows) == n and max(plan.rows) <= 2 * n / parts + n / 40 and len(plan) <= 2 * parts + 2
    assert placed.rdd.getNumPartitions() == len(plan)
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, f.collect()))


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 16, 33, 400])
def test_even_plans_cover_the_mesh_once(spark, parts):
    run = Run().with_cells(tor1=1, tor2=2, tor3=2, vpar=5, mu=4)
    axes = {"sp": 2, "iv": run.extents["vpar"], "im": run.extents["mu"]}
    plan = placement.even_plan(axes, parts)
    points = [p for s, e in zip(plan.starts, plan.extents, strict=True) for p in itertools.product(*[range(a, a + n) for a, n in zip(s, e, strict=True)])]
    assert len(points) == len(set(points)) == math.prod(axes.values()) == sum(plan.rows)
    assert min(parts, math.prod(axes.values())) <= len(plan) <= max(2 * parts, 1) and max(plan.rows) <= 2 * len(points) / min(parts, len(points)) + 1
    placed = placement.contiguous(distribution.initial(spark, run), plan)
    found = {r.part: (tuple(r.starts), tuple(r.extents)) for r in exchange.local_ranges(placed, tuple(axes)).collect()}
    assert found == dict(enumerate(zip(plan.starts, plan.extents, strict=True)))


def test_even_plan_of_a_long_axis(monkeypatch):
    monkeypatch.setattr(placement, "BINS", 8)
    plan = placement.even_plan({"a": 50, "b": 3}, 10)
    assert sum(plan.rows) == 150 and len(set(plan.bounds)) == len(plan)


def test_a_run_transposes_contiguously(spark):
    run = Run().with_cells(tor1=1, tor2=2, tor3=2, vpar=5, mu=4)
    f = distribution.initial(spark, run)
    out = simulate.transposed(f, run)
    ranges = exchange.local_ranges(out, ("sp", "iv", "im")).collect()
    assert len(ranges) >= 4 and sum(math.prod(r.extents) for r in ranges) == 2 * run.extents["vpar"] * run.extents["mu"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, f.select(*exchange.TRANSPOSED, "f").collect()))


def test_the_heavy_index_is_cut(spark):
    plan = placement.balanced_plan(_skewed(spark), AXES, 12)
    cut = [s for s, e in zip(plan.starts, plan.extents, strict=True) if s[0] <= 4 < s[0] + e[0] and e[0] == 1]
    assert len(cut) >= 4  # a third of twelve parts


def test_parts_do_not_overlap_and_rows_are_in_order(spark):
    plan = placement.balanced_plan(_skewed(spark), AXES, 9)
    rows = placement.contiguous(_skewed(spark), plan).select(F.spark_partition_id().alias("p"), *AXES).collect()
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in rows)


def test_bins_of_a_long_axis(spark, monkeypatch):
    monkeypatch.setattr(placement, "BINS", 8)
    f = _skewed(spark)
    plan = placement.balanced_plan(f, AXES, 6)
    placed = placement.contiguous(f, plan)
    assert {r.part: r.n for r in placement.filled_ranges(placed, tuple(AXES)).collect()} == dict(enumerate(plan.rows))


def test_odd_tables(spark):
    empty = placement.balanced_plan(_skewed(spark).where("false"), AXES, 4)
    assert len(empty) == 1 and placement.contiguous(_skewed(spark), empty).count() == _skewed(spark).count()
    f = spark.createDataFrame([(1, 1, 0), (None, 2, 0), (1, 1, 0), (39, 96, 4)], "i1 int, i2 int, i3 int")
    placed = placement.transpose(f, AXES, 2)
    assert placed.where(F.spark_partition_id() == 0).count() == 3 and placed.count() == 4
    with pytest.raises(ValueError):
        placement.balanced_plan(f, AXES, 0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_are_not_shuffled(spark):
    f = table_queries.weighted(spark.table(buckets.write_bucketed(table_queries.cells(spark, SF), table_queries.CELL, 4, "f")))
    two = buckets.moments_of(f, table_queries.CELL)
    assert "Exchange" not in _plan(two) and _plan(two).count("Bucketed: true") == 2
    assert "Exchange" in _plan(moments.two_pass(f.repartition(3), table_queries.CELL))
    stored = spark.table(buckets.write_bucketed(moments.one_pass(f, table_queries.CELL), table_queries.CELL, 4, "m"))
    compared = buckets.compare(two, stored, table_queries.CELL)
    assert _plan(compared).count("Exchange") == 1 and "Exchange hashpartitioning(variable" in _plan(compared)
    assert {r.variable: r.n for r in compared.collect()} == dict.fromkeys(moments.ALL, two.count())
    assert compared.agg(F.max("max_abs_error")).first()[0] < 1e-12


def test_z_order_reads_few_row_groups(spark, tmp_path):
    axes = {"a": 64, "b": 64, "c": 16, "d": 16}
    f = spark.range(60_000).select(*[(F.hash("id", F.lit(k)) % n + n).cast("int").alias(a) for k, (a, n) in enumerate(axes.items())], "id")
    f = f.select(*[(F.col(a) % n).alias(a) for a, n in axes.items()], "id").cache()
    starts, sizes = {"a": 8, "b": 20, "c": 4, "d": 0}, {"a": 8, "b": 8, "c": 4, "d": 8}
    near = lambda g: all(g(a)[0] < s + sizes[a] and g(a)[1] >= s for a, s in starts.items())

    def share(top):
        """Of all row groups those whose statistics allow rows of the box."""
        stats = []
        for name in glob.glob(f"{top}/*.parquet"):
            meta = pq.ParquetFile(name).metadata
            at = {meta.schema.column(k).name: k for k in range(len(axes))}
            stats += [near(lambda a, g=meta.row_group(k): (g.column(at[a]).statistics.min, g.column(at[a]).statistics.max)) for k in range(meta.num_row_groups)]
        return sum(stats) / len(stats), len(stats)

    top = str(tmp_path / "z")
    zorder.write_clustered(f, axes, top, partitions=64)
    f.orderBy("a").repartitionByRange(64, "a").write.parquet(str(tmp_path / "by_a"))
    clustered, n = share(f"{top}/rows")
    assert n == 64 and clustered < 0.1 and clustered < share(str(tmp_path / "by_a"))[0]
    read = zorder.files_of(spark, top, starts, sizes).count()
    assert read == round(clustered * 64)
    got = zorder.read_box(spark, top, starts, sizes)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in exchange.hyperslab(f, starts, sizes).collect())
    assert "GreaterThanOrEqual(a,8)" in _plan(got)
    assert zorder.read_box(spark, top, {"a": 70}, {"a": 3}).count() == 0
    with pytest.raises(ValueError):
        zorder.z_value({"a": 1 << 40, "b": 1 << 40})


def test_z_value_interleaves(spark):
    rows = spark.createDataFrame([(0b101, 0b1)], "a int, b int").select(zorder.z_value({"a": 8, "b": 2}).alias("z")).collect()
    assert rows[0].z == 0b1101  # a's highest bit, b's only one, then the rest of a


def test_moments_have_the_same_bits_for_any_partitioning(spark):
    f = table_queries.weighted(table_queries.points(spark, SF)).withColumn("f", F.col("f") * 1.1)
    bits = lambda df: sorted((*r[:3], *(struct.pack("<d", x) for x in r[3:])) for r in df.collect())
    found = [bits(moments.moments(f.repartition(n, F.rand(n)), keys=table_queries.CELL, method="exact", about=0.05)) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 50
    near = moments.moments(f, keys=table_queries.CELL, method="two_pass")
    assert all(abs(a[k] - b[k]) < 1e-9 for a, b in zip(sorted(near.collect(), key=lambda r: r[:3]), sorted(moments.moments(f, keys=table_queries.CELL, method="exact", about=0.05).collect(), key=lambda r: r[:3]), strict=True) for k in range(3, 6))


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e9])
def test_exact_sums_of_cancelling_terms(spark, scale):
    rng = random.Random(3)
    x = [rng.uniform(-1, 1) * scale * 10 ** rng.randint(-6, 0) for _ in range(3000)]
    x += [-v for v in x] + [scale * 1e-3, scale / 3]
    rng.shuffle(x)
    got = spark.createDataFrame([(v,) for v in x], "x double").repartition(9).agg(exact.exact_total(F.col("x"))).first()[0]
    assert abs(got - math.fsum(x)) <= 2e-16 * abs(math.fsum(x)) + len(x) * 2.0**-97


def test_exact_sums_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    cases = [([1.5, None], 1.5, 1.5), ([None], None, 0.0), ([nan, 1.0], nan, 1.0), ([inf, 1.0], inf, inf), ([-inf, inf], nan, nan), ([-0.0, 0.0], 0.0, 0.0), ([2.0**60, -1.0, -(2.0**60)], -1.0, -1.0)]
    rows = [(k, v) for k, (x, _, _) in enumerate(cases) for v in x]
    got = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(exact.exact_total(F.col("x")).alias("a"), exact.exact_total(F.col("x"), skipna=True).alias("b")).orderBy("k").collect()
    assert str([(r.a, r.b) for r in got]) == str([(a, b) for _, a, b in cases])
