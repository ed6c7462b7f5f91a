"""Versions, incremental moments, own diagnostics, tiles, digests, footers, figures of a write."""

import duckdb
import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from velograph.operators import digests, tiles
from velograph.plans import table_queries
from velograph.plans.diagnostics import Diagnostics
from velograph.plans.registry import ORACLES
from velograph.sources import files, footers, versions
from velograph.streaming import incremental

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- versions


def _failing(spark):
    return spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no more")).cast("bigint")).otherwise(F.col("id")).alias("id"))


def test_a_failed_writer_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_and_warn(spark.range(5), path)
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.replace_and_warn(_failing(spark), path)
    assert versions.read(spark, path).count() == 5 and versions.history(spark, path) == [1]
    files.replace_and_warn(spark.range(7), path)
    assert versions.read(spark, path).count() == 7 and versions.history(spark, path) == [1, 2]


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_and_warn(spark.range(5), path)
    begun = versions.read(spark, path)
    files.replace_and_warn(spark.range(9), path)
    assert begun.count() == 5 and versions.read(spark, path, 1).count() == 5 and versions.read(spark, path).count() == 9
    files.replace_and_warn(spark.range(2), path)
    assert versions.history(spark, path) == [2, 3]
    with pytest.raises(ValueError):
        versions.read(spark, path, 1)


def test_folders_of_failed_writers_go_with_their_number(spark, tmp_path):
    path = tmp_path / "t"
    versions.write(spark.range(1), str(path))
    with pytest.raises((PySparkException, Py4JJavaError)):
        versions.write(_failing(spark), str(path))
    assert len(list(path.glob("v00000002-*"))) == 1
    for k in range(3):
        versions.write(spark.range(k), str(path))
        versions.expire(spark, str(path), keep=2)
    assert sorted(p.name[:9] for p in path.glob("v*")) == ["v00000003", "v00000004"] and versions.read(spark, str(path)).count() == 2


def test_a_table_may_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_and_warn(spark.range(5), path)
    files.replace_and_warn(versions.read(spark, path).unionByName(spark.range(3)), path)
    assert versions.read(spark, path).count() == 8


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(5), path)
    with pytest.raises(versions.Conflict):
        versions.write(spark.range(6), path, version=1)
    with pytest.raises(versions.Conflict):
        versions._publish(spark, path, 1, "v00000001-other")
    assert versions.read(spark, path).count() == 5


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "p"))
    assert versions.read(spark, str(tmp_path / "p")).count() == 4


# --- incremental moments


def _state(df):
    return {r.k: (r.n, pytest.approx(r.mean, rel=1e-12, abs=1e-9), pytest.approx(r.m2, rel=1e-11, abs=1e-9)) for r in df.collect()}


def _whole(rows):
    out = {}
    for k in {k for k, _ in rows}:
        v = np.array([x for q, x in rows if q == k and x is not None])
        if len(v):
            out[k] = (len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum()))
    return out


def test_state_equals_the_batch_after_each_file_and_a_replay(spark, tmp_path):
    rng, top, seen = np.random.default_rng(2), str(tmp_path / "state"), []
    for number in range(4):
        rows = [(None if k == 3 else f"k{k}", float(v) if v > -3 else None) for k, v in zip(rng.integers(0, 4 + number, 60).tolist(), rng.normal(1e6 * (number == 2), 2, 60), strict=True)]
        batch = spark.createDataFrame(rows, "k string, v double")
        seen += rows
        incremental.take(batch, number, top, ("k",), "v")
        incremental.take(batch, number, top, ("k",), "v")  # once more, as after a failure
        assert _state(incremental.state(spark, top)) == _whole(seen)
    assert versions.history(spark, top) == [2, 3, 4]


def test_a_batch_needs_the_one_before(spark, tmp_path):
    with pytest.raises(ValueError):
        incremental.take(spark.createDataFrame([("a", 1.0)], "k string, v double"), 3, str(tmp_path / "s"), ("k",), "v")


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    top, rows = str(tmp_path), []
    for part in range(3):
        new = [(f"k{i % 5}", float(i * (part + 1))) for i in range(40)]
        rows += new
        df = spark.createDataFrame(new, "k string, v double")
        df.coalesce(1).write.mode("append").parquet(f"{top}/in")
        incremental.run(spark, f"{top}/in", df.schema, f"{top}/state", f"{top}/progress", ("k",), "v").awaitTermination()
        assert _state(incremental.state(spark, f"{top}/state")) == _whole(rows)


# --- diagnostics


def test_diagnostics_get_cells_in_order(spark):
    own = Diagnostics()
    own.register("ends", ("f", "i"), "first double, last double, n bigint, where bigint", 50)(lambda f, i: (f[0], f[-1], len(f), i[0]))
    df = spark.range(100).select((F.col("id") % 3).alias("c"), (100 - F.col("id")).cast("int").alias("i"), F.col("id").cast("double").alias("f")).repartition(7)
    got = {r.c: (r.ends_first, r.ends_last, r.ends_n, r.ends_where) for r in own.run(df, ("c",), order=("i",)).collect()}
    assert got == {0: (99.0, 0.0, 34, 1), 1: (97.0, 1.0, 33, 3), 2: (98.0, 2.0, 33, 2)}
    assert own.run(df.where("false"), ("c",), order=("i",)).collect() == []


def test_diagnostics_are_bounded_and_named(spark):
    own = Diagnostics()
    own.register("n", ("f",), "n bigint", 10)(len)
    with pytest.raises(ValueError, match="there is"):
        own.register("n", ("f",), "n bigint", 10)(len)
    with pytest.raises(ValueError, match="11 rows"):
        own.run(spark.range(11).select(F.lit(1).alias("c"), F.col("id").alias("f")), ("c",))
    with pytest.raises(ValueError, match="no diagnostic"):
        own.run(spark.range(1), ("id",), only=())


# --- tiles


@pytest.mark.parametrize("block,width", [(1, 1), (7, 3), (64, 5), (1000, 64)])
def test_tiles_there_and_back(spark, block, width):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(v) for v in rng.normal(size=13)]) for k in rng.permutation(50)] + [(70, None), (71, [1.0]), (72, [])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(4)
    t = tiles.to_tiles(df, "id", "v", 13, block=block, width=width)
    back = tiles.from_tiles(t, "id", "v").collect()
    assert {r.id: r.v for r in back} == {r.id: r.v for r in df.collect() if r.v and len(r.v) == 13} and len(back) == 50
    for r in tiles.dimensions(t, width).collect():
        assert list(r.ids) == sorted(r.ids) and r.values == [dict((b.id, b.v) for b in back)[i][r.dim] for i in r.ids]


def test_tiles_are_one_shuffle(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    there = tiles.to_tiles(t, "vec_id", "embedding", 64)
    assert _plan(there).count("Exchange hashpartitioning") == 1
    assert _plan(tiles.from_tiles(files.kept(there, "tiles"), "vec_id", "embedding")).count("Exchange hashpartitioning") == 1


def _shuffled(node):
    """Bytes that the shuffles of a plan have written."""
    own = node.metrics().apply("shuffleBytesWritten").value() if node.metrics().contains("shuffleBytesWritten") else 0
    return own + sum(_shuffled(node.children().apply(k)) for k in range(node.children().size()))


def test_tiles_shuffle_fewer_bytes_than_values(spark):
    """Of the same transposition: slices of vectors against a row for each value."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = spark.read.parquet(f"{SF}/embeddings.parquet")
        by_value = t.select((F.col("vec_id") / 1024).cast("bigint").alias("block"), "vec_id", F.posexplode("embedding").alias("dim", "x")).groupBy("block", "dim").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("x"))
        sizes = []
        for df in (tiles.to_tiles(t, "vec_id", "embedding", 64), by_value):
            df.collect()
            sizes.append(_shuffled(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < sizes[0] < sizes[1] / 1.5


# --- digests


LEVELS = [("i1",), ("i1", "i2"), ("i1", "i2", "species")]


def _tree(df):
    return digests.leaves(df, LEVELS[-1], ("species", "i1", "i2", "iv", "im", "f"))


def test_one_changed_point_is_found_by_few_joins(spark):
    a = table_queries.cells(spark, SF).cache()
    one = a.orderBy("i1", "i2", "species", "iv", "im").first()
    here = (F.col("i1") == one.i1) & (F.col("i2") == one.i2) & (F.col("species") == one.species) & (F.col("iv") == one.iv) & (F.col("im") == one.im)
    b = a.withColumn("f", F.when(here, F.col("f") + 1e-9).otherwise(F.col("f"))).repartition(5)
    got = digests.differing(_tree(a), _tree(b), LEVELS)
    assert [tuple(r) for r in got.groups.collect()] == [(one.i1, one.i2, one.species)]
    counts = [a.select("i1").distinct().count(), a.where(F.col("i1") == one.i1).select("i2").distinct().count(), a.where((F.col("i1") == one.i1) & (F.col("i2") == one.i2)).select("species").distinct().count()]
    assert got.joined == counts  # of hundreds of cells, those below what differs alone
    assert digests.rows_of(b, got.groups, LEVELS[-1]).count() < 20


def test_equal_tables_end_at_the_top(spark):
    a = table_queries.cells(spark, SF)
    got = digests.differing(_tree(a), _tree(a.repartition(3, F.rand(1))), LEVELS)
    assert got.groups.isEmpty() and got.joined[1:] == [0, 0]


def test_lost_doubled_and_null_groups(spark):
    rows = [(None, "x", 1), ("a", "x", 1), ("a", "y", 2), ("b", None, 3), ("c", "z", 4)]
    a = spark.createDataFrame(rows, "g string, h string, v int")
    levels = [("g",), ("g", "h")]
    leaves = lambda r: digests.leaves(spark.createDataFrame(r, "g string, h string, v int"), levels[-1], ("v",))
    find = lambda r: sorted((str(x.g), str(x.h)) for x in digests.differing(digests.leaves(a, levels[-1], ("v",)), leaves(r), levels).groups.collect())
    assert find(rows) == []
    assert find(rows[1:]) == [("None", "x")]
    assert find([*rows, ("d", "w", 5)]) == [("d", "w")]
    assert find([*rows, rows[3], rows[3]]) == [("b", "None")]
    assert find([*rows[:3], ("b", None, None), rows[4]]) == [("b", "None")]


# --- footers and figures


def test_ranges_come_from_footers(spark):
    df = footers.summary(spark, f"{SF}/lineitem.parquet", ("l_suppkey", "l_linenumber"))
    plan = _plan(df)
    assert "PushedAggregation: [COUNT(*), MIN(l_suppkey), MAX(l_suppkey), MIN(l_linenumber), MAX(l_linenumber)]" in plan
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert tuple(df.first()) == tuple(t.agg(F.count("*"), F.min("l_suppkey"), F.max("l_suppkey"), F.min("l_linenumber"), F.max("l_linenumber")).first())


def test_figures_are_taken_by_the_writing_job(spark, tmp_path):
    sc = spark.sparkContext
    sc.setJobGroup("observed", "")
    seen = files.write_observed(spark.range(1000, numPartitions=4), str(tmp_path / "t"), {"n": F.count("*"), "most": F.max("id")})
    jobs = sc.statusTracker().getJobIdsForGroup("observed")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen == {"n": 1000, "most": 999} and len(jobs) == 1 and versions.read(spark, str(tmp_path / "t")).count() == 1000


# --- phases


def test_timing_table_of_long_and_odd_phases(spark, tmp_path):
    """Sums of whole microseconds, written as printf writes doubles; a kind that is null, and one called total."""
    duck = duckdb.connect()
    rows = "(0, 1, '1200-01-01 00:00:00', 'long'), (1, 1, '9000-01-01 00:00:00.379', NULL), (2, 1, '9000-01-01 00:00:07.25', 'total'), (3, 1, '9000-01-01 00:01:00', 'short'), (4, 2, '2024-01-01 00:00:00', 'short'), (5, 2, '2024-01-01 00:00:00.0005', 'last')"
    duck.execute(f"COPY (SELECT a::BIGINT AS event_id, b::BIGINT AS user_id, c::TIMESTAMP AS ts, d::VARCHAR AS event_type FROM (VALUES {rows}) AS t(a, b, c, d)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = table_queries.events_timing_table(spark, str(tmp_path)).collect()
    assert got[0].line.startswith("long ") and got[0].line.endswith(".378998")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duck.execute(ORACLES["events_timing_table"]).fetchall()))
