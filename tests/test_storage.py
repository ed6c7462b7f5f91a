import logging

import pytest
from pyspark.sql import functions as F

from velograph.config import Run
from velograph.operators import distribution, exchange, moments, quadrature, verify
from velograph.plans import simulate
from velograph.plans.events import Events
from velograph.schemas import POINT
from velograph.sources import files, generate
from velograph.streaming import insitu

TINY = Run().with_cells(tor1=1, tor2=2, tor3=2)


def _rows(df):
    return sorted(map(tuple, df.select(*POINT, "f").collect()))


def test_transpose(spark):
    f = distribution.initial(spark, TINY)
    there = exchange.transpose_v2d(f, 3)
    assert there.columns[:6] == list(exchange.TRANSPOSED) and there.rdd.getNumPartitions() == 3
    assert _rows(exchange.transpose_back(there)) == _rows(f)
    blocks = exchange.transpose_blocks(f)
    assert blocks.count() == 2 * 16 * 10 and blocks.where(F.size("f") != 16).count() == 0


def test_partition_plan_covers(spark):
    plan = exchange.partition_plan(spark, [5, 4, 3], [2, 3, 1]).collect()
    cells = [(i, j, k) for p in plan for i in range(p.starts[0], p.starts[0] + p.extents[0]) for j in range(p.starts[1], p.starts[1] + p.extents[1]) for k in range(p.starts[2], p.starts[2] + p.extents[2])]
    assert len(plan) == 6 and len(cells) == len(set(cells)) == 60
    with pytest.raises(ValueError):
        exchange.partition_plan(spark, [5], [0])


def test_local_ranges(spark):
    f = exchange.velocity_split(distribution.initial(spark, TINY), 4)
    rows = exchange.local_ranges(f).collect()
    assert 1 <= len(rows) <= 4 and all(len(r.starts) == 6 for r in rows)


@pytest.mark.parametrize("mode", ["mpi_transpose", "in-situ-diagnostic"])
def test_whole_run(spark, tmp_path, mode, caplog):
    run = Run(TINY.axes, TINY.species, version=mode, n_iterations=2)
    shifts, seen, events = generate.shift_table(spark, [(1, 0.1, 0.2), (2, -0.4, 0.3)]), [], Events()
    for name in ("Init", "FluidMoments", "transposed"):
        events.on(name, lambda name=name, **data: seen.append(name))
    top = str(tmp_path / "run")
    result = simulate.simulate(spark, run, shifts, top, events)
    assert result.count() == 32 and "Init" in seen and ("transposed" if mode == "mpi_transpose" else "FluidMoments") in seen
    stored = files.read_distribution(spark, top)
    expected = simulate.state(spark, run, shifts, 0 if mode == "mpi_transpose" else 2)
    assert _rows(stored) == _rows(expected)
    box = files.read_distribution(spark, top, {"sp": 1, "i1": 2, "iv": 3}, {"sp": 1, "i1": 1, "iv": 2})
    assert box.count() == 1 * 1 * 2 * 2 * 2 * 10
    assert "PartitionFilters: [isnotnull(sp" in box._jdf.queryExecution().executedPlan().toString()
    text = files.read_timing(spark, top)
    assert mode in text and "total" in text
    assert files.read_extents(spark, top)["mu"] == [10] and files.axis_size(spark, top, "vpar") == 16
    assert files.read_breakpoints(spark, top, "mu").count() == 10 and files.read_species(spark, top).count() == 2
    if mode == "mpi_transpose":
        assert simulate.verify_run(spark, run, top).first().max_abs_error < 1e-12
        with caplog.at_level(logging.WARNING):
            files.write_moments(result, str(tmp_path / "other"))
            files.write_moments(distribution.initial(spark, run), str(tmp_path / "other"))
        assert "replacing" in caplog.text
    else:
        assert files.read_in_situ(spark, top).select("iteration").distinct().count() == 2
        last = files.read_in_situ(spark, top, last=True)
        assert "velocity" in last.columns and last.select("iteration").distinct().collect()[0][0] == 1


def test_each_phase_does_its_work(spark, tmp_path, monkeypatch):
    """A lap has jobs of its own, but for the copy between memories, which there is none of; the transpose is stored."""
    run, top, jobs = Run(TINY.axes, TINY.species, version="mpi_transpose"), str(tmp_path / "run"), []
    count = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    lap = simulate.Stopwatch.lap
    monkeypatch.setattr(simulate.Stopwatch, "lap", lambda self, name: (jobs.append((name, count())), lap(self, name)))
    before = count()
    simulate.simulate(spark, run, generate.shift_table(spark, [(1, 0.1, 0.2)]), top)
    done = [n for _, n in jobs]
    assert [name for name, a, b in zip([n for n, _ in jobs], [before, *done], done, strict=False) if a == b] == ["gpu2cpu"]
    there = files.read_transposed(spark, top)
    assert there.columns[:6] == list(exchange.TRANSPOSED) and _rows(there) == _rows(distribution.initial(spark, run))
    rows = {r.name: r.seconds for r in files.timing_table(spark, top).collect()}
    assert rows["total"] == pytest.approx(sum(v for k, v in rows.items() if k != "total")) and not files.exists(spark, f"{top}/work")


def test_verify_shuffles_partial_sums_alone(spark, tmp_path):
    """No exchange has a row of f: each is over an aggregate, or a broadcast."""
    files.write_distribution(distribution.initial(spark, TINY), TINY, str(tmp_path), dealt=True)
    f = files.read_distribution(spark, str(tmp_path))
    for method in ("two_pass", "one_pass"):
        plan = simulate.moments_of(f, spark, TINY, method=method)._jdf.queryExecution().executedPlan().toString().split("\n")
        below = [plan[k + 1] for k, line in enumerate(plan) if "Exchange hashpartitioning(sp" in line]
        assert below and all("HashAggregate" in line for line in below) and not any("SortMergeJoin" in line for line in plan)


def test_block_store(spark, tmp_path):
    f = distribution.initial(spark, TINY)
    files.write_blocks(moments.to_blocks(f), str(tmp_path))
    blocks = files.read_blocks(spark, str(tmp_path))
    w, v = moments.weight_arrays(quadrature.velocity_weights(spark, TINY))
    found = moments.block_moments(blocks, w, v)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert verify.max_abs_error(found, simulate.moments_of(f, spark, TINY)).first().max_abs_error < 1e-12


def test_relative_errors(spark):
    a = spark.createDataFrame([(0, 2.0, 0.0), (1, 3.0, float("nan"))], "k int, x double, y double")
    b = spark.createDataFrame([(0, 4.0, 0.0), (1, -3.0, 1.0)], "k int, x double, y double")
    rows = {r.variable: r for r in verify.by_variable(a, b, ("k",)).collect()}
    assert rows["x"].max_rel_error == 2.0 and rows["x"].max_abs_error == 6.0 and rows["y"].max_rel_error is None and rows["y"].n_nan == 1


def test_programs(spark, tmp_path, capsys):
    """run, verify and timing, and what makes them fail."""
    import yaml

    from tests.test_config import TREE
    from velograph.__main__ import main

    top = str(tmp_path / "out")
    a, b, c = tmp_path / "a.yaml", tmp_path / "b.yaml", tmp_path / "c.yml"
    a.write_text(yaml.safe_dump(TREE))
    b.write_text(yaml.safe_dump({"folder": top, "seed": 3, "tolerance": 1e-9}))
    c.write_text("seed: 1\n")
    with pytest.raises(SystemExit):
        main(["verify", str(a), str(b)])
    assert main(["run", str(a), str(b)]) == 0 and main(["verify", str(a), str(b)]) == 0 and main(["timing", top]) == 0
    said = capsys.readouterr().out
    assert "Max Abs Error: " in said and "mpi_transpose" in said and "total" in said
    b.write_text(yaml.safe_dump({"folder": top, "tolerance": -1.0}))
    assert main(["verify", str(a), str(b)]) == 1 and main([]) == 1 and main(["what"]) == 1
    for bad in (["run", str(a)], ["run", str(a), str(c)], ["timing", str(tmp_path / "none")]):
        with pytest.raises(SystemExit) as e:
            main(bad)
        assert e.value.code != 0


def test_timing_variants(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_timing(spark, ["a"], [1.0, 2.0], str(tmp_path))
    with pytest.raises(SystemExit):
        files.read_timing(spark, str(tmp_path / "none"))
    spark.createDataFrame([(0, "a")], "ord int, name string").write.parquet(str(tmp_path / "x" / files.TIMING))
    assert "seconds not found" in files.read_timing(spark, str(tmp_path / "x"))
    spark.createDataFrame([(0,)], "ord int").write.parquet(str(tmp_path / "y" / files.TIMING))
    assert "name not found" in files.read_timing(spark, str(tmp_path / "y"))
    raw = spark.createDataFrame([([bytearray(b"ab\0\0"), bytearray(b"c\0\0\0"), bytearray(b"d\0")], [1.0, 2.0])], "timing_names array<binary>, timing_values array<double>")
    assert [tuple(r) for r in files.timing_rows(raw).collect()] == [(0, "ab", 1.0), (1, "c", 2.0)]


def test_stream_matches_batch(spark, tmp_path):
    run = Run(TINY.axes, TINY.species, n_iterations=3)
    shifts = generate.shift_table(spark, [(1, 0.1, 0.2), (2, -0.4, 0.3)])
    folder = str(tmp_path / "shifts")
    for k in (1, 2):
        shifts.where(F.col("iteration") == k).coalesce(1).write.mode("append").parquet(folder)
    calls, events = [], Events()
    events.on("FluidMoments", lambda epoch: calls.append(epoch))
    insitu.run_stream(spark, run, folder, str(tmp_path / "out"), str(tmp_path / "cp"), events).awaitTermination(120)
    got = files.read_in_situ(spark, str(tmp_path / "out"))
    spark.createDataFrame([(0, 0.7, 0.9), (0, 0.7, 0.9)], "iteration int, shift_tor2 double, shift_tor3 double").coalesce(1).write.mode("append").parquet(folder)
    insitu.run_stream(spark, run, folder, str(tmp_path / "out"), str(tmp_path / "cp"), events).awaitTermination(120)
    got = files.read_in_situ(spark, str(tmp_path / "out"))
    want = simulate.in_situ(spark, run, shifts)
    assert len(calls) == 3 and want.where("iteration = 0").count() == 32
    assert verify.max_abs_error(got, want, ("iteration", "sp", "i1", "i2", "i3")).first().max_abs_error < 1e-12
    assert verify.unmatched(got, want, ("iteration", "sp", "i1", "i2", "i3")).first().asDict() == {"only_a": 0, "only_b": 0}


def test_views_and_labels(spark):
    simulate.register_views(spark, TINY)
    assert spark.sql("SELECT count(*) FROM fluid_moments WHERE sp = 1").first()[0] == 16
    assert verify.rename_present(spark.range(1).toDF("phony_dim_0"), {"phony_dim_0": "species", "x": "y"}).columns == ["species"]
    raw = spark.range(1).select(F.array(*[F.lit(float(k)) for k in range(6)]).alias("raw"))
    rows = generate.labelled(raw, "raw", [2, 3], ("a", "b")).collect()
    assert [(r.a, r.b, r.f) for r in rows] == [(k // 3, k % 3, float(k)) for k in range(6)]


def test_windowed_moments(spark):
    t = spark.sql("SELECT TIMESTAMP '2024-01-01 01:00:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 23:00:00', 'a', 4.0D")
    row = insitu.windowed_moments(t).first()
    assert row.n == 2 and row.density == 6.0
