"""The two modes of a run, and the offline check of what they wrote.

State 0 is the Maxwellian; state k is state 0 perturbed by the k-th shifts. In-situ iteration i, from 0 to n - 1,
sees state i. The moments written are always those of state 0; the distribution written is state 0, or state
n of an in-situ run, which no iteration has seen.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.config import Run
from velograph.operators import distribution, exchange, moments, placement, quadrature, verify
from velograph.plans.events import Events
from velograph.plans.timing import Stopwatch
from velograph.schemas import CELL, POINT
from velograph.sources import files, generate

log = logging.getLogger(__name__)


def moments_of(f: DataFrame, spark: SparkSession, run: Run, keys: tuple[str, ...] = CELL, method: str = "one_pass") -> DataFrame:
    """All moments of a run's distribution, about each species's initial mean velocity."""
    f = quadrature.weighted_of(f, spark, run)
    about = F.element_at(F.array(*[F.lit(s.upar_maxw) for s in run.species]), F.col("sp") + 1)
    return moments.moments(f, keys=keys, method=method, about=about, cells=cells_of(run) if keys == CELL else None)


def cells_of(run: Run) -> int:
    """Cells of species and space."""
    return math.prod(run.extents[n] for n in ("species", "tor1", "tor2", "tor3"))


def state(spark: SparkSession, run: Run, shifts: DataFrame, k: int, f0: DataFrame | None = None) -> DataFrame:
    """The distribution of state k, of state 0 as given or made; iteration k must be in shifts, once, unless k is 0."""
    f = distribution.initial(spark, run) if f0 is None else f0
    return f if k == 0 else distribution.perturb(f, spark, run, shifts.where(F.col("iteration") == k), 1).select(*POINT, "f")


def states(spark: SparkSession, run: Run, shifts: DataFrame, f0: DataFrame | None = None) -> DataFrame:
    """iteration and distribution of states 0 to n - 1: state 0 as it is, the others by the shifts of their number.
    All come from state 0, so they are one plan: iteration is one more key."""
    f0 = distribution.initial(spark, run) if f0 is None else f0
    zero = f0.select(F.lit(0).alias("iteration"), *POINT, "f").where(F.lit(run.n_iterations > 0))
    later = shifts.where((F.col("iteration") > 0) & (F.col("iteration") < run.n_iterations))
    return zero.unionByName(distribution.perturb(f0, spark, run, later, max(run.n_iterations, 1)))


def in_situ(spark: SparkSession, run: Run, shifts: DataFrame, f0: DataFrame | None = None) -> DataFrame:
    """iteration, cell and moments: iteration i sees state i, for i from 0 to n - 1."""
    return moments_of(states(spark, run, shifts, f0), spark, run, ("iteration", *CELL))


def transposed(f: DataFrame, run: Run) -> DataFrame:
    """f in velocity split: each partition has one contiguous range of species, vpar and mu, and all of space."""
    axes = {c: run.extents[n] for c, n in (("sp", "species"), ("iv", "vpar"), ("im", "mu"))}
    parts = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placement.contiguous(f, placement.even_plan(axes, parts)).select(*exchange.TRANSPOSED, "f").sortWithinPartitions(*exchange.TRANSPOSED)


def opening(run: Run) -> list[str]:
    """The console's lines at a run's begin: banner, sizes, mode."""
    sizes = run.extents
    lines = ["=" * 42, "velograph".center(42).rstrip(), "=" * 42, f"Number of kinetic species: {sizes['species']}", "Grid sizes:"]
    lines += [f"  {n}: {sizes[n]}" for n in run.axes]
    lines += [f"Performing {run.version}"]
    return lines + ([f"Number of iterations: {run.n_iterations}"] if run.version == "in-situ-diagnostic" else [])


def simulate(spark: SparkSession, run: Run, shifts: DataFrame, top: str, events: Events | None = None) -> DataFrame:
    """A whole run: writes distribution, mesh, moments and timings under top; returns the moments of state 0.

    Each phase ends in a job that writes its result, which the next one reads: state 0; its transpose, or the
    in-situ moments; the moments of state 0; all that stays. Nothing is computed twice, and a lap is the phase's own time."""
    events, work = events or Events(), f"{top}/work"
    for line in opening(run):
        log.info(line)
    events.publish("Init", run=run)
    watch = Stopwatch()
    files.write_distribution(distribution.initial(spark, run), run, work, dealt=True)
    f0 = files.read_distribution(spark, work)
    watch.lap("initialisation")
    last = 0
    if run.version == "mpi_transpose":
        files.write_transposed(transposed(f0, run), top)
        events.publish("transposed", f=files.read_transposed(spark, top))
    else:
        files.write_in_situ(in_situ(spark, run, shifts, f0), top)
        found = files.read_in_situ(spark, top)
        for i in range(run.n_iterations):
            log.info("Iteration %d", i)
            events.publish("FluidMoments", iteration=i, moments=found.where(F.col("iteration") == i))
        last = run.n_iterations
    watch.lap(run.version)
    files.write_moments(moments_of(f0, spark, run), work)
    result = files.read_moments(spark, work)
    watch.lap("fluid_moments")
    watch.lap("gpu2cpu")  # one memory space: nothing to copy
    files.write_distribution(state(spark, run, shifts, last, f0), run, top, dealt=True)
    files.write_moments(result, top)
    events.publish("write_fluid_moments", moments=files.read_moments(spark, top))
    watch.lap("write")
    names, seconds = watch.table()
    for name, x in zip(names, seconds, strict=True):
        log.info("Time %s: %fs", name, x)
    files.write_timing(spark, names, seconds, top)
    files.remove(spark, work)
    return files.read_moments(spark, top)


def verify_run(spark: SparkSession, run: Run, top: str) -> DataFrame:
    """Recomputes moments from the stored distribution, writes them, and compares them with the stored ones. By two
    passes, or by one where the cells are too many to be broadcast; f isn't shuffled by either."""
    method = "two_pass" if cells_of(run) <= generate.SMALL else "one_pass"
    again = moments_of(files.read_distribution(spark, top), spark, run, method=method)
    files.write_moments(again, top, "fluid_moments_verified")
    return verify.max_abs_error(files.read_moments(spark, top, "fluid_moments_verified"), files.read_moments(spark, top))


def register_views(spark: SparkSession, run: Run) -> None:
    """The run's tables as temporary views, for SQL."""
    views = {"species": generate.species_table(spark, run), "axis": generate.axis_table(spark, run), "quadrature_weights": quadrature.velocity_weights(spark, run), "fdistribu": distribution.initial(spark, run)}
    views["fluid_moments"] = moments_of(views["fdistribu"], spark, run)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
