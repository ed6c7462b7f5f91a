"""The initial distribution and its perturbation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.config import Run
from velograph.schemas import POINT
from velograph.sources import generate


def maxwellian(vpar: Column, mu: Column, n: Column, t: Column, u: Column) -> Column:
    """n (2 pi t)^(-3/2) exp(-((vpar - u)^2 / 2 + mu) / t), the magnetic moment with a plus sign and inside the half."""
    energy = F.lit(0.5) * ((vpar - u) * (vpar - u) + mu)
    return n * F.pow(F.lit(2 * math.pi) * t, F.lit(-1.5)) * F.exp(-energy / t)


def with_coordinate(f: DataFrame, spark: SparkSession, run: Run, axis: str, index: str) -> DataFrame:
    """f with the coordinate of an axis by index: by the axis's formula, or looked up; the column has the axis's name."""
    a = run.axes[axis]
    if a.kind != "greville":
        return f.withColumn(axis, F.lit(a.lo) + F.col(index) * F.lit(a.length / a.ncells))
    table = generate.axis_table(spark, run, axis).select(F.col("idx").alias(index), F.col("coord").alias(axis))
    return f.join(generate.small(table, len(a.points)), index)


def initial(spark: SparkSession, run: Run, partitions: int | None = None) -> DataFrame:
    """State 0: the Maxwellian of each species at every point of the mesh."""
    f = generate.mesh(spark, run, partitions)
    if len(run.species) <= generate.LISTED:
        f = f.withColumns({c: generate.listed([getattr(s, c) for s in run.species], F.col("sp")) for c in ("n_maxw", "t_maxw", "upar_maxw")})
    else:
        species = generate.species_table(spark, run).select("sp", "n_maxw", "t_maxw", "upar_maxw")
        f = f.join(generate.small(species, len(run.species)), "sp")
    f = with_coordinate(with_coordinate(f, spark, run, "vpar", "iv"), spark, run, "mu", "im")
    c = F.col
    return f.select(*POINT, maxwellian(c("vpar"), c("mu"), c("n_maxw"), c("t_maxw"), c("upar_maxw")).alias("f"))


def factor(run: Run, tor2: Column, tor3: Column, s2: Column, s3: Column, eps: Column | float | None = None) -> Column:
    """1 + eps cos(2 pi (tor2 / L2 - s2)) cos(2 pi (tor3 / L3 - s3)); tor2 and tor3 aren't taken from their start."""
    e, l2, l3 = run.eps if eps is None else eps, run.axes["tor2"].length, run.axes["tor3"].length
    wave = lambda x, length, s: F.cos(F.lit(2 * math.pi) * (x / F.lit(length) - s))
    return F.lit(1.0) + (e if isinstance(e, Column) else F.lit(e)) * wave(tor2, l2, s2) * wave(tor3, l3, s3)


def perturb(f: DataFrame, spark: SparkSession, run: Run, shifts: DataFrame, n_shifts: int, eps: Column | float | None = None) -> DataFrame:
    """States k of state 0, each from state 0 anew: a row for each point and iteration of shifts."""
    f = with_coordinate(with_coordinate(f, spark, run, "tor2", "i2"), spark, run, "tor3", "i3")
    spread = f.crossJoin(generate.small(shifts, n_shifts))
    c = F.col
    return spread.select("iteration", *POINT, (c("f") * factor(run, c("tor2"), c("tor3"), c("shift_tor2"), c("shift_tor3"), eps)).alias("f"))
