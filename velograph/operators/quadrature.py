"""Trapezoid weights, and weighted sums over velocity space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.config import Run
from velograph.functions.numeric import total
from velograph.schemas import CELL
from velograph.sources import generate


def check_axis(points: list[float], name: str = "axis") -> None:
    """Raises unless the points are two at least, and strictly rising or falling."""
    if len(points) < 2:
        raise ValueError(f"{name} has {len(points)} point(s); trapezoid weights need two")
    steps = [b - a for a, b in zip(points, points[1:], strict=False)]
    if not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
        raise ValueError(f"{name} isn't strictly monotone")


def shift(column: str, by: int, *, axis: str = "axis", order: str = "idx") -> Column:
    """The value `by` places back along the axis (ahead, if negative); null beyond its ends."""
    return F.lag(column, by).over(Window.partitionBy(axis).orderBy(order)) if by >= 0 else F.lead(column, -by).over(Window.partitionBy(axis).orderBy(order))


def trapezoid_weights(axes: DataFrame, *, axis: str = "axis", order: str = "idx", coord: str = "coord") -> DataFrame:
    """axes with `w`: half the way between the neighbours, or from an end to its one neighbour. A falling axis
    has negative weights, a lone point 0. One window for all axes of the table."""
    ahead, back = shift(coord, -1, axis=axis, order=order), shift(coord, 1, axis=axis, order=order)
    return axes.withColumn("w", F.lit(0.5) * (F.coalesce(ahead, F.col(coord)) - F.coalesce(back, F.col(coord))))


def outer_weights(vpar: DataFrame, mu: DataFrame, mu_rows: int) -> DataFrame:
    """iv, im, vpar, mu, w: the product of two weighted axes (idx, coord, w)."""
    a = vpar.select(F.col("idx").alias("iv"), F.col("coord").alias("vpar"), F.col("w").alias("wv"))
    b = mu.select(F.col("idx").alias("im"), F.col("coord").alias("mu"), F.col("w").alias("wm"))
    return a.crossJoin(generate.small(b, mu_rows)).select("iv", "im", "vpar", "mu", (F.col("wv") * F.col("wm")).alias("w"))


def velocity_weights(spark: SparkSession, run: Run) -> DataFrame:
    """Weights of every (vpar, mu) point of a run."""
    for n in ("vpar", "mu"):
        check_axis(run.axes[n].points, n)
    w = trapezoid_weights(generate.axis_table(spark, run, "vpar", "mu"))
    return outer_weights(w.where("axis = 'vpar'"), w.where("axis = 'mu'"), run.extents["mu"])


def weighted(f: DataFrame, weights: DataFrame, n_weights: int | None = None) -> DataFrame:
    """f with vpar, mu and w of its (iv, im)."""
    return f.join(generate.small(weights, n_weights) if n_weights else weights, ["iv", "im"])


def axis_weights(points: list[float]) -> list[float]:
    """Trapezoid weights of an axis known beforehand, by the formula of trapezoid_weights."""
    return [0.5 * (points[min(i + 1, len(points) - 1)] - points[max(i - 1, 0)]) for i in range(len(points))]


def weighted_of(f: DataFrame, spark: SparkSession, run: Run) -> DataFrame:
    """f with vpar, mu and w of its (iv, im) on the axes of a run: from lists in the plan, or looked up if they are long."""
    vpar, mu = (run.axes[n].points for n in ("vpar", "mu"))
    for n, points in (("vpar", vpar), ("mu", mu)):
        check_axis(points, n)
    if max(len(vpar), len(mu)) > generate.LISTED:
        return weighted(f, velocity_weights(spark, run), len(vpar) * len(mu))
    at = generate.listed
    w = at(axis_weights(vpar), F.col("iv")) * at(axis_weights(mu), F.col("im"))
    return f.withColumns({"vpar": at(vpar, F.col("iv")), "mu": at(mu, F.col("im")), "w": w})


def integrate(f: DataFrame, integrand: Callable[[DataFrame], Column] | Column, keys: tuple[str, ...] = CELL, *, name: str = "integral", skipna: bool = False) -> DataFrame:
    """The weighted sum of an integrand over each cell; f has w. Partial sums come before the one shuffle."""
    value = integrand(f) if callable(integrand) else integrand
    return f.groupBy(*keys).agg(total(F.col("w") * value, skipna).alias(name))
