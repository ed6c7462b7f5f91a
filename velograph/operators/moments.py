"""Fluid moments of a distribution: density, mean velocity, temperature.

Four ways with equal results up to rounding: one pass of moments about a fixed velocity (one shuffle of
partial sums; the default), two passes (the central moment summed about the mean, as defined; two shuffles of
partial sums, as long as the cells' means are few enough to be broadcast), one pass of exact sums (the same bits for any
partitioning), and a block layout, where a cell's values are one array and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.functions.exact import exact_total
from velograph.functions.numeric import ieee_div, total
from velograph.schemas import CELL
from velograph.sources.generate import small

ALL = ("density", "mean_velocity", "temperature")


def density(f: DataFrame, keys: Sequence[str] = CELL, skipna: bool = False) -> DataFrame:
    """f has w. The sum of w f in each cell."""
    return f.groupBy(*keys).agg(total(F.col("w") * F.col("f"), skipna).alias("density"))


def mean_velocity(f: DataFrame, keys: Sequence[str] = CELL, skipna: bool = False) -> DataFrame:
    """The sum of w f vpar by the density."""
    wf = F.col("w") * F.col("f")
    sums = f.groupBy(*keys).agg(total(wf, skipna).alias("m0"), total(wf * F.col("vpar"), skipna).alias("m1"))
    return sums.select(*keys, ieee_div(F.col("m1"), F.col("m0")).alias("mean_velocity"))


def temperature(f: DataFrame, keys: Sequence[str] = CELL, skipna: bool = False) -> DataFrame:
    return moments(f, ("temperature",), keys, skipna=skipna)


def one_pass(f: DataFrame, keys: Sequence[str] = CELL, about: Column | float = 0.0, skipna: bool = False) -> DataFrame:
    """Moments about a velocity near the mean (a constant, or a column that each cell has one value of), so
    that the difference of squares loses few digits."""
    about = F.lit(about) if isinstance(about, float | int) else about
    wf, v = F.col("w") * F.col("f"), F.col("vpar") - about
    sums = f.groupBy(*keys).agg(total(wf, skipna).alias("m0"), total(wf * v, skipna).alias("m1"), total(wf * v * v, skipna).alias("m2"), F.first(about).alias("about"))
    m0, m1, m2 = (F.col(c) for c in ("m0", "m1", "m2"))
    d = ieee_div(m1, m0)
    return sums.select(*keys, m0.alias("density"), (F.col("about") + d).alias("mean_velocity"), (ieee_div(m2, m0) - d * d).alias("temperature"))


def two_pass(f: DataFrame, keys: Sequence[str] = CELL, skipna: bool = False, cells: int | None = None, colocated: bool = False) -> DataFrame:
    """First density and mean velocity, by partial sums; then the second moment about that mean. cells: how many there
    are, if known. Few are broadcast, so f itself isn't shuffled; else Spark chooses the join, and the sums
    keep its partitioning."""
    wf = F.col("w") * F.col("f")
    first = f.groupBy(*keys).agg(total(wf, skipna).alias("density"), total(wf * F.col("vpar"), skipna).alias("m1")).select(*keys, "density", ieee_div(F.col("m1"), F.col("density")).alias("mean_velocity"))
    v = F.col("vpar") - F.col("mean_velocity")
    means = first.hint("merge") if colocated else small(first, cells) if cells else first
    second = f.join(means, list(keys)).groupBy(*keys).agg(F.first("density").alias("density"), F.first("mean_velocity").alias("mean_velocity"), total(wf * v * v, skipna).alias("m2"))
    return second.select(*keys, "density", "mean_velocity", ieee_div(F.col("m2"), F.col("density")).alias("temperature"))


def _exact(f: DataFrame, keys: Sequence[str], about: Column, skipna: bool) -> DataFrame:
    wf, v = F.col("w") * F.col("f"), F.col("vpar") - about
    sums = f.groupBy(*keys).agg(*[exact_total(x, skipna).alias(n) for n, x in (("m0", wf), ("m1", wf * v), ("m2", wf * v * v))], F.max(about).alias("about"))
    m0, m1, m2 = (F.col(c) for c in ("m0", "m1", "m2"))
    d = ieee_div(m1, m0)
    return sums.select(*keys, m0.alias("density"), (F.col("about") + d).alias("mean_velocity"), (ieee_div(m2, m0) - d * d).alias("temperature"))


def exact(f: DataFrame, keys: Sequence[str] = CELL, about: Column | float = 0.0, skipna: bool = False, rows: int = 1 << 21, bins: int = 1 << 16) -> DataFrame:
    """One pass, with sums whose bits don't depend on how rows are split or ordered. The sums of a cell are some 30 longs, so rows
    are dealt out by cell first, about `rows` to a task, whose memory is bounded by that; partial sums where rows lie would
    hold most cells in every task. Cells of more rows than a task's are found by counts of hashes (`bins` of them), and take partial sums."""
    about = F.lit(about) if isinstance(about, float | int) else about
    if f.isStreaming or not keys:
        return _exact(f, keys, about, skipna)
    bin_ = F.pmod(F.xxhash64(*keys), F.lit(bins))
    counts = f.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    # At most one in `rows` rows has such a bin.
    n, filled = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") > rows, F.struct("bin", "n")))).first()
    large = [r["bin"] for r in filled if r["n"] > 8 * n // bins]
    parts = max(f.sparkSession.sparkContext.defaultParallelism, -(-n // rows))
    dealt = _exact((f.where(~bin_.isin(large)) if large else f).repartition(parts, *keys), keys, about, skipna)
    return dealt.unionByName(_exact(f.where(bin_.isin(large)), keys, about, skipna)) if large else dealt


def moments(f: DataFrame, which: Sequence[str] = ALL, keys: Sequence[str] = CELL, *, method: str = "one_pass", about: Column | float = 0.0, skipna: bool = False, cells: int | None = None) -> DataFrame:
    """The moments named, of f with vpar and w; cells: how many there are, if known."""
    if unknown := set(which) - set(ALL):
        raise ValueError(f"unknown moments: {sorted(unknown)}")
    if method == "one_pass":
        out = one_pass(f, keys, about, skipna)
    elif method == "two_pass":
        out = two_pass(f, keys, skipna, cells)
    elif method == "exact":
        out = exact(f, keys, about, skipna)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select(*keys, *which)


def to_blocks(f: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Each cell's values as one array in the order of (iv, im)."""
    rows = F.array_sort(F.collect_list(F.struct("iv", "im", "f")))
    return f.groupBy(*keys).agg(rows.alias("x")).select(*keys, F.transform("x", lambda r: r["f"]).alias("f"))


def to_dense_blocks(f: DataFrame, keys: Sequence[str], n_iv: int, n_im: int) -> DataFrame:
    """As to_blocks, of a distribution that lacks points: 0 there. A point comes once at most."""
    at = F.map_from_entries(F.collect_list(F.struct((F.col("iv") * n_im + F.col("im")).alias("k"), "f")))
    places = F.sequence(F.lit(0), F.lit(n_iv * n_im - 1))
    return f.groupBy(*keys).agg(at.alias("x")).select(*keys, F.transform(places, lambda k: F.coalesce(F.try_element_at("x", k), F.lit(0.0))).alias("f"))


def weight_arrays(weights: DataFrame) -> tuple[list[float], list[float]]:
    """w and vpar in the order of (iv, im); as many as velocity points, which a block has too."""
    rows = sorted(weights.select("iv", "im", "w", "vpar").collect())
    return [r.w for r in rows], [r.vpar for r in rows]


def block_moments(blocks: DataFrame, w: list[float], vpar: list[float], keys: Sequence[str] = CELL) -> DataFrame:
    """Moments of cells in block layout, two passes within the row: no shuffle."""
    wf = F.zip_with("f", F.array(*map(F.lit, w)), lambda a, b: a * b)
    v = F.array(*map(F.lit, vpar))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    out = blocks.select(*keys, wf.alias("wf")).withColumn("density", add("wf"))
    out = out.withColumn("mean_velocity", ieee_div(add(F.zip_with("wf", v, lambda a, b: a * b)), F.col("density")))
    second = add(F.zip_with("wf", v, lambda a, b: a * (b - F.col("mean_velocity")) * (b - F.col("mean_velocity"))))
    return out.withColumn("temperature", ieee_div(second, F.col("density"))).select(*keys, *ALL)
