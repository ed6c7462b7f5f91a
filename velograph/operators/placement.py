"""Contiguous exchange: index space cut into boxes of about as many rows each, and every box put into a partition of its own.

The plan comes from the data's own histogram. Along the first axis, indices are joined into runs of one share of the rows; an
index that has more than a share is a box of its own, which the next axis cuts into as many pieces as it has shares, and so
on. So boxes stand in row-major order, a row's box is found by a binary search of its position among the boxes' first
positions, and a heavy index, if it had a third of all rows, is spread over a third of the partitions.

An axis has `BINS` bins at most: of a longer one several indices are a bin. A level's histogram has a row for each bin of each heavy
index, and a share of the rows is a heavy index at most, so what is windowed and what the driver gets is bounded by the number
of parts, not by the rows. Rows with a null index aren't in a plan and go to the first partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph import schemas
from velograph.operators import exchange
from velograph.sources import files

BINS = 1024


@dataclass(frozen=True)
class Plan:
    """axes: names and extents; bounds: the first position of each part; starts, extents and rows of each part's box."""

    axes: dict[str, int]
    bounds: tuple[int, ...]
    starts: tuple[tuple[int, ...], ...]
    extents: tuple[tuple[int, ...], ...]
    rows: tuple[int, ...]

    def __len__(self) -> int:
        return max(len(self.bounds), 1)

    def table(self, spark: SparkSession) -> DataFrame:
        """part, starts, extents, as local_ranges has them."""
        return spark.createDataFrame([(k, list(a), list(b)) for k, (a, b) in enumerate(zip(self.starts, self.extents, strict=True))], schemas.PARTITION_PLAN)


def _width(extent: int) -> int:
    return -(-max(extent, 1) // BINS)


def _bin(axis: str, extent: int) -> Column:
    return F.floor(F.col(axis) / _width(extent)).cast("bigint")


def _stride(axes: dict[str, int], after: int) -> int:
    return reduce(lambda a, n: a * (-(-max(n, 1) // _width(n))), list(axes.values())[after + 1 :], 1)


def position(axes: dict[str, int]) -> Column:
    """Where a row's bins stand in row-major order."""
    return reduce(lambda a, b: a + b, [_bin(a, n) * F.lit(_stride(axes, k)) for k, (a, n) in enumerate(axes.items())])


def balanced_plan(f: DataFrame, axes: dict[str, int], parts: int) -> Plan:
    """The boxes of f, whose indices lie from 0 to below each axis's extent; some parts more or fewer than asked for."""
    if parts < 1 or not axes:
        raise ValueError("a plan needs one part and one axis at least")
    names = list(axes)
    bounds_of = [*[F.min(a).cast("bigint").alias(f"lo_{a}") for a in names], *[F.max(a).cast("bigint").alias(f"hi_{a}") for a in names]]
    open_, closed = None, []
    for j, axis in enumerate(names):
        before, here = [f"b{k}" for k in range(j)], f"b{j}"
        rows = f.dropna(subset=names).select(*names, *[_bin(a, axes[a]).alias(f"b{k}") for k, a in enumerate(names[: j + 1])])
        if open_ is not None:
            rows = rows.join(F.broadcast(open_), before)  # fewer rows than parts
        pieces = F.first("pieces").alias("pieces") if j else F.lit(parts).cast("bigint").alias("pieces")
        counts = rows.groupBy(*before, here).agg(F.count("*").alias("n"), pieces, *bounds_of)
        so_far, all_ = Window.partitionBy(*before).orderBy(here), Window.partitionBy(*before)
        counts = counts.withColumns({"sum": F.sum("n").over(so_far), "all": F.sum("n").over(all_)})
        counts = counts.withColumn("heavy", (F.col("n") * F.col("pieces") > F.col("all")) & F.lit(j + 1 < len(names)))
        counts = files.kept(counts.withColumns({"run": F.expr("(sum - n) * pieces div all"), "passed": F.sum(F.col("heavy").cast("int")).over(so_far)}), "histogram")
        spans = [*[F.min(f"lo_{a}").alias(f"lo_{a}") for a in names], *[F.max(f"hi_{a}").alias(f"hi_{a}") for a in names]]
        for r in counts.where(~F.col("heavy")).groupBy(*before, "run", "passed").agg(F.min(here).alias(here), F.sum("n").alias("n"), *spans).collect():
            at = sum(r[f"b{k}"] * _stride(axes, k) for k in range(j + 1))
            closed.append((at, tuple(r[f"lo_{a}"] for a in names), tuple(r[f"hi_{a}"] - r[f"lo_{a}"] + 1 for a in names), r["n"]))
        open_ = counts.where("heavy").select(*before, here, F.expr("(n * pieces + all - 1) div all").alias("pieces"))
        if open_.isEmpty():
            break
    closed.sort()
    bounds, starts, extents, n = zip(*closed, strict=True) if closed else ((), (), (), ())
    return Plan(dict(axes), bounds, starts, extents, n)


def even_plan(axes: dict[str, int], parts: int) -> Plan:
    """The boxes of a mesh that has every point: they follow from its extents, no row is read."""
    if parts < 1 or not axes or any(n < 1 for n in axes.values()):
        raise ValueError("a plan needs one part, one axis and one index of each at least")
    sizes = list(axes.values())
    found: list[tuple[int, tuple[int, ...], tuple[int, ...]]] = []

    def cut(at: int, starts: tuple[int, ...], extents: tuple[int, ...], pieces: int) -> None:
        j = len(starts)
        width, stride = _width(sizes[j]), _stride(axes, j)
        bins = -(-sizes[j] // width)
        fine = pieces > bins and j + 1 < len(sizes)
        for first, n in exchange.chunks_of(bins, bins if fine else min(pieces, bins)):
            here = (*starts, first * width), (*extents, min((first + n) * width, sizes[j]) - first * width)
            if fine:
                cut(at + first * stride, *here, -(-pieces // bins))
            else:
                rest = len(sizes) - j - 1
                found.append((at + first * stride, (*here[0], *[0] * rest), (*here[1], *sizes[j + 1 :])))

    cut(0, (), (), parts)
    bounds, starts, extents = zip(*found, strict=True)
    return Plan(dict(axes), bounds, starts, extents, tuple(reduce(lambda a, b: a * b, e, 1) for e in extents))


def part_of(plan: Plan) -> Column:
    """The part whose box a row is in: a binary search among as many numbers as the plan has parts."""
    if len(plan) == 1:
        return F.lit(0)
    numbers, at = F.array(*[F.lit(b).cast("bigint") for b in plan.bounds]), position(plan.axes)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(plan).bit_length()))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(numbers, low + s) <= at, low + s).otherwise(low)), F.lit(0))


def contiguous(f: DataFrame, plan: Plan) -> DataFrame:
    """f with each box in the partition of its number, in the order of the axes: one shuffle, straight to its place."""
    return f.repartitionById(len(plan), part_of(plan)).sortWithinPartitions(*plan.axes)


def transpose(f: DataFrame, axes: dict[str, int], parts: int) -> DataFrame:
    """f, however it lies, in contiguous boxes of these axes, balanced by its histogram."""
    return contiguous(f, balanced_plan(f, axes, parts))


def filled_ranges(f: DataFrame, columns: Sequence[str]) -> DataFrame:
    """part, starts, extents, n of the partitions that have rows."""
    columns = tuple(columns)
    ranges = exchange.local_ranges(f, columns)
    return ranges.join(f.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")), "part")
