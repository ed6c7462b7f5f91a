"""Layouts of a distribution over partitions, and the change from one to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph import schemas

SPATIAL, VELOCITY = ("i1", "i2", "i3"), ("iv", "im")
TRANSPOSED = ("sp", "iv", "im", "i1", "i2", "i3")


def _dealt(f: DataFrame, columns: tuple[str, ...], partitions: int | None) -> DataFrame:
    return f.repartition(partitions, *columns) if partitions else f.repartition(*columns)


def spatial_split(f: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a spatial cell together."""
    return _dealt(f, SPATIAL, partitions)


def velocity_split(f: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a velocity point together."""
    return _dealt(f, VELOCITY, partitions)


def chunks_by(f: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Rows of one index together, as a chunk."""
    return _dealt(f, columns, partitions)


def transpose_v2d(f: DataFrame, partitions: int | None = None) -> DataFrame:
    """From any layout to the velocity split, columns and rows in the order species, velocity, space."""
    return velocity_split(f, partitions).select(*TRANSPOSED, "f").sortWithinPartitions(*TRANSPOSED)


def transpose_back(f: DataFrame, partitions: int | None = None) -> DataFrame:
    """To the spatial split, in the order species, space, velocity."""
    return spatial_split(f, partitions).select(*schemas.POINT, "f").sortWithinPartitions(*schemas.POINT)


def transpose_blocks(f: DataFrame) -> DataFrame:
    """Each velocity point's values as one array in the order of space."""
    rows = F.array_sort(F.collect_list(F.struct(*SPATIAL, "f")))
    return f.groupBy("sp", *VELOCITY).agg(rows.alias("x")).select("sp", *VELOCITY, F.transform("x", lambda r: r["f"]).alias("f"))


def chunks_of(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, extent) of n indices in so many contiguous chunks, the first ones larger by one if need be."""
    each, more = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        size = each + (k < more)
        out.append((at, size))
        at += size
    return out


def partition_plan(spark: SparkSession, extents: list[int], splits: list[int]) -> DataFrame:
    """The hyperslab of each part when axis d is cut into splits[d] chunks; the last axis varies fastest."""
    if any(s < 1 for s in splits):
        raise ValueError("each axis needs one chunk at least")
    rows: list[tuple[list[int], list[int]]] = [([], [])]
    for n, s in zip(extents, splits, strict=True):
        rows = [([*a, start], [*b, size]) for a, b in rows for start, size in chunks_of(n, s)]
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], schemas.PARTITION_PLAN)


def local_ranges(f: DataFrame, columns: tuple[str, ...] = schemas.POINT) -> DataFrame:
    """Of each partition as it is: the smallest index and the extent, by column."""
    spans = f.groupBy(F.spark_partition_id().alias("part")).agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    starts = F.array(*[F.col(f"lo_{c}").cast("bigint") for c in columns])
    extents = F.array(*[(F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1).cast("bigint") for c in columns])
    return spans.select("part", starts.alias("starts"), extents.alias("extents"))


def hyperslab(f: DataFrame, starts: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """The rows of a box of indices: plain ranges, so a Parquet scan prunes by them."""
    for c, a in starts.items():
        f = f.where(F.col(c).between(a, a + sizes[c] - 1))
    return f
