"""Distributions clustered in Z-order, so that a box over any axes reads few files and row groups.

Bits of all indices are interleaved, highest first, so rows near in every axis are near in the file; each file, and each
row group in it, spans a small range of each axis. A box is found in two steps: the manifest, a row of ranges for each file,
says which files may have rows of it; Parquet's statistics, to which the box's ranges are pushed, which row groups of those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.operators import exchange

ROWS, MANIFEST = "rows", "manifest"


def z_value(axes: dict[str, int]) -> Column:
    """The interleaved bits of indices from 0 to below each axis's extent; an axis with fewer bits has no more to add."""
    bits = {a: max(n - 1, 1).bit_length() for a, n in axes.items()}
    if sum(bits.values()) > 63:
        raise ValueError("the indices have more than 63 bits together")
    order = [(a, b - 1 - level) for level in range(max(bits.values())) for a, b in bits.items() if b > level]
    one = lambda a, k: F.shiftright(F.col(a).cast("bigint"), k).bitwiseAND(F.lit(1))
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(one(a, k), len(order) - 1 - place) for place, (a, k) in enumerate(order)])


def write_clustered(f: DataFrame, axes: dict[str, int], top: str, partitions: int | None = None, row_group_bytes: int | None = None) -> None:
    """f under top: in files by ranges of the Z-order, as many as partitions (by default as Spark's shuffles), and the manifest."""
    z = z_value(axes)
    ranged = f.repartitionByRange(partitions, z) if partitions else f.repartitionByRange(z)
    writer = ranged.sortWithinPartitions(z).write
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(f"{top}/{ROWS}")
    spark = f.sparkSession
    spans = [x for a in axes for x in (F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}"))]
    by_file = spark.read.schema(f.schema).parquet(f"{top}/{ROWS}").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *spans)
    by_file.coalesce(1).write.parquet(f"{top}/{MANIFEST}")


def files_of(spark: SparkSession, top: str, starts: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """The manifest's rows of files that may have rows of a box."""
    near = [(F.col(f"lo_{a}") <= s + sizes[a] - 1) & (F.col(f"hi_{a}") >= s) for a, s in starts.items()]
    return spark.read.parquet(f"{top}/{MANIFEST}").where(reduce(lambda x, y: x & y, near, F.lit(True)))


def read_box(spark: SparkSession, top: str, starts: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """The rows of a box of indices, over as many axes as are named. Of files, only those are listed that may have some."""
    schema = spark.read.parquet(f"{top}/{ROWS}").schema
    names = [r.file for r in files_of(spark, top, starts, sizes).select("file").collect()]  # names of files to be read
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return exchange.hyperslab(rows, starts, sizes)
