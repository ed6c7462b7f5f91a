"""Central moments kept up to date by micro-batches.

The state is a row for each key: how many values, their mean, and the sum of squares about it. A batch gives such rows
of its own by partial sums, and two rows of a key are merged by Chan's formulas, which lose no digits to a large mean. Each batch
makes one version of the state out of the version before (sources.versions), numbered by the batch: one that runs again after a failure
finds its version made, or makes it from the same version as before, so nothing is counted twice.

A batch costs a pass over its rows and one over the state's. Keys may be null; null values aren't counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from velograph.sources import versions

PARTS = ("n", "mean", "m2")


def partial(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean, m2 of some rows; Spark merges partial sums of its own by the same formulas."""
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))
    return sums.where("n > 0").withColumns({c: F.col(c).cast("double") for c in ("mean", "m2")})


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state of both together; each has a row for each key at most."""
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in PARTS])
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    both = a.join(right, on, "full_outer")
    n_a, n_b = F.coalesce("n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    n = n_a + n_b
    apart = F.when((n_a > 0) & (n_b > 0), F.col("b_mean") - F.col("mean")).otherwise(0.0)
    mean = F.coalesce("mean", "b_mean") + apart * n_b / n
    m2 = F.coalesce("m2", F.lit(0.0)) + F.coalesce("b_m2", F.lit(0.0)) + apart * apart * n_a * n_b / n
    # A key is b's where a has no row of it; a null key of a row that a has is null itself.
    own = [F.when(F.col("n").isNull(), F.col(f"b_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*own, n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def take(batch: DataFrame, number: int, top: str, keys: Sequence[str], value: str) -> None:
    """Makes version number + 1 of the state from version number and a batch; nothing, if it is there."""
    spark = batch.sparkSession
    have = versions.history(spark, top)
    if number + 1 in have:
        return
    new = partial(batch, keys, value)
    if number and number not in have:
        raise ValueError(f"batch {number} needs version {number} of {top}")
    state = merge(versions.read(spark, top, number), new, keys) if number else new
    try:
        versions.write(state, top, version=number + 1)
    except versions.Conflict:  # the same batch, run twice at once
        return
    versions.expire(spark, top, keep=3)


def run(spark: SparkSession, path: str, schema: StructType, top: str, checkpoint: str, keys: Sequence[str], value: str, files_per_batch: int = 1) -> StreamingQuery:
    """Takes in Parquet files as they arrive in a folder, until none is left."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    each = lambda batch, number: take(batch, number, top, keys, value)
    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, top: str, version: int | None = None) -> DataFrame:
    """The newest state, or that of a version; `variance` is the population's."""
    return versions.read(spark, top, version).withColumn("variance", F.col("m2") / F.col("n"))
