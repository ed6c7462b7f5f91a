"""Sizes and ranges of stored columns out of Parquet's footers: counts, least and largest values without reading rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pushing(spark: SparkSession) -> SparkSession:
    """A session of the same application in which aggregates of Parquet tables are pushed into the scan."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def summary(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row: n, and lo_<c>, hi_<c> of whole-number columns; a footer is read for each file, no row."""
    t = pushing(spark).read.parquet(path)
    return t.agg(F.count("*").alias("n"), *[x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])


def ranges(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """name, n, lo, hi: a row for each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col("n"), F.col(f"lo_{c}").cast("bigint").alias("lo"), F.col(f"hi_{c}").cast("bigint").alias("hi")) for c in columns])
    return summary(spark, path, columns).select(F.explode(rows).alias("r")).select("r.*")
