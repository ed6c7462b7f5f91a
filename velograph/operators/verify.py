"""Comparison of stored moments with recomputed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.schemas import CELL


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames the columns of `names` that df has."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def _common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in a.columns if c in b.columns and c not in keys]


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """keys, variable, difference, relative: the absolute differences of all variables in both, and their shares of b's
    size (null where that is 0), stacked; matched cells only."""
    both = _common(a, b, keys)
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in both])
    d = lambda c: F.abs(F.col(c) - F.col(f"b_{c}"))
    of = lambda c: F.struct(d(c).alias("d"), (d(c) / F.when(F.col(f"b_{c}") != 0, F.abs(f"b_{c}"))).alias("r"))
    wide = a.select(*keys, *both).join(right, list(keys)).select(*keys, *[of(c).alias(c) for c in both])
    return wide.unpivot(list(keys), both, "variable", "x").select(*keys, "variable", F.col("x.d").alias("difference"), F.col("x.r").alias("relative"))


def _largest(column: str) -> Column:
    return F.max(F.when(~F.isnan(column), F.col(column)))


def by_variable(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """variable, n, n_nan, max_abs_error, max_rel_error; NaN differences are counted, not compared."""
    return differences(a, b, keys).groupBy("variable").agg(F.count("*").alias("n"), F.count_if(F.isnan("difference")).alias("n_nan"), _largest("difference").alias("max_abs_error"), _largest("relative").alias("max_rel_error"))


def max_abs_error(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """One row: the largest difference over all variables."""
    return differences(a, b, keys).agg(_largest("difference").alias("max_abs_error"), _largest("relative").alias("max_rel_error"), F.count_if(F.isnan("difference")).alias("n_nan"))


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """One row: cells that only a has, and only b."""
    k = list(keys)
    left, right = a.select(*k).withColumn("in_a", F.lit(1)), b.select(*k).withColumn("in_b", F.lit(1))
    both = left.join(right, k, "full_outer")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
