"""Co-located tables: bucketed and sorted by cell, so that what is grouped or joined by cell isn't shuffled again.

The shuffle is paid once, when a table is written. Moments by two passes, and comparisons of tables of as many buckets, then read
buckets side by side. A cell lies in one bucket whole; a cell with a large share of all rows is better served by partial sums
over tables that aren't bucketed.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame

from velograph.operators import moments, verify
from velograph.sources import files

_numbers = itertools.count()


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str) -> str:
    """Writes df to the shared folder, a file for each bucket, as a table of the session's catalog; returns its name."""
    spark = df.sparkSession
    table = f"{name}_{spark.sparkContext.applicationId.replace('-', '_')}_{next(_numbers)}".lower()
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{files.scratch(spark, name)}/table").saveAsTable(table)
    return table


def moments_of(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments by two passes of a bucketed f: no shuffle, as sums and f are joined where they lie."""
    return moments.two_pass(f, keys, colocated=True)


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences of two tables bucketed alike, by variable; only a row for each variable and task is shuffled."""
    return verify.by_variable(a.hint("merge"), b, keys)
