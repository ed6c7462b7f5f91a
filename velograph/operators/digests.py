"""Comparison of two tables by a tree of digests, so that only what differs is joined.

A row's digest is a hash of its columns; a group's is what any order of its rows gives: their number, the exclusive or and
partial sums of the hashes. A coarser group's digest is put together from the finer ones, so a tree of any depth takes one pass
over the rows, with partial sums, and can be kept beside the table. Trees are compared from the top: a level's groups
are joined only below groups that differ one level up. Equal digests of different groups are as likely as equal 128-bit numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograph.sources import files, generate

_PARTS = ("n", "x", "y", "s")


def leaves(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, and the digest of the rows of each group: n, x, y (exclusive ors), s (a sum of 24-bit numbers)."""
    h, g = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"), F.sum(F.shiftrightunsigned(h, 40)).alias("s"))


def above(fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Digests of coarser groups, out of finer ones."""
    return fine.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("s").alias("s"))


@dataclass
class Differing:
    """groups: keys of the finest level that differ, or are in one table alone; joined: by level, how many groups were."""

    groups: DataFrame
    joined: list[int] = field(default_factory=list)


def _on(keys: Sequence[str]) -> list:
    return reduce(lambda a, b: a & b, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])


def _named(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.struct(*_PARTS).alias(side))


def differing(a: DataFrame, b: DataFrame, levels: Sequence[Sequence[str]]) -> Differing:
    """a, b: leaves by the last level's keys; levels: keys from coarse to fine, each with all of the one before."""
    found, joined, upper = None, [], ()
    for keys in levels:
        x, y = (d if keys == levels[-1] else above(d, keys) for d in (a, b))
        if found is not None:
            below = generate.small(found.select(*[F.col(k).alias(f"up_{k}") for k in upper]), n)
            match = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in upper])
            x, y = (d.join(below, match, "left_semi") for d in (x, y))
        both = files.kept(_named(x, keys, "a").join(_named(y, keys, "b"), _on(keys), "full_outer"), "digests")
        joined.append(both.count())
        found = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*[F.when(F.col("a").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys])
        n, upper = found.count(), keys
    return Differing(found, joined)


def rows_of(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of some groups; few groups are broadcast, so df isn't shuffled."""
    named = groups.select(*[F.col(k).alias(f"of_{k}") for k in keys])
    return df.join(generate.small(named, groups.count()), reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]), "left_semi")
