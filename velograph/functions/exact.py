"""Sums of doubles whose bits don't depend on the order of the rows.

A number is split into whole multiples of fixed powers of two (limbs), each a long. Sums of longs are exact in any order
and in any partial sums, so a sum's limbs, and the double that they are put together to, are the same for every
partitioning and every machine. By default limbs stand for 2^24, 1, 2^-24 ... 2^-96: a term is cut at 2^-97, and sums may
have 5 x 10^11 terms of up to 2^48 each, or more smaller ones; beyond, Spark raises an overflow and gives no wrong number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limbs:
    bits: int = 24
    top: int = 24
    """The highest limb's power of two."""
    count: int = 6

    @property
    def powers(self) -> list[int]:
        return [self.top - k * self.bits for k in range(self.count)]


def limbs(x: Column, how: Limbs = Limbs()) -> list[Column]:
    """Longs whose multiples of the powers add up to x, but for what lies below the last. x is finite."""
    # x in units of a limb, rounded; less what the limbs above hold of it. Both are exact: the difference has bits of x alone.
    units = [F.rint(x * F.lit(2.0**-p)) for p in how.powers]
    return [units[0].cast("bigint"), *[(low - high * F.lit(2.0**how.bits)).cast("bigint") for high, low in zip(units, units[1:], strict=False)]]


def joined(sums: list[Column], how: Limbs = Limbs()) -> Column:
    """The double of a sum's limbs: carried over from the lowest up, then added from the highest down."""
    carried: list[Column] = []
    carry = F.lit(0).cast("bigint")
    for s in reversed(sums[1:]):
        s = s + carry
        carry = F.shiftright(s, how.bits)  # rounds down, so that the rest is never negative
        carried.append(s - F.shiftleft(carry, how.bits))
    digits = [sums[0] + carry, *reversed(carried)]
    return reduce(lambda a, b: a + b, [d.cast("double") * F.lit(2.0**p) for d, p in zip(digits, how.powers, strict=True)])


def exact_total(x: Column, skipna: bool = False, how: Limbs = Limbs()) -> Column:
    """sum(x), the same bits in any order. NaN spreads, as do infinities; with skipna NaN is passed over, and a sum of nothing
    is 0, else null."""
    inf = F.lit(float("inf"))
    finite = F.when(F.abs(x) < inf, x)  # NaN is larger than any
    value = joined([F.coalesce(F.sum(d), F.lit(0).cast("bigint")) for d in limbs(finite, how)], how)
    nan, up, down = (F.count_if(c) for c in (F.isnan(x), x == inf, x == -inf))
    spread = (up > 0) & (down > 0) if skipna else (nan > 0) | (up > 0) & (down > 0)
    out = F.when(spread, F.lit(float("nan"))).when(up > 0, inf).when(down > 0, -inf).otherwise(value)
    return out if skipna else F.when(F.count(x) > 0, out)
