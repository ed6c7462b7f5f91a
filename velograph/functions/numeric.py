"""Arithmetic with IEEE results, and values that compare across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: NaN or an infinity for a zero divisor, where Spark would raise. The sign of a zero
    divisor doesn't count. Null in, null out."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def steady(x: Column, digits: int = 9) -> Column:
    """x rounded, without a negative zero, so that sums taken in any order hash alike."""
    return F.round(x, digits) + F.lit(0.0)


def skip_nan(x: Column) -> Column:
    """Null for NaN, so that sum passes it over."""
    return F.when(~F.isnan(x), x)


def total(x: Column, skipna: bool = False) -> Column:
    """sum(x): NaN spreads; or, with skipna, is passed over and a sum of nothing is 0."""
    return F.coalesce(F.sum(skip_nan(x)), F.lit(0.0)) if skipna else F.sum(x)


def decode_padded(raw: Column) -> Column:
    """Text of UTF-8 bytes padded with NUL at the right."""
    return F.rtrim(F.decode(raw, "UTF-8"), F.lit("\0"))


def pad_to(text: Column, width: int) -> Column:
    """The bytes of a text, padded with NUL to a width."""
    return F.rpad(text, width, "\0").cast("binary")


def fixed(x: Column, digits: int = 6) -> Column:
    """x written with that many decimals, of its exact value, as C's printf has it; Java's puts zeros after the shortest digits."""
    return F.udf(lambda v: None if v is None else f"{v:.{digits}f}", "string")(x)
