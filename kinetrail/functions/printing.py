"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let, sign_bit


def printed(x: Column, digits: int) -> Column:
    """x as C, Python and SQL engines print it with so many digits (up to 8): the decimal nearest to the double's binary value,
    ties to even. format_string alone rounds the shortest decimal, ties up: it prints 2.5 as 3 and 9.135, which is a little less, as 9.14.
    From 10^(15 - digits) on, digits are those of the shortest decimal. Null is null."""
    scale = float(10**digits)

    def at(v: Column) -> Column:
        # the product rounded to a double, and what the rounding took (Dekker)
        p = v * scale
        high = v * 134217729.0 - (v * 134217729.0 - v)
        lost = (high * scale - p) + (v - high) * scale
        tie = F.abs(p - F.rint(p)) == 0.5
        n = F.when(tie & (lost > 0), p + 0.5).when(tie & (lost < 0), p - 0.5).otherwise(F.rint(p))
        return F.when(p < 1e15, n / scale).otherwise(v)

    text = let(F.abs(x), lambda v: F.when(v == float("inf"), "inf").otherwise(F.format_string(f"%.{digits}f", at(v))))
    return F.when(F.isnan(x), "nan").when(x.isNotNull(), F.concat(F.when(sign_bit(x), "-").otherwise(""), text))
