"""The three roundings the metrics use.

They agree almost everywhere and must not be merged: summary rates round half
to even, panel rates round half up, and scores round the exact binary value of
a double to one decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO52 = 4503599627370496  # 2**52: makes any double in [1, 5] an integer


def half_even_pct(part: Column, whole: Column) -> Column:
    """``part / whole`` in whole percent, half to even; 0 when ``whole`` is 0."""
    ratio = part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.bround(ratio * 100).cast("int"), F.lit(0))


def half_up_pct(part: Column, whole: Column) -> Column:
    """``part / whole`` in whole percent, half up; 0 when ``whole`` is 0."""
    ratio = part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.floor(ratio * 100 + F.lit(0.5)).cast("int"), F.lit(0))


def one_decimal(x: Column) -> Column:
    """Round a double in [1, 5] to one decimal from its exact binary value.

    ``bround(x, 1)`` goes through the shortest decimal text of the double and
    so misjudges values such as 1.05; scaling by 2**52 keeps the test exact.
    """
    tenths = (x * F.lit(float(_TWO52))).cast("bigint") * 10
    whole = F.shiftright(tenths, 52)  # positive, so this is the integer quotient
    rest = F.pmod(tenths, F.lit(_TWO52))
    half = _TWO52 // 2
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + up.cast("bigint")) / F.lit(10.0)


def satisfaction_score(pos: Column, total: Column) -> Column:
    """1.0 (no positive opinion) to 5.0 (all positive), one decimal."""
    ratio = F.coalesce(pos / F.nullif(total, F.lit(0)), F.lit(0.0))
    return one_decimal(F.lit(1.0) + ratio * F.lit(4.0))
