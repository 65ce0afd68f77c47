"""Collect-flag rules of the alert index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import split_int_pair


def in_key_range(key: Column, lo: tuple, hi: tuple) -> Column:
    """``lo <= (a, b) <= hi`` of a key ``a-b``; malformed keys are outside."""
    a, b = split_int_pair(key)
    inside = F.struct(a, b).between(F.struct(*map(F.lit, lo)), F.struct(*map(F.lit, hi)))
    return F.coalesce(a.isNotNull() & b.isNotNull() & inside, F.lit(False))


def green_only(green: Column, red: Column, yellow: Column) -> Column:
    """on the green list and on no other; unset flags count as false."""
    on = lambda c: F.coalesce(c, F.lit(False))
    return on(green) & ~on(red) & ~on(yellow)


def clear_where_off(df: DataFrame, flag_col: str, cols: list) -> DataFrame:
    """Null the override columns where the flag is off (an unset flag is on)."""
    keep = F.coalesce(F.col(flag_col), F.lit(True))
    return df.withColumns({c: F.when(keep, F.col(c)) for c in cols})
