"""Typing of text cells: numbers, missing tokens, times, key=value lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "nothing", after trimming; case-sensitive fixed values.
EMPTY_TOKENS = ("", "nan", "NaN", "None", "null", "NULL")


def number(c: Column, *, nan_is_value: bool = False) -> Column:
    """Permissive double: null for what does not parse, and for NaN unless nan_is_value."""
    x = F.trim(c.cast("string")).try_cast("double")
    return x if nan_is_value else F.when(~F.isnan(x), x)


def whole(c: Column) -> Column:
    """Integer from text such as 1024 or 1024.0; null otherwise."""
    return number(c).try_cast("bigint")


def present(c: Column) -> Column:
    """Whether a cell holds anything but an empty token."""
    return c.isNotNull() & ~F.trim(c.cast("string")).isin(*EMPTY_TOKENS)


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False))


def near_zero(c: Column, eps: float = 1e-10) -> Column:
    """Missing or within eps of zero; NaN is neither."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) <= eps), F.lit(True))


def timestamp(c: Column) -> Column:
    """ISO time with Z or an offset, in UTC; else the date in the first ten characters; else null."""
    return F.coalesce(c.try_cast("timestamp"), F.substring(c, 1, 10).try_cast("timestamp"))


def wall_time(c: Column) -> Column:
    """The time as written, its offset dropped and not applied."""
    return F.regexp_replace(c, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")


def significant(c: Column, digits: int = 6) -> Column:
    """Rounded to so many significant digits, as a number."""
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double")


def key_values(c: Column) -> Column:
    """Map of trimmed keys and values from 'k=v,k=v'."""
    pairs = F.filter(F.split(c, ","), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.substr(p, F.instr(p, "=") + 1)))))


def get(m: Column, key: Column | str, default: Column) -> Column:
    """Map lookup with a default."""
    return F.coalesce(F.try_element_at(m, F.lit(key) if isinstance(key, str) else key), default)
