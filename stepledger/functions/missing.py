"""Missing values: they sort below every number, and ``.``, ``.A``-``.Z``, ``._`` in text mean missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TEXT = r"^\s*\.[A-Za-z_]?\s*$"


def nan_to_missing(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def lt(left: Column, right) -> Column:
    """``left < right``; a missing left side is below any number."""
    if isinstance(right, Column):
        return F.when(left.isNull(), right.isNotNull()).otherwise(F.coalesce(left < right, F.lit(False)))
    return left.isNull() | (left < F.lit(right))


def le(left: Column, right) -> Column:
    if isinstance(right, Column):
        return left.isNull() | F.coalesce(left <= right, F.lit(False))
    return left.isNull() | (left <= F.lit(right))


def gt(left: Column, right) -> Column:
    """``left > right``. Against a constant this is the plain comparison, which reaches the scan."""
    if isinstance(right, Column):
        return lt(right, left)
    return left > F.lit(right)


def ge(left: Column, right) -> Column:
    if isinstance(right, Column):
        return le(right, left)
    return left >= F.lit(right)


def eq(left: Column, right) -> Column:
    """Equality in which missing equals missing."""
    return left.eqNullSafe(right if isinstance(right, Column) else F.lit(right))


def clear_missing(text: Column) -> Column:
    """Text with the missing markers turned into null."""
    return F.when(~text.rlike(MISSING_TEXT), text)


def missing_letter(text: Column) -> Column:
    """The letter of a special missing value, null for a plain or present value."""
    letter = F.upper(F.regexp_extract(text, r"^\s*\.([A-Za-z_])\s*$", 1))
    return F.when(letter != "", letter)
