"""Arithmetic in which a missing operand or a zero divisor gives missing, and tolerant equality."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepledger.settings import ATOL, RTOL


def divide(left: Column, right: Column) -> Column:
    return F.try_divide(left, right)


def decimals_for(atol: float) -> int | None:
    """Decimal places that a tolerance stands for; None means no rounding."""
    return round(-math.log10(atol)) if atol and atol > 0 else None


def round_to(value: Column, atol: float) -> Column:
    """Round half up to the places of ``atol``; a tolerance above 1 rounds before the point."""
    places = decimals_for(atol)
    return value if places is None else F.round(value, places)


def close(left: Column, right: Column, atol: float = ATOL, rtol: float = RTOL) -> Column:
    """``|left - right| <= atol + rtol * |right|``; missing equals missing only, infinity itself only."""
    near = (F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)) & (F.abs(right) < float("inf"))
    same = left.eqNullSafe(right)
    return same | F.coalesce(near, F.lit(False))
