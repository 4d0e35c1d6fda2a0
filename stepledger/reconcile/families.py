"""Comparison families of types, and the exact common form of two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import col


INTEGER_DIGITS = 19  # of the largest integer type


def family(kind: T.DataType) -> str:
    """numeric, bool, datetime, or string for everything else."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name.lower(): family(f.dataType) for f in df.schema.fields}


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)


def plain_text(value: Column, kind: T.DataType) -> Column:
    """Text with one spelling per value: map entries sorted, nested values as JSON."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(value)))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(value)
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.DecimalType):
        text = value.cast(T.DecimalType(kind.precision, kind.scale)).cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return value.cast("string")


def common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The type in which both sides compare without loss; None means as text.

    Integers stay integers and decimals stay decimals, so 2**53 and 2**53 + 1 differ. Decimals that no one type
    holds compare as text without trailing zeros.
    """
    if isinstance(left, T.BooleanType) and isinstance(right, T.BooleanType):
        return T.BooleanType()
    if family(left) == family(right) == "numeric":
        if is_float(left) or is_float(right):
            return T.DoubleType()
        if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
            scale = max(k.scale for k in (left, right) if isinstance(k, T.DecimalType))
            whole = max(k.precision - k.scale if isinstance(k, T.DecimalType) else INTEGER_DIGITS for k in (left, right))
            return T.DecimalType(38, scale) if whole + scale <= 38 else None
        return T.LongType()
    if family(left) == family(right) == "datetime":
        return left if left == right else T.TimestampType()
    if left == right and isinstance(left, (T.StringType, T.BinaryType)):
        return left
    return None


def exact(df: DataFrame, other: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, T.DataType]]:
    """``df`` in the common form with ``other``: NaN is missing, -0.0 is 0.0."""
    mine = {f.name: f.dataType for f in df.schema.fields}
    theirs = {f.name: f.dataType for f in other.schema.fields}
    picked, kinds = [], {}
    for name in columns:
        target = common_type(mine[name], theirs[name])
        if target is None:
            value, target = plain_text(col(name), mine[name]), T.StringType()
        else:
            value = col(name).cast(target)
            if isinstance(target, T.DoubleType):
                value = F.nanvl(value, F.lit(None).cast("double")) + F.lit(0.0)
        picked.append(value.alias(name))
        kinds[name] = target
    return df.select(*picked), kinds
