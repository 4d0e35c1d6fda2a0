"""Column-name helpers: dotted names, lower-casing, null-safe key joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name; names that then collide are an error."""
    lowered = [c.lower() for c in df.columns]
    twice = sorted({c for c in lowered if lowered.count(c) > 1})
    if twice:
        raise ValueError(f"column names collide when lower-cased: {twice}")
    return df.toDF(*lowered)


def common_columns(left: DataFrame, right: DataFrame) -> tuple[list[str], bool]:
    """Names both sides have, and whether the two name sets are equal."""
    a, b = set(left.columns), set(right.columns)
    return sorted(a & b), a == b


def is_sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return is_sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(is_sortable(f.dataType) for f in kind.fields)
    return isinstance(
        kind,
        (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType),
    )


def key_of(df: DataFrame, name: str) -> Column:
    """The column as a sort or group key: NaN is missing."""
    kind = df.schema[name].dataType
    return F.nanvl(col(name), F.lit(None).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else col(name)


def ordering(df: DataFrame, order: Sequence[str], skip: Sequence[str] = (), downwards: bool = False) -> list[Column]:
    """Sort keys with missing first; ``-name`` sorts downwards. ``downwards`` gives the opposite order.

    The remaining sortable columns follow as tie-breakers, so the row order, and
    with it a retried task, gives the same answer each time.
    """
    named = [o.lstrip("-") for o in order]
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in named and f.name not in skip and is_sortable(f.dataType)
    ]
    keys = []
    for item in [*order, *rest]:
        value = key_of(df, item.lstrip("-"))
        down = item.startswith("-") != downwards
        keys.append(value.desc_nulls_last() if down else value.asc_nulls_first())
    return keys


def attach(df: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``right`` on ``by`` with missing keys matching each other; ``df`` keeps its key columns.

    Spark picks broadcast or sort-merge by size, and splits a skewed side at run time.
    """
    keys = [f"__key{i}" for i in range(len(by))]
    renamed = right.select(
        *[col(k).alias(n) for k, n in zip(by, keys)],
        *[col(c) for c in right.columns if c not in by],
    )
    match = all_of(col(k).eqNullSafe(col(n)) for k, n in zip(by, keys))
    return df.join(renamed, match, how).drop(*keys)
