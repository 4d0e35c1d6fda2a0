"""Stacking and set operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col


def stack(frames: Sequence[DataFrame], ordinal: str | None = None) -> DataFrame:
    """Concatenate by column name; a column one input lacks is missing there.

    ``ordinal`` numbers the inputs from 1, so that their order can be sorted on.
    """
    if ordinal:
        frames = [f.withColumn(ordinal, F.lit(i)) for i, f in enumerate(frames, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append(base: DataFrame, data: DataFrame) -> DataFrame:
    """Append by name. The base decides columns and types; further columns are left out."""
    kinds = dict(base.dtypes)
    known = {c.lower(): c for c in data.columns}
    picked = [
        (col(known[c.lower()]) if c.lower() in known else F.lit(None)).cast(kinds[c]).alias(c) for c in base.columns
    ]
    return base.union(data.select(*picked))


def insert_rows(base: DataFrame, data: DataFrame) -> DataFrame:
    """Insert by position."""
    if len(base.columns) != len(data.columns):
        raise ValueError(f"insert has {len(data.columns)} columns, the table has {len(base.columns)}")
    return base.union(data)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Create a named view, ``lib.name`` becoming ``lib_name``."""
    view = name.replace(".", "_")
    df.createOrReplaceTempView(view)
    return df.sparkSession.table(view)


def signed_difference(actual: DataFrame, expected: DataFrame, count: str = "copies") -> DataFrame:
    """Multiset difference in both directions by one aggregate.

    ``copies`` is positive for rows with surplus copies in ``actual``, negative for
    ``expected``. Equal rows meet in the map-side sums, so many copies of one row
    stay cheap.
    """
    both = actual.withColumn(count, F.lit(1).cast("long")).unionByName(
        expected.withColumn(count, F.lit(-1).cast("long"))
    )
    keys = [col(c) for c in actual.columns]
    return both.groupBy(*keys).agg(F.sum(count).alias(count)).filter(F.col(count) != 0)
