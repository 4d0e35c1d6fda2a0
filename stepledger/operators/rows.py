"""Row-wise operators: filters, dataset options, tags, lengths, row generation, routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col
from stepledger.functions.text import fit_length


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Keep the rows for which the condition holds; build it from ``functions.missing``."""
    return df.filter(condition)


def assign(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Assignments in order: a later one may use an earlier one."""
    for name, value in values.items():
        df = df.withColumn(name, value)
    return df


def with_options(
    df: DataFrame,
    where: Column | None = None,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Dataset options. The filter may use columns that are then dropped."""
    if where is not None:
        df = df.filter(where)
    if keep is not None:
        df = df.select(*[col(c) for c in keep])
    df = df.drop(*drop)
    return df.withColumnsRenamed(dict(rename)) if rename else df


def tag(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Set constants on every row."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def set_lengths(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    return df.withColumns({name: fit_length(col(name), n) for name, n in lengths.items()})


def do_output(df: DataFrame, start: Column, stop: Column, counter: str, by: int = 1) -> DataFrame:
    """A DO loop with OUTPUT: one row per counter value, none when the range is empty."""
    runs = (start <= stop) if by > 0 else (start >= stop)
    return df.filter(runs).withColumn(counter, F.explode(F.sequence(start, stop, F.lit(by))))


def array_to_rows(df: DataFrame, ids: Sequence[str], columns: Sequence[str], index: str, value: str) -> DataFrame:
    """Write each element of an array of columns as its own row, index from 1."""
    items = F.posexplode(F.array(*[col(c) for c in columns])).alias("__pos", value)
    rows = df.select(*[col(c) for c in ids], items)
    return rows.select(*[col(c) for c in ids], (F.col("__pos") + 1).alias(index), col(value))


def over_array(df: DataFrame, columns: Sequence[str], change) -> DataFrame:
    """Apply one expression to every column of an array."""
    return df.withColumns({c: change(col(c)) for c in columns})


def split_outputs(df: DataFrame, routes: Mapping[str, Column | None]) -> dict[str, DataFrame]:
    """Route rows to several outputs; a route without a condition takes every row."""
    return {name: df if cond is None else df.filter(cond) for name, cond in routes.items()}
