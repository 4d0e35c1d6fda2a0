"""Aggregates: summaries, slices, remerge, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import all_of, attach, col
from stepledger.operators.ordered import number_rows
from stepledger.settings import TEXT_BYTES, input_bytes, store

# Groups whose totals every task can hold.
FEW_GROUPS = 100_000

# Statistic keywords.
STATISTICS = {
    "n": F.count,
    "nmiss": lambda c: F.count_if(c.isNull()),
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def summarize(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """GROUP BY with one row per group."""
    return df.groupBy(*[col(c) for c in by]).agg(*[a.alias(n) for n, a in aggs.items()])


def proc_means(
    df: DataFrame,
    stats: Mapping[str, tuple[str, str]],
    by: Sequence[str] = (),
    keep_type_freq: bool = False,
) -> DataFrame:
    """OUTPUT OUT= of named statistics, ``{out: (statistic, column)}``."""
    aggs = {out: STATISTICS[stat.lower()](col(name)) for out, (stat, name) in stats.items()}
    if keep_type_freq:
        aggs = {"_type_": F.first(F.lit(0)), "_freq_": F.count(F.lit(1)), **aggs}
    return summarize(df, by, aggs)


def in_slices(df: DataFrame, slices: Mapping[str, Sequence]) -> DataFrame:
    """Rows of the requested slices: the cross product of lists is one IN filter per column, pushed to the scan."""
    return df.filter(all_of(col(c).isin(list(values)) for c, values in slices.items()))


def slice_aggregate(
    df: DataFrame,
    slices: Mapping[str, Sequence],
    aggs: Mapping[str, Column],
    keep_empty: bool = False,
) -> DataFrame:
    """A loop of filter, aggregate, tag and stack over slices, as one grouped pass."""
    names = list(slices)
    found = summarize(in_slices(df, slices), names, aggs)
    if not keep_empty:
        return found
    grid = df.sparkSession.range(1)
    for name in names:
        values = F.array(*[F.lit(v) for v in slices[name]]).cast(f"array<{dict(df.dtypes)[name]}>")
        grid = grid.withColumn(name, F.explode(values))
    return attach(grid.drop("id"), found, names)


def slice_map(df: DataFrame, slices: Mapping[str, Sequence], derived: Mapping[str, Column]) -> DataFrame:
    """A loop of filter, derive and stack over slices, as one projection."""
    kept = in_slices(df, slices)
    return reduce(lambda d, item: d.withColumn(*item), derived.items(), kept)


def _totals(groups: DataFrame) -> DataFrame:
    """Group rows to set beside detail rows, written once: few are broadcast, so that the details stay where they are.

    Spark takes groups for as large as the details below them, and dealt by a few keys those would be read by as few tasks.
    """
    made = store(groups)
    few = input_bytes(made) <= TEXT_BYTES and made.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return F.broadcast(made) if few else made


def remerge(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates beside every detail row.

    Aggregated first and joined back: a group of any size is summed in parts, and
    few groups are broadcast, where a window would put each group into one task.
    """
    return attach(df, _totals(summarize(df, by, aggs)), by)


def having(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], condition: Column) -> DataFrame:
    """HAVING after a remerge: detail rows of the groups that qualify."""
    return attach(df, _totals(summarize(df, by, aggs).filter(condition)), by, "inner")


def group_cardinality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups have each size."""
    sizes = summarize(df, keys, {"group_rows": F.count(F.lit(1))})
    return summarize(sizes, ["group_rows"], {"groups": F.count(F.lit(1))})


def parameters(params: DataFrame, name: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """``name`` (upper-cased) and ``value`` of a parameter table; of a repeated name the last in ``order``, then the largest."""
    picked = params.select(
        F.upper(F.trim(col(name))).alias("name"), col(value).cast("double").alias("value"), *[col(o.lstrip("-")) for o in order]
    )
    placed = number_rows(picked, ["name"], [*order, "value"], "__no")
    return placed.groupBy("name").agg(F.max_by("value", "__no").alias("value"))


def coefficients(params: DataFrame, name: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """A parameter table as one row holding a map from name to value, for tables bounded by a program's variables."""
    one = parameters(params, name, value, order)
    return one.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("params"))


def linear_score(
    df: DataFrame,
    params: DataFrame,
    name: str,
    value: str,
    variables: Sequence[str],
    out: str,
    order: Sequence[str] = (),
) -> DataFrame:
    """Sum of coefficient times column; the coefficients stay data, read by a scalar subquery.

    Only the listed variables are read from the parameter table, so its map is
    bounded by the program's variable list.
    """
    listed = params.filter(F.upper(F.trim(col(name))).isin([v.upper() for v in variables]))
    lookup = coefficients(listed, name, value, order).scalar()
    terms = [lookup[v.upper()] * col(v) for v in variables]
    return df.withColumn(out, reduce(lambda a, b: a + b, terms, F.lit(0.0)))
