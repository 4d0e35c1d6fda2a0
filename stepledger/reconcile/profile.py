"""Column profiles and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import col, lower_names
from stepledger.reconcile.families import exact, family, is_float
from stepledger.settings import ATOL, RTOL

def _summaries(df: DataFrame, kinds: dict[str, T.DataType], approx: bool) -> DataFrame:
    """One pass over a table without keys: the plain statistics of every column, one row each."""
    none = F.lit(None).cast("double")
    parts = []
    for name, kind in kinds.items():
        value, numeric = col(name), family(kind) == "numeric"
        number = value.cast("double")
        parts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(family(kind)).alias("family"),
                F.lit(is_float(kind)).alias("is_float"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(value.isNull()).alias("null_count"),
                (F.approx_count_distinct(value) if approx else F.lit(None).cast("bigint")).alias("distinct_count"),
                (F.sum(number) if numeric else none).alias("sum_value"),
                (F.sum(F.abs(number)) if numeric else none).alias("size_value"),
                (F.avg(number) if numeric else none).alias("mean_value"),
                F.min(value).cast("string").alias("min_value"),
                F.max(value).cast("string").alias("max_value"),
            )
        )
    return df.agg(F.array(*parts).alias("stats")).select(F.inline("stats"))


def _shuffled(name: str, kind: T.DataType) -> Column:
    """What is told apart in place of a value: of texts 128 bits of hash, so that none is moved."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        value = col(name)
        hashed = F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b"))
        return F.when(value.isNotNull(), hashed)
    return col(name)


def _distinct(frames: dict[str, DataFrame], kinds: dict[str, T.DataType]) -> DataFrame:
    """Exact distinct counts per column and side: ``column_name`` and one count per frame.

    Values of one type are laid out in rows and reduced by hash map-side, all sides
    together, so that a value both sides have is shuffled once. A hot value is one
    row per task.
    """
    sides = list(frames)
    by_type: dict[str, list[str]] = {}
    for name, kind in kinds.items():
        by_type.setdefault(kind.simpleString(), []).append(name)
    counted = []
    for names in by_type.values():
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), _shuffled(n, kinds[n]).alias("value")) for n in names]))
        rows = reduce(
            lambda a, b: a.union(b),
            [
                df.select(cells.alias("cell"), *[F.lit(s == side).alias(s) for s in sides])
                for side, df in frames.items()
            ],
        )
        values = rows.filter("cell.value is not null").groupBy("cell.column_name", "cell.value")
        seen = values.agg(*[F.max(s).alias(s) for s in sides])
        counted.append(seen.groupBy("column_name").agg(*[F.count_if(s).alias(s) for s in sides]))
    return reduce(lambda a, b: a.union(b), counted)


def _profiles(
    frames: dict[str, DataFrame], kinds: dict[str, T.DataType], approx: bool, floats: bool = True
) -> DataFrame:
    """Statistics of every side in long form: ``side``, ``column_name`` and the statistics.

    Without ``floats`` the values of floating columns are not counted, only summed.
    """
    rows = reduce(
        lambda a, b: a.union(b),
        [_summaries(df, kinds, approx).withColumn("side", F.lit(side)) for side, df in frames.items()],
    )
    if approx:
        return rows
    counted = {n: k for n, k in kinds.items() if floats or not is_float(k)}
    if not counted:
        return rows
    counts = _distinct(frames, counted).unpivot(["column_name"], list(frames), "side", "n")
    joined = rows.join(counts, ["side", "column_name"], "left")
    none = F.when(F.col("column_name").isin(*counted), F.lit(0))
    return joined.withColumn("distinct_count", F.coalesce("n", none)).drop("n")


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values, sum, mean, minimum, maximum."""
    plain, kinds = exact(lower_names(df), lower_names(df), [c.lower() for c in df.columns])
    return _profiles({"actual": plain}, kinds, approx).drop("is_float", "side", "size_value")


def compare_profiles(
    actual: DataFrame, golden: DataFrame, atol: float = ATOL, rtol: float = RTOL, approx: bool = False
) -> DataFrame:
    """Both profiles side by side in one job, with a verdict per column.

    Extremes of floating columns are shown but do not decide, and their distinct values are not counted:
    values within tolerance of each other may differ in them. Sums may differ by the tolerance of each value, so neither
    the order of the rows nor values that cancel out make a difference.
    """
    a, g = lower_names(actual), lower_names(golden)
    shared = sorted(set(a.columns) & set(g.columns))
    mine, kinds = exact(a, g, shared)
    theirs, _ = exact(g, a, shared)
    stats = _profiles({"actual": mine, "golden": theirs}, kinds, approx, floats=False)
    fields = [c for c in stats.columns if c not in ("side", "column_name", "family", "is_float")]
    sides = stats.groupBy("column_name", "family", "is_float").agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(f))).alias(f"{side}_{f}")
            for f in fields
            for side in ("actual", "golden")
        ]
    )

    def same(f: str) -> Column:
        return F.coalesce(F.col(f"actual_{f}"), F.lit(0)) == F.coalesce(F.col(f"golden_{f}"), F.lit(0))

    size = F.greatest("actual_size_value", "golden_size_value")
    count = F.greatest("actual_row_count", "golden_row_count")

    def near(f: str) -> Column:
        a, g = F.col(f"actual_{f}"), F.col(f"golden_{f}")
        room = atol * count + rtol * size if f == "sum_value" else atol + rtol * F.try_divide(size, count)
        return a.eqNullSafe(g) | F.coalesce(F.abs(a - g) <= room, F.lit(False))

    def equal(f: str) -> Column:
        return F.col("is_float") | F.col(f"actual_{f}").eqNullSafe(F.col(f"golden_{f}"))

    verdict = (
        same("row_count")
        & same("null_count")
        & (F.col("is_float") | same("distinct_count"))
        & near("sum_value")
        & near("mean_value")
        & equal("min_value")
        & equal("max_value")
    )
    return sides.withColumn("passed", verdict).drop("actual_size_value", "golden_size_value")
