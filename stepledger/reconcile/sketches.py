"""Mergeable column sketches: distinct values and quantiles of many tables or runs, from what each of them has stored.

A sketch is a row for each column: rows, nulls, a HyperLogLog sketch of its values and, for numbers, a KLL sketch. Sketches
of parts merge to that of the whole without reading the parts again. Distinct counts have a relative standard error
of about ``DISTINCT_ERROR``, quantiles one of about ``RANK_ERROR`` of the rows in rank; ``profile`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col, lower_names
from stepledger.reconcile.families import exact, family, plain_text

DISTINCT_BITS = 12
DISTINCT_ERROR = 0.0163  # 1.04 / sqrt(2 ** DISTINCT_BITS)
RANK_SIZE = 400
RANK_ERROR = 0.0068
FIELDS = "column_name string, row_count long, null_count long, distinct_sketch binary, quantile_sketch binary, least double, greatest double"


def column_sketches(df: DataFrame) -> DataFrame:
    """One row for each column, from one pass in which every task passes on a sketch of bounded size."""
    plain, kinds = exact(lower_names(df), lower_names(df), [c.lower() for c in df.columns])
    parts, none = [], F.lit(None).cast("double")
    for name, kind in kinds.items():
        number = col(name).cast("double") if family(kind) == "numeric" else none
        parts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(col(name).isNull()).alias("null_count"),
                F.hll_sketch_agg(plain_text(col(name), kind), F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
                (F.kll_sketch_agg_double(number, RANK_SIZE) if family(kind) == "numeric" else F.lit(None).cast("binary")).alias("quantile_sketch"),
                F.min(number).alias("least"),
                F.max(number).alias("greatest"),
            )
        )
    return plain.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several tables or runs as those of all their rows, for each value of ``by``."""
    has = F.col("quantile_sketch").isNotNull()
    return sketches.groupBy(*[col(c) for c in by], "column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.bool_or(has), F.kll_merge_agg_double("quantile_sketch", RANK_SIZE)).alias("quantile_sketch"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def estimates(sketches: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches as numbers: ``distinct_count`` and, for columns of numbers with values, ``quantiles`` at ``ranks``."""
    filled = F.col("quantile_sketch").isNotNull() & F.col("least").isNotNull()
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(r))) for r in ranks])
    return sketches.withColumns(
        {"distinct_count": F.hll_sketch_estimate("distinct_sketch"), "quantiles": F.when(filled, quantiles)}
    ).drop("distinct_sketch", "quantile_sketch")
