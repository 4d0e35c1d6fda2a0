"""Schema comparison: missing and extra columns, type families, row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.columns import lower_names
from stepledger.reconcile.families import families

SCHEMA = "column_name string, issue string, actual string, golden string"


def column_issues(actual: DataFrame, golden: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """Issues known from the two schemas alone; no job runs."""
    fa, fg = families(lower_names(actual)), families(lower_names(golden))
    rows = [(c, "missing", None, fg[c]) for c in sorted(set(fg) - set(fa))]
    rows += [(c, "extra", fa[c], None) for c in sorted(set(fa) - set(fg))]
    rows += [(c, "family", fa[c], fg[c]) for c in sorted(set(fa) & set(fg)) if fa[c] != fg[c]]
    return rows


def schema_differences(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per difference; empty when the schemas and row counts agree."""
    spark = actual.sparkSession
    known = spark.createDataFrame(column_issues(actual, golden), SCHEMA)
    sides = actual.select(F.lit(True).alias("mine")).union(golden.select(F.lit(False)))
    counts = sides.agg(F.count_if("mine").alias("a"), F.count_if(~F.col("mine")).alias("g")).filter("a <> g")
    return known.union(
        counts.select(
            F.lit("*").alias("column_name"),
            F.lit("row count").alias("issue"),
            F.col("a").cast("string").alias("actual"),
            F.col("g").cast("string").alias("golden"),
        )
    )
