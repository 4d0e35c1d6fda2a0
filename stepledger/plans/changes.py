"""Change detection: fingerprints of definitions and of data, stale steps, their downstream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col, lower_names
from stepledger.lineage.graph import downstream
from stepledger.reconcile.families import exact

def definition_fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts, each written with its length so that parts cannot run together."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def _hashed(df: DataFrame) -> tuple[DataFrame, str]:
    """Row hashes in the exact common form, and the schema text."""
    plain, kinds = exact(lower_names(df), lower_names(df), sorted(c.lower() for c in df.columns))
    schema = ", ".join(f"{n} {k.simpleString()}" for n, k in kinds.items())
    row = F.xxhash64(*[col(c) for c in plain.columns]).cast("decimal(38,0)")
    return plain.withColumn("__hash", row), schema


def _totals() -> list[Column]:
    total = F.coalesce(F.sum("__hash"), F.lit(0)).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("row_count"), total.alias("checksum")]


def dataset_fingerprint(df: DataFrame, dataset: str) -> DataFrame:
    """One row: schema text, row count, and a checksum that ignores the row order.

    The checksum is a sum of row hashes, so it is built map-side and nothing but
    partial sums is shuffled.
    """
    rows, schema = _hashed(df)
    return rows.agg(*_totals()).select(
        F.lit(dataset).alias("dataset"), F.lit(schema).alias("schema"), "row_count", "checksum"
    )


def manifest_by(df: DataFrame, key: str) -> DataFrame:
    """Fingerprints of the datasets that share one table, told apart by ``key``, in one pass."""
    rows, schema = _hashed(df)
    return rows.groupBy(col(key.lower()).alias("dataset")).agg(*_totals()).select(
        "dataset", F.lit(schema).alias("schema"), "row_count", "checksum"
    )


def manifest(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Fingerprints of many datasets."""
    rows = None
    for name, df in datasets.items():
        one = dataset_fingerprint(df, name)
        rows = one if rows is None else rows.union(one)
    if rows is None:
        raise ValueError("no datasets")
    return rows


def changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys whose row is new or differs in any column."""
    same = [c for c in now.columns]
    match = None
    old = before.select(*[col(c).alias(f"__{c}") for c in same])
    for c in same:
        here = col(c).eqNullSafe(F.col(f"__{c}"))
        match = here if match is None else match & here
    return now.join(old, match, "left_anti").select(col(key))


def changed_definitions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Steps that are new or whose fingerprint differs.

    Steps cut out of texts are far more bytes than the size that Spark derives for them, so the earlier ones are merged,
    never gathered for a broadcast.
    """
    keys = ["program", "idx", "fingerprint"]
    return now.select(*keys).join(before.select(*keys).hint("merge"), keys, "left_anti").select("program", "idx")


def stale_steps(
    definitions_now: DataFrame,
    definitions_before: DataFrame,
    data_now: DataFrame,
    data_before: DataFrame,
    io: DataFrame,
    edge_rows: DataFrame,
) -> DataFrame:
    """Steps to run again: changed definition, changed input or output data, or downstream of such a step.

    ``definitions``: program, idx, fingerprint. ``data``: manifests. ``io``: program, idx, dataset.
    """
    own = changed_definitions(definitions_now, definitions_before)
    touched = io.join(changed(data_now, data_before, "dataset"), "dataset", "left_semi").select("program", "idx")
    return downstream(own.union(touched), edge_rows)
