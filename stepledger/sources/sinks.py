"""Result sinks: verdict tables and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row as one JSON document beside its keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("json"))


def write_results(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write every result table under the folder, as Parquet."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}.parquet"
        df.write.mode(mode).parquet(paths[name])
    return paths


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).json(path)
    return path
