"""Run history: the tables of a run and its manifest become visible together, by one commit row.

A run is first staged: each of its tables is appended under an attempt of its own. Then one small file with the row
(run, attempt, manifest) is added to the commits, and from then on readers see the run. A run that fails before leaves rows
of an attempt that no commit names, which no reader sees; a run that is recorded again is left as it is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.columns import col

COMMITS = "run string, attempt string, tables array<string>, manifest string"


class RunHistory:
    """The history in a folder that driver and executors share. One writer commits a run; readers need no lock."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def runs(self) -> DataFrame:
        """run, attempt, tables, manifest (JSON) of the committed runs."""
        path = f"{self.folder}/commits"
        if not self._there(path):
            return self.spark.createDataFrame([], COMMITS)
        # Of a run committed by two writers at once the one of the lower attempt counts, for every reader.
        rows = self.spark.read.schema(COMMITS).parquet(path)
        return rows.groupBy("run").agg(F.min_by(F.struct("attempt", "tables", "manifest"), "attempt").alias("c")).select("run", "c.*")

    def stage(self, run: str, results: Mapping[str, DataFrame]) -> str:
        """Write the tables of a run, as yet unseen; the attempt to commit."""
        for name in results:
            if not re.fullmatch(r"\w+", name, re.ASCII):
                raise ValueError(f"no table name: {name!r}")
        attempt = uuid.uuid4().hex
        for name, df in results.items():
            taken = {"run", "attempt"} & {c.lower() for c in df.columns}
            if taken:
                raise ValueError(f"the history itself names the columns {sorted(taken)}")
            named = df.withColumns({"run": F.lit(run), "attempt": F.lit(attempt)})
            named.write.mode("append").partitionBy("attempt").parquet(f"{self.folder}/tables/{name}")
        return attempt

    def commit(self, run: str, attempt: str, names: list[str], manifest: DataFrame | None = None) -> None:
        """Make a staged run visible. ``manifest`` is one row, kept as JSON."""
        one = self.spark.createDataFrame([(run, attempt, sorted(names))], "run string, attempt string, tables array<string>")
        spell = {"ignoreNullFields": "false"}
        text = F.lit(None).cast("string") if manifest is None else F.lit(manifest.select(F.to_json(F.struct("*"), spell)).first()[0])
        one.withColumn("manifest", text).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def record(self, run: str, results: Mapping[str, DataFrame], manifest: DataFrame | None = None) -> bool:
        """Stage and commit; false, and nothing is written, if the run is in the history already."""
        if self.runs().filter(F.col("run") == run).take(1):
            return False
        self.commit(run, self.stage(run, results), list(results), manifest)
        return True

    def table(self, name: str) -> DataFrame:
        """The rows of a table in all committed runs, with their ``run``."""
        path = f"{self.folder}/tables/{name}"
        if not self._there(path):
            raise ValueError(f"no run has a table {name!r}")
        rows = self.spark.read.option("mergeSchema", "true").parquet(path)
        names = self.runs().filter(F.array_contains("tables", name)).select(F.col("attempt").alias("__a"))
        seen = rows.join(names, col("attempt").cast("string") == F.col("__a"), "left_semi")
        return seen.select("run", *[col(c) for c in rows.columns if c not in ("run", "attempt")])
