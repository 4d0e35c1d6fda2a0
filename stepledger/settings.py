"""Defaults shared by the operators, and the shared folder for cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reconciliation defaults.
ATOL = 1e-9
RTOL = 1e-6
MAX_REPORT = 20
PREVIEW_ROWS = 5
PREVIEW_COLUMNS = 20
PREVIEW_CHARS = 1500
DEFAULT_LIBRARY = "work"

# Bytes of tables for each range of ordered rows, and for each task that lexes texts, which costs far more a byte.
PIECE_BYTES = 64 << 20
TEXT_BYTES = 8 << 20
UNKNOWN_BYTES = 1 << 62  # what Spark gives for a table that it has no figure for lies above

# The folder below the warehouse that holds written tables where the session names no other.
SCRATCH = "_stepledger"


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables below ``df``, as the optimizer counts them after pruning; joins do not multiply them.

    Rows that the program itself hands in have no known size and count as none.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def task_count(df: DataFrame, each: int) -> int:
    """How many tasks ``df`` is cut into: one for ``each`` bytes of its tables, one a core at least.

    An explicit count is kept by Spark, where one that it chooses is merged by bytes alone, whatever the work on them.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // each))


def piece_count(df: DataFrame) -> int:
    """Ranges that ordered operators cut the rows of ``df`` into; the session can set it."""
    given = df.sparkSession.conf.get("spark.stepledger.pieces", None)
    return int(given) if given else task_count(df, PIECE_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can write: ``spark.checkpoint.dir``, else one below the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{SCRATCH}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, in one folder per application that can go when it ends."""
    root = f"{shared_dir(spark).rstrip('/')}/stepledger/{spark.sparkContext.applicationId}"
    return f"{root}/{label}-{uuid.uuid4().hex}"


class Tables:
    """The tables written by ``store`` while a ``tables`` block runs; they go when it ends, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that outlives this block: it belongs to the block around, or to the application."""
        _BLOCKS.blocks.remove(self)
        try:
            return store(df)
        finally:
            _BLOCKS.blocks.append(self)

    def free(self) -> None:
        _delete(self.spark, self.paths)
        self.paths = []


class _Blocks(threading.local):
    def __init__(self) -> None:
        self.blocks: list[Tables] = []


_BLOCKS = _Blocks()


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """A block whose written tables are deleted when it ends; a result that is still needed is handed to ``keep``.

    Blocks nest: a table belongs to the innermost one of its thread. Without a block it stays until the application's folder goes.
    """
    block = Tables(spark)
    _BLOCKS.blocks.append(block)
    try:
        yield block
    finally:
        _BLOCKS.blocks.remove(block)
        block.free()


def release(*stored: DataFrame) -> None:
    """Delete tables after their last use, given as ``store`` returned them."""
    for df in stored:
        _delete(df.sparkSession, [df._stepledger_path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    For a result that several passes read, and to cut the lineage of iterations: a
    lost executor costs no more than reading the table again. Readers prune its
    columns, and the optimizer knows its true size.
    """
    path = scratch_path(df.sparkSession, "table")
    if _BLOCKS.blocks:
        _BLOCKS.blocks[-1].paths.append(path)  # before the write, so that a failed one goes as well
    # A column of nothing but untyped nulls has no file type; it counts as text.
    untyped = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({n: F.lit(None).cast("string") for n in untyped}) if untyped else df
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stepledger_path = path
    return made
