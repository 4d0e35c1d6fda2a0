"""Datasets under a folder, by ``library.name``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import col, ordering
from stepledger.settings import DEFAULT_LIBRARY, PREVIEW_CHARS, PREVIEW_COLUMNS, PREVIEW_ROWS

# File endings that are datasets, and those that can be read here.
DATASET_ENDINGS = ["sas7bdat", "sashdat", "parquet", "csv", "tsv"]
SEPARATORS = {"csv": ",", "tsv": "\t"}


def catalog(spark: SparkSession, root: str, default_library: str = DEFAULT_LIBRARY) -> DataFrame:
    """key, path, format, bytes, files of every dataset under ``root``.

    A dotted stem names library and dataset, else the folder is the library, else
    the default one. A folder with a dataset ending is one dataset of many part
    files. Contents are not read.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    )
    endings = "|".join(DATASET_ENDINGS)
    inside = F.regexp_replace(F.col("path"), r"^.*?\Q" + base + r"\E/", "")
    found = files.select(
        "length",
        F.col("path").alias("file"),
        F.regexp_extract(inside, rf"(?i)^((?:[^/]+/)*?[^/]+\.(?:{endings}))(?:/.*)?$", 1).alias("inside"),
    ).filter("inside <> ''")
    name = F.lower(F.regexp_extract("inside", r"([^/]+)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    folder = F.lower(F.regexp_extract("inside", r"([^/]+)/[^/]+$", 1))
    key = (
        F.when(stem.contains("."), stem)
        .when(folder != "", F.concat(folder, F.lit("."), stem))
        .otherwise(F.concat(F.lit(default_library + "."), stem))
    )
    return (
        found.select(
            key.alias("key"),
            F.concat(F.lit(base + "/"), F.col("inside")).alias("path"),
            F.regexp_extract(name, r"\.([^.]+)$", 1).alias("format"),
            "length",
        )
        .groupBy("key", "path", "format")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    )


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """Keys that more than one path claims."""
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("paths")).filter("paths > 1")


# Quotes are doubled inside quotes, an empty text is quoted and a missing value is not; a quoted value may hold line
# breaks and blanks at its ends, so a file is read whole by one task: write large text datasets as many files.
TEXT_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
WRITE_OPTIONS = {"emptyValue": '""', "nullValue": ""}
# A field without anything is read as this value and so as missing; a quoted empty one is not.
READ_OPTIONS = {"emptyValue": "", "nullValue": "\x00"}


def read_path(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, line_breaks: bool = True
) -> DataFrame:
    """Read a dataset by its ending. Text formats take a schema, or their types are inferred in a pass of their own.

    With ``line_breaks`` quoted values may hold them, and one task reads a whole text file. Without, a line is a
    row, and a file is read in splits by as many tasks as it has.
    """
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        return spark.read.parquet(path)
    if ending in SEPARATORS:
        options = {**READ_OPTIONS, **TEXT_OPTIONS, "multiLine": str(line_breaks).lower()}
        reader = spark.read.options(header="true", sep=SEPARATORS[ending], **options)
        return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    raise ValueError(f"cannot read {path!r}: convert it to Parquet first")


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a dataset by its ending, one file per partition."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        df.write.mode(mode).parquet(path)
    elif ending in SEPARATORS:
        df.write.mode(mode).options(header="true", sep=SEPARATORS[ending], **WRITE_OPTIONS, **TEXT_OPTIONS).csv(path)
    else:
        raise ValueError(f"unsupported format of {path!r}")
    return path


class Catalog:
    """The datasets of a folder, one DataFrame per key and session.

    Only keys and paths are held on the driver, as many as there are datasets.
    """

    def __init__(self, spark: SparkSession, root: str, schemas=None, default_library: str = DEFAULT_LIBRARY):
        self.spark = spark
        self.schemas = {k.lower(): v for k, v in (schemas or {}).items()}
        self.entries = catalog(spark, root, default_library)
        self.paths: dict[str, str] = {}
        for row in self.entries.select("key", "path").orderBy("key", "path").collect():
            if row["key"] in self.paths:
                raise ValueError(f"dataset {row['key']} is at {self.paths[row['key']]} and {row['path']}")
            self.paths[row["key"]] = row["path"]
        self.frames: dict[str, DataFrame] = {}

    def __contains__(self, key: str) -> bool:
        return key.lower() in self.paths

    def keys(self) -> list[str]:
        return sorted(self.paths)

    def __getitem__(self, key: str) -> DataFrame:
        key = key.lower()
        if key not in self.paths:
            raise KeyError(f"no dataset {key!r}")
        if key not in self.frames:
            self.frames[key] = read_path(self.spark, self.paths[key], self.schemas.get(key))
        return self.frames[key]

    def keep(self, key: str) -> DataFrame:
        """Hold a dataset that several steps read; ``release`` frees it."""
        return self[key].persist()

    def release(self, key: str) -> None:
        self[key].unpersist()

    def copy_library(self, source: str, target: str, root: str, ending: str = "parquet") -> list[str]:
        """Write every dataset of one library as a dataset of another."""
        written = []
        for key in self.keys():
            library, _, name = key.partition(".")
            if library == source.lower():
                written.append(write_dataset(self[key], f"{root.rstrip('/')}/{target.lower()}.{name}.{ending}"))
        return written


def simple_type(kind: T.DataType) -> str:
    """bool, int, double, datetime, date or string."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.NumericType):
        return "double"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "date" if isinstance(kind, T.DateType) else "string"


def describe(df: DataFrame) -> DataFrame:
    """One row per column with its simple type and the table's row count."""
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(simple_type(f.dataType)).alias("type"))
            for i, f in enumerate(df.schema.fields, 1)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(columns), "row_count")


def preview(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS, columns: int = PREVIEW_COLUMNS) -> DataFrame:
    """The first rows in ``order``, at most ``columns`` columns; a top-k, not a sort of the table."""
    return df.orderBy(*ordering(df, order)).limit(rows).select(*[col(c) for c in df.columns[:columns]])


def preview_text(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS, chars: int = PREVIEW_CHARS) -> str:
    found = preview(df, order, rows)
    text = "\n".join([" ".join(found.columns)] + [" ".join(str(v) for v in r) for r in found.collect()])
    return text if len(text) <= chars else text[:chars] + "\n... (truncated)"


def with_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet dataset with the file and row position each row was read from: an order at no shuffle."""
    return spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")
    )
