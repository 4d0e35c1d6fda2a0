"""What the operators of this subpackage share: the word rule, ASCII folding, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# A word is a run of characters outside this class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check on the same tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, empty when null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a text without any.

    Trimming first leaves at most one empty piece, that of a text of blanks alone.
    """
    pieces = F.split(F.btrim(text, F.lit(BLANKS)), BLANK_CLASS + "+")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda w: w != ""))


def fold(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fold_text(text: str) -> str:
    """Python's side of ``fold``: bytes.lower() changes A-Z alone."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name
