"""Token counts as delta-maintained rollups.

The rollup of a corpus is kept as signed deltas: every batch of changes is summed to one row for each
(source, language, tokenizer version) and written under its own id. An insert adds a document and its
tokens, a delete takes both away, a revision takes the old count away under the old tokenizer
version and adds the new one under the new. Totals are the sums of the committed deltas, so a
batch costs what it changes and never reads the corpus again.

A batch is committed by a row in the log, written after its delta. A batch that fails before has no
effect and its delta is overwritten by the next try; one that is committed already is not applied again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stepledger.llm.common import whole, words
from stepledger.settings import scratch_path

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
LOG = "batch string, changes long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def changes(
    docs: DataFrame,
    kind: str,
    old: tuple[str, Column] | None = None,
    new: tuple[str, Column] | None = None,
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """Signed rows for ``docs``: ``old`` and ``new`` are (tokenizer version, token count).

    ``insert`` needs ``new``, ``delete`` needs ``old``, ``revise`` both. A null count adds no tokens.
    """
    needed = {INSERT: (False, True), DELETE: (True, False), REVISE: (True, True)}[kind]
    if needed != (old is not None, new is not None):
        raise ValueError(f"{kind} takes {'an old' if needed[0] else 'no old'} and {'a new' if needed[1] else 'no new'} count")

    def entry(sign: int, state: tuple[str, Column]) -> Column:
        version, tokens = state
        return F.struct(
            F.lit(version).alias("tokenizer"),
            F.lit(sign).cast("long").alias("documents"),
            (sign * F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"),
        )

    entries = ([entry(-1, old)] if old else []) + ([entry(1, new)] if new else [])
    picked = docs.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.explode(F.array(*entries)).alias("e"))
    return picked.select("source", "lang", "e.*")


class TokenRollup:
    """A rollup in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{part}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        return self._read("log", LOG).select("batch").distinct()

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply ``rows`` (from ``changes``) as ``batch``; false if it was committed before.

        Any text is an id, the empty one too; none is an error, as such a batch could not be told from another. A hot source is summed in the tasks that read it, before anything is shuffled.
        """
        if not isinstance(batch, str):
            raise TypeError("a batch is named by a text")
        if self.committed().filter(F.col("batch") == batch).take(1):
            return False
        sums = rows.groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("_rows")
        )
        # The id is data, never part of a path: the folder is named by its hash.
        path = f"{self.folder}/deltas/part-{hashlib.sha256(batch.encode()).hexdigest()}"
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(path)
        counted = self.spark.read.parquet(path).agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("changes"))
        counted.select(F.lit(batch).alias("batch"), "changes").write.mode("append").parquet(f"{self.folder}/log")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over the committed batches; groups back at zero are left out."""
        deltas = self._read("deltas", DELTA + ", batch string")
        return (
            deltas.join(self.committed(), "batch", "left_semi")
            .groupBy(*KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .filter("documents <> 0 or tokens <> 0")
        )


def words_v1(text: Column) -> Column:
    """Runs of characters that are not blank."""
    return F.size(words(whole(text))).cast("long")


def words_v2(text: Column) -> Column:
    """As ``words_v1``, with ASCII punctuation marks as tokens of their own."""
    apart = F.regexp_replace(whole(text), r"([!-/:-@\[-`{-~])", " $1 ")
    return F.size(words(apart)).cast("long")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rollup after four batches over whole tables, one of them committed twice.

    All documents are loaded under the first tokenizer version, those in English are recounted under the
    second, and those labelled as of low quality are taken out again, with the count they then had.
    """
    rollup = TokenRollup(docs.sparkSession, scratch_path(docs.sparkSession, "rollup"))
    v1, v2 = ("words-1", words_v1(F.col("text"))), ("words-2", words_v2(F.col("text")))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    low = labels.filter("quality = 0").select("doc_id").distinct()
    # Counted before the join, so that no text is moved; a semi join would be pushed below the count.
    now = F.when(english, v2[1]).otherwise(v1[1]).alias("now")
    gone = docs.select("doc_id", "source", "lang", now).join(low, "doc_id")
    rollup.commit("load", changes(docs, INSERT, new=v1))
    rollup.commit("recount", changes(docs.filter(english), REVISE, old=v1, new=v2))
    rollup.commit("remove-en", changes(gone.filter(english), DELETE, old=(v2[0], F.col("now"))))
    rollup.commit("remove-other", changes(gone.filter(~english), DELETE, old=(v1[0], F.col("now"))))
    rollup.commit("recount", changes(docs.filter(english), REVISE, old=v1, new=v2))
    return rollup.totals()


