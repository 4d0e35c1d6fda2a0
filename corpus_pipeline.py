"""The corpus pipeline: documents in, encoded documents out, with a written table after each stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.llm import byte_bpe, mixing, near_dups, quality, secret_scan
from stepledger.llm.common import fresh
from stepledger.settings import store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules, are full of symbols, or fail a rule for which their host is under suspicion."""
    at = fresh(docs, "quality")
    return quality.judge(docs, out=at).filter(F.col(at)["kept"]).drop(at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    return near_dups.deduplicate(docs, near_dups.Rule(size=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret of a text is replaced by its kind; every document stays."""
    return secret_scan.redact(docs, length="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not, once or twice."""
    at = fresh(docs, "mix")
    mixed = mixing.mix(docs, out=at)
    copy = fresh(docs, "copy")
    copies = F.expr(f"sequence(1, {at}.copies)")
    return mixed.filter(F.col(at)["copies"] > 0).withColumn(copy, F.explode(copies)).select(*docs.columns)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, as little-endian unsigned 32-bit integers; a text is given back as ``decoded`` from its ids."""
    coded = byte_bpe.pack(
        docs.select("doc_id", "lang", "source", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    ids = F.col("bpe")["ids"]
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        ids.alias("ids"),
        F.col("bpe")["decoded"].cast("string").alias("decoded"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mix", source_mix),
    ("byte-level BPE", byte_pairs),
]
# Minima, merges and hashes are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
