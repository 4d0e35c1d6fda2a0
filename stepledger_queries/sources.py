"""Scans, catalogs and sinks."""

import os

from pyspark.sql import functions as F

from stepledger.settings import scratch_path
from stepledger.sources.catalog import Catalog, catalog, describe, preview, read_path, with_file_order, write_dataset
from stepledger_queries.base import query, table

TABLES = [
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
]
VALUES = ", ".join(f"('work.{t}', 'parquet')" for t in TABLES)


@query("s1_catalog", f"SELECT * FROM (VALUES {VALUES}) v(key, format)")
def s1_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).select("key", "format")


@query(
    "s2_parquet_scan",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00'",
)
def s2_parquet_scan(spark, sf_dir):
    path = os.path.join(sf_dir, "lineitem.parquet")
    return read_path(spark, path).filter("l_shipdate < timestamp'1996-01-01 00:00:00'").select("l_orderkey", "l_extendedprice")


@query("s2_file_order", "SELECT count(*) AS n, max(i) AS last_index FROM (SELECT row_number() OVER () - 1 AS i FROM supplier)")
def s2_file_order(spark, sf_dir):
    rows = with_file_order(spark, os.path.join(sf_dir, "supplier.parquet"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last_index"))


CSV_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s3_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s3_csv_scan(spark, sf_dir):
    path = write_dataset(table(spark, sf_dir, "customer"), scratch_path(spark, "customer") + ".csv")
    return read_path(spark, path, CSV_SCHEMA)


@query(
    "s4_dataset_write",
    """
    SELECT ending, doc_id, md5(text) AS text, lang, source, n_chars
    FROM documents, (VALUES ('parquet'), ('csv'), ('tsv')) e(ending)
    """,
)
def s4_dataset_write(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    parts = []
    for ending in ("parquet", "csv", "tsv"):
        path = write_dataset(documents, f"{scratch_path(spark, 'documents')}.{ending}")
        back = read_path(spark, path, documents.schema)
        parts.append(back.select(F.lit(ending).alias("ending"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "lang", "source", "n_chars"))
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "s5_library_copy",
    " UNION ALL ".join(f"SELECT 'golden.{t}' AS key, count(*) AS n FROM {t}" for t in TABLES),
)
def s5_library_copy(spark, sf_dir):
    root = scratch_path(spark, "library")
    Catalog(spark, sf_dir).copy_library("work", "golden", root)
    copied = Catalog(spark, root)
    parts = [copied[k].agg(F.lit(k).alias("key"), F.count(F.lit(1)).alias("n")) for k in copied.keys()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "s7_describe",
    """
    SELECT position, column_name, type, (SELECT count(*) FROM orders) AS row_count
    FROM (VALUES (1, 'o_orderkey', 'int'), (2, 'o_custkey', 'int'), (3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'),
                 (5, 'o_orderdate', 'datetime'), (6, 'o_orderpriority', 'string')) v(position, column_name, type)
    """,
)
def s7_describe(spark, sf_dir):
    return describe(table(spark, sf_dir, "orders"))


@query("s8_preview", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def s8_preview(spark, sf_dir):
    return preview(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"])


@query("s9_dataset_reuse", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def s9_dataset_reuse(spark, sf_dir):
    store = Catalog(spark, sf_dir)
    assert store["work.orders"] is store["WORK.ORDERS"]
    return store["work.orders"].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
