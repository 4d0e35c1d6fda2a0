"""Aggregates, slices, remerge filters."""

from pyspark.sql import functions as F

from stepledger.operators import aggregate as A
from stepledger.reconcile import profile
from stepledger_queries.base import money, query, table, total


@query(
    "a1_group_summary",
    """
    SELECT c_mktsegment AS region, count(*) AS n_accounts, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS total_balance
    FROM customer GROUP BY 1
    """,
)
def a1_group_summary(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "region")
    return A.summarize(df, ["region"], {"n_accounts": F.count(F.lit(1)), "total_balance": total(money("c_acctbal"))})


@query(
    "a2_count_variants",
    """
    SELECT l_returnflag, count(*) AS n_rows, count(nullif(l_discount, 0)) AS n_discounts,
           count(DISTINCT nullif(l_discount, 0)) AS distinct_discounts, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY 1
    """,
)
def a2_count_variants(spark, sf_dir):
    discount = F.nullif("l_discount", F.lit(0.0))
    return A.summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        {
            "n_rows": F.count(F.lit(1)),
            "n_discounts": F.count(discount),
            "distinct_discounts": F.count_distinct(discount),
            "suppliers": F.count_distinct("l_suppkey"),
        },
    )


@query(
    "a3_proc_means",
    """
    SELECT l_returnflag, 0 AS _type_, count(*) AS _freq_, sum(l_quantity) AS total_qty, min(l_discount) AS low,
           max(l_extendedprice) AS high, round(avg(l_quantity), 6) AS mean_qty, CAST(count(*) FILTER (l_tax IS NULL) AS BIGINT) AS gone
    FROM (SELECT * REPLACE (nullif(l_tax, 0) AS l_tax) FROM lineitem) GROUP BY 1
    """,
)
def a3_proc_means(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    stats = {
        "total_qty": ("sum", "l_quantity"),
        "low": ("min", "l_discount"),
        "high": ("max", "l_extendedprice"),
        "mean_qty": ("mean", "l_quantity"),
        "gone": ("nmiss", "l_tax"),
    }
    return A.proc_means(df, stats, ["l_returnflag"], keep_type_freq=True).withColumn(
        "mean_qty", F.round("mean_qty", 6)
    )


SLICES = {"o_orderstatus": ["F", "O", "X"], "year": [1995, 1996, 1997]}


def order_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


@query(
    "a4_slice_aggregate",
    """
    WITH grid AS (SELECT s AS o_orderstatus, CAST(y AS INTEGER) AS year FROM (SELECT unnest(['F', 'O', 'X']) AS s), (SELECT unnest([1995, 1996, 1997]) AS y)),
    t AS (SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, CAST(sum(CAST(o_totalprice * 1.25 AS DECIMAL(18,4))) AS DOUBLE) AS total_usd
          FROM orders GROUP BY 1, 2)
    SELECT g.o_orderstatus, g.year, n, total_usd FROM grid g LEFT JOIN t ON g.o_orderstatus = t.o_orderstatus AND g.year = t.year
    """,
)
def a4_slice_aggregate(spark, sf_dir):
    usd = (F.col("o_totalprice") * 1.25).cast("decimal(18,4)")
    return A.slice_aggregate(
        order_years(spark, sf_dir), SLICES, {"n": F.count(F.lit(1)), "total_usd": total(usd)}, keep_empty=True
    )


@query(
    "a5_slice_map",
    """
    SELECT o_orderkey, o_orderstatus, year(o_orderdate) AS year, o_totalprice / 12 AS monthly, o_totalprice / 12 + 1 AS score
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'X') AND year(o_orderdate) IN (1995, 1996, 1997)
    """,
)
def a5_slice_map(spark, sf_dir):
    out = A.slice_map(
        order_years(spark, sf_dir), SLICES, {"monthly": F.col("o_totalprice") / 12, "score": F.col("monthly") + 1}
    )
    return out.select("o_orderkey", "o_orderstatus", "year", "monthly", "score")


@query(
    "a6_sum_mean",
    """
    SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean_qty
    FROM lineitem GROUP BY 1
    """,
)
def a6_sum_mean(spark, sf_dir):
    return A.summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_suppkey"],
        {"sum_price": total(money("l_extendedprice")), "mean_qty": F.round(F.avg("l_quantity"), 6)},
    )


@query(
    "a7_having",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 12
    """,
)
def a7_having(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.having(df, ["o_custkey"], {"n": F.count(F.lit(1))}, F.col("n") > 12)


def profile_sql(name: str, columns: list[tuple[str, bool]]) -> str:
    parts = []
    for c, number in columns:
        value = f"CAST({c} AS DECIMAL(18,4))" if number else "NULL"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"count(DISTINCT {c}) AS distinct_count, CAST(sum({value}) AS DOUBLE) AS sum_value FROM {name}"
        )
    return " UNION ALL ".join(parts)


@query(
    "a8_profile",
    profile_sql(
        "(SELECT * REPLACE (nullif(o_custkey % 10, 0) AS o_custkey) FROM orders)",
        [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)],
    ),
)
def a8_profile(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_custkey", F.nullif(F.col("o_custkey") % 10, F.lit(0)))
    return profile(df).select(
        "column_name", "row_count", "null_count", "distinct_count", F.round("sum_value", 2).alias("sum_value")
    )


@query(
    "a9_group_cardinality",
    "SELECT n AS group_rows, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1",
)
def a9_group_cardinality(spark, sf_dir):
    return A.group_cardinality(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
