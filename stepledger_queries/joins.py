"""Joins and merges."""

from pyspark.sql import functions as F

from stepledger.operators import joins as J
from stepledger_queries.base import query, table


@query(
    "j1_left_join",
    """
    SELECT c_custkey, c_nationkey, c_acctbal, rate, c_acctbal * rate AS interest
    FROM customer LEFT JOIN (SELECT n_nationkey, (n_nationkey + 1) / 100.0::DOUBLE AS rate FROM nation WHERE n_nationkey < 20)
      ON c_nationkey = n_nationkey
    """,
)
def j1_left_join(spark, sf_dir):
    rates = table(spark, sf_dir, "nation").filter("n_nationkey < 20").withColumn("rate", (F.col("n_nationkey") + 1) / 100.0)
    return J.sql_join(
        table(spark, sf_dir, "customer"),
        rates,
        F.col("a.c_nationkey") == F.col("b.n_nationkey"),
        "left",
        {
            "c_custkey": F.col("c_custkey"),
            "c_nationkey": F.col("c_nationkey"),
            "c_acctbal": F.col("c_acctbal"),
            "rate": F.col("rate"),
            "interest": F.col("c_acctbal") * F.col("rate"),
        },
    )


@query(
    "j2_sql_joins",
    """
    SELECT 'inner' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
    UNION ALL SELECT 'left', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
    UNION ALL SELECT 'right', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
    UNION ALL SELECT 'full', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
    """,
)
def j2_sql_joins(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = (F.col("a.c_custkey") == F.col("b.o_custkey")) & (F.col("b.o_totalprice") > 400000)
    parts = [
        J.sql_join(customer, orders, on, how, {"o_orderkey": F.col("o_orderkey")}).agg(
            F.lit(how).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
        )
        for how in ("inner", "left", "right", "full")
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# The positional merge, written as a spine of positions and one join per side.
MERGE_SQL = """
    WITH a AS ({a}), b AS ({b}),
    na AS (SELECT k, max(i) AS n FROM a GROUP BY k), nb AS (SELECT k, max(i) AS n FROM b GROUP BY k),
    g AS (SELECT coalesce(na.k, nb.k) AS k, coalesce(na.n, 0) AS ca, coalesce(nb.n, 0) AS cb FROM na FULL JOIN nb ON na.k = nb.k),
    spine AS (SELECT k, ca, cb, unnest(range(1, greatest(ca, cb) + 1)) AS i FROM g)
    SELECT {select}
    FROM spine s LEFT JOIN a ON a.k = s.k AND a.i = least(s.i, s.ca) LEFT JOIN b ON b.k = s.k AND b.i = least(s.i, s.cb)
    {where}
"""


@query(
    "j3_match_merge",
    MERGE_SQL.format(
        a="SELECT c_custkey AS k, c_acctbal, 1 AS i FROM customer WHERE c_nationkey <> 3",
        b="SELECT o_custkey AS k, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders",
        select="s.k AS custkey, c_acctbal, o_orderkey, o_totalprice",
        where="",
    ),
)
def j3_match_merge(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").filter("c_nationkey <> 3")
    orders = table(spark, sf_dir, "orders")
    return J.match_merge(
        {
            "c": customer.select(F.col("c_custkey").alias("custkey"), "c_acctbal"),
            "o": orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice"),
        },
        ["custkey"],
        {"o": ["o_orderkey"]},
    )


@query(
    "j4_many_to_many",
    MERGE_SQL.format(
        a="SELECT c_nationkey AS k, c_custkey, c_acctbal AS bal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer",
        b="SELECT s_nationkey AS k, s_suppkey, s_acctbal AS bal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier",
        select="s.k AS nationkey, s.i AS place, c_custkey, s_suppkey, "
        "CASE WHEN s.cb >= s.i THEN b.bal ELSE a.bal END AS bal",
        where="",
    ),
)
def j4_many_to_many(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    return J.match_merge(
        {
            "c": customer.select(F.col("c_nationkey").alias("nationkey"), "c_custkey", F.col("c_acctbal").alias("bal")),
            "s": supplier.select(F.col("s_nationkey").alias("nationkey"), "s_suppkey", F.col("s_acctbal").alias("bal")),
        },
        ["nationkey"],
        {"c": ["c_custkey"], "s": ["s_suppkey"]},
        row_no="place",
    )


@query(
    "j5_merge_flags",
    """
    WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
    SELECT o_orderkey AS orderkey, true AS in_orders, n IS NOT NULL AS in_lines, coalesce(n, 1) AS rows_out
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'
    UNION ALL
    SELECT l_orderkey, false, true, n FROM l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')
    """,
)
def j5_merge_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    merged = J.match_merge(
        {
            "o": orders.select(F.col("o_orderkey").alias("orderkey"), "o_totalprice"),
            "l": lines.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey"),
        },
        ["orderkey"],
        {"l": ["l_linenumber", "l_partkey"]},
        {"o": "in_orders", "l": "in_lines"},
    )
    return merged.groupBy("orderkey", "in_orders", "in_lines").agg(F.count(F.lit(1)).alias("rows_out"))


TX_SQL = """
    SELECT o_custkey AS c_custkey,
           arg_max(nullif(o_totalprice, 0), o_orderkey) FILTER (o_orderkey % 3 <> 0) AS price,
           arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 5 <> 0) AS segment
    FROM (SELECT * REPLACE (o_custkey + 100 AS o_custkey) FROM orders) GROUP BY 1
"""


def transactions(spark, sf_dir):
    """Order rows as updates of customers: price and priority are missing on some rows, some keys are new."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 100).alias("c_custkey"),
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("c_acctbal"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("c_mktsegment"),
    )


@query(
    "j6_update",
    f"""
    WITH tx AS ({TX_SQL})
    SELECT coalesce(m.c_custkey, tx.c_custkey) AS c_custkey, c_name, c_nationkey,
           coalesce(price, c_acctbal) AS c_acctbal, coalesce(segment, c_mktsegment) AS c_mktsegment
    FROM customer m FULL JOIN tx ON m.c_custkey = tx.c_custkey
    """,
)
def j6_update(spark, sf_dir):
    return J.update_table(
        table(spark, sf_dir, "customer"), transactions(spark, sf_dir), ["c_custkey"], ["o_orderkey"]
    )


@query(
    "j7_modify",
    f"""
    WITH tx AS ({TX_SQL})
    SELECT m.c_custkey, c_name, c_nationkey, coalesce(price, c_acctbal) AS c_acctbal, coalesce(segment, c_mktsegment) AS c_mktsegment
    FROM customer m LEFT JOIN tx ON m.c_custkey = tx.c_custkey
    """,
)
def j7_modify(spark, sf_dir):
    return J.modify_table(
        table(spark, sf_dir, "customer"), transactions(spark, sf_dir), ["c_custkey"], ["o_orderkey"]
    )


@query(
    "j8_keyed_lookup",
    """
    WITH f AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1)
    SELECT c_custkey, o_orderkey, o_totalprice, o_custkey IS NOT NULL AS found FROM customer LEFT JOIN f ON c_custkey = o_custkey
    """,
)
def j8_keyed_lookup(spark, sf_dir):
    lookup = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    got = J.keyed_lookup(
        table(spark, sf_dir, "customer").select("c_custkey"), lookup, ["c_custkey"], ["o_orderdate", "o_orderkey"], "found"
    )
    return got.select("c_custkey", "o_orderkey", "o_totalprice", "found")


@query(
    "j9_missing_inputs",
    """
    SELECT DISTINCT 'raw.orders_' || CAST(o_custkey AS STRING) AS key FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    """,
)
def j9_missing_inputs(spark, sf_dir):
    def key(c):
        return F.concat(F.lit("raw.orders_"), F.col(c).cast("string")).alias("key")

    required = table(spark, sf_dir, "orders").select(key("o_custkey")).distinct()
    available = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(key("c_custkey"))
    return J.absent_keys(required, available, "key")
