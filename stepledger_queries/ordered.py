"""BY-group operators and ordering."""

from pyspark.sql import functions as F

from stepledger.lineage import graph, steps
from stepledger.operators import aggregate as A
from stepledger.operators import ordered as O
from stepledger.operators.ordered import lag_calls
from stepledger.sources.catalog import preview
from stepledger_queries.base import money, query, table, total


@query(
    "w1_running_total",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS running
    FROM orders
    """,
)
def w1_running_total(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("price", money("o_totalprice"))
    out = O.running_total(df, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "price", "running")
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("running").cast("double").alias("running"))


@query(
    "w2_sum_statement",
    """
    SELECT event_id, user_id,
           CAST(sum(CASE WHEN event_type <> 'error' THEN coalesce(CAST(value AS DECIMAL(18,4)), 0) ELSE 0 END) OVER w AS DOUBLE) AS spent,
           CAST(count(*) FILTER (event_type = 'error') OVER w AS BIGINT) AS errors
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def w2_sum_statement(spark, sf_dir):
    value = F.when(F.col("event_type") != "error", money("value"))
    errors = F.when(F.col("event_type") == "error", F.lit(1).cast("long"))
    out = O.running_sum(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], {"spent": value, "errors": errors})
    return out.select("event_id", "user_id", F.col("spent").cast("double").alias("spent"), "errors")


@query(
    "w3_by_flags",
    """
    SELECT o_orderkey, row_number() OVER c = 1 AS first_o_custkey, row_number() OVER cd = 1 AS last_o_custkey,
           row_number() OVER s = 1 AS first_o_orderstatus, row_number() OVER sd = 1 AS last_o_orderstatus
    FROM orders
    WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey),
           cd AS (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderkey DESC),
           s AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey),
           sd AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC)
    """,
)
def w3_by_flags(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return O.by_flags(df, ["o_custkey", "o_orderstatus"], ["o_orderkey"]).drop("o_custkey", "o_orderstatus")


@query(
    "w4_retain",
    """
    WITH e AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT user_id, g, CASE WHEN value < 20 THEN NULL ELSE value END AS v FROM e WHERE event_type = 'purchase')
    SELECT event_id, e.user_id, CASE WHEN e.g = 0 THEN -1 ELSE p.v END AS last_purchase
    FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.g = e.g
    """,
)
def w4_retain(spark, sf_dir):
    value = F.when(F.col("value") >= 20, F.col("value"))
    out = O.retain(
        table(spark, sf_dir, "events"),
        ["user_id"],
        ["ts", "event_id"],
        F.col("event_type") == "purchase",
        value,
        "last_purchase",
        initial=-1.0,
    )
    return out.select("event_id", "user_id", "last_purchase")


@query(
    "w5_remerge",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
           round(l_extendedprice / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) OVER (PARTITION BY l_returnflag) AS DOUBLE), 12) AS pct,
           count(*) OVER (PARTITION BY l_returnflag) AS n
    FROM lineitem
    """,
)
def w5_remerge(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    out = A.remerge(df, ["l_returnflag"], {"sum_price": total(money("l_extendedprice")), "n": F.count(F.lit(1))})
    return out.withColumn("pct", F.round(F.try_divide("l_extendedprice", "sum_price"), 12)).drop(
        "sum_price", "l_extendedprice"
    )


@query(
    "w6_lag_lead",
    """
    SELECT o_orderkey, lag(o_totalprice) OVER w AS prior_price, lead(o_totalprice, 2) OVER w AS later_price,
           row_number() OVER w AS row_no, max(o_totalprice) OVER w AS high
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
    """,
)
def w6_lag_lead(spark, sf_dir):
    by, order = ["o_custkey"], ["o_orderkey"]
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.col("o_totalprice")
    one = O.Pass(df, by, order).shift("prior_price", price).shift("later_price", price, -2)
    return one.number("row_no").running("high", "max", price).result().drop("o_custkey", "o_totalprice")


@query("w7_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def w7_row_index(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return O.with_row_index(df, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "o1_sort_missing_first",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, discount FROM (SELECT *, nullif(l_discount, 0) AS discount FROM lineitem)
    ORDER BY discount NULLS FIRST, l_orderkey, l_partkey, l_suppkey
    """,
)
def o1_sort_missing_first(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0)))
    return O.sort_by(df, ["discount", "l_orderkey", "l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "discount"
    )


@query(
    "o2_group_order",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 NULLS FIRST",
)
def o2_group_order(spark, sf_dir):
    df = A.summarize(table(spark, sf_dir, "orders"), ["o_orderpriority"], {"n": F.count(F.lit(1))})
    return O.sort_by(df, ["o_orderpriority"])


@query("o5_head", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def o5_head(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), ["-o_totalprice", "o_orderkey"])


# Events as a history of reads and writes: the user is the program, sign-ups and purchases write.
EVENT_IO_SQL = """
    SELECT user_id AS program, event_id AS idx, 'work.d' || CAST(event_id % 7 AS STRING) AS dataset,
           event_type IN ('purchase', 'signup') AS is_write FROM events
"""


def event_io(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("program"),
        F.col("event_id").alias("idx"),
        F.concat(F.lit("work.d"), (F.col("event_id") % 7).cast("string")).alias("dataset"),
        F.col("event_type").isin("purchase", "signup").alias("is_write"),
    )


@query(
    "j10_as_of_writer",
    f"""
    WITH io AS ({EVENT_IO_SQL}),
    h AS (SELECT *, max(CASE WHEN is_write THEN idx END) OVER (PARTITION BY program, dataset ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM io)
    SELECT program, dataset, idx, writer FROM h WHERE NOT is_write
    """,
)
def j10_as_of_writer(spark, sf_dir):
    return graph.resolve_reads(event_io(spark, sf_dir))


@query(
    "a12_producers",
    f"""
    WITH io AS ({EVENT_IO_SQL})
    SELECT program, dataset, idx, row_number() OVER (PARTITION BY program, dataset ORDER BY idx) AS place FROM io WHERE is_write
    """,
)
def a12_producers(spark, sf_dir):
    return graph.producers(event_io(spark, sf_dir))


@query(
    "w9_renumber",
    """
    SELECT c_nationkey AS project, o_custkey, o_orderkey,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY o_custkey, o_orderkey) - 1 AS idx
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def w9_renumber(spark, sf_dir):
    """Orders of a customer stand for the steps of a file, the nation's customers for the files of a project."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project")
    )
    return steps.renumber(orders.join(customer, "o_custkey"), "project", ["o_custkey", "o_orderkey"])


@query(
    "w6_lag_queue",
    """
    WITH called AS (
        SELECT o_orderkey, lag(o_totalprice) OVER w AS one, lag(o_totalprice, 3) OVER w AS three
        FROM orders WHERE o_orderpriority < '3' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    every AS (
        SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS last_urgent FROM orders WHERE o_orderpriority < '2')
    SELECT o_orderkey, one, three, last_urgent FROM orders LEFT JOIN called USING (o_orderkey) LEFT JOIN every USING (o_orderkey)
    """,
)
def w6_lag_queue(spark, sf_dir):
    """Prices one and three calls ago, by customer, called for urgent orders only; and one queue over the whole table."""
    orders = table(spark, sf_dir, "orders")
    order = ["o_orderdate", "o_orderkey"]
    made = lag_calls(orders, ["o_custkey"], order, F.col("o_orderpriority") < "3", F.col("o_totalprice"), {"one": 1, "three": 3})
    made = lag_calls(made, [], order, F.col("o_orderpriority") < "2", F.col("o_orderkey"), {"last_urgent": 1})
    return made.select("o_orderkey", "one", "three", "last_urgent")
