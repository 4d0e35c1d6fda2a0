"""Stacking, set operators, routing, row generation."""

from pyspark.sql import functions as F

from stepledger.lineage import graph
from stepledger.operators import rows as R
from stepledger.operators import stack as S
from stepledger.reconcile.schema import column_issues
from stepledger_queries.base import query, table
from stepledger_queries.ordered import EVENT_IO_SQL, event_io


@query(
    "u1_stack",
    """
    SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment, CAST(NULL AS STRING) AS name, 1 AS src FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name, 2 FROM supplier
    UNION ALL SELECT n_nationkey, NULL, NULL, n_name, 3 FROM nation
    """,
)
def u1_stack(spark, sf_dir):
    frames = [
        table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal AS bal", "c_mktsegment AS segment"),
        table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS bal", "s_name AS name"),
        table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS id", "n_name AS name"),
    ]
    return S.stack(frames, "src")


@query(
    "u2_append",
    """
    SELECT s_suppkey, s_name, s_acctbal FROM supplier
    UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer
    """,
)
def u2_append(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    data = table(spark, sf_dir, "customer").selectExpr("c_custkey AS S_SUPPKEY", "c_acctbal AS s_acctbal", "c_name AS extra")
    return S.append(base, data)


@query(
    "u3_insert",
    "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
)
def u3_insert(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return S.insert_rows(base, table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("u4_create_view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def u4_create_view(spark, sf_dir):
    S.as_view(table(spark, sf_dir, "orders").filter("o_totalprice > 200000"), "work.big_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM work_big_orders GROUP BY 1")


@query(
    "u5_multiset_difference",
    """
    WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey % 2 = 0),
    g AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey % 2 = 1),
    d AS (SELECT *, 1 AS c FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM g) UNION ALL SELECT *, -1 FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM a))
    SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, CAST(sum(c) AS BIGINT) AS copies FROM d GROUP BY 1, 2, 3, 4
    """,
)
def u5_multiset_difference(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
    return S.signed_difference(df.filter("l_suppkey % 2 = 0").select(columns), df.filter("l_suppkey % 2 = 1").select(columns))


@query(
    "u6_column_set_difference",
    """
    SELECT column_name, issue, (SELECT count(*) FROM customer) AS actual_rows
    FROM (VALUES ('c_name', 'missing'), ('c_extra', 'extra'), ('c_acctbal', 'family')) v(column_name, issue)
    """,
)
def u6_column_set_difference(spark, sf_dir):
    golden = table(spark, sf_dir, "customer")
    actual = golden.drop("c_name").withColumns({"c_extra": F.lit(1), "c_acctbal": F.col("c_acctbal").cast("string")})
    names = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("issue")) for c, i, _, _ in column_issues(actual, golden)])
    return actual.agg(F.count(F.lit(1)).alias("actual_rows")).select(F.inline(names), "actual_rows")


@query(
    "u7_external_inputs",
    f"""
    WITH io AS ({EVENT_IO_SQL}), w AS (SELECT program, dataset, min(idx) AS first_write FROM io WHERE is_write GROUP BY 1, 2)
    SELECT DISTINCT io.program, io.dataset FROM io LEFT JOIN w USING (program, dataset)
    WHERE NOT is_write AND (first_write IS NULL OR idx < first_write)
    """,
)
def u7_external_inputs(spark, sf_dir):
    return graph.external_inputs(event_io(spark, sf_dir))


@query(
    "u8_final_outputs",
    f"""
    WITH io AS ({EVENT_IO_SQL})
    SELECT program, dataset FROM io WHERE is_write EXCEPT SELECT program, dataset FROM io WHERE NOT is_write
    """,
)
def u8_final_outputs(spark, sf_dir):
    return graph.final_outputs(event_io(spark, sf_dir))


@query(
    "u9_split_outputs",
    """
    SELECT 'large' AS output, o_orderkey FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT 'final', o_orderkey FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'every', o_orderkey FROM orders
    """,
)
def u9_split_outputs(spark, sf_dir):
    outs = R.split_outputs(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"),
        {"large": F.col("o_totalprice") > 300000, "final": F.col("o_orderstatus") == "F", "every": None},
    )
    return S.stack([df.select(F.lit(name).alias("output"), "o_orderkey") for name, df in outs.items()])


@query(
    "u10_do_output",
    """
    SELECT p_partkey, CAST(i AS INTEGER) AS i, p_retailprice * i AS price
    FROM (SELECT p_partkey, p_retailprice, unnest(range(1, p_size % 5 + 1)) AS i FROM part)
    """,
)
def u10_do_output(spark, sf_dir):
    rows = R.do_output(table(spark, sf_dir, "part"), F.lit(1), F.col("p_size") % 5, "i")
    return rows.select("p_partkey", "i", (F.col("p_retailprice") * F.col("i")).alias("price"))


@query(
    "u10_array_to_rows",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, 1 AS k, l_quantity AS v FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 2, l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 3, l_tax FROM lineitem
    """,
)
def u10_array_to_rows(spark, sf_dir):
    return R.array_to_rows(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_partkey", "l_suppkey"],
        ["l_quantity", "l_discount", "l_tax"],
        "k",
        "v",
    )
