"""Projections, filters, predicates."""

from pyspark.sql import functions as F

from stepledger.columns import common_columns, lower_names
from stepledger.functions import missing, numbers, text
from stepledger.operators import aggregate as A
from stepledger.operators import rows as R
from stepledger_queries.base import query, table


@query(
    "p1_where_missing",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, d AS discount
    FROM (SELECT *, nullif(l_discount, 0) AS d FROM lineitem)
    WHERE d IS NULL OR d < 0.02
    """,
)
def p1_where_missing(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0)))
    kept = R.where(df, missing.lt(F.col("discount"), 0.02))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "discount")


@query(
    "p2_assign",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           l_extendedprice * (1 - l_discount) AS net,
           CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio
    FROM lineitem
    """,
)
def p2_assign(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = R.assign(
        df,
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "ratio": numbers.divide(F.col("l_tax"), F.col("l_discount")),
        },
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "net", "ratio")


@query(
    "p3_dataset_options",
    "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
def p3_dataset_options(spark, sf_dir):
    return R.with_options(
        table(spark, sf_dir, "orders"),
        where=(F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000),
        keep=["o_orderkey", "o_custkey", "o_totalprice"],
        drop=["o_custkey"],
        rename={"o_orderkey": "id"},
    )


@query("p4_tag", "SELECT c_custkey, 'US' AS region, 2022 AS year FROM customer")
def p4_tag(spark, sf_dir):
    return R.tag(table(spark, sf_dir, "customer").select("c_custkey"), {"region": "US", "year": 2022})


@query("p5_length", "SELECT o_orderkey, rtrim(substring(o_orderpriority, 1, 2)) AS o_orderpriority FROM orders")
def p5_length(spark, sf_dir):
    return R.set_lengths(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": 2})


@query(
    "p6_put_and_read",
    """
    SELECT c_custkey,
           CAST(c_custkey AS STRING) AS key_text,
           printf('%12.2f', c_acctbal) AS balance_text,
           TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_name
                         ELSE CAST(c_custkey AS STRING) END AS DOUBLE) AS read_back,
           upper(strftime(DATE '1960-01-01' + CAST(c_custkey AS INTEGER), '%d%b%Y')) AS day_text
    FROM customer
    """,
)
def p6_put_and_read(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, ".").when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return df.select(
        "c_custkey",
        text.put(F.col("c_custkey"), "best16.").alias("key_text"),
        text.put(F.col("c_acctbal"), "12.2").alias("balance_text"),
        text.read(raw.otherwise(F.col("c_custkey").cast("string")), "8.").alias("read_back"),
        text.put_day_number(F.col("c_custkey"), "date9.").alias("day_text"),
    )


@query("p7_copy_step", "SELECT * FROM supplier")
def p7_copy_step(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("*")


# A parameter table derived from data: one coefficient per scored variable.
PARAMS_SQL = """
    SELECT 'P_SIZE' AS varname, CAST(round(avg(p_size), 3) AS DOUBLE) AS estimate FROM part
    UNION ALL SELECT 'P_RETAILPRICE', CAST(round(avg(p_retailprice), 3) AS DOUBLE) FROM part
    UNION ALL SELECT 'P_PARTKEY', CAST(count(*) AS DOUBLE) FROM part
"""


def parameters(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wide = part.agg(
        F.round(F.avg("p_size"), 3).alias("P_SIZE"),
        F.round(F.avg("p_retailprice"), 3).alias("P_RETAILPRICE"),
        F.count(F.lit(1)).cast("double").alias("P_PARTKEY"),
    )
    return wide.unpivot([], ["P_SIZE", "P_RETAILPRICE", "P_PARTKEY"], "varname", "estimate")


@query(
    "p8_linear_score",
    f"""
    WITH c AS ({PARAMS_SQL}),
    w AS (SELECT max(CASE WHEN varname = 'P_SIZE' THEN estimate END) AS a,
                 max(CASE WHEN varname = 'P_RETAILPRICE' THEN estimate END) AS b,
                 max(CASE WHEN varname = 'P_PARTKEY' THEN estimate END) AS k FROM c)
    SELECT p_partkey, round(a * p_size + b * p_retailprice + k * p_partkey, 3) AS score FROM part, w
    """,
)
def p8_linear_score(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    scored = A.linear_score(
        part, parameters(spark, sf_dir), "varname", "estimate", ["p_size", "p_retailprice", "p_partkey"], "score"
    )
    return scored.select("p_partkey", F.round("score", 3).alias("score"))


@query("p9_parameters", f"SELECT varname AS name, estimate AS value FROM ({PARAMS_SQL})")
def p9_parameters(spark, sf_dir):
    return A.parameters(parameters(spark, sf_dir), "varname", "estimate")


@query("p10_lower_names", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def p10_lower_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return lower_names(nation.toDF(*[c.upper() for c in nation.columns]))


@query(
    "p11_common_columns",
    "SELECT c_custkey, c_nationkey, false AS same_columns FROM customer",
)
def p11_common_columns(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    other = customer.select("c_custkey", "c_nationkey", F.lit(1).alias("extra"))
    shared, same = common_columns(customer, other)
    return customer.select(*shared, F.lit(same).alias("same_columns"))


@query(
    "p12_tolerance_rounding",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS price_1,
           CAST(l_quantity AS DOUBLE) AS quantity_9
    FROM lineitem
    """,
)
def p12_tolerance_rounding(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            numbers.round_to(F.col("l_extendedprice"), 0.1).alias("price_1"),
            numbers.round_to(F.col("l_quantity"), 1e-9).alias("quantity_9"),
        )
    )
