"""Reconciliation of tables with changed copies of themselves."""

from pyspark.sql import functions as F

from stepledger import reconcile as R
from stepledger.operators.stack import signed_difference
from stepledger.reconcile.families import exact
from stepledger.plans.history import RunHistory
from stepledger.plans.verdicts import pass_rate
from stepledger.settings import scratch_path, tables
from stepledger_queries.base import ORACLE, money, query, table, total
from stepledger_queries.plans import CHECKS_SQL, checks, pricing


def changed_orders(spark, sf_dir):
    """Orders with planted changes: prices, statuses, one row in 500 gone, one in 700 twice."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    copy = (
        orders.filter(k % 500 != 3)
        .withColumn("o_totalprice", F.when(k % 100 == 7, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice")))
        .withColumn("o_orderstatus", F.when(k % 250 == 9, F.lit("X")).otherwise(F.col("o_orderstatus")))
    )
    return copy.unionByName(copy.filter(k % 700 == 11))


CHANGED_SQL = """
    base AS (SELECT * REPLACE (CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice,
                               CASE WHEN o_orderkey % 250 = 9 THEN 'X' ELSE o_orderstatus END AS o_orderstatus)
             FROM orders WHERE o_orderkey % 500 <> 3),
    changed AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 700 = 11)
"""


@query(
    "r1_schema_differences",
    f"""
    WITH {CHANGED_SQL}
    SELECT * FROM (VALUES ('o_orderpriority', 'missing', NULL, 'string'), ('o_note', 'extra', 'string', NULL),
                          ('o_custkey', 'family', 'string', 'numeric')) v(column_name, issue, actual, golden)
    UNION ALL SELECT '*', 'row count', CAST(a AS STRING), CAST(g AS STRING)
    FROM (SELECT (SELECT count(*) FROM changed) AS a, (SELECT count(*) FROM orders) AS g) WHERE a <> g
    """,
)
def r1_schema_differences(spark, sf_dir):
    actual = changed_orders(spark, sf_dir).drop("o_orderpriority").withColumn("o_note", F.lit("n"))
    actual = actual.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumnRenamed("o_orderkey", "O_ORDERKEY")
    return R.schema_differences(actual, table(spark, sf_dir, "orders"))


def _stats_sql(side: str, source: str, column: str, number: bool) -> str:
    total_sql = f"CAST(sum(CAST({column} AS DECIMAL(18,4))) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{column}' AS column_name, count(*) AS {side}_row_count, count(*) - count({column}) AS {side}_null_count, "
        f"count(DISTINCT {column}) AS {side}_distinct_count, {total_sql} AS {side}_sum, "
        f"CAST(min({column}) AS STRING) AS {side}_min, CAST(max({column}) AS STRING) AS {side}_max, {column == 'o_totalprice'} AS {side}_float FROM {source}"
    )


PROFILED = [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)]


@query(
    "r2_property_compare",
    f"""
    WITH {CHANGED_SQL}, a AS ({" UNION ALL ".join(_stats_sql("actual", "changed", c, n) for c, n in PROFILED)}),
    g AS ({" UNION ALL ".join(_stats_sql("golden", "orders", c, n) for c, n in PROFILED)})
    SELECT column_name, actual_row_count, golden_row_count, actual_null_count, golden_null_count,
           CASE WHEN NOT actual_float THEN actual_distinct_count END AS actual_distinct_count,
           CASE WHEN NOT golden_float THEN golden_distinct_count END AS golden_distinct_count, round(actual_sum, 2) AS actual_sum, round(golden_sum, 2) AS golden_sum,
           actual_row_count = golden_row_count AND actual_null_count = golden_null_count
           AND (actual_float OR (actual_distinct_count = golden_distinct_count AND actual_min = golden_min AND actual_max = golden_max))
           AND coalesce(abs(actual_sum - golden_sum) <= 0.000001 * abs(golden_sum), true) AS passed
    FROM a JOIN g USING (column_name)
    """,
)
def r2_property_compare(spark, sf_dir):
    columns = [c for c, _ in PROFILED]
    rows = R.compare_profiles(changed_orders(spark, sf_dir).select(columns), table(spark, sf_dir, "orders").select(columns))
    return rows.select(
        "column_name",
        "actual_row_count",
        "golden_row_count",
        "actual_null_count",
        "golden_null_count",
        "actual_distinct_count",
        "golden_distinct_count",
        F.round("actual_sum_value", 2).alias("actual_sum"),
        F.round("golden_sum_value", 2).alias("golden_sum"),
        "passed",
    )


@query(
    "r3_exact_multiset",
    f"""
    WITH {CHANGED_SQL}, a AS (SELECT * FROM changed), g AS (SELECT * FROM orders),
    d AS (SELECT *, 1 AS c FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM g) UNION ALL SELECT *, -1 FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM a))
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, CAST(sum(c) AS BIGINT) AS copies
    FROM d GROUP BY 1, 2, 3, 4, 5, 6
    """,
)
def r3_exact_multiset(spark, sf_dir):
    actual, golden = changed_orders(spark, sf_dir), table(spark, sf_dir, "orders")
    columns = golden.columns
    return signed_difference(exact(actual, golden, columns)[0], exact(golden, actual, columns)[0])


@query(
    "r4_value_diff",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'changed' AS issue, CAST(count(*) AS BIGINT) AS copies,
           l_extendedprice + 1 AS actual_price, l_extendedprice AS golden_price
    FROM lineitem WHERE l_orderkey % 1000 = 7
    GROUP BY ALL
    """,
)
def r4_value_diff(spark, sf_dir):
    """Line items against a copy: discounts jittered inside the tolerance, some prices off by one."""
    golden = table(spark, sf_dir, "lineitem")
    off = F.when(F.col("l_orderkey") % 1000 == 7, 1.0).otherwise(0.0)
    jitter = F.when(F.col("l_partkey") % 5 == 0, 1e-12).otherwise(0.0)
    actual = golden.withColumns(
        {"l_extendedprice": F.col("l_extendedprice") + off, "l_discount": F.col("l_discount") + jitter}
    )
    with tables(spark) as block:
        rows = R.value_diff(actual, golden).rows
        return block.keep(
            rows.select(
                "l_orderkey",
                "l_partkey",
                "l_suppkey",
                "l_linenumber",
                "issue",
                "copies",
                F.col("actual.l_extendedprice").alias("actual_price"),
                F.col("golden.l_extendedprice").alias("golden_price"),
            )
        )


@query(
    "r5_cell_diff",
    """
    SELECT o_orderkey, 'o_totalprice' AS column_name, CAST(o_totalprice + 1000 AS DECIMAL(18,2)) AS actual_number,
           CAST(o_totalprice AS DECIMAL(18,2)) AS golden_number, NULL AS actual_text, NULL AS golden_text
    FROM orders WHERE o_orderkey % 100 = 7 AND o_orderkey % 500 <> 3
    UNION ALL
    SELECT o_orderkey, 'o_orderstatus', NULL, NULL, 'X', o_orderstatus FROM orders WHERE o_orderkey % 250 = 9 AND o_orderkey % 500 <> 3
    """,
)
def r5_cell_diff(spark, sf_dir):
    cells = R.value_diff(changed_orders(spark, sf_dir), table(spark, sf_dir, "orders"), ["o_orderkey"]).cells
    number = F.col("column_name") == "o_totalprice"
    return cells.select(
        "o_orderkey",
        "column_name",
        F.when(number, F.col("actual").cast("decimal(18,2)")).alias("actual_number"),
        F.when(number, F.col("golden").cast("decimal(18,2)")).alias("golden_number"),
        F.when(~number, F.col("actual")).alias("actual_text"),
        F.when(~number, F.col("golden")).alias("golden_text"),
    )


@query(
    "r5_aligned_cells",
    """
    WITH k AS (SELECT *, o_orderkey AS key FROM orders WHERE o_orderkey % 500 <> 3)
    SELECT key, 'o_orderstatus' AS column_name, CASE WHEN key % 250 = 9 THEN 'X' ELSE 'Y' END AS actual, o_orderstatus AS golden FROM k WHERE key % 250 = 9 OR key % 500 = 77
    UNION ALL SELECT key, 'o_orderpriority', 'none', o_orderpriority FROM k WHERE key % 500 = 77
    UNION ALL SELECT key, 'o_custkey', CAST(o_custkey + 1000000 AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM k WHERE key % 250 = 31
    UNION ALL SELECT key, 'o_orderkey', CAST(key + 10000000 AS VARCHAR), CAST(key AS VARCHAR) FROM k WHERE key % 700 = 13
    UNION ALL SELECT key, 'o_totalprice', CAST(CAST(o_totalprice + 1000 AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM k WHERE key % 100 = 7
    UNION ALL SELECT o_orderkey, NULL, NULL, 'only in golden' FROM orders WHERE o_orderkey % 500 = 3
    """,
)
def r5_aligned_cells(spark, sf_dir):
    """Orders against a copy with changed cells, one or two in a row and once the key itself, compared without naming a key."""
    golden = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    changed = {
        "o_orderstatus": F.when(k % 250 == 9, "X").when(k % 500 == 77, "Y"),
        "o_orderpriority": F.when(k % 500 == 77, "none"),
        "o_custkey": F.when(k % 250 == 31, F.col("o_custkey") + 1_000_000),
        "o_totalprice": F.when(k % 100 == 7, F.col("o_totalprice") + 1000),
        "o_orderkey": F.when(k % 700 == 13, k + 10_000_000),
    }
    actual = golden.filter(k % 500 != 3).withColumns({c: F.coalesce(v, F.col(c)) for c, v in changed.items()})
    diff = R.aligned_diff(actual, golden)
    keys = diff.rows.select("pair", F.coalesce("golden.o_orderkey", "actual.o_orderkey").alias("key"))
    number = F.col("column_name") == "o_totalprice"
    text = lambda c: F.when(number, F.col(c).cast("decimal(18,2)").cast("string")).otherwise(F.col(c)).alias(c)
    cells = diff.cells.join(keys, "pair").select("key", "column_name", text("actual"), text("golden"))
    none = F.lit(None).cast("string")
    alone = diff.rows.filter("issue <> 'changed'").select(
        F.coalesce("golden.o_orderkey", "actual.o_orderkey").alias("key"), none.alias("column_name"), none.alias("actual"), F.col("issue").alias("golden")
    )
    return cells.unionByName(alone)


@query(
    "o3_tolerance_pairing",
    """
    WITH v AS (
        SELECT 'a' AS side, c_mktsegment, c_acctbal + CASE WHEN c_custkey % 100 = 3 THEN 50 ELSE 0 END + 0.0000000001 AS v FROM customer
        UNION ALL SELECT 'g', c_mktsegment, c_acctbal FROM customer),
    gaps AS (
        SELECT *, coalesce(v - lag(v) OVER (PARTITION BY c_mktsegment ORDER BY v) > 0.000000001, true) AS parted FROM v),
    clusters AS (
        SELECT *, count(*) FILTER (parted) OVER (PARTITION BY c_mktsegment ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM gaps),
    -- Inside a cluster the sides pair in order; what one side has too much is left over.
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY c_mktsegment, cluster, side ORDER BY v) AS i FROM clusters),
    apart AS (
        SELECT * FROM ranked r WHERE NOT EXISTS (
            FROM ranked o WHERE o.c_mktsegment = r.c_mktsegment AND o.cluster = r.cluster AND o.i = r.i AND o.side <> r.side)),
    -- The report pairs what is left of a segment by position.
    listed AS (
        SELECT *, row_number() OVER (PARTITION BY c_mktsegment, side ORDER BY v) AS j FROM apart)
    SELECT coalesce(x.c_mktsegment, y.c_mktsegment) AS c_mktsegment, round(x.v, 2) AS actual, round(y.v, 2) AS golden, count(*) AS copies
    FROM (FROM listed WHERE side = 'a') x FULL JOIN (FROM listed WHERE side = 'g') y ON x.c_mktsegment = y.c_mktsegment AND x.j = y.j
    GROUP BY 1, 2, 3
    """,
)
def o3_tolerance_pairing(spark, sf_dir):
    """Balances without a key: those within tolerance of each other cancel, the rest of a segment is paired by position."""
    golden = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    off = F.when(F.col("c_custkey") % 100 == 3, 50.0).otherwise(0.0)
    actual = golden.withColumn("c_acctbal", F.col("c_acctbal") + off + 1e-10)
    rows = R.value_diff(actual.drop("c_custkey"), golden.drop("c_custkey"), rtol=0.0).rows
    return rows.groupBy(
        "c_mktsegment",
        F.round("actual.c_acctbal", 2).alias("actual"),
        F.round("golden.c_acctbal", 2).alias("golden"),
    ).agg(F.sum("copies").alias("copies"))


@query(
    "o4_mismatch_sample",
    """
    SELECT issue, differs, least(n, 6) AS n FROM (
        SELECT 'changed' AS issue, concat_ws(',', CASE WHEN o_orderkey % 250 = 9 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 100 = 7 THEN 'o_totalprice' END) AS differs, count(*) AS n
        FROM orders WHERE (o_orderkey % 100 = 7 OR o_orderkey % 250 = 9) AND o_orderkey % 500 <> 3 GROUP BY 2
        UNION ALL SELECT 'only in actual', '', count(*) FROM orders WHERE o_orderkey % 700 = 11 AND o_orderkey % 500 <> 3
        UNION ALL SELECT 'only in golden', '', count(*) FROM orders WHERE o_orderkey % 500 = 3)
    WHERE n > 0
    """,
)
def o4_mismatch_sample(spark, sf_dir):
    diff = R.value_diff(changed_orders(spark, sf_dir), table(spark, sf_dir, "orders"), ["o_orderkey"])
    return diff.sample(5).groupBy("issue", F.array_join("differs", ",").alias("differs")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r6_cascade",
    """
    WITH n AS (SELECT count(*) AS n FROM supplier), v AS (SELECT sum(CASE WHEN s_suppkey % 10 = 1 THEN 1 ELSE 0 END) AS moved FROM supplier)
    SELECT step, phase, CASE WHEN step = 'moved' AND phase = 'property' THEN moved = 0
                             WHEN step = 'short' THEN n = 0 ELSE true END AS passed
    FROM n, v, (VALUES ('same', 'schema'), ('same', 'property'), ('same', 'data_equivalence'), ('moved', 'schema'), ('moved', 'property'), ('short', 'schema')) x(step, phase)
    """,
)
def r6_cascade(spark, sf_dir):
    golden = table(spark, sf_dir, "supplier")
    moved = golden.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 1, 0.5).otherwise(F.col("s_acctbal")))
    results = {
        "same": R.reconcile(golden.withColumn("s_acctbal", F.col("s_acctbal") + 1e-12), golden),
        "moved": R.reconcile(moved, golden),
        "short": R.reconcile(golden.filter("s_suppkey % 7 <> 0"), golden),
    }
    return R.checks_frame(spark, results).select("step", "phase", "passed")


@query(
    "r7_step_check",
    """
    WITH g AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS s FROM orders GROUP BY 1),
    w AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4)) + 1) AS s FROM orders GROUP BY 1)
    SELECT 'right' AS step, phase, true AS passed FROM (VALUES ('schema'), ('property'), ('data_equivalence')) p(phase)
    UNION ALL SELECT 'wrong', 'schema', (SELECT count(*) FROM g) = (SELECT count(*) FROM w)
    UNION ALL SELECT 'wrong', 'property', (SELECT sum(s) FROM g) = (SELECT sum(s) FROM w)
    UNION ALL SELECT 'broken', 'schema', (SELECT count(*) FROM g) < 0
    """,
)
def r7_step_check(spark, sf_dir):
    def summed(extra):
        def transform(spark, inputs):
            amount = F.sum(money("o_totalprice") + extra).alias("spent")
            return inputs["raw.orders"].groupBy("o_custkey").agg(amount)

        return transform

    orders = table(spark, sf_dir, "orders")
    data = {"raw.orders": orders, "work.spent": summed(0)(spark, {"raw.orders": orders})}
    steps = {"right": summed(0), "wrong": summed(1), "broken": lambda spark, inputs: inputs["raw.nothing"]}
    results = {n: R.check_step(spark, data, fn, ["raw.orders"], "work.spent") for n, fn in steps.items()}
    return R.checks_frame(spark, results).select("step", "phase", "passed")


@query(
    "r8_final_output_check",
    f"""
    WITH flow AS ({ORACLE["pl1_step_flow"]}),
    trusted AS (
        SELECT c_mktsegment AS region, count(*) AS n_accounts, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS total_balance,
               CAST(sum(CAST(CAST(c_acctbal AS DECIMAL(18,4)) * (c_nationkey + 1) / 100 AS DECIMAL(18,4))) AS DOUBLE) AS total_interest
        FROM customer WHERE c_acctbal > 0 GROUP BY 1),
    outputs AS (
        SELECT 'work.summary' AS step, * FROM flow
        UNION ALL SELECT 'work.off', region, n_accounts, total_balance, total_interest + 1 FROM flow
        UNION ALL SELECT 'work.short', * FROM flow WHERE region <> (SELECT min(region) FROM flow)),
    compared AS (
        SELECT s.step, (SELECT count(*) FROM outputs o WHERE o.step = s.step) = (SELECT count(*) FROM trusted) AS rows_met,
               (SELECT abs(sum(o.total_interest) - (SELECT sum(total_interest) FROM trusted)) FROM outputs o WHERE o.step = s.step)
                 <= 0.000001 * (SELECT sum(abs(total_interest)) FROM trusted) AS sums_met,
               NOT EXISTS (FROM outputs o WHERE o.step = s.step AND NOT EXISTS (
                 FROM trusted t WHERE t.region = o.region AND t.n_accounts = o.n_accounts AND abs(t.total_balance - o.total_balance) <= 0.000001 * abs(t.total_balance)
                 AND abs(t.total_interest - o.total_interest) <= 0.000001 * abs(t.total_interest))) AS values_met
        FROM (SELECT DISTINCT step FROM outputs) s)
    SELECT step, 'schema' AS phase, rows_met AS passed FROM compared
    UNION ALL SELECT step, 'property', sums_met FROM compared WHERE rows_met
    UNION ALL SELECT step, 'data_equivalence', values_met FROM compared WHERE rows_met AND sums_met
    UNION ALL SELECT step, 'end_to_end', rows_met AND sums_met AND values_met FROM compared
    UNION ALL SELECT 'work.absent', 'end_to_end', false
    """,
)
def r8_final_output_check(spark, sf_dir):
    """The pricing flow end to end against a summary computed on its own; two outputs are wrong, one was not produced."""
    produced = dict(pricing(spark, sf_dir))
    right = produced["work.summary"]
    first = table(spark, sf_dir, "customer").agg(F.min("c_mktsegment")).scalar()
    produced["work.off"] = right.withColumn("total_interest", F.col("total_interest") + 1)
    produced["work.short"] = right.filter(F.col("region") != first)
    interest = (money("c_acctbal") * (F.col("c_nationkey") + 1) / 100).cast("decimal(18,4)")
    trusted = (
        table(spark, sf_dir, "customer")
        .filter("c_acctbal > 0")
        .groupBy(F.col("c_mktsegment").alias("region"))
        .agg(
            F.count(F.lit(1)).alias("n_accounts"),
            total(money("c_acctbal")).alias("total_balance"),
            total(interest).alias("total_interest"),
        )
    )
    names = ["work.summary", "work.off", "work.short", "work.absent"]
    results = R.check_final_outputs(produced, {n: trusted for n in names}, names)
    return R.checks_frame(spark, results).select("step", "phase", "passed")


@query(
    "r9_pass_rate",
    f"""
    WITH c AS ({CHECKS_SQL}),
    v AS (SELECT run, program, step, bool_and(passed OR skipped) AND bool_or(passed AND NOT skipped) AS ok FROM c GROUP BY 1, 2, 3)
    SELECT run, count(*) AS steps, count(*) FILTER (ok) AS passed_steps, round(count(*) FILTER (ok) / count(*), 9) AS pass_rate FROM v GROUP BY 1
    """,
)
def r9_pass_rate(spark, sf_dir):
    return pass_rate(checks(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 9))


SKETCHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "a8_merged_sketches",
    f"""
    WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM orders" for c in SKETCHED)})
    SELECT column_name, row_count, null_count, distinct_count, true AS near_distinct,
           CASE WHEN column_name IN ('o_orderkey', 'o_custkey', 'o_totalprice') THEN true END AS near_quartiles FROM c
    """,
)
def a8_merged_sketches(spark, sf_dir):
    """Sketches of each year's orders, stored as a run and merged, held against the exact profile of all orders."""
    orders = table(spark, sf_dir, "orders")
    history = RunHistory(spark, scratch_path(spark, "sketches"))
    years = sorted(r.y for r in orders.select(F.year("o_orderdate").alias("y")).distinct().collect())
    for y in years:
        history.record(str(y), {"columns": R.column_sketches(orders.filter(F.year("o_orderdate") == y).select(SKETCHED))})
    found = R.estimates(R.merged(history.table("columns"))).withColumnRenamed("distinct_count", "about")
    known = R.profile(orders.select(SKETCHED)).select("column_name", "distinct_count")
    numbers = ["o_orderkey", "o_custkey", "o_totalprice"]
    # The share of rows up to each estimated quartile, exactly.
    quartiles = {r.column_name: r.quantiles for r in found.filter(F.col("quantiles").isNotNull()).collect()}
    below = lambda c, q: F.avg((F.col(c) <= F.lit(q)).cast("double"))
    wide = orders.agg(*[F.array(*[below(c, q) for q in quartiles[c]]).alias(c) for c in numbers])
    shares = wide.unpivot([], numbers, "column_name", "shares")
    near = F.forall(F.arrays_zip("shares", F.array(*map(F.lit, (0.25, 0.5, 0.75))).alias("at")), lambda z: F.abs(z["shares"] - z["at"]) <= 4 * R.RANK_ERROR)
    joined = found.join(known, "column_name").join(shares.select("column_name", near.alias("near_quartiles")), "column_name", "left")
    return joined.select(
        "column_name", "row_count", "null_count", "distinct_count",
        (F.abs(F.col("about") - F.col("distinct_count")) <= 4 * R.DISTINCT_ERROR * F.col("distinct_count")).alias("near_distinct"),
        "near_quartiles",
    )
