"""Step flows, verdict roll-ups, change detection."""

from pyspark.sql import functions as F

from stepledger.functions import text
from stepledger.lineage import graph, steps
from stepledger.operators import aggregate as A
from stepledger.operators import joins as J
from stepledger.operators import ordered as O
from stepledger.operators import rows as R
from stepledger.plans import ranges, verdicts
from stepledger.plans.changes import definition_fingerprint, manifest_by, stale_steps
from stepledger.plans.flow import Step, run_flow
from stepledger.plans.history import RunHistory
from stepledger.settings import scratch_path, store
from stepledger.sources.sinks import manifest_json, write_manifest, write_results
from stepledger_queries.base import money, query, table, total
from stepledger_queries.corpora import TEXT, corpus
from stepledger_queries.lineage import edges_cte


def load_accounts(spark, inputs):
    """Keep accounts with a positive balance, regions in upper case."""
    kept = R.where(inputs["raw.accounts"], F.col("balance") > 0)
    return R.assign(kept, {"region": text.upcase(F.col("region"))})


def price_accounts(spark, inputs):
    return J.sql_join(
        inputs["work.accounts"],
        inputs["work.rates"],
        F.col("a.nation") == F.col("b.nation"),
        "left",
        {
            "account_id": F.col("a.account_id"),
            "region": F.col("a.region"),
            "balance": F.col("a.balance"),
            "rate": F.col("b.rate"),
            "interest": (F.col("a.balance").cast("decimal(18,4)") * F.col("b.rate")).cast("decimal(18,4)"),
        },
    )


def accumulate(spark, inputs):
    return O.running_total(inputs["work.priced"], ["region"], ["account_id"], "interest", "running_interest")


def summarize(spark, inputs):
    return A.summarize(
        inputs["work.priced"],
        ["region"],
        {
            "n_accounts": F.count(F.lit(1)),
            "total_balance": total(money("balance")),
            "total_interest": total(F.col("interest")),
        },
    )


PRICING = [
    Step("step000_data_accounts", ("work.accounts",), ("raw.accounts",), load_accounts),
    Step("step001_data_rates", ("work.rates",), ("raw.rates",), lambda spark, i: i["raw.rates"].select("*")),
    Step("step002_proc_sql", ("work.priced",), ("work.accounts", "work.rates"), price_accounts),
    Step("step003_data_cumulative", ("work.cumulative",), ("work.priced",), accumulate),
    Step("step004_proc_sql", ("work.summary",), ("work.priced",), summarize),
]


def pricing(spark, sf_dir):
    """The pricing program over customers and nations: every dataset it makes, lazily."""
    accounts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.lower("c_mktsegment").alias("region"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )
    rates = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation"),
        ((F.col("n_nationkey") + 1) / F.lit(100)).cast("decimal(9,2)").alias("rate"),
    )
    return run_flow(spark, {"raw.accounts": accounts, "raw.rates": rates}, PRICING)


PRICED_SQL = """
    SELECT c_custkey AS account_id, upper(c_mktsegment) AS region, CAST(c_acctbal AS DECIMAL(18,4)) AS balance,
           CAST(CAST(c_acctbal AS DECIMAL(18,4)) * CAST(n_nationkey + 1 AS DECIMAL(9,0)) / 100 AS DECIMAL(18,4)) AS interest
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
"""


@query(
    "pl1_step_flow",
    f"""
    SELECT region, count(*) AS n_accounts, CAST(sum(balance) AS DOUBLE) AS total_balance, CAST(sum(interest) AS DOUBLE) AS total_interest
    FROM ({PRICED_SQL}) GROUP BY 1
    """,
)
def pl1_step_flow(spark, sf_dir):
    return pricing(spark, sf_dir)["work.summary"]


@query(
    "pl1_flow_running_interest",
    f"""
    SELECT account_id, region, CAST(interest AS DOUBLE) AS interest,
           CAST(sum(interest) OVER (PARTITION BY region ORDER BY account_id) AS DOUBLE) AS running_interest
    FROM ({PRICED_SQL})
    """,
)
def pl1_flow_running_interest(spark, sf_dir):
    return pricing(spark, sf_dir)["work.cumulative"].select(
        "account_id",
        "region",
        F.col("interest").cast("double").alias("interest"),
        F.col("running_interest").cast("double").alias("running_interest"),
    )


@query("x1_step_function", "SELECT o_orderpriority AS priority, max(o_totalprice) AS top_price FROM orders GROUP BY 1")
def x1_step_function(spark, sf_dir):
    def transform(spark, inputs):
        return inputs["raw.orders"].groupBy(F.col("o_orderpriority").alias("priority")).agg(
            F.max("o_totalprice").alias("top_price")
        )

    step = Step("step000_data_top", ("work.top",), ("raw.orders",), transform)
    return run_flow(spark, {"raw.orders": table(spark, sf_dir, "orders")}, [step])["work.top"]


# Check outcomes derived from orders: runs are years, programs priorities, steps groups of customers.
CHECKS_SQL = """
    SELECT CAST(year(o_orderdate) AS STRING) AS run, o_orderpriority AS program, 'step' || CAST(o_custkey % 200 AS STRING) AS step,
           CASE o_orderkey % 5 WHEN 0 THEN 'static' WHEN 1 THEN 'schema' WHEN 2 THEN 'property' WHEN 3 THEN 'data_equivalence' ELSE 'llm_judge' END AS phase,
           o_totalprice > 30000 AS passed, o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS skipped, 'order ' || CAST(o_orderkey AS STRING) AS summary
    FROM orders
"""


def checks(spark, sf_dir):
    phases = ["static", "schema", "property", "data_equivalence", "llm_judge"]
    return table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("string").alias("run"),
        F.col("o_orderpriority").alias("program"),
        F.concat(F.lit("step"), (F.col("o_custkey") % 200).cast("string")).alias("step"),
        F.element_at(F.array(*[F.lit(p) for p in phases]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("phase"),
        (F.col("o_totalprice") > 30000).alias("passed"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0)).alias("skipped"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("summary"),
    )


@query(
    "a13_verdicts",
    f"""
    WITH c AS ({CHECKS_SQL}),
    v AS (SELECT program, step, bool_and(passed OR skipped) AND bool_or(passed AND NOT skipped) AS ok FROM c GROUP BY 1, 2)
    SELECT program, count(*) AS steps, count(*) FILTER (ok) AS passed_steps, count(*) FILTER (NOT ok) AS review_steps, count(*) FILTER (NOT ok) = 0 AS all_passed
    FROM v GROUP BY 1
    """,
)
def a13_verdicts(spark, sf_dir):
    return verdicts.roll_up(verdicts.step_verdicts(checks(spark, sf_dir)), ["program"])


@query(
    "a14_strength",
    f"""
    WITH c AS ({CHECKS_SQL})
    SELECT program, step, bool_or(phase IN ('schema', 'property', 'data_equivalence') AND passed AND NOT skipped) AS data_verified,
           bool_or(phase IN ('schema', 'property', 'data_equivalence') AND NOT skipped) AS data_ran,
           bool_or(phase = 'llm_judge' AND passed AND NOT skipped) AS judged
    FROM c GROUP BY 1, 2
    """,
)
def a14_strength(spark, sf_dir):
    return verdicts.strength(checks(spark, sf_dir), ["program", "step"])


@query("pl3_review", f"SELECT program, step, phase, summary FROM ({CHECKS_SQL}) WHERE NOT passed AND NOT skipped")
def pl3_review(spark, sf_dir):
    return verdicts.review(checks(spark, sf_dir))


@query(
    "s12_result_manifest",
    f"""
    SELECT program, step, '{{"phase":"' || phase || '","passed":' || passed || ',"skipped":' || skipped || '}}' AS json FROM ({CHECKS_SQL})
    """,
)
def s12_result_manifest(spark, sf_dir):
    return manifest_json(checks(spark, sf_dir).drop("run", "summary"), ["program", "step"])


@query(
    "pl2_stale_steps",
    f"""
    WITH RECURSIVE {edges_cte()},
    kind AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS k FROM part),
    changed AS (SELECT 'raw.' || max(k) AS dataset FROM kind),
    own AS (SELECT program, idx FROM steps WHERE CAST(substring(program, 5) AS BIGINT) % 97 = 0 AND idx = 0
            UNION SELECT program, idx FROM io JOIN changed USING (dataset)),
    down(program, idx) AS (SELECT program, idx FROM own UNION SELECT e.program, e.dst FROM down d JOIN edges e ON e.program = d.program AND e.src = d.idx)
    SELECT program, idx FROM down
    """,
)
def pl2_stale_steps(spark, sf_dir):
    """Programs edited since the last run, and one raw dataset whose rows changed."""
    now = store(steps.extract_steps(corpus(spark, sf_dir)))
    edited = f"CASE WHEN p_partkey % 97 = 0 THEN replace({TEXT}, 'nocenter', 'center') ELSE {TEXT} END"
    before = steps.extract_steps(corpus(spark, sf_dir, edited))
    io = steps.step_io(now)
    part = table(spark, sf_dir, "part").withColumn(
        "dataset", F.concat(F.lit("raw."), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))))
    )
    last = part.agg(F.max("dataset")).scalar()
    dearer = F.when(F.col("dataset") == last, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    data, old = manifest_by(part, "dataset"), manifest_by(part.withColumn("p_retailprice", dearer), "dataset")
    named = [d.withColumn("fingerprint", definition_fingerprint(F.col("text"))) for d in (now, before)]
    return stale_steps(named[0], named[1], data, old, io, graph.edges(io))


def orders_changed_in_places(spark, sf_dir):
    """Orders with a few key ranges changed: dearer, dropped, written twice; and new keys far above."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    here = k.between(2000, 2600)
    dearer = F.when(here & (k % 10 == 1), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter(~(here & (k % 50 == 3))).withColumn("o_totalprice", dearer)
    new = orders.filter("o_orderkey < 20").withColumn("o_orderkey", k + 1_000_000_000)
    return kept.unionByName(new).unionByName(orders.filter(k.between(3000, 3040) & (k % 7 == 0)))


@query(
    "pl2_changed_keys",
    """
    SELECT o_orderkey AS key, CASE WHEN o_orderkey % 50 = 3 THEN 'removed' ELSE 'changed' END AS change FROM orders
    WHERE o_orderkey BETWEEN 2000 AND 2600 AND (o_orderkey % 10 = 1 OR o_orderkey % 50 = 3)
    UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM orders WHERE o_orderkey < 20
    UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey BETWEEN 3000 AND 3040 AND o_orderkey % 7 = 0
    """,
)
def pl2_changed_keys(spark, sf_dir):
    """Two versions written in order of their key; only the ranges whose checksums differ are compared by key."""
    before = ranges.write_by_key(table(spark, sf_dir, "orders"), "o_orderkey")
    now = ranges.write_by_key(orders_changed_in_places(spark, sf_dir), "o_orderkey")
    nodes = ranges.differing(*[store(ranges.tree(df, "o_orderkey")) for df in (now, before)])
    return ranges.changed_keys(now, before, "o_orderkey", nodes)


@query(
    "r9_run_history",
    f"""
    WITH c AS (FROM ({CHECKS_SQL}) WHERE run IN ('1996', '1997', '1998')),
    v AS (SELECT run, program, step, bool_and(passed OR skipped) AND bool_or(passed AND NOT skipped) AS ok FROM c GROUP BY 1, 2, 3)
    SELECT run, count(*) AS steps, count(*) FILTER (ok) AS passed_steps, round(count(*) FILTER (ok) / count(*), 9) AS pass_rate,
           (SELECT '{{"checks":' || count(*) || ',"engine":null}}' FROM c WHERE c.run = v.run) AS manifest
    FROM v GROUP BY 1
    """,
)
def r9_run_history(spark, sf_dir):
    """Pass rates over the runs on record: one is staged and never committed, one is handed in twice with other checks."""
    rows = checks(spark, sf_dir)
    history = RunHistory(spark, scratch_path(spark, "history"))
    of = lambda run: rows.filter(F.col("run") == run).drop("run")
    for run in ("1996", "1997", "1998"):
        settings = of(run).agg(F.count(F.lit(1)).alias("checks"), F.lit(None).cast("string").alias("engine"))
        history.record(run, {"checks": of(run)}, settings)
    history.stage("1999", {"checks": of("1999")})
    history.record("1997", {"checks": of("2000")})
    rates = verdicts.pass_rate(history.table("checks")).withColumn("pass_rate", F.round("pass_rate", 9))
    return rates.join(history.runs().select("run", "manifest"), "run")


@query(
    "s12_written_results",
    f"""
    WITH c AS ({CHECKS_SQL}), v AS (SELECT program, step, bool_and(passed OR skipped) AND bool_or(passed AND NOT skipped) AS ok FROM c GROUP BY 1, 2)
    SELECT program, count(*) AS steps, count(*) FILTER (ok) AS passed_steps, (SELECT count(*) FROM c WHERE c.program = v.program) AS documents,
           (SELECT count(*) FROM c WHERE c.program = v.program AND phase = 'schema' AND passed) AS passed_schema
    FROM v GROUP BY 1
    """,
)
def s12_written_results(spark, sf_dir):
    """Verdict tables and the manifest written to files and read back."""
    rows = checks(spark, sf_dir)
    folder = scratch_path(spark, "results")
    tables = {"steps": verdicts.step_verdicts(rows), "programs": verdicts.roll_up(verdicts.step_verdicts(rows), ["program"])}
    paths = write_results(tables, folder)
    written = write_manifest(manifest_json(rows.select("program", "step", "phase", "passed", "skipped"), ["program", "step"]), f"{folder}/manifest")
    lines = spark.read.schema("program string, step string, json string").json(written)
    lines = lines.withColumn("m", F.from_json("json", "phase string, passed boolean, skipped boolean"))
    counted = lines.groupBy("program").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("m.phase") == "schema") & F.col("m.passed")).alias("passed_schema")
    )
    return spark.read.parquet(paths["programs"]).select("program", "steps", "passed_steps").join(counted, "program")


@query(
    "pl1_eligible_steps",
    f"""
    WITH RECURSIVE {edges_cte()},
    status AS (SELECT program, idx, (CAST(substring(program, 5) AS BIGINT) + idx) % 11 AS r FROM steps),
    state AS (SELECT program, idx, CASE r WHEN 3 THEN 'failed' WHEN 7 THEN 'translated' WHEN 9 THEN NULL ELSE 'passed' END AS status FROM status),
    lost(program, idx) AS (
        SELECT program, idx FROM state WHERE status IS NULL OR status = 'failed'
        UNION SELECT e.program, e.dst FROM lost JOIN edges e ON e.program = lost.program AND e.src = lost.idx)
    SELECT s.program, s.idx, CASE WHEN status IS NULL OR status = 'failed' THEN 'left out' WHEN l.idx IS NOT NULL THEN 'lacks inputs' ELSE 'runs' END AS verdict
    FROM state s LEFT JOIN lost l ON l.program = s.program AND l.idx = s.idx
    """,
)
def pl1_eligible_steps(spark, sf_dir):
    found = store(steps.extract_steps(corpus(spark, sf_dir)))
    r = (F.substring("program", 5, 20).cast("long") + F.col("idx")) % 11
    status = F.when(r == 3, "failed").when(r == 7, "translated").when(r == 9, None).otherwise("passed")
    states = found.select("program", "idx", status.alias("status"))
    made = verdicts.eligibility(states, graph.edges(steps.step_io(found)), include_unverified=True)
    return made.select("program", "idx", "verdict")
