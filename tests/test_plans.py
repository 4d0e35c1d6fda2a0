"""Flows, verdicts and change detection; the pricing program against its hand-computed tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stepledger import reconcile as R
from stepledger import settings
from stepledger.plans import changes, flow, ranges, verdicts
from stepledger.plans.history import RunHistory
from stepledger.settings import release, store, tables
from stepledger_queries.corpora import corpus
from stepledger_queries.plans import PRICING


@pytest.fixture
def sources(spark):
    accounts = spark.createDataFrame(
        [(21, "jp", 40.0, 0), (22, "br", 310.0, 1), (23, "br", -12.0, 1), (27, "jp", 90.0, 0)],
        "account_id long, region string, balance double, nation int",
    )
    rates = spark.createDataFrame([(0, 0.25), (1, 0.05)], "nation int, rate double")
    return {"raw.accounts": accounts, "raw.rates": rates}


def rows(df, *names):
    return sorted(tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in df.select(*names).collect())


def test_pricing_program(spark, sources, heavy):
    made = flow.run_flow(spark, sources, PRICING)
    assert rows(made["work.accounts"], "account_id", "region", "balance") == [(21, "JP", 40.0), (22, "BR", 310.0), (27, "JP", 90.0)]
    assert rows(made["work.priced"], "account_id", "rate", "interest") == [(21, 0.25, 10.0), (22, 0.05, 15.5), (27, 0.25, 22.5)]
    assert rows(made["work.cumulative"], "account_id", "running_interest") == [(21, 10.0), (22, 15.5), (27, 32.5)]
    assert rows(made["work.summary"], "region", "n_accounts", "total_balance", "total_interest") == [
        ("BR", 1, 310.0, 15.5), ("JP", 2, 130.0, 32.5),
    ]
    assert flow.external_inputs(PRICING) == ["raw.accounts", "raw.rates"]
    assert flow.final_outputs(PRICING) == ["work.cumulative", "work.summary"]


def test_flow_reports_what_is_absent(spark, sources):
    with pytest.raises(ValueError, match="raw.rates"):
        flow.run_flow(spark, {"raw.accounts": sources["raw.accounts"]}, PRICING)
    with pytest.raises(ValueError, match="work.rates"):
        flow.run_flow(spark, sources, [s for s in PRICING if "rates" not in s.label], required=["raw.accounts"])


def test_only_verified_steps_run():
    status = {s.label: "passed" for s in PRICING} | {"step003_data_cumulative": "needs_human"}
    assert len(flow.eligible(PRICING, status)) == 4
    assert len(flow.eligible(PRICING, status, include_unverified=True)) == 5


def test_every_output_of_a_step_is_wired(spark):
    two = flow.Step("s", ("a", "b"), ("x",), lambda spark, i: {"a": i["x"].filter("id < 2"), "b": i["x"].filter("id >= 2")})
    use = flow.Step("t", ("c",), ("b",), lambda spark, i: i["b"])
    made = flow.run_flow(spark, {"x": spark.range(5)}, [two, use])
    assert (made["a"].count(), made["c"].count()) == (2, 3)
    with pytest.raises(ValueError, match="declares"):
        flow.run_flow(spark, {"x": spark.range(5)}, [flow.Step("s", ("a",), ("x",), lambda spark, i: {"z": i["x"]})])


@pytest.fixture
def checks(spark):
    results = {
        "good": [R.Check("schema", True), R.Check("property", True)],
        "bad": [R.Check("schema", True), R.Check("property", False, "sums differ", ["x"])],
        "idle": [R.Check("schema", True, skipped=True)],
        "judged": [R.Check("static", True), R.Check("llm_judge", True)],
    }
    return R.checks_frame(spark, results, run="r1", program="p")


def test_verdicts(checks):
    got = {r["step"]: r["step_passed"] for r in verdicts.step_verdicts(checks).collect()}
    assert got == {"good": True, "bad": False, "idle": False, "judged": True}
    total = verdicts.roll_up(verdicts.step_verdicts(checks)).first()
    assert (total["steps"], total["passed_steps"], total["review_steps"], total["all_passed"]) == (4, 2, 2, False)
    how = {r["step"]: (r["data_verified"], r["data_ran"], r["judged"]) for r in verdicts.strength(checks, ["step"]).collect()}
    assert how == {"good": (True, True, False), "bad": (True, True, False), "idle": (False, False, False), "judged": (False, False, True)}
    assert [(r["step"], r["phase"], r["diagnostics"]) for r in verdicts.review(checks).collect()] == [("bad", "property", ["x"])]
    assert verdicts.pass_rate(checks).first()["pass_rate"] == 0.5


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "k long, s string, v double")
    one = changes.dataset_fingerprint(df, "d").first()
    same = changes.dataset_fingerprint(df.orderBy(F.desc("k")).select("v", "S", "k"), "d").first()
    other = changes.dataset_fingerprint(df.withColumn("v", F.lit(1.0)), "d").first()
    assert one == same and one != other and one["row_count"] == 2
    pair = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert pair.select(changes.definition_fingerprint(F.col("x"), F.col("y")).alias("f")).distinct().count() == 2


def test_manifest_by_key_equals_one_by_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "d string, v int")
    got = {r["dataset"]: r["checksum"] for r in changes.manifest_by(df, "d").collect()}
    for key in "ab":
        assert got[key] == changes.dataset_fingerprint(df.filter(F.col("d") == key), key).first()["checksum"]


def test_stale_steps_and_their_downstream(spark):
    io = spark.createDataFrame(
        [("p", 0, "raw.a"), ("p", 0, "w.b"), ("p", 1, "raw.c"), ("p", 1, "w.d"), ("p", 2, "w.b"), ("p", 2, "w.e"), ("p", 3, "w.d")],
        "program string, idx long, dataset string",
    )
    pairs = spark.createDataFrame([("p", 0, 2), ("p", 1, 3)], "program string, src long, dst long")
    definitions = spark.createDataFrame([("p", i, f"f{i}") for i in range(4)], "program string, idx long, fingerprint string")
    base = {k: spark.range(3) for k in ("raw.a", "raw.c")}
    old = changes.manifest(base)
    stale = lambda d, m: {r["idx"] for r in changes.stale_steps(d, definitions, m, old, io, pairs).collect()}
    assert stale(definitions, changes.manifest(base)) == set()
    assert stale(definitions, changes.manifest({**base, "raw.a": spark.range(4)})) == {0, 2}
    edited = definitions.withColumn("fingerprint", F.when(F.col("idx") == 1, F.lit("z")).otherwise(F.col("fingerprint")))
    assert stale(edited, changes.manifest(base)) == {1, 3}


def test_changed_keys_read_changed_ranges_only(spark):
    rnd = random.Random(41)
    rows = [(k, f"v{k % 13}", k * 0.5) for k in rnd.sample(range(-40_000, 60_000), 9_000)] + [(None, "none", 1.0)] * 3
    gone, new = set(rnd.sample([r[0] for r in rows[:9000]], 3)), [(70_001, "n", 0.0), (70_002, "n", 0.0)]
    other = set(rnd.sample(sorted(r[0] for r in rows[:9000] if r[0] not in gone), 4))
    twice = next(r for r in rows if r[0] is not None and r[0] not in gone | other)
    kinds = "k long, s string, x double"
    before = ranges.write_by_key(spark.createDataFrame(rows, kinds).repartition(3), "k", 1)
    changed = [(k, s, -1.0 if k in other else x) for k, s, x in rows if k not in gone] + new + [twice]
    now = ranges.write_by_key(spark.createDataFrame(changed, kinds).repartition(5), "k", 1)
    trees = [ranges.tree(df, "k") for df in (now, before)]
    nodes = ranges.differing(*trees)
    found = ranges.changed_keys(now, before, "k", nodes)
    want = {(k, "removed") for k in gone} | {(k, "added") for k, *_ in new} | {(k, "changed") for k in other | {twice[0]}}
    assert {tuple(r) for r in found.collect()} == want
    leaves = {r["node"] for r in nodes.filter("level = 0").collect()}
    assert leaves == {k >> ranges.BITS for k, _ in want}
    # Both scans get the key ranges, and read only a part of the rows.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [Or(") + plan.count("PushedFilters: [And(") >= 2
    assert before.filter(ranges._intervals(nodes, "k", ranges.BITS, ranges.FAN)).count() < 600
    nulls = spark.createDataFrame([(None, "none", 1.0)] * 2, kinds)
    less = now.filter("k is not null").union(nulls)
    only = ranges.differing(ranges.tree(less, "k"), trees[0])
    assert [tuple(r) for r in ranges.changed_keys(less, now, "k", only).collect()] == [(None, "changed")]


def test_equal_and_empty_versions_have_no_differing_range(spark):
    df = spark.createDataFrame([(i, i) for i in range(500)], "k long, v int")
    assert ranges.differing(ranges.tree(df, "k"), ranges.tree(df.repartition(7), "k")).count() == 0
    none = df.limit(0)
    assert ranges.differing(ranges.tree(none, "k"), ranges.tree(none, "k")).count() == 0
    all_new = ranges.changed_keys(df, none, "k", ranges.differing(ranges.tree(df, "k"), ranges.tree(none, "k")))
    assert all_new.filter("change = 'added'").count() == 500


def test_many_differing_ranges_are_all_found(spark):
    """More ranges than a filter lists: wider ones are read, and no key is lost or made up."""
    df = spark.createDataFrame([(i * 200, 0) for i in range(3000)], "k long, v int")
    moved = df.withColumn("v", F.when(F.col("k") % 3 == 0, 1).otherwise(F.col("v")))
    nodes = ranges.differing(ranges.tree(moved, "k"), ranges.tree(df, "k"))
    assert nodes.filter("level = 0").count() > ranges.INTERVALS
    assert {r["key"] for r in ranges.changed_keys(moved, df, "k", nodes).collect()} == {i * 200 for i in range(3000) if i * 200 % 3 == 0}


def test_run_history(spark, tmp_path):
    history = RunHistory(spark, str(tmp_path))
    checks = lambda n, **more: spark.createDataFrame([(f"s{i}", i % 2 == 0) for i in range(n)], "step string, passed boolean").withColumns(more)
    assert history.runs().count() == 0
    with pytest.raises(ValueError):
        history.table("checks")
    settings = spark.createDataFrame([(4, None)], "threads int, note string")
    assert history.record("2024/01 a=b", {"checks": checks(3), "steps": checks(1)}, settings)
    assert not history.record("2024/01 a=b", {"checks": checks(9)})
    # A run that fails after staging, or while it writes its second table, is not seen.
    attempt = history.stage("half", {"checks": checks(5)})
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("step"))
    with pytest.raises(Exception, match="no"):
        history.record("broken", {"checks": checks(2), "steps": broken})
    seen = lambda name: sorted((r["run"], r["step"]) for r in history.table(name).collect())
    assert seen("checks") == [("2024/01 a=b", f"s{i}") for i in range(3)] and len(seen("steps")) == 1
    assert history.record("broken", {"checks": checks(2, extra=F.lit(1))})
    history.commit("half", attempt, ["checks"])
    assert [r for r, _ in seen("checks")] == ["2024/01 a=b"] * 3 + ["broken"] * 2 + ["half"] * 5
    assert {r["extra"] for r in history.table("checks").filter("run = 'broken'").collect()} == {1}
    manifests = {r["run"]: r["manifest"] for r in history.runs().collect()}
    assert manifests == {"2024/01 a=b": '{"threads":4,"note":null}', "broken": None, "half": None}
    # A second writer of the same run: one of the two counts, the same for all readers.
    history.commit("half", history.stage("half", {"checks": checks(1)}), ["checks"])
    assert history.table("checks").filter("run = 'half'").count() in (1, 5)
    for results in ({"../x": checks(1)}, {"ok": checks(1).withColumnRenamed("step", "Run")}):
        with pytest.raises(ValueError):
            history.stage("z", results)


def test_written_tables_go_with_their_block(spark):
    def there(df):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stepledger_path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    with tables(spark) as outer:
        first = store(spark.range(5))
        with tables(spark) as inner:
            second = store(spark.range(7))
            kept = inner.keep(second.filter("id > 2"))
        assert not there(second) and there(first) and there(kept) and kept.count() == 4
        result = outer.keep(kept.union(first.toDF("id")))
    assert not there(first) and not there(kept) and result.count() == 9
    made = []
    with pytest.raises(ValueError), tables(spark):
        made.append(store(spark.range(3)))
        raise ValueError
    assert not there(made[0])
    release(result)
    assert not there(result)


def test_a_comparison_leaves_no_table_behind(spark, monkeypatch):
    written = []
    plain_path = settings.scratch_path
    monkeypatch.setattr(settings, "scratch_path", lambda s, label: written.append(plain_path(s, label)) or written[-1])
    golden = spark.createDataFrame([(i % 7, float(i)) for i in range(60)], "k int, v double")
    actual = golden.withColumn("v", F.when(F.col("v") == 5.0, 2.0).when(F.col("v") == 2.0, 5.0).otherwise(F.col("v")))
    assert [c.phase for c in R.reconcile(actual, golden)] == ["schema", "property", "data_equivalence"]
    assert len(written) > 2 and not any(os.path.exists(p.removeprefix("file:")) for p in written)


def test_eligibility_reaches_all_steps_below(spark):
    status = spark.createDataFrame(
        [("p", 0, "passed"), ("p", 1, "translated"), ("p", 2, "passed"), ("p", 3, "passed"), ("p", 4, None), ("q", 2, "passed")],
        "program string, idx long, status string",
    )
    pairs = spark.createDataFrame([("p", 0, 2), ("p", 1, 2), ("p", 2, 3)], "program string, src long, dst long")
    strict = {(r["program"], r["idx"]): r["verdict"] for r in verdicts.eligibility(status, pairs).collect()}
    assert strict == {
        ("p", 0): "runs", ("p", 1): "left out", ("p", 2): "lacks inputs", ("p", 3): "lacks inputs", ("p", 4): "left out", ("q", 2): "runs",
    }
    loose = {r["idx"]: r["verdict"] for r in verdicts.eligibility(status, pairs, include_unverified=True).filter("program = 'p'").collect()}
    assert loose == {0: "runs", 1: "runs", 2: "runs", 3: "runs", 4: "left out"}


def test_definitions_are_never_gathered_for_a_broadcast(spark):
    old = [("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c"), (None, 0, "d")]
    now = [("p", 0, "a"), ("p", 1, "B"), ("p", 1, "B"), ("q", 0, "c"), ("q", 1, "c"), (None, 0, "d")]
    kind = "program string, idx long, fingerprint string"
    own = changes.changed_definitions(spark.createDataFrame(now, kind), spark.createDataFrame(old, kind))
    assert "Broadcast" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["program"] or "", r["idx"]) for r in own.collect()) == [("", 0), ("p", 1), ("p", 1), ("q", 1)]


def test_corpus_is_dealt_before_its_texts_are_made(spark, sf_dir):
    made = corpus(spark, sf_dir)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "options nocenter" in plan.split("Repartition")[0]
    assert "options nocenter" not in plan.split("Repartition", 1)[1]
