"""Reconciliation: what passes, what fails, and that exactly the changed cells are reported."""

import random

import pytest
from pyspark.sql import functions as F

from stepledger import reconcile as R
from stepledger.reconcile.families import families

COLS = "sample long, plant string, height double, growth double, yield double"
GOLD = [(11, "oat", 80.0, 0.25, 20.0), (12, "rye", 120.0, 0.5, 60.0), (15, "rye", 98.0, 0.5, 49.0), (19, "flax", 60.0, 0.75, 45.0)]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLD, COLS)


def verdicts(checks):
    return [(c.phase, c.passed) for c in checks]


ALL = [("schema", True), ("property", True), ("data_equivalence", True)]


def test_reordered_and_renamed_passes(spark, golden):
    actual = spark.createDataFrame(list(reversed(GOLD)), COLS).select(
        F.col("yield").alias("YIELD"), F.col("plant").alias("Plant"), "sample", "growth", "height"
    )
    assert verdicts(R.reconcile(actual, golden)) == ALL


def test_jitter_passes(spark, golden):
    actual = golden.withColumn("yield", F.col("yield") + 1e-12)
    assert verdicts(R.reconcile(actual, golden)) == ALL


def test_wrong_value_fails_property_and_names_the_side(spark, golden):
    actual = golden.withColumn("yield", F.when(F.col("sample") == 12, 999.0).otherwise(F.col("yield")))
    checks = R.reconcile(actual, golden)
    assert verdicts(checks) == [("schema", True), ("property", False)]
    diff = R.value_diff(actual, golden)
    assert [tuple(r) for r in diff.cells.select("sample", "column_name", "actual", "golden", "copies").collect()] == [
        (12, "yield", "999.0", "60.0", 1)
    ]


def test_missing_column_and_row_count_fail_schema(spark, golden):
    (check,) = R.reconcile(golden.drop("growth"), golden)
    assert not check.passed and "growth" in check.diagnostics[0]
    (check,) = R.reconcile(golden.limit(2), golden)
    assert check.phase == "schema" and "row count 2" in check.diagnostics[0]
    rows = R.schema_differences(golden.drop("growth").limit(2), golden).collect()
    assert [(r["column_name"], r["issue"], r["actual"], r["golden"]) for r in rows] == [
        ("growth", "missing", None, "numeric"),
        ("*", "row count", "2", "4"),
    ]


def test_null_count_fails_property(spark, golden):
    actual = golden.withColumn("growth", F.when(F.col("sample") != 11, F.col("growth")))
    assert verdicts(R.reconcile(actual, golden)) == [("schema", True), ("property", False)]


def test_duplicate_for_dropped_row_fails_values(spark, golden):
    actual = spark.createDataFrame([GOLD[0], GOLD[0], GOLD[1], GOLD[3]], COLS)
    rows = R.value_diff(actual, golden).rows.collect()
    assert sorted((r["sample"], r["issue"], r["copies"]) for r in rows) == [
        (11, "only in actual", 1),
        (15, "only in golden", 1),
    ]


def test_floats_a_little_off_still_meet_their_own_row(spark, heavy):
    """Three floating columns, each pushed another way in every copy of a row, and sorted otherwise by the push."""
    rnd = random.Random(17)
    rows = [(rnd.choice(["fir", "yew", None]), 0.5 * rnd.randint(1, 3), 7.0 * rnd.randint(0, 2), float(rnd.randint(0, 1))) for _ in range(90)]
    push = lambda v: v + rnd.choice([-3e-10, 0.0, 3e-10])
    moved = [(t, push(x), push(y), push(z)) for t, x, y, z in reversed(rows)]
    kinds = "tree string, girth double, age double, felled double"
    golden, actual = spark.createDataFrame(rows, kinds), spark.createDataFrame(moved, kinds).repartition(3)
    assert R.value_diff(actual, golden).rows.count() == 0
    assert R.value_diff(actual, golden.withColumn("age", F.col("age") + 1), atol=1e-9).rows.count() > 0


def test_the_sample_is_the_same_for_any_partitioning(spark):
    """Every kind of difference is in it, and reruns show the same rows."""
    rows = [(i, i % 5, float(i), "abc"[i % 3]) for i in range(400)]
    golden = spark.createDataFrame(rows, "k long, m long, x double, s string")
    off = F.when(F.col("k") % 7 == 0, 1.0).otherwise(0.0)
    actual = golden.filter("k % 31 <> 5").withColumn("x", F.col("x") + off).withColumn("s", F.when(F.col("k") % 11 == 0, F.lit("z")).otherwise(F.col("s")))
    actual = actual.union(spark.createDataFrame([(1000 + i, 0, 0.0, "n") for i in range(9)], golden.schema))
    samples = []
    for n in (1, 3, 8):
        diff = R.value_diff(actual.repartition(n), golden.repartition(2 * n), ["k"])
        samples.append(sorted(diff.sample(3).select("issue", F.array_join("differs", ","), "k", "place").collect(), key=repr))
    assert samples[0] == samples[1] == samples[2]
    kinds = {}
    for issue, differs, _, place in samples[0]:
        kinds.setdefault((issue, differs), []).append(place)
        kinds[issue, differs].sort()
    assert kinds == {
        (issue, differs): [1, 2, 3, 4]
        for issue, differs in [("changed", "s"), ("changed", "x"), ("changed", "s,x"), ("only in actual", ""), ("only in golden", "")]
    }
    text = R.reconcile(actual.withColumn("k", F.col("k") + 0), golden)[0].diagnostics[0]
    assert "row count" in text


def test_values_that_round_apart_are_close(spark):
    golden = spark.createDataFrame([(1.5e-9,)], "v double")
    actual = spark.createDataFrame([(1.49e-9,)], "v double")
    assert R.value_diff(actual, golden).rows.count() == 0


def test_large_integers_stay_exact(spark):
    golden = spark.createDataFrame([(2**53,)], "v long")
    actual = spark.createDataFrame([(2**53 + 1,)], "v long")
    assert R.value_diff(actual, golden).rows.count() == 2


def test_relative_tolerance_counts(spark):
    golden = spark.createDataFrame([(1, 1e9)], "k int, v double")
    actual = spark.createDataFrame([(1, 1e9 + 10)], "k int, v double")
    assert R.value_diff(actual, golden).rows.count() == 0
    assert R.value_diff(actual, golden, rtol=0.0).rows.count() == 1


def test_nan_is_missing_and_zero_has_no_sign(spark):
    golden = spark.createDataFrame([(1, None), (2, 0.0)], "k int, v double")
    actual = spark.createDataFrame([(1, float("nan")), (2, -0.0)], "k int, v double")
    assert R.value_diff(actual, golden).rows.count() == 0


def test_maps_dots_and_families(spark):
    sql = "select map('a', 1, 'b', 2) as `m.x`, array(1) as arr, date'2020-01-01' as d, cast(1 as decimal(9,2)) as n"
    golden = spark.sql(sql)
    actual = spark.sql(sql.replace("'a', 1, 'b', 2", "'b', 2, 'a', 1"))
    assert verdicts(R.reconcile(actual, golden)) == ALL
    assert families(golden) == {"m.x": "string", "arr": "string", "d": "datetime", "n": "numeric"}


def test_no_common_columns_is_an_error(spark):
    with pytest.raises(ValueError):
        R.value_diff(spark.range(1), spark.range(1).toDF("k"))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_every_planted_change_is_found(spark, heavy, seed):
    """Cells perturbed, rows dropped and copied; jitter everywhere."""
    rnd = random.Random(seed)
    base = [(i, rnd.choice("ab"), rnd.random() * 100, float(rnd.randint(1, 9))) for i in range(60)]
    changed = set(rnd.sample(range(60), 9))
    gone = set(rnd.sample(sorted(set(range(60)) - changed), 3))
    twice = set(rnd.sample(sorted(set(range(60)) - changed - gone), 3))
    rows = []
    for r in base:
        if r[0] in gone:
            continue
        x = r[2] + rnd.choice([-1, 0, 1]) * 4e-10
        rows.append((r[0], r[1], x + (1.0 if r[0] in changed else 0), r[3]))
        if r[0] in twice:
            rows.append(rows[-1])
    kinds = "k int, s string, x double, y double"
    golden, actual = spark.createDataFrame(base, kinds), spark.createDataFrame(rows, kinds).repartition(3)
    for keys in (None, ["k"]):
        diff = R.value_diff(actual, golden, keys)
        found = diff.rows.collect()
        assert {r["k"] for r in found if r["issue"] == "changed"} == changed
        assert {r["k"] for r in found if r["issue"] == "only in golden"} == gone
        assert {r["k"] for r in found if r["issue"] == "only in actual"} == twice
        assert {(r["k"], r["column_name"]) for r in diff.cells.collect()} == {(k, "x") for k in changed}


def test_many_copies_pair_as_counts(spark, heavy):
    """One group, many copies of few rows: pairing counts copies and lists none of them."""
    golden = spark.createDataFrame([("g", 1.0)] * 40 + [("g", 5.0)] * 20, "s string, v double")
    actual = spark.createDataFrame([("g", 1.0 + 1e-12)] * 40 + [("g", 6.0)] * 20, "s string, v double")
    rows = R.value_diff(actual, golden).rows.collect()
    assert [(r["issue"], r["copies"], r["actual"]["v"], r["golden"]["v"]) for r in rows] == [("changed", 20, 6.0, 5.0)]


def test_sample_is_bounded(spark):
    golden = spark.range(0, 100)
    actual = spark.range(1000, 1100)
    assert R.value_diff(actual, golden).sample(5).count() == 12
    checks = R.reconcile(actual.toDF("id"), golden, max_report=5)
    assert not checks[-1].passed


def test_profile_values(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, None, "x"), (3, 3.0, None)], "k int, v double, s string")
    got = {r["column_name"]: r for r in R.profile(df).collect()}
    assert (got["v"]["null_count"], got["v"]["distinct_count"], got["v"]["sum_value"], got["v"]["mean_value"]) == (1, 2, 4.0, 2.0)
    assert (got["s"]["distinct_count"], got["s"]["sum_value"], got["s"]["min_value"]) == (1, None, "x")
    assert {r["distinct_count"] for r in R.profile(df, approx=True).collect()} == {3, 2, 1}


def test_step_and_final_output_checks(spark, golden):
    data = {"raw.a": golden.drop("yield"), "work.b": golden}
    good = lambda spark, i: i["raw.a"].withColumn("yield", F.col("height") * F.col("growth"))
    bad = lambda spark, i: i["raw.a"].withColumn("yield", F.col("height") + F.col("growth"))
    broken = lambda spark, i: i["nope"]
    assert verdicts(R.check_step(spark, data, good, ["raw.a"], "work.b")) == ALL
    assert not R.check_step(spark, data, bad, ["raw.a"], "work.b")[-1].passed
    untyped = lambda spark, i: i["raw.a"].withColumn("yield", F.lit(None))
    (failed,) = R.check_step(spark, data, untyped, ["raw.a"], "work.b")
    assert failed.diagnostics == ["yield: family (actual string, golden numeric)"]
    (failed,) = R.check_step(spark, data, broken, ["raw.a"], "work.b")
    assert not failed.passed and "KeyError" in failed.diagnostics[0]
    (skip,) = R.check_step(spark, data, good, ["raw.zzz"], "work.b")
    assert skip.skipped
    ends = R.check_final_outputs({"work.b": golden}, data, ["work.b", "work.c"])
    assert [c.passed for c in ends["work.b"]] == [True] * 4 and not ends["work.c"][0].passed
    table = R.checks_frame(spark, ends, run="r1", program="p")
    assert table.count() == 5


def test_a_value_at_the_edge_of_a_rounding_step_is_close(spark, heavy):
    golden = spark.createDataFrame([(0.5e-9, i) for i in range(50)], "v double, i int")
    actual = spark.createDataFrame([(0.5e-9 + (-1) ** i * 2e-10, i) for i in range(50)], "v double, i int")
    assert R.value_diff(actual, golden).rows.count() == 0


def test_one_replaced_row_is_one_difference(spark, heavy):
    golden = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    actual = spark.createDataFrame([(500.5 if i == 3 else i + 1e-10,) for i in range(100)], "v double")
    rows = R.value_diff(actual, golden).rows.collect()
    assert [(r["issue"], r["copies"], r["actual"]["v"], r["golden"]["v"]) for r in rows] == [("changed", 1, 500.5, 3.0)]


def test_sums_do_not_depend_on_row_order(spark):
    rnd = random.Random(8)
    values = [(rnd.uniform(-1e9, 1e9),) for _ in range(2000)]
    values += [(-v,) for (v,) in values]
    golden = spark.createDataFrame(values, "v double")
    rnd.shuffle(values)
    assert verdicts(R.reconcile(spark.createDataFrame(values, "v double").repartition(7), golden)) == ALL


def test_decimals_that_no_type_holds_are_compared(spark):
    wide = spark.sql("select cast('12345678901234567890123456789012345678' as decimal(38,0)) as v")
    fine = spark.sql("select cast('5.25' as decimal(38,8)) as v")
    five = spark.sql("select cast('5' as decimal(38,0)) as v")
    assert R.value_diff(wide, fine).rows.count() == 2
    assert R.value_diff(five, spark.sql("select cast('5' as decimal(38,8)) as v")).rows.count() == 0


def test_rows_without_a_key_meet_the_row_they_differ_least_from(spark, heavy):
    """Cells of any type changed, one or two a row; copies; rows that have no partner."""
    rnd = random.Random(29)
    rows = [(rnd.choice("pqrs"), rnd.randint(0, 400), rnd.choice(["north", None]), float(rnd.randint(0, 900)), rnd.randint(0, 50)) for _ in range(70)]
    kinds = "a string, b int, c string, d double, e int"
    names = "abcde"
    changed, want = [], []
    for i, r in enumerate(rows):
        r = list(r)
        for at in rnd.sample(range(5), (0, 0, 1, 2)[i % 4]):
            new = {"a": "z", "b": 1000 + i, "c": "south", "d": 5000.5 + i, "e": 100 + i}[names[at]]
            want.append((names[at], str(new), None if r[at] is None else str(r[at])))
            r[at] = new
        changed.append(tuple(r))
    extra = [("w", 7777, "x", -1.0, -5)] * 3
    golden, actual = spark.createDataFrame(rows, kinds), spark.createDataFrame(changed + extra, kinds).repartition(3)
    diff = R.aligned_diff(actual, golden)
    found = [(r["column_name"], r["actual"], r["golden"]) for r in diff.cells.collect() for _ in range(r["copies"])]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    alone = [(r["issue"], r["actual"]["b"], r["copies"]) for r in diff.rows.filter("issue <> 'changed'").collect()]
    assert alone == [("only in actual", 7777, 3)]


def test_alignment_of_copies_and_of_rows_too_far_apart(spark):
    golden = spark.createDataFrame([("a", 1, 1)] * 5 + [("b", 2, 2)], "s string, x int, y int")
    actual = spark.createDataFrame([("a", 1, 9)] * 3 + [("c", 3, 3)], "s string, x int, y int")
    rows = sorted((r["issue"], r["copies"], r["differs"]) for r in R.aligned_diff(actual, golden).rows.collect())
    assert rows == [("changed", 3, ["y"]), ("only in actual", 1, []), ("only in golden", 1, []), ("only in golden", 2, [])]
    same = R.aligned_diff(golden, golden)
    assert same.rows.count() == 0 and same.cells.count() == 0


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    """Within the stated errors of the exact figures, for any split; nulls, texts, columns without a value."""
    rnd = random.Random(51)
    rows = [(rnd.randint(0, 5000), rnd.gauss(0, 9) if rnd.random() < 0.9 else None, f"t{rnd.randint(0, 900)}", None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "k int, v double, s string, none double").repartition(6)
    exact = {r["column_name"]: r for r in R.profile(df).collect()}
    for parts in (1, 7):
        pieces = [R.column_sketches(df.filter(F.abs(F.hash("k")) % parts == i)) for i in range(parts)]
        both = pieces[0]
        for p in pieces[1:]:
            both = both.unionByName(p)
        got = {r["column_name"]: r for r in R.estimates(R.merged(both), (0.1, 0.5, 0.99)).collect()}
        for c in ("k", "v", "s"):
            assert (got[c]["row_count"], got[c]["null_count"]) == (20_000, exact[c]["null_count"])
            assert abs(got[c]["distinct_count"] / exact[c]["distinct_count"] - 1) < 4 * R.DISTINCT_ERROR
        for at, c in ((0, "k"), (1, "v")):
            values = sorted(r[at] for r in rows if r[at] is not None)
            for rank, q in zip((0.1, 0.5, 0.99), got[c]["quantiles"]):
                share = sum(v <= q for v in values) / len(values)
                assert abs(share - rank) < 4 * R.RANK_ERROR
        assert got["s"]["quantiles"] is None and got["none"]["quantiles"] is None and got["none"]["distinct_count"] == 0
