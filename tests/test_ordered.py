"""Ordered BY-group operators against brute force, with one group holding half the rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from stepledger.operators import heavy as heavy_rows
from stepledger.operators import ordered as O


def data(seed=1, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((g, rnd.choice(["x", "y", None]), i, rnd.choice([None, 1.0, 2.0, 3.5])))
    return rows


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(data(), "g string, h string, t long, v double").repartition(5)


def by_group(rows, key):
    ordered = sorted(rows, key=lambda r: (repr(key(r)), r[2]))
    return [list(part) for _, part in groupby(ordered, key=lambda r: repr(key(r)))]


def test_running_total(frame, heavy):
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        total = 0.0
        for r in part:
            total += r[3] or 0.0
            want[r[2]] = total
    got = O.running_total(frame, ["g"], ["t"], "v", "out")
    assert got.columns == ["g", "h", "t", "v", "out"]
    assert {r["t"]: r["out"] for r in got.collect()} == want


def test_running_total_downwards(frame, heavy):
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        total = 0.0
        for r in reversed(part):
            total += r[3] or 0.0
            want[r[2]] = total
    got = O.running_total(frame, ["g"], ["-t"], "v", "out")
    assert {r["t"]: r["out"] for r in got.collect()} == want


def test_number_rows(frame, heavy):
    want = {r[2]: i for part in by_group(data(), lambda r: r[0]) for i, r in enumerate(part, 1)}
    assert {r["t"]: r["row_no"] for r in O.number_rows(frame, ["g"], ["t"]).collect()} == want


def test_row_index(frame, heavy):
    got = O.with_row_index(frame, ["t"]).collect()
    assert all(r["t"] == r["row_index"] for r in got) and len(got) == 120


def test_retain_holds_an_assigned_missing(frame, heavy):
    """h = 'x' assigns v, even when v is missing."""
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        held = -1.0
        for r in part:
            if r[1] == "x":
                held = r[3]
            want[r[2]] = held
    got = O.retain(frame, ["g"], ["t"], F.col("h") == "x", F.col("v"), "out", initial=-1.0)
    assert {r["t"]: r["out"] for r in got.collect()} == want


def test_carry_forward_before_current(frame, heavy):
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        held = None
        for r in part:
            want[r[2]] = held
            if r[1] == "x":
                held = r[2]
    got = O.carry_forward(frame, ["g"], ["t"], {"out": (F.col("h") == "x", F.col("t"))}, False)
    assert {r["t"]: r["out"] for r in got.collect()} == want


def test_by_flags(frame, heavy):
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        subs = by_group(part, lambda r: r[1])
        subs.sort(key=lambda s: (s[0][1] is not None, s[0][1] or ""))
        flat = [r for s in subs for r in s]
        for s in subs:
            for r in s:
                want[r[2]] = (r is flat[0], r is flat[-1], r is s[0], r is s[-1])
    got = O.by_flags(frame, ["g", "h"], ["t"])
    assert {r["t"]: (r["first_g"], r["last_g"], r["first_h"], r["last_h"]) for r in got.collect()} == want


@pytest.mark.parametrize("k", [1, -1, 3])
def test_shift(frame, heavy, k):
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        for i, r in enumerate(part):
            j = i - k
            want[r[2]] = part[j][3] if 0 <= j < len(part) else None
    got = O.shift(frame, ["g"], ["t"], "v", "out", k)
    assert {r["t"]: r["out"] for r in got.collect()} == want


def test_sort_missing_first(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (-5.0,)], "v double")
    got = [r["v"] for r in O.sort_by(df, ["v"]).collect()]
    assert got[2:] == [-5.0, 1.0]


def test_decimal_running_total_keeps_its_type(spark, heavy):
    df = spark.createDataFrame([("a", i) for i in range(30)], "g string, t int").withColumn(
        "v", F.col("t").cast("decimal(18,2)")
    )
    got = O.running_total(df, ["g"], ["t"], "v", "out")
    assert dict(got.dtypes)["out"] == "decimal(28,2)"
    assert {r["t"]: int(r["out"]) for r in got.collect()} == {i: i * (i + 1) // 2 for i in range(30)}


def test_running_extremes(frame, heavy):
    want = {}
    for part in by_group(data(), lambda r: r[0]):
        seen = []
        for r in part:
            seen += [] if r[3] is None else [r[3]]
            want[r[2]] = (min(seen, default=None), max(seen, default=None))
    got = O.running(frame, ["g"], ["t"], {"low": ("min", F.col("v")), "high": ("max", F.col("v"))})
    assert {r["t"]: (r["low"], r["high"]) for r in got.collect()} == want


def test_running_passes_over_missing_terms(spark, heavy):
    values = [0, 1, 2, None, None, None, None, None, 4, None]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v int")
    got = [r["t"] for r in O.running(df, ["g"], ["i"], {"t": ("sum", F.col("v"))}).orderBy("i").collect()]
    assert got == [0, 1, 3, 3, 3, 3, 3, 3, 7, 7]


def test_nan_is_missing_in_groups_and_order(spark, heavy):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 1), (1.0, nan, 2), (nan, 1.0, 3), (None, 2.0, 4)], "g double, x double, i int")
    got = {r["i"]: r["n"] for r in O.number_rows(df, ["g"], ["x"], "n").collect()}
    assert got == {2: 1, 1: 2, 3: 1, 4: 2}


def test_one_pass_for_several_operators(spark, heavy):
    df = spark.createDataFrame([(i % 3, i, i * i % 17) for i in range(60)], "g int, i int, v int")
    v = F.col("v")
    got = O.Pass(df, ["g"], ["i"]).shift("back", v, 3).shift("ahead", v, -2).number("no").running("high", "max", v).flags().result()
    rows = sorted((tuple(r) for r in df.collect()))
    for r in got.collect():
        line = [x for x in rows if x[0] == r["g"]]
        at = [x[1] for x in line].index(r["i"])
        assert r["no"] == at + 1 and r["high"] == max(x[2] for x in line[: at + 1])
        assert r["back"] == (line[at - 3][2] if at >= 3 else None) and r["ahead"] == (line[at + 2][2] if at + 2 < len(line) else None)
        assert r["first_g"] == (at == 0) and r["last_g"] == (at == len(line) - 1)


def test_lag_calls_equal_a_row_loop(spark, heavy):
    """A queue of past calls: rows without a call neither ask it nor fill it."""
    rnd = random.Random(21)
    rows = [(rnd.choice("ab"), i, rnd.random() < 0.4, rnd.choice([None, 1.5 * i])) for i in range(160)]
    df = spark.createDataFrame(rows, "g string, i int, c boolean, v double").repartition(4)
    for by in (["g"], []):
        got = {r["i"]: (r["one"], r["three"]) for r in O.lag_calls(df, by, ["i"], F.col("c"), F.col("v"), {"one": 1, "three": 3}).collect()}
        queues, want = {}, {}
        for g, i, c, v in rows:
            queue = queues.setdefault(g if by else "", [None] * 3)
            want[i] = (queue[-1], queue[-3]) if c else (None, None)
            if c:
                queue.append(v)
        assert got == want
    with pytest.raises(ValueError):
        O.lag_calls(df, [], ["i"], F.col("c"), F.col("v"), {"none": 0})


def test_only_groups_at_borders_of_pieces_are_carried(spark):
    rows = [(0, None, 1), (0, None, 2), (0, "a", 1), (0, "b", 1), (1, "b", 2), (2, "b", 3), (2, "c", 1), (2, "d", 1), (2, "e", 1)]
    parts = spark.createDataFrame(rows, f"{heavy_rows.PIECE} int, k string, i int")
    got = sorted((r[0], r[1] or "", r[2]) for r in heavy_rows.at_borders(parts, ["k"]).collect())
    assert got == [(0, "", 1), (0, "", 2), (0, "b", 1), (1, "b", 2), (2, "b", 3), (2, "e", 1)]
    assert heavy_rows.at_borders(parts, []).count() == len(rows)


def test_values_are_held_and_shifted_across_pieces_with_missing_keys(spark, heavy):
    keys = [None] * 30 + ["a"] * 2 + ["b"] * 60 + ["c", "d", "e"] + ["f"] * 20
    rows = [(k, float(i % 7) if i % 5 == 0 else None, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    work = O.Pass(df, ["k"], ["i"]).hold("held", F.col("v").isNotNull(), F.col("v"), False).shift("prior", F.col("i"), 2).shift("next", F.col("i"), -1)
    want, seen = {}, {}
    for k, v, i in rows:
        before = seen.setdefault(k, [])
        near = [x for x, _ in before]
        later = rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][0] == k else None
        want[i] = (next((x for _, x in reversed(before) if x is not None), None), near[-2] if len(near) > 1 else None, later)
        before.append((i, v))
    assert {r.i: (r.held, r.prior, r.next) for r in work.result().collect()} == want


def test_carried_values_sort_only_groups_at_borders(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(60)], "k int, i int").withColumn("v", F.col("i"))
    plan = O.carry_forward(df, ["k"], ["i"], {"held": (F.col("v") > 1, F.col("v"))})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1
