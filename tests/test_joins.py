"""Match-merge, update, modify and lookup against row-loop models."""

import random

import pytest
from pyspark.sql import functions as F

from stepledger.operators import joins as J


def loop_merge(frames, by):
    """Row loop of a BY merge: a value vector kept across the rows of a group."""
    groups = sorted({r[by] for rows in frames.values() for r in rows}, key=lambda k: (k is not None, k))
    out = []
    for g in groups:
        parts = {d: [r for r in rows if r[by] == g] for d, rows in frames.items()}
        vector = {c: None for rows in frames.values() for r in rows for c in r}
        for i in range(max(len(p) for p in parts.values())):
            for d, part in parts.items():
                if i < len(part):
                    vector.update(part[i])
            row = dict(vector, **{f"in_{d}": bool(p) for d, p in parts.items()})
            row[by] = g
            out.append(row)
    return out


def as_set(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_merge_equals_the_row_loop(spark, heavy, seed):
    rnd = random.Random(seed)
    frames, order = {}, {}
    for d, cols in (("a", ["x", "s"]), ("b", ["y", "s"]), ("c", ["z", "s"])):
        rows = []
        for k in [1, 2, 3, 4, None]:
            for i in range(rnd.choice([0, 1, 1, 2, 9 if k == 1 else 3])):
                rows.append({"id": k, "o" + d: i, cols[0]: rnd.choice([None, 10 * i]), cols[1]: rnd.choice([None, f"{d}{i}"])})
        frames[d], order[d] = rows, ["o" + d]
    schemas = {
        "a": "id int, oa int, x int, s string",
        "b": "id int, ob int, y int, s string",
        "c": "id int, oc int, z int, s string",
    }
    dfs = {
        d: spark.createDataFrame([tuple(r[f.split()[0]] for f in schemas[d].split(", ")) for r in rows], schemas[d])
        for d, rows in frames.items()
    }
    got = J.match_merge(dfs, ["id"], order, {d: f"in_{d}" for d in dfs})
    assert as_set(r.asDict() for r in got.collect()) == as_set(loop_merge(frames, "id"))


def test_many_to_many_carries_the_short_side(spark):
    a = spark.createDataFrame([(1, 1, "a1"), (1, 2, "a2"), (1, 3, "a3")], "id int, o int, v string")
    b = spark.createDataFrame([(1, 1, "b1"), (1, 2, "b2")], "id int, p int, v string")
    got = J.match_merge({"a": a, "b": b}, ["id"], {"a": ["o"], "b": ["p"]}, row_no="i").orderBy("i")
    assert [r["v"] for r in got.collect()] == ["b1", "b2", "a3"]


def test_merge_flags_give_join_kinds(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    m = J.match_merge({"a": a, "b": b}, ["id"], {}, {"a": "x", "b": "y"})
    assert [r["id"] for r in m.filter(J.contributed(["x", "y"])).collect()] == [2]
    assert [r["id"] for r in m.filter("x and not y").collect()] == [1]
    assert m.filter(J.contributed(["x", "y"], every=False)).count() == 3


def test_update_and_modify(spark):
    master = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "id int, s string, v double")
    tx = spark.createDataFrame(
        [(1, 1, None, 5.0), (1, 2, "z", None), (3, 1, "new", None), (None, 1, None, 9.0)],
        "id int, o int, s string, v double",
    )
    up = {r["id"]: (r["s"], r["v"]) for r in J.update_table(master, tx, ["id"], ["o"]).collect()}
    assert up == {1: ("z", 5.0), 2: ("b", 2.0), 3: ("new", None), None: ("n", 9.0)}
    mod = J.modify_table(master, tx, ["id"], ["o"])
    assert mod.columns == ["id", "s", "v"]
    assert {r["id"]: (r["s"], r["v"]) for r in mod.collect()} == {1: ("z", 5.0), 2: ("b", 2.0), None: ("n", 9.0)}


def test_keyed_lookup_takes_the_first_match(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    lk = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 1, "two")], "k int, o int, v string")
    got = {r["k"]: (r["v"], r["hit"]) for r in J.keyed_lookup(df, lk, ["k"], ["o"], "hit").collect()}
    assert got == {1: ("early", True), 2: ("two", True), 9: (None, False)}


def test_sql_join_and_absent_keys(spark):
    a = spark.createDataFrame([(1, "US"), (2, "EU"), (3, None)], "id int, region string")
    r = spark.createDataFrame([("US", 0.1)], "region string, rate double")
    got = J.sql_join(
        a, r, F.col("a.region") == F.col("b.region"), "left", {"id": F.col("a.id"), "rate": F.col("b.rate")}
    )
    assert {x["id"]: x["rate"] for x in got.collect()} == {1: 0.1, 2: None, 3: None}
    need = spark.createDataFrame([("w.a",), ("w.b",)], "key string")
    have = spark.createDataFrame([("w.a",)], "key string")
    assert [x["key"] for x in J.absent_keys(need, have, "key").collect()] == ["w.b"]


def test_update_with_missing_tied_and_downward_order(spark, heavy):
    master = spark.createDataFrame([(1, 10), (3, 30)], "k int, v int")
    tx = spark.createDataFrame([(1, None, 99), (2, None, 5), (3, 4, 31), (3, 9, 32), (3, 9, None)], "k int, at int, v int")
    done = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert done(J.update_table(master, tx, ["k"], ["at"])) == [(1, 99), (2, 5), (3, 32)]
    assert done(J.update_table(master, tx, ["k"], ["-at"])) == [(1, 99), (2, 5), (3, 31)]
    assert done(J.modify_table(master, tx, ["k"], ["at"])) == [(1, 99), (3, 32)]
