import math

import pytest
from pyspark.sql import functions as F

from stepledger.columns import common_columns, lower_names
from stepledger.functions import dates, missing, numbers, text
from stepledger.operators import aggregate as A
from stepledger.operators import rows as R
from stepledger.operators import stack as S


def one(df, c):
    return df.select(c.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def dot(spark):
    return spark.range(1)


def test_missing_sorts_below_numbers(spark):
    df = spark.createDataFrame([(None, 1.0), (-1.0, 0.0), (2.0, None), (None, None)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(missing.lt(a, 0), missing.gt(a, 0), missing.lt(a, b), missing.gt(a, b), missing.le(a, b), missing.ge(a, b), missing.eq(a, b))
    assert [tuple(r) for r in got.collect()] == [
        (True, None, True, False, True, False, False),
        (True, False, True, False, True, False, False),
        (False, True, False, True, False, True, False),
        (True, None, False, False, True, True, True),
    ]


def test_special_missing(spark):
    df = spark.createDataFrame([(".",), (".A",), ("._",), ("1.5",), (".5",), ("",)], "t string")
    got = [tuple(r) for r in df.select(missing.clear_missing(F.col("t")), missing.missing_letter(F.col("t"))).collect()]
    assert got == [(None, None), (None, "A"), (None, "_"), ("1.5", None), (".5", None), ("", None)]


def test_dates(dot):
    assert str(one(dot, dates.day_number_to_date(F.lit(22280)))) == "2020-12-31"
    assert one(dot, dates.date_to_day_number(F.lit("1960-01-02").cast("date"))) == 1
    assert str(one(dot, dates.second_number_to_timestamp(F.lit(86400)))) == "1960-01-02 00:00:00"
    assert one(dot, dates.timestamp_to_second_number(F.lit("1960-01-01 00:01:00").cast("timestamp"))) == 60


@pytest.mark.parametrize(
    "value, want", [(-2.5, "-2.5"), (0.0123, "0.0123"), (0.00004, "0.00004"), (0.18, "0.18"), (100.0, "100"), (0.0, "0")]
)
def test_best_format(dot, value, want):
    assert one(dot, text.put(F.lit(value), "best16.")) == want


def test_formats_and_informats(dot):
    assert one(dot, text.put(F.lit(None).cast("double"), "best16.")) == "."
    assert one(dot, text.put(F.lit(3.14159), "8.2")) == "    3.14"
    assert one(dot, text.put(F.lit(7), "z4.")) == "0007"
    assert one(dot, text.put(F.lit("2020-01-05").cast("date"), "date9.")) == "05JAN2020"
    assert one(dot, text.put(F.lit("abcdef"), "$3.")) == "abc"
    assert one(dot, text.read(F.lit("12.5"), "8.")) == 12.5
    assert one(dot, text.read(F.lit("$1,200"), "comma8.")) == 1200.0
    assert one(dot, text.read(F.lit("."), "8.")) is None
    assert one(dot, text.read(F.lit("abc"), "8.")) is None
    assert str(one(dot, text.read(F.lit("05JAN2020"), "date9."))) == "2020-01-05"
    assert one(dot, text.read(F.lit("nonsense"), "date9.")) is None
    assert str(one(dot, text.read(F.lit("2020-01-05"), "yymmdd10."))) == "2020-01-05"


def test_words(dot):
    assert one(dot, text.countw(F.lit("US EU  JP"))) == 3
    assert one(dot, text.scan(F.lit("US EU JP"), 2)) == "EU"
    assert one(dot, text.scan(F.lit("US EU JP"), -1)) == "JP"
    assert one(dot, text.scan(F.lit("US EU JP"), 9)) == ""
    assert one(dot, text.squeeze(F.lit("  a \n\t b c "))) == "a b c"
    assert one(dot, text.fit_length(F.lit("US  "), 2)) == "US"


def test_numbers(dot):
    assert one(dot, numbers.divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(dot, numbers.round_to(F.lit(0.125), 1e-2)) == 0.13
    close = lambda a, b: one(dot, numbers.close(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert close(1.0, 1.0 + 1e-12) and close(None, None) and not close(None, 1.0) and not close(1.0, 2.0)
    assert close(math.inf, math.inf) and not close(5.0, math.inf)


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["A.x", "B"])
    assert lower_names(df).columns == ["a.x", "b"]
    with pytest.raises(ValueError):
        lower_names(spark.createDataFrame([(1, 2)], ["a", "b"]).toDF("a", "A"))
    assert common_columns(df, df.drop("B")) == (["A.x"], False)


def test_options_and_loops(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "id int, x int, s string")
    assert R.with_options(df, where=F.col("x") > 2, keep=["id"]).collect()[0].asDict() == {"id": 1}
    assert R.with_options(df, drop=["s"], rename={"x": "y"}).columns == ["id", "y"]
    got = R.do_output(df, F.lit(1), F.col("x"), "i", by=2).select("id", "i").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 3), (1, 5), (2, 1)]
    assert R.do_output(df, F.lit(3), F.col("x"), "i").count() == 3
    long = R.array_to_rows(df, ["id"], ["x", "id"], "k", "v").collect()
    assert sorted(map(tuple, long)) == [(1, 1, 5), (1, 2, 1), (2, 1, 1), (2, 2, 2)]
    assert R.over_array(df, ["x"], lambda c: c * 10).first()["x"] == 50
    outs = R.split_outputs(df, {"big": F.col("x") > 2, "all": None})
    assert (outs["big"].count(), outs["all"].count()) == (1, 2)
    assert R.assign(df, {"y": F.col("x") + 1, "z": F.col("y") + 1}).first()["z"] == 7
    assert R.tag(df, {"region": "US"}).first()["region"] == "US"
    assert R.set_lengths(df.withColumn("s", F.lit("abc ")), {"s": 2}).first()["s"] == "ab"


def test_stack_append_insert(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2.5, 2)], "v double, id int")
    got = S.stack([a, b], "src").orderBy("src").collect()
    assert [tuple(r) for r in got] == [(1, "x", 1, None), (2, None, 2, 2.5)]
    assert [tuple(r) for r in S.append(a, b).orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert S.insert_rows(a, a).count() == 2
    with pytest.raises(ValueError):
        S.insert_rows(a, a.drop("s"))
    assert S.as_view(a, "work.v1").count() == 1 and spark.sql("select * from work_v1").count() == 1


def test_signed_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    g = spark.createDataFrame([(1,), (3,), (None,), (3,)], "k int")
    got = {r["k"]: r["copies"] for r in S.signed_difference(a, g).collect()}
    assert got == {1: 1, 2: 1, 3: -2}


def test_slices_equal_the_loop(spark):
    rows = [("US", 2022, 1.0, 2.0), ("US", 2023, 3.0, 1.0), ("EU", 2022, 5.0, 1.0), ("JP", 2022, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "region string, year int, amount double, fx double")
    slices = {"region": ["US", "EU"], "year": [2022, 2023]}
    aggs = {"total": F.sum(F.col("amount") * F.col("fx"))}
    got = {(r["region"], r["year"]): r["total"] for r in A.slice_aggregate(df, slices, aggs).collect()}
    assert got == {("US", 2022): 2.0, ("US", 2023): 3.0, ("EU", 2022): 5.0}
    full = {(r["region"], r["year"]): r["total"] for r in A.slice_aggregate(df, slices, aggs, keep_empty=True).collect()}
    assert full == {**got, ("EU", 2023): None}
    assert A.slice_map(df, slices, {"usd": F.col("amount") * F.col("fx"), "k": F.col("usd") + 1}).count() == 3


def test_remerge_having_means(spark):
    rows = [("d", 4.0), ("d", 1.0), (None, 2.0), (None, None), ("e", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = A.remerge(df, ["g"], {"total": F.sum("v")}).withColumn("pct", F.try_divide("v", "total"))
    assert sorted((r["g"] or "", r["v"] or 0, r["pct"]) for r in got.collect() if r["pct"] is not None) == [
        ("", 2.0, 1.0), ("d", 1.0, 0.2), ("d", 4.0, 0.8),
    ]
    assert got.count() == 5
    assert A.having(df, ["g"], {"n": F.count("v")}, F.col("n") > 1).count() == 2
    m = A.proc_means(df, {"total": ("sum", "v"), "gone": ("nmiss", "v")}, keep_type_freq=True).first()
    assert m.asDict() == {"_type_": 0, "_freq_": 5, "total": 7.0, "gone": 1}
    sizes = {r["group_rows"]: r["groups"] for r in A.group_cardinality(df, ["g"]).collect()}
    assert sizes == {2: 2, 1: 1}


def test_linear_score(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0)], "INTERCEPT double, YEARS double, CCI double")
    params = spark.createDataFrame([("INTERCEPT", -0.5), (" years ", 2.0), ("CCI", 0.25), ("other", 9.0)], "varname string, estimate double")
    got = [r["score"] for r in A.linear_score(df, params, "varname", "estimate", ["intercept", "years", "cci"], "score").collect()]
    assert got == [4.25, None]


def test_remerge_leaves_detail_rows_of_few_groups_in_place(spark):
    given = [("a", 1), ("a", 2), ("b", 5), (None, 7), (None, 8)]
    df = spark.createDataFrame(given, "g string, v long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = A.remerge(df, ["g"], {"total": F.sum("v")})
        kept = A.having(df, ["g"], {"total": F.sum("v")}, F.col("total") > 4)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (made, kept)]
        assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
        assert sorted(map(tuple, made.collect()), key=str) == sorted([("a", 1, 3), ("a", 2, 3), ("b", 5, 5), (None, 7, 15), (None, 8, 15)], key=str)
        assert sorted(r["v"] for r in kept.collect()) == [5, 7, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
