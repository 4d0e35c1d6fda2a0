import os

import pytest
from pyspark.sql import functions as F

from stepledger.operators import ordered
from stepledger.settings import shared_dir
from stepledger.sources import catalog as C
from stepledger.sources import corpus as P
from stepledger.sources import sinks


@pytest.fixture
def library(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id long, s string, v double")
    for name in ("raw.accts.csv", "plain.parquet", "Ref/Rates.TSV", "work.x.parquet"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        df.toPandas().to_csv(tmp_path / name, index=False, sep="\t" if name.endswith("TSV") else ",") if not name.endswith(
            "parquet"
        ) else C.write_dataset(df.repartition(2), str(tmp_path / name))
    (tmp_path / "notes.txt").write_text("not a dataset")
    (tmp_path / "old.sas7bdat").write_bytes(b"\0")
    return str(tmp_path)


def test_catalog_keys(spark, library):
    rows = {r["key"]: (r["format"], r["files"]) for r in C.catalog(spark, library).collect()}
    assert set(rows) == {"raw.accts", "work.plain", "ref.rates", "work.x", "work.old"}
    assert rows["raw.accts"] == ("csv", 1) and rows["ref.rates"][0] == "tsv"


def test_catalog_reads_by_ending(spark, library):
    kinds = "id long, s string, v double"
    store = C.Catalog(spark, library, {"raw.accts": kinds, "ref.rates": kinds})
    assert "RAW.accts" in store and "raw.nope" not in store
    want = [(1, "a", 1.5), (2, None, None)]
    for key in ("raw.accts", "ref.rates", "work.plain", "work.x"):
        assert sorted(map(tuple, store[key].collect())) == want, key
    assert store["work.x"] is store["WORK.X"]
    assert store.keep("work.x").is_cached
    store.release("work.x")
    with pytest.raises(ValueError, match="Parquet"):
        store["work.old"]
    with pytest.raises(KeyError):
        store["raw.nope"]


def test_csv_without_a_schema_is_inferred(spark, library):
    assert {k for _, k in C.read_path(spark, f"{library}/raw.accts.csv").dtypes} == {"int", "double", "string"}


def test_text_files_without_line_breaks_are_read_in_splits(spark, tmp_path):
    kinds = "id long, s string, v double"
    rows = [(i, f"a, \"{i}\"" if i % 3 else None, i / 4) for i in range(3000)]
    path = C.write_dataset(spark.createDataFrame(rows, kinds).coalesce(1), str(tmp_path / "big.csv"))
    whole = C.read_path(spark, path, kinds)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        cut = C.read_path(spark, path, kinds, line_breaks=False)
        assert cut.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_two_paths_for_a_key_are_an_error(spark, library):
    os.makedirs(f"{library}/work")
    C.write_dataset(spark.range(1), f"{library}/work/x.parquet")
    assert [r["key"] for r in C.duplicate_keys(C.catalog(spark, library)).collect()] == ["work.x"]
    with pytest.raises(ValueError, match="work.x"):
        C.Catalog(spark, library)


def test_library_copy_and_unknown_format(spark, library, tmp_path):
    os.remove(f"{library}/old.sas7bdat")
    target = str(tmp_path / "copied")
    assert len(C.Catalog(spark, library).copy_library("work", "golden", target)) == 2
    assert C.Catalog(spark, target).keys() == ["golden.plain", "golden.x"]
    with pytest.raises(ValueError):
        C.write_dataset(spark.range(1), f"{target}/x.xlsx")


def test_describe_and_preview(spark):
    df = spark.sql("select id, cast(id as decimal(9,2)) n, date'2020-01-01' d, timestamp'2020-01-01' t, true b, 'x' s from range(9)")
    got = {r["column_name"]: (r["type"], r["row_count"]) for r in C.describe(df).collect()}
    assert got == {c: (t, 9) for c, t in dict(id="int", n="double", d="date", t="datetime", b="bool", s="string").items()}
    assert [r["id"] for r in C.preview(df, ["-id"], 3).collect()] == [8, 7, 6]
    assert C.preview_text(df, ["id"], chars=30).endswith("(truncated)")
    assert len(C.preview(spark.range(1).selectExpr(*[f"id as c{i}" for i in range(30)]), ["c0"]).columns) == 20


def test_file_order(spark, library):
    rows = C.with_file_order(spark, f"{library}/plain.parquet").collect()
    assert all(r["row_index"] == 0 and r["file_path"] for r in rows)


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_corpus_pairs_and_order(spark, tmp_path):
    (tmp_path / "01_load.sas").write_text("%macro m; %mend;")
    (tmp_path / "01_load.log").write_bytes(b"MPRINT(M): data a;\n\xff")
    (tmp_path / "02_more.sas").write_text("data b; set a; run;")
    (tmp_path / "readme.md").write_text("no program")
    found = P.program_files(P.read_corpus(spark, str(tmp_path)))
    rows = {r["name"]: r for r in P.pair_sources(found).withColumn("name", P.file_name(F.col("path"))).collect()}
    assert set(rows) == {"01_load.sas", "01_load.log", "02_more.sas"}
    assert rows["01_load.log"]["source"] == "%macro m; %mend;" and rows["02_more.sas"]["source"] is None
    assert rows["01_load.log"]["text"].endswith("�")
    ordered = P.ordered_by_path(found.withColumn("project", F.lit("p"))).select("file_no", P.file_name(F.col("path")).alias("n"))
    assert [r["n"] for r in ordered.orderBy("file_no").collect()] == ["01_load.log", "01_load.sas", "02_more.sas"]


def test_manifest(spark):
    lines = ["# order", "b.sas", "", " /abs/a.sas ", "a.sas"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    order = P.manifest_order(df, "jobs")
    assert [(r["file_no"], r["path"]) for r in order.orderBy("file_no").collect()] == [
        (1, "jobs/b.sas"), (2, "/abs/a.sas"), (3, "jobs/a.sas"),
    ]
    corpus = spark.createDataFrame([("jobs/a.sas", "x"), ("jobs/z.sas", "y")], "path string, text string")
    assert [(r["file_no"], r["text"]) for r in P.ordered_by_manifest(corpus, order).orderBy("file_no").collect()] == [(1, None), (2, None), (3, "x")]


def test_spread_deals_by_program(spark):
    plan = P.spread(spark.range(10).selectExpr("cast(id as string) program", "'t' text"))
    assert "RepartitionByExpression [program" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, True)], "program string, n int, ok boolean")
    paths = sinks.write_results({"verdicts": df}, str(tmp_path / "out"))
    assert spark.read.parquet(paths["verdicts"]).count() == 1
    doc = sinks.manifest_json(df, ["program"])
    assert doc.first()["json"] == '{"n":1,"ok":true}'
    assert spark.read.json(sinks.write_manifest(doc, str(tmp_path / "m"))).count() == 1


@pytest.mark.parametrize("ending", ["csv", "tsv"])
def test_text_formats_give_back_what_was_written(spark, tmp_path, ending):
    rows = [(1, 'say "hi", ok', 1.5), (2, "two\nlines\t, and a tab", None), (3, "", 2.0), (4, None, -1.0), (5, " blanks ", 0.0), (6, '"', 0.0)]
    df = spark.createDataFrame(rows, "i int, t string, v double")
    path = C.write_dataset(df, f"{tmp_path}/x.{ending}")
    assert sorted(map(tuple, C.read_path(spark, path, df.schema).collect())) == sorted(rows)
    assert dict(C.read_path(spark, path).dtypes) == {"i": "int", "t": "string", "v": "double"}


def test_standard_quotes_are_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n"say ""hi"", ok",1\n')
    assert [tuple(r) for r in C.read_path(spark, f"{tmp_path}/x.csv").collect()] == [('say "hi", ok', 1)]


def test_listed_files_that_are_absent_are_told(spark):
    corpus = spark.createDataFrame([("/p/a.log", "x")], "path string, text string")
    lines = spark.createDataFrame([(1, "b.log"), (2, "# no"), (3, "a.log")], "line_no int, line string")
    order = P.manifest_order(lines, "/p")
    assert [r["path"] for r in P.absent_files(corpus, order).collect()] == ["/p/b.log"]
    assert sorted((r["file_no"], r["text"]) for r in P.ordered_by_manifest(corpus, order).collect()) == [(1, None), (2, "x")]


def test_file_numbers_do_not_sort_by_whole_texts(spark, monkeypatch):
    given = [("x", "/x/b", "long " * 50, None), ("x", "/x/a", "t", "s"), ("x", "/x/a", "u", "s"), ("y", "/y/c", None, None)]
    files = spark.createDataFrame(given, "project string, path string, text string, source string")
    sorted_by = []
    inner = ordered.in_pieces
    monkeypatch.setattr(ordered, "in_pieces", lambda df, by, keys: sorted_by.extend(str(k) for k in keys) or inner(df, by, keys))
    made = P.ordered_by_path(files)
    assert sorted_by and not any(c in k for k in sorted_by for c in ("text", "source"))
    assert made.columns == [*files.columns, "file_no"]
    got = made.collect()
    assert sorted((r["path"], r["file_no"]) for r in got) == [("/x/a", 1), ("/x/a", 2), ("/x/b", 3), ("/y/c", 1)]
    assert sorted(str(tuple(r)[:4]) for r in got) == sorted(map(str, given))


def test_pieces_are_the_texts(spark, tmp_path, monkeypatch):
    """Marks at the start, missing line feeds at the end, other line ends, broken bytes and odd paths, with splits and without."""
    monkeypatch.setattr(P, "PIECE_LINES", 2)
    files = {
        "a b%20+ü/bom.sas": b"\xef\xbb\xbfa\nb\n\n\nc\n",
        "a b%20+ü/bom.log": b"\xef\xbb\xbfMPRINT(A): data a;\nx\nMPRINT(A): run;",
        "ends.sas": b"data a;\rset b;\r\nrun;\x85\n\x0c",
        "broken.sas": b"\xe2\x82\n\xff\xfe;\n\xc3",
        "feeds.LOG": b"\n\n\n\n\nx",
        "feed.sas": b"\n",
        "empty.sas": b"",
        "other.txt": b"no",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = {r["path"]: r["text"] for r in P.program_files(P.read_corpus(spark, str(tmp_path))).collect() if r["text"]}
    assert len(want) == 6
    for split in ("", "16"):
        try:
            if split:
                spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            pieces = P.read_pieces(spark, str(tmp_path))
            assert pieces.count() > len(want)
            assert {r["path"]: r["text"] for r in P.whole_texts(pieces).collect()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
