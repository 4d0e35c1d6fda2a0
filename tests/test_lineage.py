"""Lexing, steps, reads and writes, graphs, log facts, provenance."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stepledger.lineage import graph as G
from stepledger.lineage import lexing as X
from stepledger.lineage import logs as L
from stepledger.lineage import provenance as V
from stepledger.lineage import steps as T
from stepledger.lineage.project import read_project
from stepledger.settings import scratch_path
from stepledger.sources import corpus as C


def programs(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "program string, text string")


def steps_of(spark, text):
    return T.extract_steps(programs(spark, text)).orderBy("idx").collect()


def scan_statements(text):
    """A character scanner, as the model for the lexing expressions."""
    out, quote, i = [], None, 0
    while i < len(text):
        c = text[i]
        if quote:
            out.append(c)
            quote = None if c == quote else quote
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 1
            out.append(" ")
        else:
            quote = c if c in "'\"" else None
            out.append("\0" if c == ";" else c)
        i += 1
    pieces = [re.sub(r"\s+", " ", p).strip() for p in "".join(out).split("\0")]
    return [p for p in pieces if p and not p.startswith("*")]


def test_lexing_agrees_with_a_scanner(spark):
    rnd = random.Random(5)
    parts = ["a", " ", ";", "'", '"', "/*", "*/", "*", "/", "\n", "data x", "réel"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", X.split_statements(F.col("t")).alias("s")).collect()}
    wrong = [(t, got[i], scan_statements(t)) for i, t in enumerate(texts) if got[i] != scan_statements(t)]
    assert not wrong, wrong[:3]


def test_lexing_takes_a_long_text(spark):
    text = "x = 'a;b' + \"c\"; /* note */ " * 60_000
    df = programs(spark, text)
    assert df.select(F.size(X.split_statements(F.col("text"))).alias("n")).first()["n"] == 60_000


def test_comments_in_quotes_stay(spark):
    (row,) = programs(spark, "v = '/* kept */'; /* gone */ w = 2;").select(X.strip_comments(F.col("text")).alias("t")).collect()
    assert "/* kept */" in row["t"] and "gone" not in row["t"]


def test_steps_and_boundaries(spark):
    got = steps_of(spark, "options x; data one; set r.one; data two; m = 'a; b'; set r.two; run; quit; proc sql; create table t3 as select * from two; quit;")
    assert [(s["kind"], s["proc"], s["label"]) for s in got] == [
        ("other", None, "step000_other"),
        ("data", None, "step001_data_one"),
        ("data", None, "step002_data_two"),
        ("other", None, "step003_other"),
        ("proc", "sql", "step004_proc_sql"),
    ]
    assert got[2]["statements"] == ["data two", "m = 'a; b'", "set r.two", "run"]
    assert got[2]["text"] == "data two;\nm = 'a; b';\nset r.two;\nrun;"


@pytest.mark.parametrize(
    "text, inputs, outputs",
    [
        ("data lib.o; set raw.i; run;", ["raw.i"], ["lib.o"]),
        ("data m; merge a b raw.c; by id; run;", ["work.a", "work.b", "raw.c"], ["work.m"]),
        ("data o; set raw.i end=eof nobs = n; run;", ["raw.i"], ["work.o"]),
        ("data o(keep=a b) p; set raw.i(where=(x>0) keep=a b); run;", ["raw.i"], ["work.o", "work.p"]),
        ("data _null_; set model.p; run;", ["model.p"], []),
        ("proc sql; create view v as select * from a x left join w.b y on x.k=y.k; insert into z select * from a; quit;", ["work.a", "w.b"], ["work.v", "work.z"]),
        ("proc sort data=t; by id; run;", ["work.t"], ["work.t"]),
        ("proc sort data=t out=u(drop=q); by id; run;", ["work.t"], ["work.u"]),
        ("proc append base=all data=one; run;", ["work.one"], ["work.all"]),
        ("proc reg data=t outest=e; run;", ["work.t"], ["work.e"]),
        ("data u; update mst tx; by id; run;", ["work.mst", "work.tx"], ["work.u"]),
        ("data x; set x; run;", ["work.x"], ["work.x"]),
    ],
)
def test_reads_and_writes(spark, text, inputs, outputs):
    (s,) = steps_of(spark, text)
    assert (s["inputs"], s["outputs"]) == (inputs, outputs)


PRICING = """
data accts; set raw.accts; run;
data rates; set raw.rates; run;
proc sql; create table priced as select * from accts a left join rates r on a.k = r.k; quit;
proc sort data=priced; by k; run;
data last; set priced; run;
"""


def io_of(spark, *texts):
    return T.step_io(T.extract_steps(programs(spark, *texts)))


def test_graph_of_two_programs(spark, heavy):
    io = io_of(spark, PRICING, "data a; set b; run; data b; set a; run;")
    got = sorted(tuple(r) for r in G.edges(io).collect())
    assert got == [
        ("p0", 0, 2, "work.accts"),
        ("p0", 1, 2, "work.rates"),
        ("p0", 2, 3, "work.priced"),
        ("p0", 3, 4, "work.priced"),
        ("p1", 0, 1, "work.a"),
    ]
    outside = sorted(tuple(r) for r in G.external_inputs(io).collect())
    assert outside == [("p0", "raw.accts"), ("p0", "raw.rates"), ("p1", "work.b")]
    assert [tuple(r) for r in G.final_outputs(io).collect()] == [("p0", "work.last")]
    depth = {(r["program"], r["idx"]): r["depth"] for r in G.layers(io, G.edges(io)).collect()}
    assert depth == {("p0", 0): 0, ("p0", 1): 0, ("p0", 2): 1, ("p0", 3): 2, ("p0", 4): 3, ("p1", 0): 0, ("p1", 1): 1}
    degree = {(r["program"], r["idx"]): (r["predecessors"], r["successors"]) for r in G.neighbours(G.edges(io)).collect()}
    assert degree[("p0", 2)] == (2, 1)
    places = sorted(tuple(r) for r in G.producers(io).filter("dataset = 'work.priced'").collect())
    assert [p[2:] for p in places] == [(2, 1), (3, 2)]


@pytest.mark.parametrize("extra", [(1, 0), (0, 0)])
def test_cycle_is_an_error(spark, extra):
    nodes = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2)], "program string, idx long")
    pairs = spark.createDataFrame([("p", 0, 1), ("p", 1, 2), ("p", *extra)], "program string, src long, dst long")
    with pytest.raises(ValueError, match="cycle"):
        G.layers(nodes, pairs)


def test_cycle_behind_a_root_is_an_error(spark):
    nodes = spark.createDataFrame([("p", i) for i in range(3)], "program string, idx long")
    pairs = spark.createDataFrame([("p", 0, 1), ("p", 1, 2), ("p", 2, 1)], "program string, src long, dst long")
    with pytest.raises(ValueError, match="cycle"):
        G.layers(nodes, pairs)


def test_downstream(spark):
    io = io_of(spark, PRICING)
    start = spark.createDataFrame([("p0", 1)], "program string, idx long")
    assert sorted(r["idx"] for r in G.downstream(start, G.edges(io)).collect()) == [1, 2, 3, 4]


def test_graph_json(spark):
    steps = T.extract_steps(programs(spark, PRICING))
    rows = G.graph_json(steps, G.edges(T.step_io(steps))).collect()
    parts = [r["part"] for r in rows]
    assert {p: parts.count(p) for p in set(parts)} == {"node": 5, "edge": 4, "external": 2, "final": 1, "layer": 5}
    assert {r["json"] for r in rows if r["part"] in ("external", "final")} == {f'{{"dataset":"{d}"}}' for d in ("raw.accts", "raw.rates", "work.last")}
    assert '{"from":0,"to":2}' in {r["json"] for r in rows}


# A yearly table of tides built by nested macros: two loops, a branch, and symbol lines out of order.
SOURCE = """%macro gauge(port=, depth_col=level);
  proc means data=tide.&port; var &depth_col; run;
%mend gauge;
%let ports = brest oban;
%macro year_book(from=, to=);
  %do y = &from %to &to;
    data book_&y; set tide.raw_&y; if level < &low_water then dry = 1; run;
    %do p = 1 %to 2;
      %gauge(port=%scan(&ports, &p))
    %end;
    %if &surge > 0 %then %do;
      data flood_&y; set book_&y; level = level + &surge; run;
    %end;
  %end;
%mend year_book;
%Let  Edition=second;
"""
LOG = """NOTE: compiled
SYMBOLGEN:  Macro variable SURGE resolves to .75
MLOGIC(YEAR_BOOK):  Beginning execution.
MLOGIC(YEAR_BOOK):  Parameter FROM has value 1987
MLOGIC(YEAR_BOOK):  Parameter TO has value 1987
MLOGIC(YEAR_BOOK):  %DO loop beginning; index variable Y; start value is 1987; stop value is 1987; by value is 1.
SYMBOLGEN:  Macro variable LOW_WATER resolves to 4
MPRINT(YEAR_BOOK):   data book_1987;
MPRINT(YEAR_BOOK):   set tide.raw_1987; if level < -2.5e1 then dry = 1;
SYMBOLGEN:  Macro variable LOW_WATER resolves to -2.5e1 	
MPRINT(YEAR_BOOK):   run;
MLOGIC(YEAR_BOOK):  %DO loop beginning; index variable P; start value is 1; stop value is 2; by value is 1.
MLOGIC(GAUGE):  Parameter PORT has value brest
MLOGIC(GAUGE):  Parameter DEPTH_COL has value level
SYMBOLGEN:  Macro variable PORTS resolves to brest oban
SYMBOLGEN:  Macro variable DEPTH_COL resolves to level
MPRINT(GAUGE):   proc means data=tide.brest; var level; run;
SYMBOLGEN:  Macro variable EDITION resolves to 2
SYMBOLGEN:  Macro variable P resolves to 2
MPRINT(GAUGE):   proc means data=tide.oban; var level; run;
MLOGIC(YEAR_BOOK):  %IF condition &surge > 0 is TRUE
MPRINT(YEAR_BOOK):   data flood_1987; set book_1987; level = level + .75;  run;
SYMBOLGEN:  Macro variable Y resolves to 1987
SYMBOLGEN:  Macro variable WAVES resolves to 31
WARNING: nothing was written
"""


def test_log_detection_and_flattening(spark):
    plain, noise = "data a; set b; run;", "ERROR: no such library\nsome other line"
    df = programs(spark, LOG, plain, noise, "MPRINT:  data z;\r\nMPRINT:  run;")
    got = {r["program"]: r for r in df.select("program", L.looks_like_log(F.col("text")).alias("log"), L.flatten(F.col("text")).alias("code")).collect()}
    assert [got[p]["log"] for p in ("p0", "p1", "p2", "p3")] == [True, False, True, True]
    assert got["p0"]["code"] == (
        "  data book_1987;\n  set tide.raw_1987; if level < -2.5e1 then dry = 1;\n  run;\n"
        "  proc means data=tide.brest; var level; run;\n  proc means data=tide.oban; var level; run;\n"
        "  data flood_1987; set book_1987; level = level + .75;  run;\n"
    )
    assert got["p1"]["code"] == plain and got["p2"]["code"] == noise
    assert got["p3"]["code"] == " data z;\n run;\n"


def test_log_facts(spark):
    facts = L.harvest(programs(spark, LOG))
    assert {r["variable"]: r["value"] for r in facts.symbols.collect()} == {
        "SURGE": ".75", "LOW_WATER": "-2.5e1", "PORTS": "brest oban", "DEPTH_COL": "level", "EDITION": "2", "P": "2", "Y": "1987", "WAVES": "31",
    }
    assert {(r["variable"], r["role"]) for r in facts.structural.collect()} == {
        ("FROM", "parameter"), ("TO", "parameter"), ("PORT", "parameter"), ("DEPTH_COL", "parameter"), ("Y", "loop"), ("P", "loop"),
    }
    assert {(r["macro"], r["statement"]) for r in facts.emitted.collect()} == {
        ("YEAR_BOOK", "data book_1987"), ("YEAR_BOOK", "set tide.raw_1987"), ("YEAR_BOOK", "if level < -2.5e1 then dry = 1"),
        ("GAUGE", "proc means data=tide.brest"), ("GAUGE", "proc means data=tide.oban"), ("GAUGE", "var level"),
        ("YEAR_BOOK", "data flood_1987"), ("YEAR_BOOK", "set book_1987"), ("YEAR_BOOK", "level = level + .75"),
    }
    lets = L.let_variables(programs(spark, SOURCE))
    assert {r["variable"] for r in lets.collect()} == {"PORTS", "EDITION"}
    assert {r["variable"] for r in L.derived_symbols(facts, lets).collect()} == {"SURGE", "LOW_WATER", "WAVES"}
    bodies = {r["macro"]: r["definition"] for r in L.macro_definitions(programs(spark, SOURCE)).collect()}
    assert set(bodies) == {"GAUGE", "YEAR_BOOK"}
    assert bodies["YEAR_BOOK"].startswith("%macro year_book(from") and bodies["YEAR_BOOK"].endswith("%mend year_book;")


def test_provenance_marks_only_data_derived_steps(spark):
    logs, sources = programs(spark, LOG), programs(spark, SOURCE)
    flat = logs.select("program", L.flatten(F.col("text")).alias("text"))
    rows = {r["idx"]: r for r in V.provenance(T.extract_steps(flat), L.harvest(logs), sources).collect()}
    # The two printed means carry no number from data.
    assert sorted(rows) == [0, 3]
    assert all(r["macros"] == ["YEAR_BOOK"] and r["original_source"].startswith("%macro year_book") for r in rows.values())
    assert [tuple(s) for s in rows[0]["substitutions"]] == [("LOW_WATER", "-2.5e1")]
    assert [tuple(s) for s in rows[3]["substitutions"]] == [("SURGE", ".75")]
    by_loop = LOG.replace("variable SURGE", "variable Y").replace("variable LOW_WATER", "variable FROM")
    logs = programs(spark, by_loop)
    flat = logs.select("program", L.flatten(F.col("text")).alias("text"))
    assert V.provenance(T.extract_steps(flat), L.harvest(logs), sources).count() == 0


def test_numeric_tokens_equal_a_search_for_each_value(spark):
    """Token equality finds what a search for the value as a standalone number finds."""
    rnd = random.Random(11)
    parts = ["1", "25", ".", "e", "E", "-", "+", " ", "x", "_", "*", "(", "0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(600)]
    values = ["1", "-1", "+25", "1.25", ".25", "-.0", "1e1", "1e-1", "-1e-1", "1E+25", "0", "25.", "-25.", "1.e-0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: set(r["n"]) for r in df.select("i", V.numeric_tokens(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        for v in values:
            alone = re.search(r"(?<![\w.])" + re.escape(v) + r"(?![\w.])", t) is not None
            assert (v in got[i]) == alone, (t, v)


def test_files_of_a_project_share_datasets(spark, heavy):
    steps = T.extract_steps(programs(spark, PRICING, "data next; set last; run;"))
    tagged = steps.withColumn("project", F.lit("j"))
    numbered = T.renumber(tagged.withColumnRenamed("idx", "step_no"), "project", ["program", "step_no"])
    assert sorted(r["idx"] for r in numbered.collect()) == list(range(6))
    io = T.step_io(numbered, "project")
    assert ("j", 4, 5, "work.last") in {tuple(r) for r in G.edges(io, "project").collect()}


def test_layers_and_downstream_of_a_long_chain(spark):
    """Longer than one written round, with shortcuts that must not lower a depth."""
    n = 23
    nodes = spark.createDataFrame([("p", i) for i in range(n)], "program string, idx long")
    chain = [("p", i, i + 1) for i in range(n - 1)] + [("p", 0, i) for i in range(2, n, 3)]
    pairs = spark.createDataFrame(chain, "program string, src long, dst long")
    assert {r["idx"]: r["depth"] for r in G.layers(nodes, pairs).collect()} == {i: i for i in range(n)}
    start = spark.createDataFrame([("p", 5)], "program string, idx long")
    assert sorted(r["idx"] for r in G.downstream(start, pairs).collect()) == list(range(5, n))
    back = pairs.union(spark.createDataFrame([("p", 20, 7)], pairs.schema))
    assert sorted(r["idx"] for r in G.downstream(start, back).collect()) == list(range(5, n))


def test_layers_of_a_chain_of_a_thousand_steps(spark):
    n = 1000
    nodes = spark.createDataFrame([("p", i) for i in range(n)] + [("q", 0)], "program string, idx long")
    pairs = spark.createDataFrame([("p", i, i + 1) for i in range(n - 1)], "program string, src long, dst long")
    assert len(G._walks(pairs, "program")) == 10
    got = {(r["program"], r["idx"]): r["depth"] for r in G.layers(nodes, pairs).collect()}
    assert got == {("q", 0): 0, **{("p", i): i for i in range(n)}}
    ring = pairs.union(spark.createDataFrame([("p", n - 1, 0)], pairs.schema))
    with pytest.raises(ValueError, match="cycle"):
        G.layers(nodes, ring)


def test_layers_equal_a_plain_longest_path(spark):
    rnd = random.Random(8)
    edges = sorted({(p, *sorted(rnd.sample(range(25), 2))) for p in "ab" for _ in range(40)})
    nodes = spark.createDataFrame([(p, i) for p in "ab" for i in range(25)], "program string, idx long")
    pairs = spark.createDataFrame(edges, "program string, src long, dst long")
    want = {(p, i): 0 for p in "ab" for i in range(25)}
    for p, a, b in sorted(edges, key=lambda e: e[1]):
        want[p, b] = max(want[p, b], want[p, a] + 1)
    assert {(r["program"], r["idx"]): r["depth"] for r in G.layers(nodes, pairs).collect()} == want


def test_versions_of_datasets(spark, heavy):
    io = io_of(spark, "data x; set x; run;", "data a; set r.z; run; data a; set a; run; data b; set a; run; data a; set b; run; data a; y = 1; run;")
    assert G.final_outputs(io).count() == 0
    final = sorted(tuple(r) for r in G.final_versions(io).collect())
    assert final == [("p0", "work.x", "work.x@0"), ("p1", "work.a", "work.a@4")]
    opened = {(r["program"], r["name"]): (r["version"], r["readers"], r["is_last"]) for r in G.versions(io).collect()}
    assert opened == {
        ("p0", "work.x@0"): (1, 0, True),
        ("p1", "work.a@0"): (1, 1, False),
        ("p1", "work.a@1"): (2, 1, False),
        ("p1", "work.b@2"): (1, 1, True),
        ("p1", "work.a@3"): (3, 0, False),
        ("p1", "work.a@4"): (4, 0, True),
    }
    got = {(r["program"], r["src"], r["dst"]) for r in G.version_edges(io).collect()}
    assert got == {
        ("p0", "work.x", "work.x@0"), ("p1", "r.z", "work.a@0"), ("p1", "work.a@0", "work.a@1"),
        ("p1", "work.a@1", "work.b@2"), ("p1", "work.b@2", "work.a@3"),
    }


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every 300 bytes, wherever that falls in a line."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("300", "1", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_log_of_many_splits_equals_one_text(spark, tmp_path, tiny_splits):
    """Line numbers, flattened code and facts; lines longer than a split, every line end, bytes that are no text."""
    rnd = random.Random(31)
    texts = {"a": LOG * 12, "b": "plain code;\r\nrun;\r\n" * 60, "c": "", "d": "x" * 1500 + "\n" + LOG + "no end", "e": "\n\n\r\r\n\x0bq\x85z\n"}
    texts["f"] = "".join(rnd.choice([*LOG.splitlines(keepends=True), "\n", "SYMBOLGEN:  Macro variable SURGE resolves to é9\n"]) for _ in range(300))
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    (tmp_path / "g.log").write_bytes(b"NOTE: \xff\xfe\n" + LOG.encode())
    texts["g"] = "NOTE: \ufffd\ufffd\n" + LOG
    found = C.read_lines(spark, str(tmp_path)).withColumn("program", C.stem(C.file_name(F.col("path"))))
    assert found.select(F.countDistinct("path")).first()[0] == 6
    corpus = spark.createDataFrame(list(texts.items()), "program string, text string")
    key = lambda rows: sorted(tuple(r) for r in rows)
    whole = [r for r in L.numbered_lines(corpus).collect()]
    last = {p: max(r["line_no"] for r in whole if r["program"] == p) for p in texts}
    # A text that ends its last line has an empty one after it, which a file has not.
    want = [(r["program"], r["line_no"], r["line"]) for r in whole if r["line"] or r["line_no"] < last[r["program"]]]
    assert key(found.select("program", "line_no", "line").collect()) == sorted(want)
    flat = {}
    for r in sorted(L.flatten_lines(found).collect(), key=lambda r: r["line_no"]):
        flat.setdefault(r["program"], []).append(r["line"])
    for r in corpus.select("program", L.flatten(F.col("text")).alias("t")).collect():
        expanded = "MPRINT" in texts[r["program"]]
        lines_of = r["t"].split("\n")[:-1] if expanded else [w[2] for w in sorted(want) if w[0] == r["program"]]
        assert flat.get(r["program"], []) == lines_of
    a, b = L.harvest_lines(found), L.harvest(corpus)
    for t in ("symbols", "structural", "emitted"):
        columns = sorted(getattr(b, t).columns)
        assert key(getattr(a, t).select(columns).collect()) == key(getattr(b, t).select(columns).collect())


def test_a_folder_of_files_is_one_project_each(spark, tmp_path):
    files = {
        "p/b.sas": "data late; set mid; run;", "p/a.log": LOG, "p/a.sas": SOURCE, "p/c.sas": "data last; set late flood_1987; run;",
        "q/only.sas": "data mid; set book_1987; run;", "q/readme.txt": "data no; run;",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    made = read_project(spark, str(tmp_path))
    order = sorted((r["project"], r["file_no"], r["path"].rsplit("/", 1)[1], r["source"] is not None) for r in made.files.collect())
    assert order == [("p", 1, "a.log", True), ("p", 2, "b.sas", False), ("p", 3, "c.sas", False), ("q", 1, "only.sas", False)]
    linked = {(r["project"], r["src"], r["dst"], r["dataset"]) for r in made.edges.collect()}
    assert linked == {("p", 0, 3, "work.book_1987"), ("p", 3, 5, "work.flood_1987"), ("p", 4, 5, "work.late")}
    lines = spark.createDataFrame([(1, "# order"), (2, "c.sas"), (3, "b.sas"), (4, "gone.sas")], "line_no long, line string")
    listed = read_project(spark, str(tmp_path), manifest=lines, folder=f"file:{tmp_path}/p")
    assert {(r["src"], r["dst"]) for r in listed.edges.collect()} == set()
    assert [r["path"].rsplit("/", 1)[1] for r in listed.files.orderBy("file_no").collect()] == ["c.sas", "b.sas"]


def pieces_of(rnd, text):
    """The text in pieces of one to three lines."""
    lines, out = text.splitlines(keepends=True), []
    while lines:
        n = rnd.randint(1, 3)
        out.append("".join(lines[:n]))
        lines = lines[n:]
    return out


def test_steps_of_pieces_are_those_of_whole_texts(spark):
    """Quotes, comments, statements and steps go over the borders of pieces; logs have pieces without code."""
    rnd = random.Random(7)
    bits = ["a", " ", ";", "'", '"', "/*", "*/", "*", "/", "\n", "\n", "data x", "réel", "run;", "; proc sort data=b;", ";\nset c;", "quit", "endsas;", "; data"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(900)]
    logged = ["\n".join(rnd.choice(["MPRINT(M):  ", "NOTE: "]) + x for x in t.split("\n")) for t in texts[::3]]
    texts += logged
    rows = [(f"p{i}", n, x) for i, t in enumerate(texts) for n, x in enumerate(pieces_of(rnd, t))]
    pieces = L.flatten_pieces(spark.createDataFrame(rows, "program string, piece int, text string"))
    whole = T.extract_steps(programs(spark, *texts).select("program", L.flatten(F.col("text")).alias("text")))
    made = T.extract_steps_of_pieces(pieces)
    assert made.columns == whole.columns
    want, got = ({(r["program"], r["idx"]): r for r in df.collect()} for df in (whole, made))
    wrong = [(texts[int(k[0][1:])], want.get(k), got.get(k)) for k in {*want, *got} if want.get(k) != got.get(k)]
    assert not wrong, wrong[:3]
    assert T.whole_steps(pieces).count() > 1.5 * len(texts)


def test_project_texts_are_in_no_row(spark, tmp_path, monkeypatch):
    """A file of many steps is read, flattened and cut in pieces; the whole text is made where it is asked for."""
    monkeypatch.setattr(C, "PIECE_LINES", 8, raising=False)
    said = "NOTE: n\nMPRINT(M):  data b{}; set b{}; /* ;\nMPRINT(M):  it's */ run;\n"
    text = "".join(said.format(i + 1, i) for i in range(200))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.log").write_text(text)
    (tmp_path / "p" / "a.sas").write_text("%macro m; %mend;")
    (tmp_path / "p" / "b.sas").write_text("\n")
    before = set(map(str, scratch(spark)))
    made = read_project(spark, str(tmp_path))
    longest = 0
    for table in scratch(spark):
        if str(table) not in before:
            df = spark.read.parquet(str(table))
            sizes = [F.max(F.length(c)) for c, kind in df.dtypes if kind == "string"]
            longest = max([longest, *[n or 0 for n in df.agg(*sizes).first()]] if sizes else [longest])
    assert 0 < longest < len(text) / 10
    assert {(r["src"], r["dst"]) for r in made.edges.collect()} == {(i, i + 1) for i in range(199)}
    found = [(r["file_no"], r["text"], r["source"]) for r in made.files.orderBy("file_no").collect()]
    assert found == [(1, text, "%macro m; %mend;"), (2, "\n", None)]


def scratch(spark):
    root = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    return [p for p in root.glob("table-*")]


def test_flatten_goes_through_the_lines_once(spark):
    df = programs(spark, "MPRINT(A):  data x;  \nNOTE: n\nMPRINT(A):   run;\n", "data y; run;", "NOTE: no code\n", None)
    made = df.select("program", L.flatten(F.col("text")).alias("text"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MPRINT") == 1
    got = {r["program"]: r["text"] for r in made.collect()}
    assert got == {"p0": " data x;\n  run;\n", "p1": "data y; run;", "p2": "NOTE: no code\n", "p3": None}


def test_facts_are_hashed_and_not_sorted(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(L, "store", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    said = "SYMBOLGEN:  Macro variable A resolves to {}\n"
    facts = L.harvest(programs(spark, "".join(map(said.format, (1, 2, 1, 9, 2))) + "MPRINT(m):  data x; set y;\n" * 2))
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]
    assert [tuple(r) for r in facts.symbols.collect()] == [("p0", "A", "2")]
    assert sorted(tuple(r) for r in facts.emitted.collect()) == [("p0", "M", "data x"), ("p0", "M", "set y")]


def test_dataset_names_are_cleaned_once(spark):
    found = T.extract_steps(programs(spark, "data 'Lib.A'(keep=x) .b c; set d; run;")).select("outputs", "inputs")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\([\s\S]*$") == 2
    assert found.first()["inputs"] == ["work.d"]


def test_pairs_of_steps_need_one_shuffle_of_the_edges(spark):
    io = spark.createDataFrame([("p", i, f"d{i - w}", bool(w)) for i in range(1, 6) for w in (0, 1)], "program string, idx long, dataset string, is_write boolean")
    pairs = G.edges(io).select("program", "src", "dst").distinct()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any(", dst#" in x for x in dealt) and not any(", src#" in x for x in dealt)


def test_layers_with_missing_names(spark):
    nodes = spark.createDataFrame([(None, 0), (None, 1), ("p", 0), ("p", 1), ("p", 2)], "program string, idx long")
    pairs = spark.createDataFrame([(None, 0, 1), ("p", 0, 1), ("p", 1, 2), ("p", 1, 7)], "program string, src long, dst long")
    got = {(r["program"], r["idx"]): r["depth"] for r in G.layers(nodes, pairs).collect()}
    assert got == {(None, 0): 0, (None, 1): 0, ("p", 0): 0, ("p", 1): 1, ("p", 2): 2, ("p", 7): 2}
