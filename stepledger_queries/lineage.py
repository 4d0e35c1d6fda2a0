"""Program and log analytics."""

from pyspark.sql import functions as F

from stepledger.lineage import graph, lexing, logs, provenance, steps
from stepledger.lineage import patterns as P
from stepledger.lineage.project import read_project
from stepledger.settings import scratch_path, store
from stepledger.sources.corpus import manifest_order, pair_sources, read_lines
from stepledger_queries import expressions as X
from stepledger_queries.base import literal, query, table
from stepledger_queries.corpora import LOG, PROGRAM, SOURCE, corpus, corpus_sql
from stepledger_queries.scalars import clean_sql, statements_sql

def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {literal(X.SPACE + '+')}, ' ', 'g'), ' ')"


def ends_sql(x: str) -> str:
    return f"regexp_replace({x}, {literal('^' + X.SPACE + '+|' + X.SPACE + '+$')}, '', 'g')"


def statements_cte(corpus_text: str) -> str:
    """Common tables down to ``steps``: one row per step with its text."""
    return f"""
    corpus AS ({corpus_text}),
    clean AS (SELECT program, {clean_sql("text")} AS c FROM corpus),
    split AS (SELECT program, {statements_sql("c")} AS s FROM clean),
    stmts AS (SELECT program, unnest(s) AS statement, generate_subscripts(s, 1) - 1 AS stmt_no FROM split),
    words AS (SELECT *, lower(regexp_extract(statement, '^([A-Za-z_][A-Za-z0-9_]*)', 1)) AS word FROM stmts),
    starts AS (SELECT *, CASE WHEN word IN ('data', 'proc') OR lag(word) OVER w IS NULL OR lag(word) OVER w IN ('run', 'quit', 'endsas') THEN 1 ELSE 0 END AS start
               FROM words WINDOW w AS (PARTITION BY program ORDER BY stmt_no)),
    numbered AS (SELECT *, CAST(sum(start) OVER (PARTITION BY program ORDER BY stmt_no) - 1 AS BIGINT) AS idx FROM starts),
    steps AS (SELECT program, idx, string_agg(statement, ';' || chr(10) ORDER BY stmt_no) || ';' AS text, count(*) AS n_statements,
              CASE WHEN arg_min(word, stmt_no) IN ('data', 'proc') THEN arg_min(word, stmt_no) ELSE 'other' END AS kind,
              CASE WHEN arg_min(word, stmt_no) = 'proc' THEN nullif(lower(regexp_extract(arg_min(statement, stmt_no), '^(?i:proc) ([A-Za-z_][A-Za-z0-9_]*)', 1)), '') END AS proc
              FROM numbered GROUP BY program, idx)
    """


def io_cte(corpus_text: str = corpus_sql()) -> str:
    """Common tables down to ``io``: program, idx, dataset, is_write."""
    options = f"unnest(regexp_extract_all(text, {literal(X.PROC_OPTION)}, 1)) AS k, unnest(regexp_extract_all(text, {literal(X.PROC_OPTION)}, 2)) AS name"
    return f"""{statements_cte(corpus_text)},
    named AS (
        SELECT n.program, n.idx, n.word = 'data' AS is_write,
               unnest(regexp_extract_all(regexp_replace(substring(n.statement, length(n.word) + 1), {literal(X.OPTION_PAIR)}, ' ', 'g'), {literal(X.DATASET_TOKEN)})) AS name, true AS data_step
        FROM numbered n JOIN steps s ON s.program = n.program AND s.idx = n.idx
        WHERE s.kind = 'data' AND n.word IN ('data', 'set', 'merge', 'update', 'modify')
        UNION ALL SELECT program, idx, true, unnest(regexp_extract_all(text, {literal(X.SQL_CREATE)}, 1)), false FROM steps WHERE proc = 'sql'
        UNION ALL SELECT program, idx, true, unnest(regexp_extract_all(text, {literal(X.SQL_INSERT)}, 1)), false FROM steps WHERE proc = 'sql'
        UNION ALL SELECT program, idx, false, unnest(regexp_extract_all(text, {literal(X.SQL_FROM)}, 1)), false FROM steps WHERE proc = 'sql'
        UNION ALL SELECT program, idx, false, unnest(regexp_extract_all(text, {literal(X.SQL_JOIN)}, 1)), false FROM steps WHERE proc = 'sql'
        UNION ALL SELECT program, idx, lower(k) IN ('out', 'outest', 'base'), name, false FROM (SELECT program, idx, {options} FROM steps WHERE kind = 'proc' AND proc <> 'sql')
    ),
    plain AS (SELECT program, idx, is_write, lower({squeeze_sql("regexp_replace(name, '[(].*$', '', 's')")}) AS name, data_step FROM named),
    keyed AS (SELECT DISTINCT program, idx, is_write, CASE WHEN contains(name, '.') THEN name ELSE 'work.' || name END AS dataset
              FROM plain WHERE name NOT IN ('_null_', '_data_', '_last_') AND NOT (data_step AND name IN ('end', 'nobs', 'point', 'key', 'in', 'by'))),
    io AS (SELECT program, idx, is_write, dataset FROM keyed
           UNION SELECT k.program, k.idx, true, k.dataset FROM keyed k JOIN steps s USING (program, idx)
           WHERE s.proc = 'sort' AND NOT EXISTS (SELECT 1 FROM keyed w WHERE w.program = k.program AND w.idx = k.idx AND w.is_write))
    """


def edges_cte(corpus_text: str = corpus_sql()) -> str:
    return f"""{io_cte(corpus_text)},
    edges AS (SELECT DISTINCT r.program, max(w.idx) OVER (PARTITION BY r.program, r.idx, r.dataset) AS src, r.idx AS dst, r.dataset
              FROM io r JOIN io w ON w.program = r.program AND w.dataset = r.dataset AND w.is_write AND w.idx < r.idx WHERE NOT r.is_write)
    """


LINES = f"""
    corpus AS ({corpus_sql(LOG)}),
    split AS (SELECT program, regexp_split_to_array(text, {literal(X.LINE_END)}) AS ls FROM corpus),
    lines AS (SELECT program, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM split)
"""
CODE = f"""{LINES},
    code AS (SELECT program, string_agg(c, chr(10) ORDER BY line_no) || chr(10) AS text FROM (
        SELECT program, line_no, regexp_replace(regexp_extract(line, {literal(X.EXPANDED)}, 1), {literal(X.SPACE + '+$')}, '') AS c
        FROM lines WHERE regexp_matches(line, {literal(X.EXPANDED)})) WHERE c <> '' GROUP BY program),
    flat AS (SELECT corpus.program, coalesce(code.text, corpus.text) AS text FROM corpus LEFT JOIN code USING (program))
"""


def flat_corpus(spark, sf_dir):
    return corpus(spark, sf_dir, LOG).select("program", logs.flatten(F.col("text")).alias("text"))


@query(
    "f9_log_lines",
    f"""
    WITH {LINES}
    SELECT program, CAST(line_no AS BIGINT) AS line_no, regexp_extract(line, {literal(X.EXPANDED)}, 1) AS code,
           regexp_matches(line, {literal(X.LOG_NOISE)}) AS noise
    FROM lines WHERE regexp_matches(line, {literal(X.EXPANDED)}) OR regexp_matches(line, {literal(X.LOG_NOISE)})
    """,
)
def f9_log_lines(spark, sf_dir):
    rows = logs.numbered_lines(corpus(spark, sf_dir, LOG)).filter(logs.is_log_line(F.col("line")))
    return rows.select(
        "program",
        F.col("line_no").cast("long"),
        F.regexp_extract("line", P.EXPANDED, 1).alias("code"),
        F.col("line").rlike(P.LOG_NOISE).alias("noise"),
    )


SYMBOLS = f"""{LINES},
    found AS (SELECT program, line_no, upper(regexp_extract(line, {literal(X.SYMBOL)}, 1)) AS variable,
                     {ends_sql(f"regexp_extract(line, {literal(X.SYMBOL)}, 2)")} AS value
              FROM lines WHERE regexp_matches(line, {literal(X.SYMBOL)})),
    symbols AS (SELECT program, variable, arg_max(value, line_no) AS value FROM found GROUP BY 1, 2),
    logic AS (SELECT program, line FROM lines WHERE NOT regexp_matches(line, {literal(X.SYMBOL)})
              AND NOT regexp_matches(line, {literal(X.EXPANDED_NAMED)}) AND contains(upper(line), 'MLOGIC')),
    structural AS (SELECT DISTINCT * FROM (
        SELECT program, upper(regexp_extract(line, {literal(X.LOOP_INDEX)}, 1)) AS variable, 'loop' AS role FROM logic
        UNION ALL SELECT program, upper(regexp_extract(line, {literal(X.PARAMETER)}, 1)), 'parameter' FROM logic) WHERE variable <> ''),
    emitted AS (SELECT DISTINCT program, macro, statement FROM (
        SELECT program, macro, lower({squeeze_sql(f"regexp_replace({squeeze_sql('piece')}, ';+$', '')")}) AS statement FROM (
            SELECT program, upper(regexp_extract(line, {literal(X.EXPANDED_NAMED)}, 1)) AS macro,
                   unnest(string_split(regexp_extract(line, {literal(X.EXPANDED_NAMED)}, 2), ';')) AS piece
            FROM lines WHERE regexp_matches(line, {literal(X.EXPANDED_NAMED)}) AND NOT regexp_matches(line, {literal(X.SYMBOL)})))
        WHERE statement NOT IN ('', 'run', 'quit', 'endsas'))
"""


@query("a10_last_symbol_value", f"WITH {SYMBOLS} SELECT program, variable, value FROM symbols")
def a10_last_symbol_value(spark, sf_dir):
    return logs.harvest(corpus(spark, sf_dir, LOG)).symbols


@query("f10_macro_facts", f"WITH {SYMBOLS} SELECT program, variable, role FROM structural")
def f10_macro_facts(spark, sf_dir):
    return logs.harvest(corpus(spark, sf_dir, LOG)).structural


@query("a11_emitted_statements", f"WITH {SYMBOLS} SELECT program, macro, statement FROM emitted")
def a11_emitted_statements(spark, sf_dir):
    return logs.harvest(corpus(spark, sf_dir, LOG)).emitted


@query(
    "l1_log_detection",
    f"""
    WITH {LINES} SELECT program, bool_or(regexp_matches(line, {literal(X.EXPANDED)}) OR regexp_matches(line, {literal(X.LOG_NOISE)})) AS is_log
    FROM lines GROUP BY program
    """,
)
def l1_log_detection(spark, sf_dir):
    return corpus(spark, sf_dir, LOG).select("program", logs.looks_like_log(F.col("text")).alias("is_log"))


@query("l2_flatten", f"WITH {CODE} SELECT program, length(text) AS n, md5(text) AS digest FROM flat")
def l2_flatten(spark, sf_dir):
    return flat_corpus(spark, sf_dir).select(
        "program", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest")
    )


@query(
    "l3_log_facts",
    f"""
    WITH {SYMBOLS} SELECT s.program, s.variables, coalesce(r.roles, 0) AS roles, coalesce(e.statements, 0) AS statements
    FROM (SELECT program, count(*) AS variables FROM symbols GROUP BY 1) s
    LEFT JOIN (SELECT program, count(*) AS roles FROM structural GROUP BY 1) r USING (program)
    LEFT JOIN (SELECT program, count(*) AS statements FROM emitted GROUP BY 1) e USING (program)
    """,
)
def l3_log_facts(spark, sf_dir):
    facts = logs.harvest(corpus(spark, sf_dir, LOG))
    parts = [
        df.select("program", *[F.lit(int(i == j)).alias(n) for j, n in enumerate(("variables", "roles", "statements"))])
        for i, df in enumerate((facts.symbols, facts.structural, facts.emitted))
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy("program").agg(*[F.sum(c).alias(c) for c in ("variables", "roles", "statements")])


@query(
    "l4_let_variables",
    f"""
    WITH c AS ({corpus_sql(SOURCE)})
    SELECT DISTINCT program, upper(v) AS variable FROM (SELECT program, unnest(regexp_extract_all(text, {literal(X.LET)}, 1)) AS v FROM c)
    """,
)
def l4_let_variables(spark, sf_dir):
    return logs.let_variables(corpus(spark, sf_dir, SOURCE))


DEFINITION_SQL = literal(X.DEFINITION)
DEFINITIONS = f"""
    sources AS ({corpus_sql(SOURCE)}),
    bodies AS (SELECT program, unnest(regexp_extract_all(text, {DEFINITION_SQL})) AS body FROM sources),
    definitions AS (SELECT program, upper(regexp_extract(body, {literal(X.DEFINITION_NAME)}, 1)) AS macro, {ends_sql("body")} AS definition FROM bodies)
"""


@query("j14_macro_definitions", f"WITH {DEFINITIONS} SELECT program, macro, definition FROM definitions")
def j14_macro_definitions(spark, sf_dir):
    return logs.macro_definitions(corpus(spark, sf_dir, SOURCE))


DERIVED = f"""{SYMBOLS},
    lets AS (SELECT DISTINCT program, upper(v) AS variable FROM (SELECT program, unnest(regexp_extract_all(text, {literal(X.LET)}, 1)) AS v FROM ({corpus_sql(SOURCE)}))),
    derived AS (SELECT program, variable, value FROM symbols s WHERE regexp_matches(value, {literal(X.NUMBER)})
        AND NOT EXISTS (SELECT 1 FROM structural x WHERE x.program = s.program AND x.variable = s.variable)
        AND NOT EXISTS (SELECT 1 FROM lets x WHERE x.program = s.program AND x.variable = s.variable))
"""


def log_parts(spark, sf_dir):
    found = steps.extract_steps(flat_corpus(spark, sf_dir)).select("program", "idx", "statements", "text")
    return store(found), logs.harvest(corpus(spark, sf_dir, LOG)), corpus(spark, sf_dir, SOURCE)


@query("l5_derived_symbols", f"WITH {DERIVED} SELECT program, variable, value FROM derived")
def l5_derived_symbols(spark, sf_dir):
    facts = logs.harvest(corpus(spark, sf_dir, LOG))
    return logs.derived_symbols(facts, logs.let_variables(corpus(spark, sf_dir, SOURCE))).select(
        "program", "variable", "value"
    )


# The log facts and the steps of the flattened logs, under one WITH.
FLAT_STEPS = (
    DERIVED
    + ","
    + CODE[len(LINES) :].lstrip(",\n ")
    + ","
    + statements_cte("SELECT program, text FROM flat").replace("corpus AS", "programs AS").replace("FROM corpus", "FROM programs").replace("split", "split_stmts")
)
# A value stands alone when nothing of a word or number touches it: every value against every text.
ALONE = r"'(^|[^\p{L}\p{N}_.])' || regexp_escape(value) || '($|[^\p{L}\p{N}_.])'"
LITERALS = f"literals AS (SELECT s.program, s.idx, variable, value FROM steps s JOIN derived d ON d.program = s.program WHERE regexp_matches(s.text, {ALONE}))"
MACROS = f"""macros AS (SELECT DISTINCT n.program, n.idx, macro FROM numbered n JOIN emitted e ON e.program = n.program
    AND e.statement = lower({squeeze_sql(f"regexp_replace({squeeze_sql('n.statement')}, ';+$', '')")}))"""


@query("j11_literals_in_steps", f"WITH {FLAT_STEPS}, {LITERALS} SELECT program, idx, variable, value FROM literals")
def j11_literals_in_steps(spark, sf_dir):
    found, facts, sources = log_parts(spark, sf_dir)
    return provenance.literals_in_steps(found, logs.derived_symbols(facts, logs.let_variables(sources)))


@query("j12_macros_of_steps", f"WITH {FLAT_STEPS}, {MACROS} SELECT program, idx, macro FROM macros")
def j12_macros_of_steps(spark, sf_dir):
    found, facts, _ = log_parts(spark, sf_dir)
    return provenance.macros_of_steps(found, facts.emitted)


@query(
    "l6_provenance",
    f"""
    WITH {FLAT_STEPS}, {LITERALS}, {MACROS}, {DEFINITIONS},
    m AS (SELECT macros.program, idx, string_agg(macros.macro, ',' ORDER BY macros.macro) AS macros, string_agg(definition, chr(10) || chr(10) ORDER BY macros.macro) AS source
          FROM macros LEFT JOIN definitions d ON d.program = macros.program AND d.macro = macros.macro GROUP BY 1, 2),
    l AS (SELECT program, idx, string_agg(variable || '=' || value, ',' ORDER BY variable) AS substitutions FROM literals GROUP BY 1, 2)
    SELECT m.program, m.idx, macros, md5(coalesce(source, '')) AS source_digest, substitutions FROM m JOIN l ON l.program = m.program AND l.idx = m.idx
    """,
)
def l6_provenance(spark, sf_dir):
    rows = provenance.provenance(*log_parts(spark, sf_dir))
    pairs = F.transform("substitutions", lambda s: F.concat(s["variable"], F.lit("="), s["value"]))
    return rows.select(
        "program",
        "idx",
        F.array_join("macros", ",").alias("macros"),
        F.md5("original_source").alias("source_digest"),
        F.array_join(pairs, ",").alias("substitutions"),
    )


@query(
    "w8_step_numbers",
    f"WITH {statements_cte(corpus_sql())} SELECT program, CAST(stmt_no AS BIGINT) AS stmt_no, word, idx FROM numbered",
)
def w8_step_numbers(spark, sf_dir):
    rows = steps.step_numbers(steps.statements(corpus(spark, sf_dir)))
    return rows.select("program", F.col("stmt_no").cast("long"), "word", "idx")


@query(
    "l7_steps",
    f"WITH {statements_cte(corpus_sql())} SELECT program, idx, kind, proc, n_statements, md5(text) AS digest FROM steps",
)
def l7_steps(spark, sf_dir):
    return steps.extract_steps(corpus(spark, sf_dir)).select(
        "program",
        "idx",
        "kind",
        "proc",
        F.size("statements").cast("long").alias("n_statements"),
        F.md5("text").alias("digest"),
    )


@query("l8_reads_writes", f"WITH {io_cte()} SELECT program, idx, dataset, is_write FROM io")
def l8_reads_writes(spark, sf_dir):
    return steps.step_io(steps.extract_steps(corpus(spark, sf_dir)))


@query(
    "f15_step_label",
    f"""
    WITH {io_cte()}, target AS (SELECT program, idx, min(CASE WHEN dataset = 'work.rejects' THEN 'zz' ELSE '' END || regexp_replace(dataset, '^[^.]*[.]', '')) AS name FROM io WHERE is_write GROUP BY 1, 2)
    SELECT program, idx, 'step' || lpad(CAST(idx AS STRING), 3, '0') || '_' || CASE kind WHEN 'proc' THEN 'proc_' || proc WHEN 'data' THEN 'data_' || name ELSE 'other' END AS label
    FROM steps LEFT JOIN target USING (program, idx)
    """,
)
def f15_step_label(spark, sf_dir):
    return steps.extract_steps(corpus(spark, sf_dir)).select("program", "idx", "label")


@query(
    "s6_dataset_key",
    f"""
    SELECT p_partkey, key FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(concat('lib.', p_name)) ELSE lower(concat('work.', p_name)) END AS key FROM part)
    """,
)
def s6_dataset_key(spark, sf_dir):
    token = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  'Lib."), F.upper("p_name"), F.lit("' (keep=a.b); "))).otherwise(
        F.concat("p_name", F.lit("(where=(x>0)) ;"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", lexing.dataset_key(token).alias("key"))


def part_graph(spark, sf_dir):
    """Steps are written once; the passes over them read a few of their columns."""
    found = store(steps.extract_steps(corpus(spark, sf_dir)))
    io = steps.step_io(found)
    return found, io, graph.edges(io)


@query("l9_edges", f"WITH {edges_cte()} SELECT program, src, dst, dataset FROM edges")
def l9_edges(spark, sf_dir):
    return part_graph(spark, sf_dir)[2]


VERSIONS = f"""{io_cte()},
    opened AS (SELECT program, dataset, idx, row_number() OVER (PARTITION BY program, dataset ORDER BY idx) AS version,
                      lead(idx) OVER (PARTITION BY program, dataset ORDER BY idx) AS until
               FROM (SELECT DISTINCT program, dataset, idx FROM io WHERE is_write)),
    readers AS (SELECT o.program, o.dataset, o.idx, count(DISTINCT r.idx) AS readers
                FROM opened o JOIN io r ON r.program = o.program AND r.dataset = o.dataset AND NOT r.is_write
                     AND r.idx > o.idx AND (o.until IS NULL OR r.idx <= o.until) GROUP BY 1, 2, 3)
    """


@query(
    "u8_dataset_versions",
    f"""
    WITH {VERSIONS}
    SELECT o.program, o.dataset, version, o.idx, o.dataset || '@' || o.idx AS name, coalesce(readers, 0) AS readers, until IS NULL AS is_last
    FROM opened o LEFT JOIN readers USING (program, dataset, idx)
    """,
)
def u8_dataset_versions(spark, sf_dir):
    return graph.versions(part_graph(spark, sf_dir)[1])


@query(
    "u8_final_versions",
    f"""
    WITH {VERSIONS}
    SELECT o.program, o.dataset, o.dataset || '@' || o.idx AS name FROM opened o
    WHERE until IS NULL AND NOT EXISTS (SELECT 1 FROM readers r WHERE r.program = o.program AND r.dataset = o.dataset AND r.idx = o.idx)
    """,
)
def u8_final_versions(spark, sf_dir):
    return graph.final_versions(part_graph(spark, sf_dir)[1])


@query(
    "j10_version_edges",
    f"""
    WITH {VERSIONS}
    SELECT DISTINCT r.program, r.idx, CASE WHEN w.idx IS NULL THEN r.dataset ELSE r.dataset || '@' || w.idx END AS src, t.dataset || '@' || t.idx AS dst
    FROM io r JOIN io t ON t.program = r.program AND t.idx = r.idx AND t.is_write
    LEFT JOIN opened w ON w.program = r.program AND w.dataset = r.dataset AND w.idx < r.idx AND (w.until IS NULL OR w.until >= r.idx)
    WHERE NOT r.is_write
    """,
)
def j10_version_edges(spark, sf_dir):
    return graph.version_edges(part_graph(spark, sf_dir)[1])


@query(
    "l10_layers",
    f"""
    WITH RECURSIVE {edges_cte()},
    d(program, idx, depth) AS (
        SELECT program, idx, 0 FROM (SELECT DISTINCT program, idx FROM steps) s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.program = s.program AND e.dst = s.idx)
        UNION SELECT e.program, e.dst, d.depth + 1 FROM d JOIN edges e ON e.program = d.program AND e.src = d.idx)
    SELECT program, idx, max(depth) AS depth FROM d GROUP BY 1, 2
    """,
)
def l10_layers(spark, sf_dir):
    found, _, pairs = part_graph(spark, sf_dir)
    return graph.layers(found, pairs)


FILE = "concat('job', CAST(p_partkey % 5 AS STRING))"
FILE_PROJECT = "concat('project', CAST(p_partkey % 7 AS STRING))"
# Five logs and two sources in each project.
PROJECT_FILES = 49


def project_files(spark, sf_dir):
    """A folder for each of seven projects with five logs, and sources beside two of them; each file is of many programs."""
    part = table(spark, sf_dir, "part").select("*", F.expr(FILE_PROJECT).alias("project"), F.expr(FILE).alias("file"))
    parts = part.withColumn("kind", F.explode(F.array(F.lit("log"), F.lit("sas")))).filter("kind = 'log' or file in ('job1', 'job3')")
    made, folder = scratch_path(spark, "made"), scratch_path(spark, "projects")
    # One writer a file; the rows are dealt and sorted before the texts are made of them, so no text is moved.
    rows = parts.repartition(PROJECT_FILES, "project", "file", "kind").sortWithinPartitions("project", "file", "kind", "p_partkey")
    text = F.when(F.col("kind") == "log", F.expr(LOG)).otherwise(F.expr(SOURCE))
    rows.select("project", "file", "kind", text.alias("text")).write.partitionBy("project", "file", "kind").text(made)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A writer names its files itself; these few are given the names that programs have.
    for found in fs.globStatus(at(f"{made}/*/*/*/part-*")):
        project, file, kind = (found.getPath().toString().split("/")[-i].split("=")[1] for i in (4, 3, 2))
        fs.mkdirs(at(f"{folder}/{project}"))
        fs.rename(found.getPath(), at(f"{folder}/{project}/{file}.{kind}"))
    return read_project(spark, folder)


PROJECT = f"""
    joined AS (SELECT {FILE_PROJECT} AS project, {FILE} AS file, string_agg({LOG}, chr(10) ORDER BY p_partkey) || chr(10) AS text FROM part GROUP BY 1, 2),
    all_lines AS (SELECT project, file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM joined),
    codes AS (SELECT project, file, line_no, rtrim(regexp_extract(line, {literal(X.EXPANDED)}, 1)) AS line FROM all_lines WHERE regexp_matches(line, {literal(X.EXPANDED)})),
    flats AS (SELECT project || '/' || file AS program, coalesce((SELECT string_agg(line, chr(10) ORDER BY line_no) || chr(10) FROM codes c WHERE c.project = j.project AND c.file = j.file AND line <> ''), text) AS text FROM joined j)
"""


@query(
    "l11_file_corpus",
    f"""
    WITH {PROJECT},
    {io_cte("SELECT program, text FROM flats")},
    numbers AS (SELECT program, idx, split_part(program, '/', 1) AS project, row_number() OVER (PARTITION BY split_part(program, '/', 1) ORDER BY program, idx) - 1 AS global_idx FROM steps),
    pio AS (SELECT project, global_idx AS idx, dataset, is_write FROM io JOIN numbers USING (program, idx)),
    held AS (SELECT *, max(CASE WHEN is_write THEN idx END) OVER (PARTITION BY project, dataset ORDER BY idx, is_write ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM pio)
    SELECT DISTINCT project, writer AS src, idx AS dst, dataset FROM held WHERE NOT is_write AND writer IS NOT NULL AND writer <> idx
    """,
)
def l11_file_corpus(spark, sf_dir):
    return project_files(spark, sf_dir).edges


@query(
    "l11_project_edges",
    f"""
    WITH {io_cte()},
    numbers AS (SELECT program, idx, CAST(substring(program, 5) AS BIGINT) % 25 AS project,
                row_number() OVER (PARTITION BY CAST(substring(program, 5) AS BIGINT) % 25 ORDER BY program, idx) - 1 AS global_idx FROM steps),
    pio AS (SELECT project, global_idx AS idx, dataset, is_write FROM io JOIN numbers USING (program, idx)),
    held AS (SELECT *, max(CASE WHEN is_write THEN idx END) OVER (PARTITION BY project, dataset ORDER BY idx, is_write ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM pio)
    SELECT DISTINCT project, writer AS src, idx AS dst, dataset FROM held WHERE NOT is_write AND writer IS NOT NULL AND writer <> idx
    """,
)
def l11_project_edges(spark, sf_dir):
    """Programs of 25 projects, numbered through in file order; datasets are shared inside a project."""
    found = store(steps.extract_steps(corpus(spark, sf_dir)))
    tagged = found.withColumn("project", F.substring("program", 5, 20).cast("long") % 25)
    numbered = steps.renumber(tagged.withColumnRenamed("idx", "step_no"), "project", ["program", "step_no"])
    return graph.edges(steps.step_io(numbered, "project"), "project")


@query(
    "l12_graph_export",
    f"""
    WITH RECURSIVE {edges_cte()},
    target AS (SELECT program, idx, min(CASE WHEN dataset = 'work.rejects' THEN 'zz' ELSE '' END || regexp_replace(dataset, '^[^.]*[.]', '')) AS name FROM io WHERE is_write GROUP BY 1, 2),
    sides AS (SELECT program, idx, coalesce(list(dataset ORDER BY dataset) FILTER (NOT is_write), []) AS inputs, coalesce(list(dataset ORDER BY dataset) FILTER (is_write), []) AS outputs FROM io GROUP BY 1, 2),
    nodes AS (SELECT program, idx, 'step' || lpad(CAST(idx AS VARCHAR), 3, '0') || '_' || CASE kind WHEN 'proc' THEN 'proc_' || proc WHEN 'data' THEN 'data_' || name ELSE 'other' END AS label,
                     kind, proc, coalesce(inputs, []) AS inputs, coalesce(outputs, []) AS outputs
              FROM steps LEFT JOIN target USING (program, idx) LEFT JOIN sides USING (program, idx)),
    d(program, idx, depth) AS (
        SELECT program, idx, 0 FROM (SELECT DISTINCT program, idx FROM steps) s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.program = s.program AND e.dst = s.idx)
        UNION SELECT e.program, e.dst, d.depth + 1 FROM d JOIN edges e ON e.program = d.program AND e.src = d.idx)
    SELECT program, 'node' AS part, CAST(to_json({{'idx': idx, 'label': label, 'kind': kind, 'proc': proc, 'inputs': inputs, 'outputs': outputs}}) AS VARCHAR) AS json FROM nodes
    UNION ALL SELECT DISTINCT program, 'edge', '{{"from":' || src || ',"to":' || dst || '}}' FROM edges
    UNION ALL SELECT DISTINCT program, 'external', '{{"dataset":"' || dataset || '"}}' FROM io r
        WHERE NOT is_write AND NOT EXISTS (SELECT 1 FROM io w WHERE w.program = r.program AND w.dataset = r.dataset AND w.is_write AND w.idx < r.idx)
    UNION ALL SELECT DISTINCT program, 'final', '{{"dataset":"' || dataset || '"}}' FROM io w
        WHERE is_write AND NOT EXISTS (SELECT 1 FROM io r WHERE r.program = w.program AND r.dataset = w.dataset AND NOT r.is_write)
    UNION ALL SELECT program, 'layer', '{{"idx":' || idx || ',"depth":' || max(depth) || '}}' FROM d GROUP BY program, idx
    """,
)
def l12_graph_export(spark, sf_dir):
    """The names of a step in order of the alphabet, which the checking engine can state."""
    found, _, pairs = part_graph(spark, sf_dir)
    return graph.graph_json(found.withColumns({c: F.array_sort(c) for c in ("inputs", "outputs")}), pairs)


FILES = f"""
    texts AS (SELECT p_partkey % 20 AS program, p_partkey, {LOG} AS text FROM part),
    pieces AS (SELECT program, p_partkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
    lines AS (SELECT program, line, row_number() OVER (PARTITION BY program ORDER BY p_partkey, i) AS line_no FROM pieces)
"""


def log_files(spark, sf_dir):
    """Lines of twenty log files, each of many sessions, written to the shared folder and read back in splits."""
    part = table(spark, sf_dir, "part").select(F.expr("p_partkey % 20").alias("program"), "p_partkey", F.expr(LOG).alias("text"))
    rows = part.select("program", "p_partkey", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    folder = scratch_path(spark, "logs")
    rows.repartition(20, "program").sortWithinPartitions("program", "p_partkey", "i").select("program", "line").write.partitionBy("program").text(folder)
    name = F.regexp_extract("path", r"program=(\d+)", 1).cast("long")
    return read_lines(spark, folder).withColumn("program", name)


@query("s10_file_lines", f"WITH {FILES} SELECT program, line_no, md5(line) AS digest FROM lines")
def s10_file_lines(spark, sf_dir):
    return log_files(spark, sf_dir).select("program", "line_no", F.md5("line").alias("digest"))


@query(
    "l2_flatten_files",
    f"""
    WITH {FILES}, code AS (SELECT program, line_no, rtrim(regexp_extract(line, {literal(X.EXPANDED)}, 1)) AS line FROM lines WHERE regexp_matches(line, {literal(X.EXPANDED)}))
    SELECT program, line_no, line FROM code WHERE line <> ''
    UNION ALL SELECT program, line_no, line FROM lines WHERE program NOT IN (SELECT program FROM code WHERE line <> '')
    """,
)
def l2_flatten_files(spark, sf_dir):
    return logs.flatten_lines(log_files(spark, sf_dir))


@query(
    "l3_file_facts",
    f"""
    WITH {FILES},
    symbols AS (SELECT program, regexp_extract(line, {literal(X.SYMBOL)}, 1) AS name, arg_max(trim(regexp_extract(line, {literal(X.SYMBOL)}, 2)), line_no) AS detail
                FROM lines WHERE regexp_matches(line, {literal(X.SYMBOL)}) GROUP BY 1, 2)
    SELECT program, 'symbol' AS role, name, detail FROM symbols
    UNION SELECT program, 'loop', regexp_extract(line, {literal(X.LOOP_INDEX)}, 1), NULL FROM lines WHERE regexp_matches(line, {literal(X.LOOP_INDEX)})
    UNION SELECT program, 'parameter', regexp_extract(line, {literal(X.PARAMETER)}, 1), NULL FROM lines WHERE regexp_matches(line, {literal(X.PARAMETER)})
    """,
)
def l3_file_facts(spark, sf_dir):
    facts = logs.harvest_lines(log_files(spark, sf_dir))
    symbols = facts.symbols.select("program", F.lit("symbol").alias("role"), F.col("variable").alias("name"), F.col("value").alias("detail"))
    none = F.lit(None).cast("string")
    return symbols.unionByName(facts.structural.select("program", "role", F.col("variable").alias("name"), none.alias("detail")))


@query(
    "f17_edge_json",
    f"""
    WITH {edges_cte()} SELECT DISTINCT program, '{{"from":' || src || ',"to":' || dst || '}}' AS json FROM edges
    """,
)
def f17_edge_json(spark, sf_dir):
    found, _, pairs = part_graph(spark, sf_dir)
    return graph.graph_json(found, pairs).filter("part = 'edge'").drop("part")


@query(
    "l9_neighbours",
    f"""
    WITH {edges_cte()}, p AS (SELECT DISTINCT program, src, dst FROM edges),
    e AS (SELECT program, src AS idx, 0 AS pred, 1 AS succ FROM p UNION ALL SELECT program, dst, 1, 0 FROM p)
    SELECT program, idx, CAST(sum(pred) AS BIGINT) AS predecessors, CAST(sum(succ) AS BIGINT) AS successors FROM e GROUP BY 1, 2
    """,
)
def l9_neighbours(spark, sf_dir):
    return graph.neighbours(part_graph(spark, sf_dir)[2])


@query("o6_run_order", f"WITH {statements_cte(corpus_sql())} SELECT program, idx FROM steps ORDER BY program, idx")
def o6_run_order(spark, sf_dir):
    return graph.run_order(steps.extract_steps(corpus(spark, sf_dir)).select("program", "idx"))


@query(
    "j13_source_pairs",
    f"""
    SELECT {PROGRAM} || '.log' AS path, length({LOG}) AS n, CASE WHEN p_partkey % 2 = 0 THEN length({SOURCE}) END AS source_n FROM part
    UNION ALL SELECT {PROGRAM} || '.sas', length({SOURCE}), NULL FROM part WHERE p_partkey % 2 = 0
    """,
)
def j13_source_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.select(F.expr(f"concat({PROGRAM}, '.log')").alias("path"), F.expr(LOG).alias("text")).union(
        part.filter("p_partkey % 2 = 0").select(F.expr(f"concat({PROGRAM}, '.sas')"), F.expr(SOURCE))
    )
    rows = pair_sources(found)
    return rows.select("path", F.length("text").cast("long").alias("n"), F.length("source").cast("long").alias("source_n"))


@query(
    "s11_manifest_order",
    """
    SELECT row_number() OVER (ORDER BY o_orderkey) AS file_no, CASE o_orderkey % 4 WHEN 2 THEN 'jobs/file' || o_orderkey || '.sas' ELSE '/abs/file' || o_orderkey || '.sas' END AS path
    FROM orders WHERE o_orderkey % 4 >= 2
    """,
)
def s11_manifest_order(spark, sf_dir):
    name = F.concat(F.lit("file"), F.col("o_orderkey").cast("string"), F.lit(".sas"))
    kind = F.col("o_orderkey") % 4
    line = (
        F.when(kind == 0, F.lit("# a remark"))
        .when(kind == 1, F.lit("  "))
        .when(kind == 2, F.concat(F.lit("  "), name))
        .otherwise(F.concat(F.lit("/abs/"), name, F.lit(" ")))
    )
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return manifest_order(manifest, "jobs")
