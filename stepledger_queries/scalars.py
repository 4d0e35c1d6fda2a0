"""Scalar functions over whole columns and whole texts."""

from pyspark.sql import functions as F

from stepledger.functions import dates, missing, numbers, text
from stepledger.lineage import lexing, logs
from stepledger.lineage import patterns as P
from stepledger.plans.changes import definition_fingerprint
from stepledger.sources.corpus import spread
from stepledger_queries import expressions as X
from stepledger_queries.base import literal, query, table


@query("f1_case", "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low FROM customer")
def f1_case(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.upcase(F.col("c_name")).alias("up"), text.lowcase(F.col("c_mktsegment")).alias("low")
    )


@query(
    "f2_strip_and_squeeze",
    f"""
    SELECT doc_id, length(s) AS n, md5(s) AS digest
    FROM (SELECT doc_id, trim(regexp_replace(text, {literal(P.SPACE + "+")}, ' ', 'g'), ' ') AS s FROM documents)
    """,
)
def f2_strip_and_squeeze(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", text.squeeze(F.col("text")).alias("s"))
    return df.select("doc_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


@query(
    "f3_words",
    r"""
    WITH w AS (SELECT p_partkey, [x FOR x IN regexp_split_to_array(p_name || ' ' || p_type, '[ #]+') IF x <> ''] AS ws FROM part)
    SELECT p_partkey, len(ws) AS n, coalesce(ws[2], '') AS second, coalesce(ws[-1], '') AS last_word,
           coalesce(ws[9], '') AS ninth
    FROM w
    """,
)
def f3_words(spark, sf_dir):
    both = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.countw(both, " #").cast("long").alias("n"),
        text.scan(both, 2, " #").alias("second"),
        text.scan(both, -1, " #").alias("last_word"),
        text.scan(both, 9, " #").alias("ninth"),
    )


@query(
    "f4_arithmetic",
    """
    SELECT o_orderkey, o_totalprice + x AS plus, o_totalprice - x AS minus, o_totalprice * x AS times,
           CASE WHEN x = 0 THEN NULL ELSE o_totalprice / x END AS over
    FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 4 - 1 AS DOUBLE) END AS x FROM orders)
    """,
)
def f4_arithmetic(spark, sf_dir):
    x = F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 4 - 1).cast("double"))
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (price + x).alias("plus"),
        (price - x).alias("minus"),
        (price * x).alias("times"),
        numbers.divide(price, x).alias("over"),
    )


@query(
    "f5_rounding",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(l_extendedprice AS DECIMAL(18,4)), 1) AS r1 FROM lineitem",
)
def f5_rounding(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.round_to(price, 0.1).cast("decimal(18,1)").alias("r1")
    )


@query(
    "f6_closeness",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false
                ELSE abs(a - b) <= 0.001 + 0.01 * abs(b) END AS near
    FROM (SELECT *, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b FROM lineitem)
    """,
)
def f6_closeness(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    a, b = F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", numbers.close(a, b, 0.001, 0.01).alias("near"))


@query(
    "f7_epoch_dates",
    """
    SELECT o_orderkey, date_diff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS days,
           date_diff('second', TIMESTAMP '1960-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP)) AS seconds,
           CAST(o_orderdate AS DATE) AS back
    FROM orders
    """,
)
def f7_epoch_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    number = dates.date_to_day_number(day)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        number.cast("long").alias("days"),
        dates.timestamp_to_second_number(F.col("o_orderdate").cast("timestamp")).alias("seconds"),
        dates.day_number_to_date(number).alias("back"),
    )


@query(
    "f8_special_missing",
    """
    WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.' WHEN 1 THEN '.' || substring(c_mktsegment, 1, 1)
                     WHEN 2 THEN '._' ELSE CAST(c_acctbal AS STRING) END AS s FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN NULL ELSE CAST(s AS DOUBLE) END AS value,
           CASE WHEN c_custkey % 4 IN (1, 2) THEN substring(s, 2, 1) END AS letter
    FROM t
    """,
)
def f8_special_missing(spark, sf_dir):
    kind = F.col("c_custkey") % 4
    raw = (
        F.when(kind == 0, F.lit("."))
        .when(kind == 1, F.concat(F.lit("."), F.substring("c_mktsegment", 1, 1)))
        .when(kind == 2, F.lit("._"))
        .otherwise(F.col("c_acctbal").cast("string"))
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        missing.clear_missing(raw).try_cast("double").alias("value"),
        missing.missing_letter(raw).alias("letter"),
    )


@query(
    "f11_numeric_literal",
    f"""
    SELECT event_id, regexp_matches(k, {literal(X.NUMBER)}) AS number_k, regexp_matches(event_type, {literal(X.NUMBER)}) AS number_type
    FROM (SELECT event_id, event_type, regexp_extract(props, ': ([^}}]*)', 1) AS k FROM events)
    """,
)
def f11_numeric_literal(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.regexp_extract("props", r": ([^}]*)", 1).rlike(P.NUMBER).alias("number_k"),
        F.col("event_type").rlike(P.NUMBER).alias("number_type"),
    )


COMMENT_SQL = literal(X.COMMENT_TOKEN)
STATEMENT_SQL = literal(X.STATEMENT)


def clean_sql(text_sql: str) -> str:
    return (
        f"array_to_string([CASE WHEN starts_with(t, '/*') THEN ' ' ELSE t END FOR t IN "
        f"regexp_extract_all({text_sql}, {COMMENT_SQL})], '')"
    )


def statements_sql(clean: str) -> str:
    squeezed = f"trim(regexp_replace(t, {literal(P.SPACE + '+')}, ' ', 'g'), ' ')"
    return (
        f"[s FOR s IN [{squeezed} FOR t IN regexp_extract_all({clean}, {STATEMENT_SQL})] "
        f"IF s <> '' AND NOT starts_with(s, '*')]"
    )


@query(
    "f12_strip_comments",
    f"""
    SELECT page_id, length(c) AS n, md5(c) AS digest
    FROM (SELECT page_id, {clean_sql("replace(replace(html, '<p>', '/* '), '</p>', ' */')")} AS c FROM pages)
    """,
)
def f12_strip_comments(spark, sf_dir):
    marked = F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit("/* ")), F.lit("</p>"), F.lit(" */"))
    df = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", lexing.strip_comments(marked).alias("c"))
    return df.select("page_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@query(
    "f13_statements",
    f"""
    WITH c AS (SELECT page_id, {clean_sql("html")} AS c FROM pages),
    s AS (SELECT page_id, {statements_sql("c")} AS s FROM c),
    u AS (SELECT page_id, unnest(s) AS statement, generate_subscripts(s, 1) - 1 AS stmt_no FROM s)
    SELECT page_id, CAST(stmt_no AS BIGINT) AS stmt_no, md5(statement) AS digest FROM u
    """,
)
def f13_statements(spark, sf_dir):
    df = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    rows = df.select("page_id", F.posexplode(lexing.split_statements(F.col("html"))).alias("stmt_no", "statement"))
    return rows.select("page_id", F.col("stmt_no").cast("long"), F.md5("statement").alias("digest"))


@query(
    "f14_first_word",
    """
    SELECT doc_id, lower(regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*)', 1)) AS word FROM documents
    """,
)
def f14_first_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lexing.first_word(F.col("text")).alias("word"))


@query(
    "f16_fingerprint",
    """
    SELECT doc_id, sha256(concat(length(lang), ':', lang, length(source), ':', source, length(text), ':', text)) AS fingerprint
    FROM documents
    """,
)
def f16_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", definition_fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint")
    )


@query(
    "s10_corpus_lines",
    f"""
    WITH l AS (SELECT doc_id, regexp_split_to_array(text, {literal(P.LINE_END)}) AS ls FROM documents),
    u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM l)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(line) AS digest FROM u
    """,
)
def s10_corpus_lines(spark, sf_dir):
    rows = logs.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("line_no").cast("long"), F.md5("line").alias("digest"))
