"""The registered queries of the numbered operators over the driver's tables, and SQL where it can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.llm import (
    byte_bpe,
    mixing,
    near_dups,
    periodic,
    ppm,
    quality,
    repeats,
    secret_scan,
    sketch,
    token_rollup,
    toxicity,
    url_rules,
    whitening,
)
from stepledger.llm.common import ORACLE, QUERIES, held, query, table

__all__ = ["ORACLE", "QUERIES"]

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


@query("op1_ppm_score")
def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.report(table(spark, sf_dir, "documents"), held(F.col("doc_id"), 7, 2))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.report(documents, labels, lambda doc_id: held(doc_id, 5, 0))


@query("op3_scaled_sketch")
def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.report(table(spark, sf_dir, "documents"))


@query(
    "op4_source_mix",
    rf"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS k,
             row_number() OVER () AS r
      FROM documents),
    s AS (
      SELECT source, sum(size) AS source_size FROM d GROUP BY ALL),
    ranked AS (
      SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS budget
      FROM s),
    rounds AS (
      SELECT 0 AS n, source, source_size, w, cap, budget, false AS at_cap FROM ranked
      UNION ALL
      SELECT n + 1, source, source_size, w, cap, budget,
             cap <= w * (budget - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ())
                      / sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER ()
      FROM rounds WHERE n < 40),
    targets AS (
      SELECT source, source_size,
             CASE WHEN at_cap THEN cap ELSE least(cap,
               w * (budget - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ())
                 / sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER ()) END AS target
      FROM rounds WHERE n = 40),
    plans AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies,
             target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget
      FROM targets),
    placed AS (
      SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, r ROWS UNBOUNDED PRECEDING) AS upto FROM d)
    SELECT doc_id, size::BIGINT AS size, p.source_size::BIGINT AS source_size, p.target AS target,
           (size * (copies + CASE WHEN budget > 0 AND (upto <= budget
              OR (upto - size <= budget AND 2 * (budget - (upto - size)) >= size)) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM placed JOIN plans p ON placed.source IS NOT DISTINCT FROM p.source
    """,
)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query(
    "op6_token_rollup",
    r"""
    WITH d AS (
      SELECT source, lang, coalesce(lang = 'en', false) AS english,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS v1,
             len(regexp_extract_all(coalesce(text, ''),
               '[!-/:-@\[-`{-~]|[^\x20\x09-\x0D!-/:-@\[-`{-~]+')) AS v2,
             EXISTS (FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 0) AS low
      FROM documents)
    SELECT source, lang, CASE WHEN english THEN 'words-2' ELSE 'words-1' END AS tokenizer,
           count(*)::BIGINT AS documents, sum(CASE WHEN english THEN v2 ELSE v1 END)::BIGINT AS tokens
    FROM d WHERE NOT low GROUP BY ALL
    """,
)
def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op7_url_rules",
    r"""
    WITH u AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    p AS (
      SELECT page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM u),
    r AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM p)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
        WHEN rule IS NOT NULL THEN 'allow'
        WHEN host || path LIKE '%.casino.%' OR host || path LIKE '%.porn.%' OR host || path LIKE '%/torrent/%'
          OR host || path LIKE '%/login/%' OR host || path LIKE '%/cart/%' OR host || path LIKE 'ads.%'
          OR host || path LIKE '%.exe' OR host || path LIKE '%.zip' THEN 'block'
        ELSE 'allow' END AS verdict
    FROM r
    """,
)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(table(spark, sf_dir, "pages"))


@query("op8_near_dups")
def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.report(table(spark, sf_dir, "documents"))


@query(
    "op9_host_quality",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
    tri AS (
      SELECT r, i, word AS a, lead(word) OVER x AS b, lead(word, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
    again AS (
      SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
    covered AS (
      SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) AS g(k) GROUP BY r),
    lines AS (
      SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
    m AS (
      SELECT d.r, doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM d LEFT JOIN covered ON covered.r = d.r LEFT JOIN lines ON lines.r = d.r),
    f AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines,
             word_chars < 3 * n_words OR word_chars > 12 * n_words AS word_length
      FROM m),
    h AS (
      SELECT source, rule, count(*) AS n, sum(failed::INT) AS k
      FROM (UNPIVOT (SELECT source, symbols, dup_lines, word_length FROM f) ON symbols, dup_lines, word_length INTO NAME rule VALUE failed)
      GROUP BY source, rule),
    prior AS (
      SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
    suspects AS (
      SELECT source, rule FROM h JOIN prior USING (rule)
      WHERE 1.05 * m < CASE WHEN v <= 1e-12 THEN m WHEN v >= m * (1 - m) THEN k / n
               ELSE (k + m * (m * (1 - m) / v - 1)) / (n + (m * (1 - m) / v - 1)) END)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND NOT 100 * n_symbols > 20 * n_words AND NOT EXISTS (
             FROM suspects s WHERE s.source IS NOT DISTINCT FROM f.source
             AND ((rule = 'symbols' AND symbols) OR (rule = 'dup_lines' AND dup_lines) OR (rule = 'word_length' AND word_length))) AS kept
    FROM f
    """,
)
def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.report(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query(
    "op11_block_repeats",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
    places AS (
      SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
    windows AS (
      SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM places),
    least AS (
      SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
    repeated AS (
      SELECT r, i FROM windows JOIN least USING (s) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)),
    gone AS (
      SELECT DISTINCT r, i + k AS i FROM repeated, range(13) AS g(k)),
    words AS (
      SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    left_over AS (
      SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
      FROM words WHERE NOT EXISTS (FROM gone WHERE gone.r = words.r AND gone.i = words.i) GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN left_over ON left_over.r = d.r
    """,
)
def op11_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))
