"""Run logs: detection, flattening to program text, and the facts about macro variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col
from stepledger.lineage import patterns as P
from stepledger.lineage.lexing import normalize_statement
from stepledger.settings import store


def lines(text: Column) -> Column:
    return F.split(text, P.LINE_BREAK)


def numbered_lines(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1 in each program."""
    kept = [c for c in corpus.columns if c != text]
    rows = corpus.select(*kept, F.posexplode(lines(F.col(text))).alias("__pos", "line"))
    return rows.select(*kept, (F.col("__pos") + 1).alias("line_no"), "line")


def is_log_line(line: Column) -> Column:
    return line.rlike(P.EXPANDED) | line.rlike(P.LOG_NOISE)


def looks_like_log(text: Column) -> Column:
    return F.exists(lines(text), is_log_line)


def flatten(text: Column) -> Column:
    """The concrete program: expanded code of a log in line order; plain source, or a log without code, as it is."""
    # Named once, so that the lines are gone through once.
    return F.coalesce(_code(text), text)


def _code(text: Column) -> Column:
    """The expanded code of a log, a line feed after each line; missing where there is none."""
    code = F.filter(F.transform(lines(text), expanded_code), lambda x: x != "")
    return F.nullif(F.array_join(F.transform(code, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit(""))


def expanded_code(line: Column) -> Column:
    """What an expanded line says, without white space at its end; empty for any other line."""
    return F.regexp_replace(F.regexp_extract(line, P.EXPANDED, 1), P.BLANK + "+$", "")


def flatten_lines(rows: DataFrame, program: str = "program") -> DataFrame:
    """``flatten`` for programs given as lines (``program, line_no, line``), however many: the lines of the concrete program.

    Joined in order of ``line_no`` they are its text. Only the names of programs with expanded code meet.
    """
    code = rows.withColumn("__code", expanded_code(F.col("line"))).filter("__code <> ''")
    expanded = code.select(col(program).alias("__p")).distinct()
    plain = rows.join(expanded, col(program).eqNullSafe(F.col("__p")), "left_anti")
    return code.select(col(program), "line_no", F.col("__code").alias("line")).unionByName(plain.select(col(program), "line_no", "line"))


def flatten_pieces(pieces: DataFrame, program: str = "program") -> DataFrame:
    """``flatten`` for programs given in pieces of whole lines (``program, piece, text``), however many: the pieces of the concrete
    program, written once. A piece without code says nothing in a program that has code elsewhere.
    """
    coded = pieces.select(col(program), "piece", "text", _code(F.col("text")).alias("__code"))
    flat = store(coded.select(col(program), "piece", F.coalesce("__code", "text").alias("text"), F.col("__code").isNotNull().alias("__is_code")))
    expanded = store(flat.filter("__is_code").select(col(program).alias("__p")).distinct())
    known = flat.join(expanded, col(program).eqNullSafe(F.col("__p")), "left")
    return known.filter("__is_code or __p is null").select(col(program), "piece", "text")


@dataclass
class LogFacts:
    """Tables harvested from run logs, keyed by ``program``."""

    symbols: DataFrame  # program, variable, value: the last value of each variable
    structural: DataFrame  # program, variable, role: loop indices and parameters
    emitted: DataFrame  # program, macro, statement: normalised expanded statements


def fact_rows(logs: DataFrame, text: str = "text") -> DataFrame:
    """Every fact of every log line: see ``line_facts``."""
    return line_facts(numbered_lines(logs.select("program", text), text))


def line_facts(rows: DataFrame) -> DataFrame:
    """The facts of log lines (``program, line_no, line``): program, line_no, role, name, detail.

    A line is a symbol line, an expanded line or a logic line, in that order of
    trial; an expanded line gives one fact per statement, a logic line up to two.
    """
    line = F.col("line")

    def fact(role: str, name: Column, details: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.upper(name).alias("name"), details.alias("details"))

    none = F.array(F.lit(None).cast("string"))
    symbol = F.array(
        fact("symbol", F.regexp_extract(line, P.SYMBOL, 1), F.array(squeeze_ends(F.regexp_extract(line, P.SYMBOL, 2))))
    )
    pieces = F.split(F.regexp_extract(line, P.EXPANDED_NAMED, 2), ";")
    # The macro is taken out of the line once, not for each of its statements.
    expanded = F.array(fact("emitted", F.regexp_extract(line, P.EXPANDED_NAMED, 1), F.transform(pieces, normalize_statement)))
    logic = F.array(
        fact("loop", F.regexp_extract(line, P.LOOP_INDEX, 1), none),
        fact("parameter", F.regexp_extract(line, P.PARAMETER, 1), none),
    )
    facts = (
        F.when(line.rlike(P.SYMBOL), symbol)
        .when(line.rlike(P.EXPANDED_NAMED), expanded)
        .when(F.upper(line).contains(P.LOGIC), logic)
    )
    rows = rows.select("program", "line_no", F.explode(facts).alias("f"))
    rows = rows.select("program", "line_no", "f.role", "f.name", F.explode("f.details").alias("detail"))
    emitted = F.col("role") == "emitted"
    empty = (emitted & ((F.col("detail") == "") | F.col("detail").isin(P.TERMINATORS))) | (~emitted & (F.col("name") == ""))
    return rows.filter(~empty)


def harvest(logs: DataFrame, text: str = "text") -> LogFacts:
    """Facts of every log, each a text in one row."""
    return _harvested(fact_rows(logs, text))


def harvest_lines(rows: DataFrame) -> LogFacts:
    """Facts of logs given as lines (``program, line_no, line``), however many."""
    return _harvested(line_facts(rows))


def _harvested(rows: DataFrame) -> LogFacts:
    """One aggregate finds each fact once with its last line, reduced map-side; it is written for the readers of the
    three tables. It keeps a number for each fact, which is hashed, where a kept value would have all facts sorted."""
    found = store(rows.groupBy("program", "role", "name", F.col("detail").alias("statement")).agg(F.max("line_no").alias("line_no")))
    last = F.max(F.struct("line_no", F.col("statement").alias("value")))
    values = found.filter("role = 'symbol'").groupBy("program", F.col("name").alias("variable")).agg(last.alias("last"))
    symbols = values.select("program", "variable", F.col("last.value").alias("value"))
    structural = found.filter("role in ('loop', 'parameter')").select(
        "program", F.col("name").alias("variable"), "role"
    )
    emitted = found.filter("role = 'emitted'").select("program", F.col("name").alias("macro"), "statement")
    return LogFacts(symbols, structural, emitted)


def squeeze_ends(text: Column) -> Column:
    """White space removed at both ends only."""
    return F.regexp_replace(text, f"^{P.BLANK}+|{P.BLANK}+$", "")


def let_variables(sources: DataFrame, text: str = "text") -> DataFrame:
    """Variables assigned by ``%let`` in the parametric source."""
    names = F.regexp_extract_all(F.col(text), F.lit(P.LET), F.lit(1))
    return sources.select("program", F.explode(F.transform(names, F.upper)).alias("variable")).distinct()


def macro_definitions(sources: DataFrame, text: str = "text") -> DataFrame:
    """The last definition text of each macro."""
    found = sources.select(
        "program", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(P.DEFINITION), F.lit(0))).alias("place", "body")
    )
    named = found.select(
        "program",
        F.upper(F.regexp_extract("body", P.DEFINITION_NAME, 1)).alias("macro"),
        F.struct("place", squeeze_ends(F.col("body")).alias("body")).alias("at"),
    )
    return named.groupBy("program", "macro").agg(F.max("at")["body"].alias("definition"))


def derived_symbols(facts: LogFacts, lets: DataFrame) -> DataFrame:
    """Numeric variables that are neither loop index, parameter nor ``%let``: their values came from data."""
    structural = facts.structural.select("program", "variable").union(lets.select("program", "variable"))
    return facts.symbols.filter(F.col("value").rlike(P.NUMBER)).join(structural, ["program", "variable"], "left_anti")
