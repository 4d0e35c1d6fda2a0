"""Which macro emitted a step, and which of its literals came from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.lineage import patterns as P
from stepledger.lineage.lexing import normalize_statement
from stepledger.lineage.logs import LogFacts, derived_symbols, let_variables, macro_definitions

EDGE = r"[\p{L}\p{N}_.]"


def numeric_tokens(text: Column) -> Column:
    """Every stretch of a text at which a number can stand alone, each once.

    A value stands alone when no letter, digit, underscore or point touches it. The
    stretches are runs of such characters that begin with a digit or point, the same
    with a leading sign, and numbers whose exponent has a sign; each is tried only where
    its first character stands.
    """
    forms = [
        rf"(?=[0-9.])(?<!{EDGE}){EDGE}+",
        rf"(?=[+-])(?<!{EDGE})[+-]{EDGE}+",
        rf"(?=[0-9.])(?<!{EDGE})[0-9.]+[eE][+-][0-9]+(?!{EDGE})",
        rf"(?=[+-])(?<!{EDGE})[+-][0-9.]+[eE][+-][0-9]+(?!{EDGE})",
    ]
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f), F.lit(0)) for f in forms]))
    return F.array_distinct(F.filter(found, lambda t: t.rlike(P.NUMBER)))


def macros_of_steps(steps: DataFrame, emitted: DataFrame) -> DataFrame:
    """program, idx, macro: the macros whose emitted statements the step contains."""
    own = (
        steps.select("program", "idx", F.explode("statements").alias("s"))
        .select("program", "idx", normalize_statement(F.col("s")).alias("statement"))
        .filter((F.col("statement") != "") & ~F.col("statement").isin(P.TERMINATORS))
        .distinct()
    )
    return own.join(emitted, ["program", "statement"]).select("program", "idx", "macro").distinct()


def literals_in_steps(steps: DataFrame, derived: DataFrame) -> DataFrame:
    """program, idx, variable, value: the data-derived values a step's text contains.

    Numbers are taken out of each text and matched by equality, never text against every value.
    """
    tokens = steps.select("program", "idx", F.explode(numeric_tokens(F.col("text"))).alias("value"))
    return tokens.join(derived, ["program", "value"]).select("program", "idx", "variable", "value")


def provenance(steps: DataFrame, facts: LogFacts, sources: DataFrame, text: str = "text") -> DataFrame:
    """Steps expanded from a macro that carry data-derived literals.

    Steps of a purely structural macro are left out: their expansion is the program.
    The collected lists are bounded by one step's statements and literals.
    """
    macros = macros_of_steps(steps, facts.emitted)
    literals = literals_in_steps(steps, derived_symbols(facts, let_variables(sources, text)))
    defined = macros.join(macro_definitions(sources, text), ["program", "macro"], "left")
    names = defined.groupBy("program", "idx").agg(
        F.array_sort(F.collect_list(F.struct("macro", "definition"))).alias("m")
    )
    subs = literals.groupBy("program", "idx").agg(
        F.array_sort(F.collect_list(F.struct("variable", "value"))).alias("substitutions")
    )
    bodies = F.filter(F.col("m.definition"), lambda d: d.isNotNull())
    return names.join(subs, ["program", "idx"]).select(
        "program",
        "idx",
        F.col("m.macro").alias("macros"),
        F.array_join(bodies, "\n\n").alias("original_source"),
        "substitutions",
    )
