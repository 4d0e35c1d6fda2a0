"""Program text to statements, as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepledger.functions.text import squeeze
from stepledger.lineage import patterns as P


def strip_comments(text: Column) -> Column:
    """Block comments become a blank; quoted text is kept as it is."""
    tokens = F.regexp_extract_all(text, F.lit(P.COMMENT_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("/*"), F.lit(" ")).otherwise(t)), "")


def split_statements(text: Column) -> Column:
    """Statements between semicolons outside quotes; comment statements and blanks are dropped."""
    pieces = F.regexp_extract_all(strip_comments(text), F.lit(P.STATEMENT), F.lit(0))
    return F.filter(F.transform(pieces, squeeze), lambda s: (s != "") & ~s.startswith("*"))


def first_word(statement: Column) -> Column:
    return F.lower(F.regexp_extract(statement, P.FIRST_WORD, 1))


def proc_name(statement: Column) -> Column:
    """The procedure a ``proc`` statement names, else null."""
    name = F.lower(F.regexp_extract(statement, r"^(?i:proc) ([A-Za-z_][A-Za-z0-9_]*)", 1))
    return F.when(name != "", name)


def normalize_statement(statement: Column) -> Column:
    """The form in which a logged and a segmented statement are compared."""
    return F.lower(F.trim(F.regexp_replace(squeeze(statement), ";+$", "")))


def dataset_key(token: Column, library: str = "work") -> Column:
    """``lib.name`` in lower case, options and quotes dropped, default library filled in."""
    return with_library(bare_name(token), library)


def bare_name(token: Column) -> Column:
    """A dataset token in lower case without its options and quotes."""
    bare = F.regexp_replace(squeeze(token), r"^[;\s]+|[;\s]+$", "")
    bare = squeeze(F.regexp_replace(bare, r"\([\s\S]*$", ""))
    return F.lower(F.regexp_replace(bare, r"""^["']+|["']+$""", ""))


def with_library(bare: Column, library: str = "work") -> Column:
    return (
        F.when(bare.startswith("."), F.concat(F.lit(library), bare))
        .when(bare.contains("."), bare)
        .otherwise(F.concat(F.lit(f"{library}."), bare))
    )
