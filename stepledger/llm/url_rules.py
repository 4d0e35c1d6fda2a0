"""URL filters: pattern rules fetched by their rarest literal token.

A rule is a pattern over host and path. Its index entry is the one of its literal tokens that the
urls at hand contain least often; the tokens of a url fetch the rules entered under them, and only
those rules run their regular expression on it. A rule that has no literal token is tried on every url.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.llm.common import fold, fresh

TOKEN = r"[^\p{L}\p{N}_]+"
ANY = ""  # the index entry of rules without a literal token


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls that fit ``text``.

    A host rule is ``host/path``: it fits the host and its subdomains where the path starts with
    the rule's. A glob rule is matched against host and path together, ``*`` standing for anything.
    A host rule beats a glob rule, a longer rule a shorter one.
    """

    text: str
    verdict: str
    glob: bool = False

    @property
    def pattern(self) -> str:
        if self.glob:
            return "(?s)^" + ".*".join(re.escape(x) for x in self.text.split("*")) + "$"
        host, _, path = self.text.partition("/")
        return r"(?s)^(?:[^/]*\.)?" + re.escape(host) + "/" + re.escape(path)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting url has whole: none that touches a ``*`` or an open end."""
        marked = self.text if self.glob else "." + self.text + "*"
        pieces = re.split(r"([^\w*]+)", marked, flags=re.UNICODE)
        return sorted({p for p in pieces if p and "*" not in p and re.fullmatch(r"\w+", p)})


# Fixed values of the registered query.
HOST_RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
# What the method adds for urls that no host rule fits; any other url is allowed.
GLOB_RULES = (
    Rule("*.casino.*", "block", glob=True),
    Rule("*.porn.*", "block", glob=True),
    Rule("*/torrent/*", "block", glob=True),
    Rule("*/login/*", "block", glob=True),
    Rule("*/cart/*", "block", glob=True),
    Rule("ads.*", "block", glob=True),
    Rule("*.exe", "block", glob=True),
    Rule("*.zip", "block", glob=True),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return fold(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, TOKEN), lambda t: t != ""))


def index_rules(spark: SparkSession, urls: DataFrame, at: str, rules: Sequence[Rule]) -> DataFrame:
    """Each rule under its token that fewest of ``urls`` (host and path in ``at``) contain; ties by the token."""
    listed = [
        (i, r.text, r.verdict, r.pattern, not r.glob, len(r.text), t)
        for i, r in enumerate(rules)
        for t in (r.tokens or [ANY])
    ]
    schema = "rule_no int, rule string, verdict string, pattern string, is_host boolean, size int, token string"
    entries = spark.createDataFrame(listed, schema)
    seen = (
        urls.select(F.explode(_tokens(F.col(at))).alias("token"))
        .join(entries.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("urls"))
    )
    rarest = (
        entries.join(seen, "token", "left")
        .groupBy("rule_no")
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    )
    return entries.join(rarest, ["rule_no", "token"], "left_semi")


def judge(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = DEFAULT
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the host rule that decided, else null) and ``verdict``.

    Null urls and those without ``://`` have an empty host and path and get the default. Repeated rows
    stay. Columns of these names that ``pages`` already has are replaced.

    Tokens of one url are reduced in the task that made them; a token or url that a third of the pages
    share is no group of its own, since the pages are grouped by their row.
    """
    row, at = fresh(pages, "_row"), fresh(pages, "_at")
    pages = pages.drop("host", "path", "rule", "verdict")
    columns = pages.columns
    located = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(
        at, F.concat("host", "path")
    )
    index = index_rules(pages.sparkSession, located, at, rules).withColumnRenamed("rule", "rule_text")
    token = fresh(pages, "_token")
    spread = located.withColumn(row, F.monotonically_increasing_id()).withColumn(
        token, F.explode(F.concat(_tokens(F.col(at)), F.array(F.lit(ANY))))
    )
    rule = fresh(pages, "_rule")
    entry = F.struct("pattern", "is_host", "size", "rule_text", "verdict").alias(rule)
    index = index.select(F.col("token").alias(rule + "_token"), entry)
    hit = F.expr(f"`{rule}` is not null and rlike(`{at}`, `{rule}`.pattern)")
    best = F.when(hit, F.struct(*[F.col(rule)[f].alias(f) for f in ("is_host", "size", "rule_text", "verdict")]))
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in [*columns, "host", "path"]]
    return (
        spread.join(index, F.col(token) == F.col(rule + "_token"), "left")
        .groupBy(F.col(row), *kept)
        .agg(F.max(best).alias(rule))
        .select(
            *kept,
            F.when(F.col(rule)["is_host"], F.col(rule)["rule_text"]).alias("rule"),
            F.coalesce(F.col(rule)["verdict"], F.lit(default)).alias("verdict"),
        )
    )


def report(pages: DataFrame) -> DataFrame:
    """Only the id and the url are read; pages are never moved."""
    judged = judge(pages.select("page_id", "url"), (*HOST_RULES, *GLOB_RULES))
    return judged.select("page_id", F.col("host"), F.col("path"), "rule", "verdict")
