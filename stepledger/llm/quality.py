"""Quality rules with host verdicts: documents are measured, hosts judged from their documents' failures.

Each document is measured by built-in expressions inside its own row. Failures of each style rule are then counted
by host, each host's rate is shrunk towards the rate of all hosts by a beta prior fitted to the
hosts themselves, and the verdict goes back to the documents: a document always has to pass the
base rules and must not be full of symbols, whatever its host; and it has to pass each style rule for which its host
is under suspicion, that is, fails clearly more often than hosts in general. A clean document is kept in any host.

Only counts by host are shuffled; a host with a third of the documents is summed before that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import attach
from stepledger.llm.common import BLANKS, fresh, whole, words
from stepledger.settings import store

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
# Style rules, asked for in hosts under suspicion.
MOST_SYMBOLS = 10  # symbols per hundred words
MOST_DUP_LINES = 30  # percent of the lines with a word
WORD_LENGTH = (3, 12)  # mean code points of a word
GRAVE_SYMBOLS = 20  # symbols per hundred words that are too many in any host
ALIKE = 1e-12  # variance of the hosts' rates up to which they count as equal
SUSPECT = 1.05  # a host's shrunk failure rate over the mean of the prior, from which it is under suspicion


def _repeats(hashed: str) -> Column:
    """Positions of the windows of ``hashed``, sorted (hash, position) pairs, whose hash occurs again."""
    pairs = F.col(hashed)

    def again(pair: Column, at: Column) -> Column:
        same = lambda other: F.coalesce(F.get(pairs, other)["h"] == pair["h"], F.lit(False))
        return same(at - 1) | same(at + 1)

    return F.sort_array(F.transform(F.filter(pairs, again), lambda p: p["i"]))


def _covered(places: Column) -> Column:
    """How many words windows of three at the sorted ``places`` cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("int").alias("at"))
    step = lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(3), p - a["at"])).cast("long").alias("n"), p.alias("at")
    )
    return F.aggregate(places, start, step, lambda a: a["n"])


def measure(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with the struct ``out`` of counts: words, characters, symbols, lines, repeats.

    Null counts as the empty text. Three-word windows are told apart by 64-bit hashes within
    their own text.
    """
    t, w, s = (fresh(docs, n) for n in ("_whole", "_words", "_windows"))
    n = F.size(F.col(w))
    window = lambda x, i: F.struct(
        F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("i")
    )
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # Each step is a projection of its own: an array that a lambda looks into must be there already.
    return (
        docs.withColumn(t, whole(F.col(text)))
        .withColumn(w, words(F.col(t)))
        .withColumn(s, F.sort_array(F.transform(F.slice(F.col(w), F.lit(1), F.greatest(n - 2, F.lit(0))), window)))
        .withColumn(
            out,
            F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.translate(F.col(t), BLANKS, "")).cast("long").alias("word_chars"),
                (F.length(F.col(t)) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _covered(_repeats(s)).alias("n_repeat_words"),
            ),
        )
        .drop(t, w, s)
    )


def base_failed(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def style_rules(q: Column) -> dict[str, Column]:
    """For each style rule whether a document fails it."""
    short, long = WORD_LENGTH
    return {
        "symbols": 100 * q["n_symbols"] > MOST_SYMBOLS * q["n_words"],
        "dup_lines": 100 * q["n_dup_lines"] > MOST_DUP_LINES * q["n_lines"],
        "word_length": (q["word_chars"] < short * q["n_words"]) | (q["word_chars"] > long * q["n_words"]),
    }


def grave(q: Column) -> Column:
    return 100 * q["n_symbols"] > GRAVE_SYMBOLS * q["n_words"]


def host_rates(judged: DataFrame, host: str, rules: Mapping[str, Column]) -> DataFrame:
    """Per host the number of documents and for each rule a struct: ``n_failed``, ``rate`` and ``common``.

    ``rate`` is shrunk by a beta prior with the moments of the hosts' rates, ``common`` is the mean of the prior. Where
    all hosts fail alike, or there is one host, every host has the common rate.
    """
    per = judged.groupBy(F.col(host)).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(failed.cast("long")).alias(name) for name, failed in rules.items()]
    )
    # The prior is one row.
    prior = per.agg(
        *[F.avg(F.col(r) / F.col("n_docs")).alias(f"{r}_m") for r in rules],
        *[F.var_pop(F.col(r) / F.col("n_docs")).alias(f"{r}_v") for r in rules],
    ).withColumn("one", F.lit(1))

    def judged_by(r: str) -> Column:
        n, k, m, v = F.col("n_docs"), F.col(r), F.col(f"{r}_m"), F.col(f"{r}_v")
        strength = m * (1 - m) / v - 1
        rate = F.when(v <= ALIKE, m).when(v >= m * (1 - m), k / n).otherwise((k + m * strength) / (n + strength))
        return F.struct(k.alias("n_failed"), rate.alias("rate"), m.alias("common")).alias(r)

    both = per.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")
    return both.select(F.col(host), "n_docs", *[judged_by(r) for r in rules])


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", out: str = "quality", keep_text: bool = True
) -> DataFrame:
    """``docs`` with the struct ``out``: the counts, ``base_failed``, ``style_failed`` (rules), ``suspect`` (rules) and ``kept``.

    ``suspect`` names the rules for which the host is under suspicion. Null hosts form one host. Empty texts fail for
    want of words. Tables without rows give none.
    The measured rows are written once, since both the hosts and the documents read them.
    """
    q = F.col(out)
    measured = measure(docs, text, out).withColumn(out, q.withField("base_failed", base_failed(q)))
    measured = store(measured if keep_text else measured.drop(text))
    rules = style_rules(q)
    at = fresh(measured, "_suspect")
    above = [F.when(F.col(r)["rate"] > SUSPECT * F.col(r)["common"], F.lit(r)) for r in rules]
    rates = host_rates(measured.select(F.col(host), q), host, rules)
    rates = rates.select(F.col(host), F.array_compact(F.array(*above)).alias(at))
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(r)) for r, fails in rules.items()]))
    kept = ~q["base_failed"] & ~grave(q) & ~F.arrays_overlap(failed, F.col(at))
    return (
        attach(measured, rates, [host])
        .withColumn(out, q.withField("style_failed", failed).withField("suspect", F.col(at)).withField("kept", kept))
        .drop(at)
    )


def report(docs: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "source", "text"), keep_text=False)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])
