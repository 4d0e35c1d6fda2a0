"""Mixing sources to target weights by hash-threshold histograms.

A source's target is whole copies of its documents plus a remainder. The remainder is the documents
whose hash lies below a threshold, and the threshold is found without sorting: sizes are summed by
source and hash bucket, the bucket in which the budget runs out is cut into finer buckets, and so on
until it holds one document. Documents below the threshold are then filtered. A larger budget takes
all that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.columns import attach
from stepledger.llm.common import fresh, whole, words
from stepledger.operators import ordered
from stepledger.settings import store

# Fixed values of the registered query.
WEIGHTS = (3, 1, 2)  # repeating, by source
SHARE = 1.5  # of all sizes
MOST = 2.0  # times a source's size

BITS = 12  # of the hash at each refinement
KEY_BITS = 60
LEVELS = KEY_BITS // BITS


def word_count(text: Column) -> Column:
    return F.size(words(whole(text))).cast("long")


def hash_key(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts, as a number."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` of each source, from ``source, source_size``.

    Sources by code point, null last, take ``weights`` in turn. What a source cannot take is shared
    again by weight, in rounds over the table of sources, until no source is above its limit.
    """
    ranked = ordered.with_row_index(
        sizes.withColumn("_absent", F.col(source).isNull()), ["_absent", source], "_rank"
    )
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    ranked = store(
        ranked.select(
            F.col(source),
            "source_size",
            weight.alias("weight"),
            (F.lit(float(most)) * F.col("source_size")).alias("limit"),
        )
    )
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("limit") <= level * F.col("weight")
        # One row of sums for each round; sizes are whole numbers, so their order does not matter.
        total, taken, open_weight, now = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(full.cast("long")),
        ).first()
        if not total or not open_weight or now == capped:
            break
        capped, level = now, (share * float(total) - taken) / open_weight
    target = F.lit(0.0) if level is None else F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return ranked.select(F.col(source), "source_size", target.alias("target"))


def thresholds(rows: DataFrame, source: str, size: str, keys: tuple[str, str], budgets: DataFrame) -> DataFrame:
    """``source, bar, tie_bar``: rows with a key below ``bar``, or equal to it and a tie key below ``tie_bar``,
    hold the ``budget`` of their source as nearly as whole rows can.

    Every level reads the rows of the boundary buckets alone and writes one row for each source.
    The second key tells rows apart whose first key is the same.
    """
    key, tie = keys
    state = store(
        budgets.filter(F.col("budget") > 0).select(
            F.col(source).alias("_source"),
            F.col("budget").alias("_left"),
            F.lit(0).cast("long").alias("_bar"),
            F.lit(0).cast("long").alias("_tie_bar"),
            F.lit(True).alias("_open"),
        )
    )
    for level in range(2 * LEVELS):
        column = key if level < LEVELS else tie
        shift = KEY_BITS - BITS * (level % LEVELS + 1)
        above = shift + BITS
        inside = F.col(source).eqNullSafe(F.col("_source"))
        if level >= LEVELS:
            inside &= F.col(key) == F.col("_bar")
        if level % LEVELS:
            start = F.col("_bar") if level < LEVELS else F.col("_tie_bar")
            inside &= F.shiftright(F.col(column), above) == F.shiftright(start, above)
        still = state.filter("_open")
        buckets = (
            rows.join(still, inside)
            .groupBy("_source", F.shiftright(F.col(column), shift).alias("_bucket"))
            .agg(F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        )
        # At most 2 ** BITS buckets of a source.
        upto = F.sum("_sum").over(
            Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        )
        edge = attach(
            buckets.withColumn("_upto", upto),
            still.select("_source", "_left", "_bar", "_tie_bar"),
            ["_source"],
            "inner",
        ).filter("_upto - _sum <= _left and _left < _upto")
        left = F.col("_left") - (F.col("_upto") - F.col("_sum"))
        last = level == 2 * LEVELS - 1
        done = (F.col("_n") == 1) | F.lit(last)
        # A bucket of one row is taken whole if at least half of it fits.
        bucket = F.col("_bucket") + F.when(done & (2 * left >= F.col("_sum")), 1).otherwise(0)
        at = F.shiftleft(bucket, shift)
        moved = edge.select(
            "_source",
            left.alias("_left"),
            (at if level < LEVELS else F.col("_bar")).alias("_bar"),
            (F.lit(0).cast("long") if level < LEVELS else at).alias("_tie_bar"),
            (~done).alias("_open"),
        )
        state = store(state.filter("not _open").unionByName(moved))
        if not state.filter("_open").take(1):
            break
    return state.select(F.col("_source").alias(source), F.col("_bar").alias("bar"), F.col("_tie_bar").alias("tie_bar"))


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    out: str = "mix",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the struct ``out``: ``size`` in words, ``source_size``, ``target``, ``copies``, ``taken``.

    Null sources form one source, null texts have no words. Equal rows are told apart by their place,
    so that a source of nothing but copies meets its target too; which of them is taken makes no
    difference. A table without rows gives none.
    """
    size, key, tie, plan = (fresh(docs, n) for n in ("_size", "_key", "_tie", "_plan"))
    rows = docs.withColumns(
        {
            size: word_count(F.col(text)),
            key: hash_key(F.col(doc_id), F.col(text)),
            tie: F.monotonically_increasing_id(),
        }
    ).withColumn(tie, hash_key(F.col(tie)))
    rows = store(rows if keep_text else rows.drop(text))
    sizes = rows.groupBy(F.col(source)).agg(F.sum(size).alias("source_size"))
    sizes = targets(sizes, source, weights, share, most)
    whole_copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - F.col("whole_copies") * F.col("source_size")
    sizes = sizes.withColumn("whole_copies", whole_copies).withColumn("budget", budget)
    bars = thresholds(rows.select(F.col(source), size, key, tie), source, size, (key, tie), sizes)
    plans = attach(sizes, bars, [source]).select(
        F.col(source), F.struct("source_size", "target", "whole_copies", "bar", "tie_bar").alias(plan)
    )
    below = (F.col(key) < F.col(plan)["bar"]) | (
        (F.col(key) == F.col(plan)["bar"]) & (F.col(tie) < F.col(plan)["tie_bar"])
    )
    copies = F.col(plan)["whole_copies"] + F.when(below, 1).otherwise(0)
    return (
        attach(rows, plans, [source])
        .withColumn(
            out,
            F.struct(
                F.col(size).alias("size"),
                F.col(plan)["source_size"].alias("source_size"),
                F.col(plan)["target"].alias("target"),
                copies.cast("int").alias("copies"),
                (F.col(size) * copies).cast("long").alias("taken"),
            ),
        )
        .drop(size, key, tie, plan)
    )


def report(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", *[F.col("mix")[f].alias(f) for f in ("size", "source_size", "target", "taken")])
