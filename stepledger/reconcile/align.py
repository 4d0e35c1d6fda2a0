"""Comparison without keys: rows that differ are paired so that few cells differ.

What is left after equal and alike rows have cancelled is aligned level by level. At level n each row is entered under a
hash of every choice of all but n columns, so two rows that differ in n cells share an entry. Inside an entry the two
sides are paired by position, which proposes at most one partner for a row and entry; a proposal that is the best one of
both its rows is taken, and the others are proposed anew from the rows that are left. Rows that agree in all columns but
the floating ones come last, in order of their floats. No entry is gathered and no two rows are paired on trial.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col
from stepledger.functions.numbers import close, round_to
from stepledger.operators.ordered import number_rows
from stepledger.reconcile.families import plain_text
from stepledger.reconcile.values import _pair, surplus
from stepledger.settings import ATOL, RTOL, store

APART = 2


@dataclass
class AlignedDiff:
    """``rows``: ``pair, copies, issue, differs, actual, golden`` with whole rows as structs; ``cells``: the differing cells of pairs."""

    rows: DataFrame
    cells: DataFrame
    same_columns: bool


def aligned_diff(
    actual: DataFrame, golden: DataFrame, apart: int = APART, atol: float = ATOL, rtol: float = RTOL
) -> AlignedDiff:
    """Differing rows of two tables without a key, paired by fewest differing cells.

    Pairs differ in at most ``apart`` cells, and in no more than half of them, or in floating columns only; further rows
    are ``only in`` their side. Copies count. Where a row has several equally near partners, a hash of both decides,
    so reruns agree. Each level enters a row once for every choice of columns, and takes a few rounds.
    """
    residual, kinds, floats, same = surplus(actual, golden, atol, rtol)
    columns = [c for c in residual.columns if c != "copies"]
    whole_row = F.struct(*[col(c) for c in columns])
    rows = residual.select(
        F.md5(F.to_json(F.struct(F.signum("copies"), whole_row), {"ignoreNullFields": "false"})).alias("id"),
        (F.col("copies") > 0).alias("mine"),
        F.abs("copies").alias("copies"),
        whole_row.alias("row"),
    )
    pool = store(rows.select("id", "mine", "copies", *_entries(columns, kinds, floats, atol, apart)))
    pairs: list[DataFrame] = []
    for level in range(1, min(apart, len(columns) // 2) + 1):
        taken, pool = _matched(pool, level)
        pairs += taken
    exact_columns = [c for c in columns if c not in floats]
    left = pool.select("id", "mine", "copies").join(rows.select(F.col("id").alias("r"), "row"), F.col("id") == F.col("r")).drop("r")
    met = _by_position(left, columns, exact_columns, floats, atol)
    side = lambda name, mine: rows.filter(F.col("mine") == mine).select(F.col("id").alias(f"{name}_id"), F.col("row").alias(name))
    for taken in pairs:
        whole = taken.join(side("actual", True), "actual_id").join(side("golden", False), "golden_id")
        met = met.unionByName(whole.select("copies", "actual", "golden"))

    def agrees(c: str) -> Column:
        a, g = F.col("actual")[c], F.col("golden")[c]
        return close(a, g, atol, rtol) if c in floats else a.eqNullSafe(g)

    paired = F.col("actual").isNotNull() & F.col("golden").isNotNull()
    issue = F.when(paired, "changed").when(F.col("golden").isNull(), "only in actual").otherwise("only in golden")
    differs = F.array_compact(F.array(*[F.when(~agrees(c), F.lit(c)) for c in columns]))
    both = F.to_json(F.struct("actual", "golden"), {"ignoreNullFields": "false"})
    met = store(
        met.select(
            F.md5(both).alias("pair"),
            "copies",
            issue.alias("issue"),
            F.when(paired, differs).otherwise(F.array().cast("array<string>")).alias("differs"),
            "actual",
            "golden",
        )
    )
    cell = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                plain_text(F.col("actual")[c], kinds[c]).alias("actual"),
                plain_text(F.col("golden")[c], kinds[c]).alias("golden"),
            )
            for c in columns
        ]
    )
    changed = met.filter("issue = 'changed'")
    shown = F.filter(cell, lambda x: F.array_contains("differs", x["column_name"]))
    cells = changed.select("pair", "copies", F.explode(shown).alias("c")).select("pair", "c.column_name", "c.actual", "c.golden", "copies")
    return AlignedDiff(met, cells, same)


def _entries(columns: Sequence[str], kinds: dict, floats: Sequence[str], atol: float, apart: int) -> list[Column]:
    """For each level the hashes of all choices of all but so many columns; floating values at the tolerance."""
    cell = lambda c: F.col("row")[c]
    coarse = {c: round_to(cell(c), atol) if c in floats else plain_text(cell(c), kinds[c]) for c in columns}
    made = []
    for level in range(1, apart + 1):
        choices = [[c for c in columns if c not in out] for out in combinations(columns, level)] if level < len(columns) else []
        hashes = [
            F.xxhash64(F.lit(f"{level}:{i}"), *[F.struct(coarse[c].isNull(), coarse[c]) for c in choice]) for i, choice in enumerate(choices)
        ]
        made.append((F.array(*hashes) if hashes else F.array().cast("array<bigint>")).alias(f"level{level}"))
    return made


def _matched(pool: DataFrame, level: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of pairs (``actual_id, golden_id, copies``) at this level, and what is left of the pool."""
    found = []
    while True:
        entered = pool.select("id", "mine", F.explode(F.array_distinct(f"level{level}")).alias("entry"))
        met = entered.groupBy("entry").agg(F.bool_or("mine").alias("a"), F.bool_or(~F.col("mine")).alias("g"))
        shared = store(entered.join(met.filter("a and g").select("entry"), "entry"))
        if shared.isEmpty():
            return found, pool
        placed = number_rows(shared, ["entry", "mine"], ["id"], "place")
        a = placed.filter("mine").select("entry", "place", F.col("id").alias("actual_id"))
        g = placed.filter(~F.col("mine")).select("entry", "place", F.col("id").alias("golden_id"))
        proposed = a.join(g, ["entry", "place"]).select("actual_id", "golden_id").distinct()
        proposed = store(proposed.withColumn("order", F.struct(F.xxhash64("actual_id", "golden_id").alias("h"), "actual_id", "golden_id")))
        best = [proposed.groupBy(s).agg(F.min("order").alias("order")).select("order") for s in ("actual_id", "golden_id")]
        # The best one of both its rows; there is one at least, the best of all.
        chosen = best[0].join(best[1], "order").select("order.actual_id", "order.golden_id")
        count = lambda s, mine: pool.filter(F.col("mine") == mine).select(F.col("id").alias(f"{s}_id"), F.col("copies").alias(s))
        taken = store(
            chosen.join(count("actual", True), "actual_id")
            .join(count("golden", False), "golden_id")
            .select("actual_id", "golden_id", F.least("actual", "golden").alias("copies"))
        )
        found.append(taken)
        used = taken.select(F.explode(F.array("actual_id", "golden_id")).alias("u"), F.col("copies").alias("less"))
        rest = pool.join(used, F.col("id") == F.col("u"), "left").withColumn("copies", F.col("copies") - F.coalesce("less", F.lit(0)))
        pool = store(rest.filter("copies > 0").drop("u", "less"))


def _by_position(left: DataFrame, columns: list[str], group: list[str], floats: list[str], atol: float) -> DataFrame:
    """Rows that agree in all but floating columns, paired in order of the floats; the others alone."""
    signed = left.select(*[F.col("row")[c].alias(c) for c in columns], F.when(F.col("mine"), F.col("copies")).otherwise(-F.col("copies")).alias("copies"))
    if not floats:
        mine = F.col("copies") > 0
        row = F.struct(*[col(c) for c in columns])
        return signed.select(F.abs("copies").alias("copies"), F.when(mine, row).alias("actual"), F.when(~mine, row).alias("golden"))
    coarse = {f"__c{i}": round_to(col(c), atol) for i, c in enumerate(floats)}
    met = _pair(signed.withColumns(coarse), group, floats, [*coarse, *floats])
    row = lambda s: F.when(F.col(s).isNotNull(), F.struct(*[(F.col(s)[c] if c in floats else col(c)).alias(c) for c in columns]))
    return met.select("copies", row("actual").alias("actual"), row("golden").alias("golden"))
