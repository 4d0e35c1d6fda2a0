"""Change detection by key ranges: a tree of checksums for each version of a table, compared from the root down.

A leaf covers 2**bits neighbouring keys; each level above joins 2**fan nodes into one. A node holds the number of its
rows and the sum of their hashes, so the tree of a table is one aggregate and the levels above its leaves are sums of sums.
Two trees are compared node by node where their parents differ, and only the key ranges of differing leaves are
read again from either version. Rows without a key are a leaf of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import attach, col
from stepledger.plans.changes import _hashed, _totals
from stepledger.settings import store, task_count

BITS, FAN, LEVELS = 8, 4, 4
INTERVALS = 64  # key ranges of one pushed filter; more are covered by ranges of a level above


def write_by_key(df: DataFrame, key: str, each: int = 128 << 20) -> DataFrame:
    """The table, written in order of ``key``, so that a filter on key ranges skips what lies outside."""
    return store(df.repartitionByRange(task_count(df, each), col(key)).sortWithinPartitions(col(key)))


def tree(df: DataFrame, key: str, bits: int = BITS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``level, node, row_count, checksum`` of every node that has rows; ``key`` is a whole number. Level 0 has the leaves."""
    rows, _ = _hashed(df)
    leaf = F.shiftright(col(key.lower()).cast("bigint"), bits)
    leaves = store(rows.groupBy(leaf.alias("node")).agg(*_totals()))
    total = F.sum("checksum").cast("decimal(38,0)")
    parts = [leaves.select(F.lit(0).alias("level"), "node", "row_count", "checksum")]
    for level in range(1, levels + 1):
        above = leaves.groupBy(F.shiftright("node", fan * level).alias("node")).agg(F.sum("row_count").alias("row_count"), total.alias("checksum"))
        parts.append(above.select(F.lit(level).alias("level"), "node", "row_count", "checksum"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _apart(now: DataFrame, before: DataFrame) -> DataFrame:
    """Nodes that differ between two sets of nodes, or that one of them lacks."""
    both = now.withColumn("s", F.lit(1)).unionByName(before.withColumn("s", F.lit(-1)))
    same = (F.sum("s") == 0) & (F.min("row_count") == F.max("row_count")) & (F.min("checksum") == F.max("checksum"))
    return both.groupBy("node").agg(same.alias("same")).filter("not same").select("node")


def differing(now: DataFrame, before: DataFrame, fan: int = FAN) -> DataFrame:
    """``level, node`` of the nodes that differ, level by level below differing nodes only."""
    top = now.agg(F.max("level")).first()[0]
    if top is None:
        top = before.agg(F.max("level")).first()[0]
    if top is None:
        return now.select("level", "node")
    found, parents = [], None
    for level in range(top, -1, -1):
        sides = []
        for side in (now, before):
            nodes = side.filter(F.col("level") == level).select("node", "row_count", "checksum")
            if parents is not None:
                nodes = attach(nodes.withColumn("up", F.shiftright("node", fan)), parents, ["up"], "left_semi").drop("up")
            sides.append(nodes)
        apart = store(_apart(*sides))
        found.append(apart.select(F.lit(level).alias("level"), "node"))
        parents = apart.withColumnRenamed("node", "up")
    return reduce(lambda a, b: a.unionByName(b), found)


def _intervals(nodes: DataFrame, key: str, bits: int, fan: int) -> Column:
    """A filter on the key that holds all differing leaves: exact up to ``INTERVALS`` of them, wider ones beyond."""
    counts = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    level = min((lv for lv, n in counts.items() if n <= INTERVALS), default=None)
    if level is None:
        return F.lit(True)
    shift = bits + fan * level
    # At most INTERVALS rows.
    picked = sorted((r["node"] for r in nodes.filter(F.col("level") == level).collect()), key=lambda n: (n is not None, n or 0))
    ranges: list[list[int]] = []
    for n in picked:
        if n is None:
            continue
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    conditions = [col(key).between(a << shift, (b + 1 << shift) - 1) for a, b in ranges]
    conditions += [col(key).isNull()] if None in picked else []
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def changed_keys(
    now: DataFrame, before: DataFrame, key: str, nodes: DataFrame, bits: int = BITS, fan: int = FAN
) -> DataFrame:
    """``key, change`` (added, removed, changed) of every key whose rows differ, from the ranges in ``nodes`` alone.

    ``nodes`` comes from ``differing``. A key with several rows differs if their multiset does.
    """
    wanted = _intervals(nodes, key, bits, fan)
    leaves = nodes.filter("level = 0").select(F.col("node").alias("__node"))

    def side(df: DataFrame, name: str) -> DataFrame:
        rows, _ = _hashed(df.filter(wanted))
        rows = rows.withColumn("__node", F.shiftright(col(key.lower()).cast("bigint"), bits))
        return attach(rows, leaves, ["__node"], "left_semi").groupBy(col(key.lower()).alias("key")).agg(*_totals()).withColumn("side", F.lit(name))

    at = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    both = side(now, "now").unionByName(side(before, "before")).groupBy("key").agg(
        *[at(s, c).alias(f"{s}_{c}") for s in ("now", "before") for c in ("row_count", "checksum")]
    )
    change = (
        F.when(F.col("before_row_count").isNull(), "added")
        .when(F.col("now_row_count").isNull(), "removed")
        .when((F.col("now_row_count") != F.col("before_row_count")) | (F.col("now_checksum") != F.col("before_checksum")), "changed")
    )
    return both.select("key", change.alias("change")).filter("change is not null")
