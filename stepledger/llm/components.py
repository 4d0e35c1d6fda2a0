"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.settings import store


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a``, ``b``); the root is the smallest node of the component.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to the
    smallest of them, until all links lead to roots. Each round writes the links anew; nodes with
    very many neighbours are reduced to a minimum in the tasks before anything meets. A graph that has
    not settled after ``rounds`` is an error.
    """
    known = store(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    for _ in range(rounds):
        both = known.select("a", "b").union(known.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        ).distinct()
        # Every link now leads down; a node's smallest neighbour below takes it and the others.
        below = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
        small = (
            large.join(below, F.col("a") == F.col("x"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("l"))
            .select("l.a", "l.b")
            .filter("a <> b")
            .distinct()
        )
        known = store(small)
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = known.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return known.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
