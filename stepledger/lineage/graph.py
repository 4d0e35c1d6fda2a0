"""Dependency graphs of many programs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import attach, col
from stepledger.lineage.steps import step_io
from stepledger.operators.ordered import carry_forward, number_rows
from stepledger.settings import store, tables


def resolve_reads(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """Each read with the most recent earlier write of that dataset, ``writer`` null when external.

    A step's reads sort before its own writes, so a rewrite in place reads the
    previous writer.
    """
    held = carry_forward(
        io, [program, "dataset"], [order, "is_write"], {"writer": (F.col("is_write"), col(order))}, False
    )
    return held.filter(~F.col("is_write")).drop("is_write")


def edges(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """program, src, dst, dataset."""
    reads = resolve_reads(io, program, order).filter(F.col("writer").isNotNull() & (F.col("writer") != col(order)))
    found = reads.select(col(program), F.col("writer").alias("src"), col(order).alias("dst"), "dataset")
    # Dealt by the reading step, so that later passes over pairs of steps need no further shuffle.
    return found.repartition(col(program), "dst").distinct()


def external_inputs(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """Datasets read before any write: the first read comes no later than the first write."""
    read, write = (F.min(F.when(F.col("is_write") == w, col(order))) for w in (False, True))
    names = io.groupBy(col(program), "dataset").agg(read.alias("__read"), write.alias("__write"))
    return names.filter("__read is not null and (__write is null or __read <= __write)").select(col(program), "dataset")


def final_outputs(io: DataFrame, program: str = "program") -> DataFrame:
    """Datasets written and never read."""
    names = io.groupBy(col(program), "dataset").agg(F.bool_and("is_write").alias("unread"))
    return names.filter("unread").drop("unread")


def versions(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """Every write opens a version of its dataset: its number among the writes, name ``dataset@step``, readers, and whether
    it is the last one.

    A dataset that a step reads and writes in place, or that is written again, so has a version for each state.
    """
    opened = producers(io, program, order).withColumnRenamed("place", "version")
    bound = resolve_reads(io, program, order).filter("writer is not null")
    readers = bound.groupBy(col(program), "dataset", F.col("writer").alias("__w")).agg(F.count_distinct(col(order)).alias("readers"))
    last = opened.groupBy(col(program), "dataset").agg(F.max("version").alias("__last"))
    joined = opened.join(
        readers.withColumnsRenamed({program: "__p", "dataset": "__d"}),
        col(program).eqNullSafe(F.col("__p")) & (F.col("dataset") == F.col("__d")) & (col(order) == F.col("__w")),
        "left",
    ).drop("__p", "__d", "__w")
    return attach(joined, last, [program, "dataset"]).select(
        col(program),
        "dataset",
        "version",
        col(order),
        version_name(F.col("dataset"), col(order)).alias("name"),
        F.coalesce("readers", F.lit(0)).alias("readers"),
        (F.col("version") == F.col("__last")).alias("is_last"),
    )


def version_name(dataset: Column, writer: Column) -> Column:
    """``dataset@step``, and the dataset alone where no step has written it."""
    return F.when(writer.isNull(), dataset).otherwise(F.concat(dataset, F.lit("@"), writer.cast("string")))


def version_edges(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """The graph of versions: from each version (or external dataset) that a step reads to each one that it writes."""
    reads = resolve_reads(io, program, order).select(
        col(program), col(order), version_name(F.col("dataset"), F.col("writer")).alias("src")
    )
    writes = io.filter("is_write").select(col(program), col(order), version_name(F.col("dataset"), col(order)).alias("dst"))
    return reads.distinct().join(writes.distinct(), [program, order]).select(col(program), col(order), "src", "dst")


def final_versions(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """Versions that leave the program: the last of their dataset, and read by no step."""
    return versions(io, program, order).filter("is_last and readers = 0").select(col(program), "dataset", "name")


def producers(io: DataFrame, program: str = "program", order: str = "idx") -> DataFrame:
    """Every writer of a dataset with its place among the writers, one row each."""
    writes = io.filter("is_write").select(col(program), "dataset", col(order)).distinct()
    return number_rows(writes, [program, "dataset"], [order], "place")


def neighbours(edge_rows: DataFrame, program: str = "program") -> DataFrame:
    """Degree of every step that has an edge."""
    pairs = edge_rows.select(col(program), "src", "dst").distinct()
    ends = pairs.select(
        col(program),
        F.explode(
            F.array(
                F.struct(F.col("src").alias("idx"), F.lit(0).alias("pred"), F.lit(1).alias("succ")),
                F.struct(F.col("dst").alias("idx"), F.lit(1).alias("pred"), F.lit(0).alias("succ")),
            )
        ).alias("e"),
    )
    return ends.groupBy(col(program), F.col("e.idx").alias("idx")).agg(
        F.sum("e.pred").alias("predecessors"), F.sum("e.succ").alias("successors")
    )


# Edges followed per written round: fewer rounds, each still one plan of a few joins.
HOPS = 4
# Most graphs have no longer path than 2 to this power; later rounds are bounded by their number of steps.
CYCLE_CHECK_ROUND = 4


def _hops(pairs: DataFrame, front: DataFrame, program: str, depth: int) -> DataFrame:
    """The steps that the next edges reach from the front, with the last depth at which each is reached.

    A front is steps of many programs, whose names shrink in files: by its size there it would be gathered for a broadcast.
    """
    parts = []
    for hop in range(1, HOPS + 1):
        moving = pairs.join(front.select(col(program), F.col("idx").alias("src")).hint("merge"), [program, "src"], "left_semi")
        front = moving.select(col(program), F.col("dst").alias("idx")).distinct()
        parts.append(front.withColumn("depth", F.lit(depth + hop)))
    reached = reduce(lambda a, b: a.union(b), parts)
    return store(reached.groupBy(col(program), "idx").agg(F.max("depth").alias("depth")))


def _most_steps(pairs: DataFrame, program: str) -> int:
    """Steps with edges in the largest program; a path without a cycle has fewer edges."""
    ends = pairs.select(col(program), F.explode(F.array("src", "dst")).alias("idx")).distinct()
    return ends.groupBy(col(program)).count().agg(F.max("count")).first()[0]


def _walks(pairs: DataFrame, program: str) -> list[DataFrame]:
    """Pairs of steps joined by walks of exactly 1, 2, 4 ... edges, while there are any; a cycle is an error.

    Each table is the one before joined with itself, so a path of n edges takes about log2(n) rounds.
    """
    rounds: list[DataFrame] = []
    walks, most = pairs, None
    while not walks.isEmpty():
        rounds.append(walks)
        if len(rounds) > CYCLE_CHECK_ROUND and most is None:
            most = _most_steps(pairs, program)
        if most is not None and 1 << (len(rounds) - 1) >= most:
            raise ValueError("dependency graph has a cycle")
        onwards = walks.select(col(program), F.col("src").alias("dst"), F.col("dst").alias("end"))
        walks = store(walks.join(onwards, [program, "dst"]).select(col(program), "src", F.col("end").alias("dst")).distinct())
    return rounds


def layers(nodes: DataFrame, edge_rows: DataFrame, program: str = "program") -> DataFrame:
    """Longest-path depth of every step; a cycle is an error.

    A step has a depth of d or more if a walk of d edges ends at it. So the steps whose depth lies from 2**k up to
    2**(k + 1) end walks of 2**k edges and none of twice as many, and their depth is 2**k more than the
    greatest depth at which those walks start, which is below 2**k and known by then. All programs go at once.
    """
    with tables(edge_rows.sparkSession) as block:
        pairs = store(edge_rows.select(col(program), "src", "dst").distinct())
        walks = _walks(pairs, program)
        # Steps that no edge ends at, by one aggregate. A missing name is equal to no other, so its edges join nothing.
        ended = F.when(col(program).isNotNull() & F.col("dst").isNotNull(), 1).otherwise(0)
        every = nodes.select(col(program), "idx", F.lit(0).alias("ended"))
        every = every.union(pairs.select(col(program), "src", F.lit(0))).union(pairs.select(col(program), "dst", ended))
        first = every.groupBy(col(program), "idx").agg(F.max("ended").alias("ended")).filter("ended = 0")
        first = first.select(col(program), "idx", F.lit(0).alias("depth"))
        if not walks:
            return block.keep(first)
        ends = [w.select(col(program), F.col("dst").alias("idx")).distinct() for w in walks]
        known = store(first)
        for k, w in enumerate(walks):
            if k + 1 < len(ends):
                w = w.join(ends[k + 1].withColumnRenamed("idx", "dst"), [program, "dst"], "left_anti")
            starts = known.select(col(program), F.col("idx").alias("src"), "depth")
            found = w.join(starts, [program, "src"]).groupBy(col(program), F.col("dst").alias("idx"))
            known = store(known.union(found.agg((F.max("depth") + (1 << k)).cast("int").alias("depth"))))
        return block.keep(known)


def run_order(steps: DataFrame, program: str = "program") -> DataFrame:
    """Topological order, lowest step first: edges go from lower to higher steps, so it is the step order."""
    return steps.orderBy(col(program), "idx")


def downstream(start: DataFrame, edge_rows: DataFrame, program: str = "program") -> DataFrame:
    """Every step reachable from the ``start`` steps, themselves included."""
    with tables(edge_rows.sparkSession) as block:
        pairs = store(edge_rows.select(col(program), "src", "dst").distinct())
        seen = store(start.select(col(program), "idx").distinct())
        front = seen
        while not front.isEmpty():
            reached = _hops(pairs, front, program, 0)
            # Steps met before the last hop have been followed already.
            front = store(
                reached.filter(F.col("depth") == HOPS).drop("depth").join(seen.hint("merge"), [program, "idx"], "left_anti")
            )
            seen = seen.union(reached.drop("depth"))
        return block.keep(seen.distinct())


def graph_json(steps: DataFrame, edge_rows: DataFrame, program: str = "program") -> DataFrame:
    """The graph as JSON rows (``part``: node, edge, external, final or layer), so that no program is gathered into one value.

    ``external`` and ``final`` name the datasets that a program takes in and leaves, ``layer`` the depth of a step.
    """
    spell = {"ignoreNullFields": "false"}

    def part(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select(col(program), F.lit(name).alias("part"), F.to_json(value, spell).alias("json"))

    io = step_io(steps, program)
    parts = [
        part(steps, "node", F.struct("idx", "label", "kind", "proc", "inputs", "outputs")),
        part(edge_rows.select(col(program), "src", "dst").distinct(), "edge", F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))),
        part(external_inputs(io, program), "external", F.struct("dataset")),
        part(final_outputs(io, program), "final", F.struct("dataset")),
        part(layers(steps, edge_rows, program), "layer", F.struct("idx", "depth")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
