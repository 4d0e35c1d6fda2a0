"""BY groups of any size: ranges of the ordered rows instead of whole groups.

A window puts a whole BY group into one task. So the rows are range-partitioned on (BY, order) and
written once with the number of their piece; windows then work inside (piece, BY), and what a group carries
from one piece to the next is one small row for each piece. There is one plan for every size: no group is
searched for, and none is left out. Rows that are equal in every column cannot be told apart and share a piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.columns import all_of, attach, col, key_of
from stepledger.settings import piece_count, store

PIECE = "__piece"


def in_pieces(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows, written in ranges of (BY, order), each with the number of its range; see ``piece_count``."""
    keys = [key_of(df, c).asc_nulls_first() for c in by] + list(order)
    ranged = df.repartitionByRange(piece_count(df), *keys) if keys else df.coalesce(1)
    return store(ranged.withColumn(PIECE, F.spark_partition_id()))


def window(df: DataFrame, by: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(F.col(PIECE), *[key_of(df, c) for c in by]).orderBy(*order)


def across_pieces(df: DataFrame, by: Sequence[str]):
    """Window over the per-piece rows of a group: as many rows as it has pieces."""
    return Window.partitionBy(*[key_of(df, c) for c in by]).orderBy(PIECE)


def per_piece(parts: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return parts.groupBy(PIECE, *[key_of(parts, c).alias(c) for c in by]).agg(*aggs)


def at_borders(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of the first and the last group of each piece: ranges are contiguous, so no other group is in two pieces."""
    if not by:
        return parts
    names = [f"__border{i}" for i in range(len(by))]
    group = F.struct(*[key_of(parts, c).alias(n) for c, n in zip(by, names)])
    ends = parts.groupBy(F.col(PIECE).alias("__of")).agg(F.array_distinct(F.array(F.min(group), F.max(group))).alias("ends"))
    borders = ends.select("__of", F.inline("ends"))
    same = [key_of(parts, c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]
    return parts.join(F.broadcast(borders), all_of([F.col(PIECE) == F.col("__of"), *same]), "left_semi")


def stitch(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring the carried values to the rows.

    Ranges are contiguous, so a piece continues at most one group from an earlier
    piece and one into a later piece: ``carried`` holds at most two rows per piece.
    """
    return attach(rows, F.broadcast(carried), [PIECE, *by])
