"""Joins: SQL joins, match-merge, update, modify, keyed lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.columns import all_of, any_of, attach, col, ordering
from stepledger.operators.ordered import number_rows


def sql_join(left: DataFrame, right: DataFrame, on: Column, how: str, select: Mapping[str, Column]) -> DataFrame:
    """A SQL join and its select list; the sides carry aliases ``a`` and ``b``."""
    return left.alias("a").join(right.alias("b"), on, how).select(*[c.alias(n) for n, c in select.items()])


def keyed_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], order: Sequence[str], found: str | None = None
) -> DataFrame:
    """Indexed lookup: the first match in ``order`` per key, missing when there is none."""
    # row_number with a limit is cut map-side, so a key with many copies stays cheap.
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*ordering(lookup, order, skip=keys))
    first = lookup.withColumn("__no", F.row_number().over(w)).filter("__no = 1").drop("__no")
    if found:
        first = first.withColumn(found, F.lit(True))
    joined = attach(df, first, keys)
    return joined.withColumn(found, F.coalesce(col(found), F.lit(False))) if found else joined


def absent_keys(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Required datasets that the catalog does not have."""
    return required.join(available.select(key), key, "left_anti")


def match_merge(
    frames: Mapping[str, DataFrame],
    by: Sequence[str],
    order: Mapping[str, Sequence[str]],
    flags: Mapping[str, str] | None = None,
    row_no: str | None = None,
) -> DataFrame:
    """MERGE with BY: rows of a group pair up by position, a short side repeats its last row.

    Rows are numbered per BY group and joined on (BY, number), whose keys are
    nearly unique however large a group is. The last row of each side, one per
    group, is joined for the positions that side does not reach. A shared variable
    comes from the last listed dataset that still has a row there.
    """
    names = list(frames)
    owners: dict[str, list[str]] = {}
    for d in names:
        for c in frames[d].columns:
            if c not in by:
                owners.setdefault(c, []).append(d)

    merged = None
    lasts = {}
    for d in names:
        numbered = number_rows(frames[d], by, order.get(d, ()), "__no")
        values = F.struct(*[col(c) for c in frames[d].columns if c not in by], F.lit(True).alias("__here"))
        packed = numbered.select(*[col(c) for c in by], F.col("__no"), values.alias(f"__{d}"))
        lasts[d] = packed.groupBy(*[col(c) for c in by]).agg(
            F.max("__no").alias(f"__{d}_n"), F.max_by(f"__{d}", "__no").alias(f"__{d}_last")
        )
        if merged is None:
            merged = packed
            continue
        keys = [*by, "__no"]
        right = packed.select(*[col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.col(f"__{d}"))
        match = all_of(col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys))
        merged = merged.join(right, match, "full_outer")
        # A row of the right side alone has null keys on the left.
        alone = F.col("__no").isNull()
        merged = merged.withColumns(
            {k: F.when(alone, F.col(f"__r{i}")).otherwise(col(k)) for i, k in enumerate(keys)}
        ).drop(*[f"__r{i}" for i in range(len(keys))])
    for d in names:
        merged = attach(merged, lasts[d], by)

    out = {}
    for c, owning in owners.items():
        longest = F.greatest(*[F.col(f"__{d}_n") for d in owning], F.lit(0))
        choice = F.coalesce(
            *[F.when(F.col(f"__{d}").isNotNull(), F.struct(F.col(f"__{d}")[c].alias("v"))) for d in reversed(owning)],
            *[
                F.when(F.col(f"__{d}_n") == longest, F.struct(F.col(f"__{d}_last")[c].alias("v")))
                for d in reversed(owning)
            ],
        )
        out[c] = choice["v"]
    picked = [col(c) for c in by] + [v.alias(c) for c, v in out.items()]
    picked += [F.col(f"__{d}_n").isNotNull().alias(flag) for d, flag in (flags or {}).items()]
    if row_no:
        picked.append(F.col("__no").alias(row_no))
    return merged.select(*picked)


def _last_present(tx: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, the last non-missing value of each column in ``order``, where missing comes first.

    Rows that ``order`` does not tell apart follow their other columns.
    """
    placed = number_rows(tx, by, order, "__no")
    return placed.groupBy(*[col(c) for c in by]).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col("__no"))).alias(c) for c in columns]
    )


def _overlaid(master: DataFrame, changes: DataFrame, by: Sequence[str], how: str, extra: Sequence[str]) -> DataFrame:
    shared = [c for c in master.columns if c not in by and c in changes.columns]
    new = {c: f"__new{i}" for i, c in enumerate(changes.columns) if c not in by}
    renamed = changes.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(by)], *[col(c).alias(n) for c, n in new.items()]
    )
    match = all_of(col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by))
    joined = master.withColumn("__old", F.lit(True)).join(renamed, match, how)
    alone = F.col("__old").isNull()
    keys = [F.when(alone, F.col(f"__k{i}")).otherwise(col(k)).alias(k) for i, k in enumerate(by)]
    values = [
        (F.coalesce(F.col(new[c]), col(c)) if c in shared else col(c)).alias(c) for c in master.columns if c not in by
    ]
    return joined.select(*keys, *values, *[F.col(new[c]).alias(c) for c in extra])


def update_table(master: DataFrame, tx: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """UPDATE: non-missing transaction values overwrite in order, unmatched transactions are added.

    The master has one row per key. Transactions are reduced to one row per key
    first. ``order`` takes ``-name`` for a downward order.
    """
    named = [o.lstrip("-") for o in order]
    columns = [c for c in tx.columns if c not in by and (c in master.columns or c not in named)]
    extra = [c for c in columns if c not in master.columns]
    return _overlaid(master, _last_present(tx, by, order, columns), by, "full_outer", extra)


def modify_table(master: DataFrame, tx: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """MODIFY: like UPDATE, but neither keys nor columns are added."""
    columns = [c for c in tx.columns if c not in by and c in master.columns]
    return _overlaid(master, _last_present(tx, by, order, columns), by, "left", [])


def contributed(flags: Sequence[str], every: bool = True) -> Column:
    """Condition on match-merge flags: all of them, or any."""
    return (all_of if every else any_of)(col(f) for f in flags)
