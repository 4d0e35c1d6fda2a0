"""Value comparison: exact multiset difference first, tolerance only on what is left."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import all_of, attach, col, common_columns, lower_names
from stepledger.functions.numbers import close, round_to
from stepledger.operators.ordered import carry_forward, running_sum, shift
from stepledger.operators.stack import signed_difference
from stepledger.reconcile.families import exact, is_float, plain_text
from stepledger.settings import ATOL, MAX_REPORT, RTOL, store


@dataclass
class ValueDiff:
    """``rows``: differing rows with both versions; ``cells``: the cells that differ in paired rows."""

    rows: DataFrame
    cells: DataFrame
    same_columns: bool

    def sample(self, n: int = MAX_REPORT) -> DataFrame:
        """At most n + 1 differing rows of each kind, the extra one telling that there are more.

        A kind is an issue and the set of columns that differ. The rows with the lowest hashes of a kind are taken, so
        the sample is the same however the rows are dealt; each task passes on no more than n + 1 of a kind.
        ``place`` counts them.
        """
        return bottom_rows(self.rows, ["issue", "differs"], n + 1, "place")


def bottom_rows(rows: DataFrame, kinds: Sequence[str], n: int, place: str) -> DataFrame:
    """The ``n`` rows of each kind with the lowest hash of all their columns, counted from 1 in ``place``.

    Rows equal in every column are equal choices. The limit for each kind is applied in the tasks first.
    """
    whole_row = F.to_json(F.struct(*[col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    hashed = rows.withColumn("__hash", F.xxhash64(whole_row)).withColumn("__row", whole_row)
    order = Window.partitionBy(*[col(k) for k in kinds]).orderBy("__hash", "__row")
    return hashed.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= n).drop("__hash", "__row")


def _singles(residual: DataFrame, group: list[str], values: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Pairs of the groups that have a row on each side at most, by one aggregate; the rows of the others, None without any."""
    if not group:
        return None, residual
    row = F.struct("copies", F.struct(*[col(c) for c in values]).alias("row"))
    mine, theirs = F.col("copies") > 0, F.col("copies") < 0
    groups = store(
        residual.groupBy(*[col(c) for c in group]).agg(
            F.count_if(mine).alias("__mine"),
            F.count_if(theirs).alias("__theirs"),
            F.any_value(F.when(mine, row), F.lit(True)).alias("__a"),
            F.any_value(F.when(theirs, row), F.lit(True)).alias("__g"),
        )
    )
    is_single = (F.col("__mine") <= 1) & (F.col("__theirs") <= 1)
    a, g = F.coalesce(F.col("__a.copies"), F.lit(0)), -F.coalesce(F.col("__g.copies"), F.lit(0))
    both = F.least(a, g)
    a_row, g_row, no = F.col("__a.row"), F.col("__g.row"), F.lit(False)
    parts = F.array(
        F.struct(both.alias("copies"), a_row.alias("actual"), g_row.alias("golden")),
        F.struct((a - both).alias("copies"), a_row.alias("actual"), F.when(no, g_row).alias("golden")),
        F.struct((g - both).alias("copies"), F.when(no, a_row).alias("actual"), g_row.alias("golden")),
    )
    single = (
        groups.filter(is_single)
        .select(*[col(c) for c in group], F.explode(parts).alias("__p"))
        .filter("__p.copies > 0")
        .select(*[col(c) for c in group], "__p.copies", "__p.actual", "__p.golden")
    )
    crowded = groups.filter(~is_single).select(*[col(c) for c in group])
    return single, None if crowded.isEmpty() else attach(residual, crowded, group, "left_semi")


def _pair(residual: DataFrame, group: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Pair the surplus rows of the two sides by position inside their group.

    Most groups have a row on each side, or on one; only the others are laid out.
    """
    single, rest = _singles(residual, group, values)
    if single is None:
        return _laid_out(rest, group, values, order)
    return single if rest is None else single.unionByName(_laid_out(rest, group, values, order))


def _laid_out(residual: DataFrame, group: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Pairs by position, for groups of any size.

    Copies are kept as counts. Each side lays its rows out along positions; where
    the two layouts are cut together, every stretch has one row of either side.
    So many copies of a row cost one stretch, and no group is gathered in a task.
    """
    laid = residual.withColumns({"side": F.signum("copies").cast("int"), "n": F.abs("copies")})
    placed = running_sum(laid, [*group, "side"], order, {"stop": F.col("n")})
    row = F.struct(*[col(c) for c in values])
    starts = placed.select(
        *[col(c) for c in group], "side", (F.col("stop") - F.col("n")).alias("place"), row.alias("row")
    )
    ends = placed.groupBy(*[col(c) for c in group], "side").agg(F.max("stop").alias("place"))
    events = starts.unionByName(ends, allowMissingColumns=True)
    cuts = events.withColumn("ends", F.col("row").isNull())
    paired = carry_forward(
        cuts,
        group,
        ["place", "ends", "side"],
        {"actual": (F.col("side") == 1, F.col("row")), "golden": (F.col("side") == -1, F.col("row"))},
    )
    # At one place the event sorted last has seen all the others; the stretch starts there.
    spans = shift(paired, group, ["place", "ends", "side"], "place", "next", -1)
    return (
        spans.filter("next > place and (actual is not null or golden is not null)")
        .withColumn("copies", F.col("next") - F.col("place"))
        .select(*[col(c) for c in group], "copies", "actual", "golden")
    )


def _clusters(rows: DataFrame, others: list[str], floats: list[str], atol: float, rtol: float) -> DataFrame:
    """``rows`` with a cluster number for each floating column.

    Column after column, the values inside the clusters so far are laid out in order and cut where the gap to
    the value before exceeds the tolerance; a missing value stands alone. Values within tolerance of each other are
    never parted, wherever on the axis they lie.
    """
    group = list(others)
    for i, c in enumerate(floats):
        before = shift(rows, group, [c], c, "__before")
        near = close(F.col("__before"), col(c), atol, rtol)
        cut = F.when(near, 0).otherwise(1).cast("long")
        rows = running_sum(before, group, [c], {f"__cluster{i}": cut}).drop("__before")
        group.append(f"__cluster{i}")
    return rows


def _cancel_close(residual: DataFrame, others: list[str], floats: list[str], atol: float, rtol: float) -> DataFrame:
    """The surplus rows of either side that have no partner within tolerance on the other.

    Rows pair by position inside the last cluster, so a row too many leaves the other clusters as they are.
    """
    paired, rest = _singles(residual, others, floats)
    if rest is not None:
        names = [f"__cluster{i}" for i in range(len(floats))]
        clusters = _clusters(rest, others, floats, atol, rtol)
        met = _pair(clusters, [*others, *names], floats, floats).drop(*names)
        paired = met if paired is None else paired.unionByName(met)
    alike = all_of(close(F.col("actual")[c], F.col("golden")[c], atol, rtol) for c in floats)
    left = paired.filter(~F.coalesce(F.col("actual").isNotNull() & F.col("golden").isNotNull() & alike, F.lit(False)))
    sides = [
        left.filter(F.col(side).isNotNull()).select(
            *[col(c) for c in others], *[F.col(side)[c].alias(c) for c in floats], (sign * F.col("copies")).alias("copies")
        )
        for side, sign in (("actual", 1), ("golden", -1))
    ]
    return store(sides[0].unionByName(sides[1]))


def surplus(
    actual: DataFrame, golden: DataFrame, atol: float = ATOL, rtol: float = RTOL
) -> tuple[DataFrame, dict[str, T.DataType], list[str], bool]:
    """The rows of either side without a partner, with their signed number of ``copies``; common types, floating columns,
    and whether both sides have the same columns.

    Equal rows cancel in one aggregate, then rows that are alike within tolerance. Written once, as several passes read it.
    """
    a, g = lower_names(actual), lower_names(golden)
    shared, same = common_columns(a, g)
    if not shared:
        raise ValueError("no common columns to compare")
    mine, kinds = exact(a, g, shared)
    theirs, _ = exact(g, a, shared)
    floats = [c for c in shared if is_float(kinds[c])]
    residual = store(signed_difference(mine, theirs, "copies"))
    if floats:
        others = [c for c in shared if c not in floats]
        residual = _cancel_close(residual, others, floats, atol, rtol).select(*[col(c) for c in residual.columns])
    return residual, kinds, floats, same


def value_diff(
    actual: DataFrame,
    golden: DataFrame,
    keys: Sequence[str] | None = None,
    atol: float = ATOL,
    rtol: float = RTOL,
) -> ValueDiff:
    """Order-insensitive, duplicate-aware comparison with absolute and relative tolerance.

    What is left when rows that are equal or alike have cancelled differs; for the report it is paired by ``keys`` when
    given, else by all columns that are not floating, in order of the floats.
    Without keys, rows that differ in several floating columns can pair in more
    than one way; name the keys where that matters, or see ``align.aligned_diff``.
    """
    residual, kinds, floats, same = surplus(actual, golden, atol, rtol)
    shared = [c for c in residual.columns if c != "copies"]
    group = [k.lower() for k in keys] if keys else [c for c in shared if c not in floats]
    values = [c for c in shared if c not in group]

    if not values:
        rows = residual.select(
            *[col(c) for c in group],
            F.abs("copies").alias("copies"),
            F.when(F.col("copies") > 0, F.lit("only in actual")).otherwise(F.lit("only in golden")).alias("issue"),
            F.array().cast("array<string>").alias("differs"),
        )
        cells = rows.limit(0).select(
            *[col(c) for c in group],
            F.lit("").alias("column_name"),
            F.lit("").alias("actual"),
            F.lit("").alias("golden"),
            "copies",
        )
        return ValueDiff(rows, cells, same)

    # Jitter must not decide the order: exact columns lead, then floats at the tolerance, then as they are.
    coarse = {f"__c{i}": round_to(col(c), atol) for i, c in enumerate(c for c in values if c in floats)}
    order = [c for c in values if c not in floats] + list(coarse) + [c for c in values if c in floats]
    paired = _pair(residual.withColumns(coarse), group, values, order)

    def agrees(c: str):
        left, right = F.col("actual")[c], F.col("golden")[c]
        return close(left, right, atol, rtol) if c in floats else left.eqNullSafe(right)

    together = F.col("actual").isNotNull() & F.col("golden").isNotNull()
    rows = paired.withColumn(
        "issue",
        F.when(F.col("golden").isNull(), F.lit("only in actual"))
        .when(F.col("actual").isNull(), F.lit("only in golden"))
        .otherwise(F.lit("changed")),
    ).filter(~together | ~all_of(agrees(c) for c in values))
    apart = F.array(*[F.when(~agrees(c), F.lit(c)) for c in values])
    rows = rows.withColumn("differs", F.when(together, F.array_compact(apart)).otherwise(F.array().cast("array<string>")))
    per_cell = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                plain_text(F.col("actual")[c], kinds[c]).alias("actual"),
                plain_text(F.col("golden")[c], kinds[c]).alias("golden"),
                agrees(c).alias("same"),
            )
            for c in values
        ]
    )
    cells = (
        rows.filter("issue = 'changed'")
        .select(*[col(c) for c in group], "copies", F.explode(F.filter(per_cell, lambda x: ~x["same"])).alias("cell"))
        .select(*[col(c) for c in group], "cell.column_name", "cell.actual", "cell.golden", "copies")
    )
    return ValueDiff(rows, cells, same)
