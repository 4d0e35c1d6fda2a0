"""Order-dependent BY-group operators: numbering, running totals, retained values, flags, lags.

Every function takes the row order. ``-name`` sorts downwards, missing sorts lowest and NaN is missing.
Operators with the same BY and order can share one pass over the rows: see ``Pass``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.columns import col, key_of, ordering
from stepledger.operators.heavy import PIECE, across_pieces, at_borders, in_pieces, per_piece, stitch, window


def sort_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sort with missing first; NaN counts as missing."""
    keys = []
    for item in by:
        value = key_of(df, item.lstrip("-"))
        keys.append(value.desc_nulls_last() if item.startswith("-") else value.asc_nulls_first())
    return df.orderBy(*keys)


# How a running aggregate starts, and how an earlier piece's value joins a row's own. Missing terms are passed over.
_RUNNING = {
    "sum": (F.sum, lambda own, before: F.coalesce(own + before, own, before)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


@dataclass
class _Running:
    out: str
    kind: str
    term: str


@dataclass
class _Held:
    out: str
    slot: str
    include_current: bool


@dataclass
class _Shift:
    out: str
    value: str
    rows: int


class Pass:
    """Several ordered operators over the same BY groups in the same order: one write, one sort, one read of the pieces."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], carried: Sequence[str] = ()):
        """``carried`` columns break no ties: the ends of the ranges are chosen by the driver, from sort keys of some rows."""
        self.df = df
        self.by = list(by)
        self.order = order
        self.carried = list(carried)
        self.terms: dict[str, Column] = {}
        self.runs: list[_Running] = []
        self.helds: list[_Held] = []
        self.shifts: list[_Shift] = []
        self.flagged = False

    def _term(self, value: Column) -> str:
        name = f"__term{len(self.terms)}"
        self.terms[name] = value
        return name

    def running(self, out: str, kind: str, term: Column) -> Pass:
        """Cumulative ``sum``, ``min`` or ``max``. Missing terms are passed over."""
        self.runs.append(_Running(out, kind, self._term(term)))
        return self

    def number(self, out: str) -> Pass:
        """The place in the BY group, from 1."""
        return self.running(out, "sum", F.lit(1).cast("long"))

    def hold(self, out: str, when: Column, value: Column, include_current: bool = True) -> Pass:
        """The value last assigned; an assigned missing value is held like any other."""
        slot = self._term(F.when(when, F.struct(value.alias("v"))))
        self.helds.append(_Held(out, slot, include_current))
        return self

    def shift(self, out: str, value: Column, rows: int = 1) -> Pass:
        """The value ``rows`` rows earlier (later when negative)."""
        self.shifts.append(_Shift(out, self._term(value), rows))
        return self

    def flags(self) -> Pass:
        """``first_x`` and ``last_x`` for every prefix of the BY list."""
        self.flagged = True
        return self

    def result(self) -> DataFrame:
        df, by = self.df, self.by
        keys = ordering(df, self.order, skip=[*by, *self.carried])
        parts = in_pieces(df.withColumns(self.terms), by, keys)
        w = window(parts, by, keys)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        local: dict[str, Column] = {}
        for i, r in enumerate(self.runs):
            local[f"__run{i}"] = _RUNNING[r.kind][0](r.term).over(upto)
        for i, h in enumerate(self.helds):
            local[f"__held{i}"] = F.last(h.slot, ignorenulls=True).over(upto if h.include_current else before)
        for i, s in enumerate(self.shifts):
            local[f"__shift{i}"] = F.lag(F.struct(F.col(s.value).alias("v")), s.rows).over(w)
        if self.shifts or self.helds:
            local["__place"] = F.row_number().over(w)
        if any(s.rows < 0 for s in self.shifts):
            local["__rest"] = F.count(F.lit(1)).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        for i in range(len(by) if self.flagged else 0):
            prefix, sort = by[: i + 1], [key_of(parts, c).asc_nulls_first() for c in by[i + 1 :]] + keys
            inside = window(parts, prefix, sort)
            local[f"__first{i}"] = F.lag(F.lit(1)).over(inside).isNull()
            local[f"__last{i}"] = F.lead(F.lit(1)).over(inside).isNull()
        rows = parts.withColumns(local)
        if self.runs or self.helds or self.shifts:
            rows = stitch(rows, self._carried(parts, keys), by)
        for i in range(len(by) if self.flagged else 0):
            rows = stitch(rows, self._spans(parts, by[: i + 1], i), by[: i + 1])
        return self._finished(rows)

    def _carried(self, parts: DataFrame, keys: list[Column]) -> DataFrame:
        """What each piece of a group has from the group's earlier (for leads, later) pieces; one row for a piece and group."""
        by = self.by
        aggs = [_RUNNING[r.kind][0](r.term).alias(f"__run{i}_all") for i, r in enumerate(self.runs)]
        back = max([s.rows for s in self.shifts if s.rows > 0], default=0)
        ahead = max([-s.rows for s in self.shifts if s.rows < 0], default=0)
        if self.helds or self.shifts:
            # Before the sort: mostly a few groups are left of many.
            parts = at_borders(parts, by)
            w = window(parts, by, keys)
            parts = parts.withColumn("__place", F.row_number().over(w))
            if back:
                # Counted over the same sorted rows.
                size = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                parts = parts.withColumn("__from_end", size - F.col("__place") + 1)
        for i, h in enumerate(self.helds):
            set_at = F.when(F.col(h.slot).isNotNull(), F.col("__place"))
            aggs.append(F.max_by(F.col(h.slot), set_at).alias(f"__held{i}_last"))
        for i, s in enumerate(self.shifts):
            k = abs(s.rows)
            near = F.col("__from_end") <= k if s.rows > 0 else F.col("__place") <= k
            # At most k rows of each piece and group.
            kept = F.collect_list(F.when(near, F.struct(F.col("__place"), F.col(s.value).alias("v"))))
            aggs.append(F.sort_array(kept).alias(f"__near{i}"))
        totals = per_piece(parts, by, *aggs, F.count(F.lit(1)).alias("__rows"))
        w = across_pieces(totals, by)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        out: dict[str, Column] = {}
        for i, r in enumerate(self.runs):
            out[f"__run{i}_before"] = _RUNNING[r.kind][0](f"__run{i}_all").over(earlier)
        for i, _ in enumerate(self.helds):
            out[f"__held{i}_before"] = F.last(f"__held{i}_last", ignorenulls=True).over(earlier)
        for i, s in enumerate(self.shifts):
            # Every piece of the group has a row of it, so k pieces hold k rows.
            k = abs(s.rows)
            span = w.rowsBetween(-k, -1) if s.rows > 0 else w.rowsBetween(1, k)
            out[f"__near{i}_before"] = F.flatten(F.collect_list(f"__near{i}").over(span))
        out["__pieces"] = F.count(F.lit(1)).over(Window.partitionBy(*[key_of(totals, c) for c in by]))
        kept = totals.withColumns(out).filter("__pieces > 1")
        return kept.select(PIECE, *[col(c) for c in by], *[c for c in out if c != "__pieces"])

    def _spans(self, parts: DataFrame, prefix: list[str], i: int) -> DataFrame:
        totals = per_piece(parts, prefix, F.count(F.lit(1)).alias("__n"))
        w = across_pieces(totals, prefix)
        flags = {f"__prior{i}": F.lag("__n").over(w).isNotNull(), f"__later{i}": F.lead("__n").over(w).isNotNull()}
        return totals.withColumns(flags).filter(f"__prior{i} or __later{i}").drop("__n")

    def _finished(self, rows: DataFrame) -> DataFrame:
        types = dict(rows.dtypes)
        made: dict[str, Column] = {}
        for i, r in enumerate(self.runs):
            own = F.col(f"__run{i}")
            made[r.out] = _RUNNING[r.kind][1](own, F.col(f"__run{i}_before")).cast(types[f"__run{i}"])
        for i, h in enumerate(self.helds):
            made[h.out] = F.coalesce(f"__held{i}", f"__held{i}_before")["v"]
        for i, s in enumerate(self.shifts):
            near, k = F.col(f"__near{i}_before"), abs(s.rows)
            if s.rows > 0:
                outside = F.get(near, F.size(near) - (k - F.col("__place")) - 1)
                carried = F.when(F.col("__place") <= k, outside)
            else:
                carried = F.when(F.col("__rest") <= k, F.get(near, k - F.col("__rest")))
            made[s.out] = F.coalesce(F.col(f"__shift{i}"), F.when(carried.isNotNull(), F.struct(carried["v"].alias("v"))))["v"]
        for i, c in enumerate(self.by if self.flagged else []):
            made[f"first_{c}"] = F.col(f"__first{i}") & ~F.coalesce(F.col(f"__prior{i}"), F.lit(False))
            made[f"last_{c}"] = F.col(f"__last{i}") & ~F.coalesce(F.col(f"__later{i}"), F.lit(False))
        old = [col(c) for c in self.df.columns if c not in made]
        return rows.select(*old, *[v.alias(n) for n, v in made.items()])


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str], aggs: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Cumulative sum, min or max within the BY group, ``{out: (kind, term)}``. Missing terms are passed over."""
    work = Pass(df, by, order)
    for out, (kind, term) in aggs.items():
        work.running(out, kind, term)
    return work.result()


def running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Running totals within the BY group. A missing term adds nothing; the total starts at zero."""
    return running(df, by, order, {out: ("sum", F.coalesce(term, F.lit(0))) for out, term in sums.items()})


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The sum statement: retained, reset at the first row of the BY group."""
    return running_sum(df, by, order, {out: col(value)})


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "row_no", carried: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each BY group from 1; ``carried`` columns, such as whole texts, are no sort keys."""
    return Pass(df, by, order, carried).number(out).result()


def with_row_index(df: DataFrame, order: Sequence[str], out: str = "row_index", start: int = 0) -> DataFrame:
    """A gap-free index over the whole table, without gathering it in one task."""
    return number_rows(df, [], order, out).withColumn(out, F.col(out) - 1 + start)


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    assigned: Mapping[str, tuple[Column, Column]],
    include_current: bool = True,
) -> DataFrame:
    """Hold the value last assigned in the BY group, ``{out: (when, value)}``.

    An assigned missing value is held like any other; before the first assignment
    the result is missing.
    """
    work = Pass(df, by, order)
    for out, (when, value) in assigned.items():
        work.hold(out, when, value, include_current)
    return work.result()


def retain(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    when: Column,
    value: Column,
    out: str,
    initial=None,
) -> DataFrame:
    """RETAIN of a conditionally assigned value, restarting with ``initial`` in each BY group."""
    held = carry_forward(df, by, order, {out: (when, value), "__set": (when, F.lit(True))})
    if initial is not None:
        held = held.withColumn(out, F.when(F.col("__set").isNull(), F.lit(initial)).otherwise(col(out)))
    return held.drop("__set")


def by_flags(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``first_x`` and ``last_x`` for every prefix of the BY list."""
    return Pass(df, by, order).flags().result()


def shift(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, rows: int = 1
) -> DataFrame:
    """The value ``rows`` rows earlier in the BY group (later when negative).

    This is the lag of a call made on every row; for one called on some rows only see ``lag_calls``.
    """
    return Pass(df, by, order).shift(out, col(value), rows).result()


def lag_calls(
    df: DataFrame, by: Sequence[str], order: Sequence[str], when: Column, value: Column, lags: Mapping[str, int]
) -> DataFrame:
    """LAG called on some rows only, ``{out: n}``: where ``when`` holds, the value of the n-th call before; missing elsewhere.

    A call puts the row's value into a queue, whatever rows lie between the calls. So the rows with a call are a group
    of their own, and the lag is one of rows inside it. Without ``by`` there is one queue for the whole table.
    """
    called = "__called"
    work = Pass(df.withColumn(called, F.coalesce(when, F.lit(False))), [*by, called], order)
    for out, n in lags.items():
        if n < 1:
            raise ValueError(f"a queue of {n} calls has no earlier value")
        work.shift(out, value, n)
    made = work.result()
    return made.withColumns({out: F.when(F.col(called), col(out)) for out in lags}).drop(called)
