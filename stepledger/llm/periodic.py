"""Periodic runs of words in texts, by Lyndon roots.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words long, that no
neighbouring word extends. Every run consists of copies of a Lyndon word (smaller than all its proper suffixes), its
root, and for one of the two orders of the words each whole root inside the run is the longest Lyndon word that
starts there.

The lengths of those words, the Lyndon array, come from the first phase of Baier's suffix sorter, for both orders:
suffixes are grouped by first word, and the groups are taken from the greatest down. Each suffix of the group in
turn lengthens the nearest suffix before it that is in a lower group; those that are lengthened alike leave
their group together for a new one just above. In the end a group is the suffixes that share their longest Lyndon word.
So equal groups at a distance of that word's length are neighbouring roots. A chain of roots is extended on either
side by less than a period, which is what its longest common extensions come to, and is a run if it is long enough.

In a run each word occurs once a period, so a word that occurs less than ``exponent`` times cannot be in one and cuts
the text; so again in the pieces. Runs never cross such a cut. Only the pieces that are left are sorted.

Texts are independent of each other: nothing is shuffled, and a task holds the words of about ``CHARS_AT_ONCE``
characters, or of one text where that is longer. Null texts and texts without words have no runs; equal
texts have equal runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import col
from stepledger.llm.common import WORD, fresh, whole, words

EXPONENT = 4
LEAST = 6
CHARS_AT_ONCE = 2_000_000

FIND = re.compile(WORD).findall
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


class _Group:
    """Suffixes whose longest Lyndon word, as far as it is known, is the same one of ``size`` words."""

    __slots__ = ("higher", "lower", "members", "size")

    def __init__(self, size: int, members: list[int]):
        self.size, self.members = size, members
        self.lower: _Group | None = None
        self.higher: _Group | None = None

    def put_above(self, below: _Group) -> None:
        self.lower, self.higher = below, below.higher
        if below.higher is not None:
            below.higher.lower = self
        below.higher = self


def lyndon_groups(codes: list[int], falling: bool = False) -> tuple[list[int], list[int]]:
    """For each place the length of the longest Lyndon word that starts there, and the number of its group.

    ``falling`` turns the order of the codes round; the end of the text is below every code in both orders.
    """
    n = len(codes)
    by_code: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        by_code.setdefault(c, []).append(i)
    group, of = None, {}
    for c in sorted(by_code, reverse=falling):
        made = _Group(1, by_code[c])
        if group is not None:
            made.put_above(group)
        group = of[c] = made
    owner = [of[c] for c in codes]
    lengths, numbers, number = [0] * n, [0] * n, 0
    # A forest: place i, if its group is still to come, is the root i + 1; else the way leads to the left. 0 is no place.
    way = list(range(n + 1))
    while group is not None:
        members = [i for i in group.members if owner[i] is group]
        for i in members:
            lengths[i], numbers[i] = group.size, number
            way[i + 1] = i
        times: dict[int, int] = {}
        for at in members:
            while way[at] != at:
                way[at] = way[way[at]]
                at = way[at]
            if at:
                times[at - 1] = times.get(at - 1, 0) + 1
        leaving: dict[tuple[int, _Group], list[int]] = {}
        for i, k in times.items():
            leaving.setdefault((k, owner[i]), []).append(i)
        # Each new group comes just above the one it leaves, so those lengthened most often end highest.
        for (k, old), places in sorted(leaving.items(), key=lambda x: -x[0][0]):
            made = _Group(old.size + k * group.size, places)
            made.put_above(old)
            for i in places:
                owner[i] = made
        number += 1
        group = group.lower
    return lengths, numbers


def runs(codes: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of the codes, by start, then period. ``exponent`` is 3 or more."""
    n = len(codes)
    a = np.array(codes, dtype=np.int64)
    found = set()
    for falling in (False, True):
        lengths, groups = (np.array(x, dtype=np.int64) for x in lyndon_groups(codes, falling))
        after = np.arange(n) + lengths
        linked = np.flatnonzero((after < n) & (groups[np.minimum(after, n - 1)] == groups))
        follows = np.zeros(n, dtype=bool)
        follows[after[linked]] = True
        is_linked = np.zeros(n + 1, dtype=bool)
        is_linked[linked] = True
        for i in linked[~follows[linked]].tolist():
            p, end = int(lengths[i]), i
            while is_linked[end]:
                end += p
            end += p
            if end - i < (exponent - 1) * p:
                continue
            m = min(p, n - end)
            right = _equal(a[end : end + m], a[end - p : end - p + m])
            m = min(p, i)
            left = _equal(a[i - m : i][::-1], a[i - m + p : i + p][::-1])
            if left + end - i + right >= max(least, exponent * p):
                found.add((i - left, left + end - i + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries from the first on are equal."""
    apart = np.flatnonzero(a != b)
    return int(apart[0]) if len(apart) else len(a)


def _pieces(codes: np.ndarray, owner: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Stretches, as places of ``codes``, that can hold runs; ``owner`` numbers the texts."""
    at = np.arange(len(codes))
    while len(at):
        _, back, n = np.unique(owner * (codes.max() + 1) + codes, return_inverse=True, return_counts=True)
        keep = n[back] >= exponent
        kept = at[keep]
        starts = np.ones(len(kept), dtype=bool)
        starts[1:] = (np.diff(kept) != 1) | (np.diff(owner[keep]) != 0)
        number = np.cumsum(starts) - 1
        long = (np.bincount(number) >= least)[number]
        before, at, codes, owner = len(at), kept[long], codes[keep][long], number[long]
        # Each round is exact by itself; when little goes any more, sorting is cheaper.
        if 10 * len(at) > 9 * before:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
    return list(zip(at[first].tolist(), (at[np.r_[first[1:] - 1, len(at) - 1]] + 1).tolist()))


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def find(texts: list[str], exponent: int = EXPONENT, least: int = LEAST) -> Iterator[tuple[int, list, str]]:
    """For each text its number of words, its runs, and its words without the repeated periods of its runs."""
    split = [FIND(t) for t in texts]
    sizes = [len(w) for w in split]
    table = _Codes()
    codes = np.fromiter(map(table.__getitem__, (w for ws in split for w in ws)), dtype=np.int64, count=sum(sizes))
    starts = np.cumsum(sizes) - sizes
    found: dict[int, list] = {}
    for a, b in _pieces(codes, np.repeat(np.arange(len(texts)), sizes), exponent, least):
        doc = int(np.searchsorted(starts, a, side="right")) - 1
        at = a - int(starts[doc])
        made = [(at + s, n, p) for s, n, p in runs(codes[a:b].tolist(), exponent, least)]
        if made:
            found.setdefault(doc, []).extend(made)
    for doc, ws in enumerate(split):
        own = found.get(doc, [])
        if own:
            edge = np.zeros(len(ws) + 1, dtype=np.int64)
            for s, n, p in own:
                edge[s + p] += 1
                edge[s + n] -= 1
            ws = [w for w, k in zip(ws, np.cumsum(edge).tolist()) if not k]
        yield sizes[doc], own, " ".join(ws)


def find_runs(
    docs: DataFrame, text: str = "text", out: str = "periodic", exponent: int = EXPONENT, least: int = LEAST
) -> DataFrame:
    """``docs`` with the struct ``out``: ``n_words``, ``runs`` (start, length and period in words) and ``collapsed``.

    ``collapsed`` is the words of the text, joined by one space, without those that a run contains after its first
    period. Runs are in order of start, then period.
    """
    if exponent < 3:
        raise ValueError("a run has three periods or more here")
    others = [c for c in docs.columns if c != out]
    shape = T.StructType([*[docs.schema[c] for c in others], T.StructField(out, FOUND)])
    at = fresh(docs, "_t")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))), ("collapsed", pa.string())]
        )
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _parts(texts):
                rows = [
                    {"n_words": n, "runs": [dict(zip(RUN.names, r)) for r in own], "collapsed": left}
                    for n, own, left in find(texts[a:b], exponent, least)
                ]
                columns = [c.slice(a, b - a) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*batch.schema.names[1:], out])

    rows = docs.select(whole(col(text)).alias(at), *[col(c) for c in others])
    return rows.mapInArrow(found, shape)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > CHARS_AT_ONCE:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def with_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of every row; one in ten texts gets a periodic tail, by the crc32 of its id (missing: of nothing)."""
    w, h = "w", "h"
    rows = docs.select(
        col(doc_id).alias("doc_id"),
        whole(col(text)).alias("text"),
        F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")).alias(h),
    )
    rows = rows.withColumn(w, F.when(F.col(h) % 10 == 0, words(F.col("text"))))
    n, g = F.size(w), F.floor(F.col(h) / 10)
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))))
    rows = rows.withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    tailed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(w, place(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, tailed).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of each text, after one in ten got a periodic tail."""
    made = find_runs(with_tails(docs))
    all_runs = F.col("periodic")["runs"]
    # Greatest length first, of ties the smallest start, then period.
    best = F.array_min(F.transform(all_runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    made = made.withColumn("best", best)
    length, period = -F.col("best")["l"], F.col("best")["p"]
    listed = F.transform(all_runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return made.select(
        "doc_id",
        F.size(all_runs).cast("long").alias("n_runs"),
        F.col("best")["s"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic")["collapsed"].cast("binary"), 256).alias("collapsed_sha256"),
    )
