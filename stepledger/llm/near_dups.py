"""Near-duplicates by b-bit MinHash.

A text is the set of its word shingles. Texts with the same set are taken as one from here on. Minima of a set
under many hash functions are cut into bands; sets that share a band are candidates. Of each minimum only
two bits are kept, packed into a signature; the share of equal pairs of bits, corrected for chance, estimates
the similarity, and what could reach the threshold is confirmed on the full sets.

Pairs are never written out. The candidates of a band are tied to one of them, the components of those ties
are clusters, and the sets of a cluster meet in blocks: a cluster is dealt into parts of bounded size, and each
task compares two parts in memory and passes on only the links that join what was not joined before. So a
cluster of any size is spread over as many tasks as it has pairs of parts, and a group of n sets gives at most
n - 1 links a task.

The number of bands follows from the threshold: a pair at the threshold is missed with a probability of at most
``MISSED``. Signatures are only refused six standard deviations below the threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.llm.common import WORD, fold_text, fresh, whole
from stepledger.llm.components import components
from stepledger.settings import store

ROWS = 6  # minima of a band
MISSED = 1e-6
PART_SETS = 2_048  # sets of a part of a cluster, about
PART_SHINGLES = 3_000_000  # and its shingles
BITMAP = 1 << 23  # bits of the filter that keeps most texts without candidates from being moved

FIND = re.compile(WORD).findall
EVEN = np.uint64(0x5555555555555555)
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; linked if 100 * shared >= ``percent`` * union."""

    size: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISSED) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def least_equal(self) -> float:
        """Share of equal bit pairs below which a pair cannot be linked, by six standard deviations."""
        n, p = self.bands * ROWS, 0.25 + 0.75 * self.percent / 100
        return p - 6 * math.sqrt(p * (1 - p) / n)

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)


class Shingler:
    """Sets, band keys and signatures of texts; words are hashed once a worker."""

    def __init__(self, rule: Rule):
        import xxhash

        self.rule = rule
        self.hash = xxhash.xxh3_64_intdigest
        self.digest = xxhash.xxh3_128_digest
        self.words: dict[str, int] = {}
        n = rule.bands * ROWS
        made = np.random.default_rng(20240229)
        self.factor = made.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = made.integers(0, 2**63, n, dtype=np.uint64)
        self.fold = made.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; of all words where there are fewer than a shingle has."""
        words = FIND(fold_text(text))
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.words) > 500_000:
            self.words.clear()
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            for w in words:
                if w not in known:
                    known[w] = self.hash(w)
            found = [known[w] for w in words]
        h = np.array(found, dtype=np.uint64)
        size = min(self.rule.size, len(h))
        made = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            made = (made ^ h[k : len(h) - size + 1 + k]) * MIX
            made ^= made >> np.uint64(29)
        return np.unique(made)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024, None] * self.factor + self.offset
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def bands(self, minima: np.ndarray) -> np.ndarray:
        rows = (minima.reshape(-1, ROWS) ^ (minima.reshape(-1, ROWS) >> np.uint64(31))) * self.fold
        return (rows.sum(axis=1, dtype=np.uint64) * MIX).view(np.int64)

    def signature(self, minima: np.ndarray) -> bytes:
        """Two bits of each minimum, packed into words of 64 bits."""
        bits = (minima >> np.uint64(17)) & np.uint64(3)
        padded = np.zeros(-(-len(bits) // 32) * 32, dtype=np.uint64)
        padded[: len(bits)] = bits
        return np.bitwise_or.reduce(padded.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).tobytes()


_SHINGLERS: dict[Rule, Shingler] = {}


def _shingler(rule: Rule) -> Shingler:
    if rule not in _SHINGLERS:
        _SHINGLERS[rule] = Shingler(rule)
    return _SHINGLERS[rule]


def _described(rule: Rule):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(rule)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[], [], [], []]
                for text in part.column("text").to_pylist():
                    s = shingler.shingles(text)
                    minima = shingler.minima(s) if len(s) else None
                    out[0].append(len(s))
                    out[1].append(shingler.digest(s.tobytes()) if len(s) else None)
                    out[2].append(None if minima is None else shingler.signature(minima))
                    out[3].append(None if minima is None else shingler.bands(minima))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], *[pa.array(v, t) for v, t in zip(out, types)]],
                    names=[*names, "n_shingles", "set_key", "signature", "bands"],
                )

    return described


def _compare(rule: Rule, left: list, right: list | None) -> list[tuple[bytes, bytes]]:
    """Links between the sets of two parts, or inside one, that join what no earlier link of this call joins.

    A part is a list of (key, signature, sorted shingles).
    """
    sets = left + (right or [])
    m, split = len(sets), len(left)
    sizes = np.array([len(s[2]) for s in sets])
    signatures = np.array([np.frombuffer(s[1], dtype=np.uint64) for s in sets])
    values, flat = np.unique(np.concatenate([s[2] for s in sets]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values), dtype=np.int32)
    label = np.arange(m)
    most_unequal = int((1 - rule.least_equal) * rule.bands * ROWS)
    links = []
    for i in range(split if right is not None else m - 1):
        first = split if right is not None else i + 1
        unequal = signatures[first:] ^ signatures[i]
        unequal = np.bitwise_count((unequal | (unequal >> np.uint64(1))) & EVEN).sum(axis=1)
        maybe = first + np.flatnonzero((unequal <= most_unequal) & (label[first:] != label[i]))
        if not len(maybe):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        if 4 * len(maybe) > m:
            shared = np.add.reduceat(mark[flat], starts)[maybe]
        else:
            shared = np.array([mark[flat[starts[j] : starts[j] + sizes[j]]].sum() for j in maybe])
        mark[own] = 0
        for j in maybe[rule.linked(shared, sizes[i], sizes[maybe])]:
            if label[i] != label[j]:
                links.append((sets[i][0], sets[j][0]))
                label[label == label[j]] = label[i]
    return links


def _linked(rule: Rule):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block; of each block only the sets are held, not the texts."""
        shingler = _shingler(rule)
        block, sides = None, ({}, {})

        def done() -> pa.RecordBatch:
            left, right = ([(k, *v) for k, v in side.items()] for side in sides)
            _, i, j = block
            links = _compare(rule, left, None) if i == j else _compare(rule, left, right) if left and right else []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([a for a, _ in links], [b for _, b in links])], schema=schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cluster", "i", "j", "part", "set_key", "signature", "text"))
            for cluster, i, j, part, key, signature, text in zip(*columns):
                if (cluster, i, j) != block:
                    if block is not None:
                        yield done()
                    block, sides = (cluster, i, j), ({}, {})
                side = sides[int(part != i)]
                if key not in side:
                    side[key] = (signature, shingler.shingles(text))
        if block is not None:
            yield done()

    return linked


def _bitmap(positions: DataFrame) -> bytes:
    """At most ``BITMAP`` distinct numbers as a bitmap of that many bits."""
    bits = np.zeros(BITMAP, dtype=bool)
    bits[positions.distinct().toArrow().column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` with one text for each of its digests; texts that are not wanted are mostly not moved."""
    place = lambda d: (F.conv(F.substring(F.hex(d), 1, 8), 16, 10).cast("long") % BITMAP).cast("int")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(place(F.col("digest")))))

    def held(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)
        for p in places:
            yield pd.Series(known[p.to_numpy()])

    t = whole(F.col(text))
    some = docs.select(t.alias("text"), digest(t).alias("_digest"))
    some = some.filter(F.pandas_udf(held, "boolean")(place(F.col("_digest"))))
    # Copies are reduced to one in the task that reads them.
    one = some.groupBy("_digest").agg(F.first("text").alias("text"))
    return wanted.join(one, F.col("digest") == F.col("_digest")).drop("_digest")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def links(docs: DataFrame, sets: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """Links ``a, b`` between the keys of different sets of ``sets`` (``set_key, digest, signature, bands, n_shingles``).

    Their components are those of all links at the threshold.
    """
    banded = sets.select("set_key", F.posexplode("bands").alias("band", "value"))
    hubs = (
        banded.groupBy("band", "value")
        .agg(F.min("set_key").alias("hub"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    ties = banded.join(hubs, ["band", "value"]).filter("set_key <> hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b"))
    clusters = store(components(ties))
    members = sets.join(clusters, F.col("set_key") == F.col("node")).select("set_key", "digest", "signature", "n_shingles", F.col("root").alias("cluster"))
    sizes = members.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / PART_SETS, F.sum("n_shingles") / PART_SHINGLES)).cast("int").alias("parts")
    )
    placed = _texts(docs, text, members.drop("n_shingles")).join(sizes, "cluster")
    part = F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")
    blocks = (
        placed.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "part")
    )
    columns = blocks.select("cluster", "i", "j", "part", "set_key", "signature", "text")
    return columns.mapInArrow(_linked(rule), "a binary, b binary")


def group(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, n_shingles, component_id, kept, first`` of every row.

    ``digest`` tells texts apart. ``component_id`` is the smallest id that links reach, ``kept`` whether it is the
    row's own; ``first`` marks rows equal to the first one (by id, nulls last, then digest) of their component.
    Texts without words, null ones among them, are linked with nothing. A missing id is never a component's if
    another member has one. Repeated rows are copies.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    kind = dict(rows.dtypes)["doc_id"]
    shape = f"doc_id {kind}, digest binary, n_shingles long, set_key binary, signature binary, bands array<long>"
    described = store(rows.select("doc_id", "digest", "text").mapInArrow(_described(rule), shape))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("digest"))
    # All that a set's copies differ in is the id and the text, so any of them describes it.
    sets = store(
        described.filter("set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min(order).alias("low"),
            F.any_value("signature").alias("signature"),
            F.any_value("bands").alias("bands"),
            F.any_value("n_shingles").alias("n_shingles"),
        )
        .withColumn("digest", F.col("low.digest"))
    )
    roots = store(components(links(docs, sets, rule, text)))
    lows = sets.select("set_key", "low").join(roots, F.col("set_key") == F.col("node"), "left")
    root = F.coalesce("root", "set_key").alias("root")
    # Sets with links only: the others are their own component.
    joined = lows.filter("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    named = (
        lows.select("set_key", "low", root)
        .join(joined.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left")
        .select(F.col("set_key").alias("_set"), F.coalesce("least", "low").alias("least"))
    )
    own = F.coalesce(F.col("least.doc_id"), F.when(F.col("_set").isNull(), F.col("doc_id")))
    return (
        described.select("doc_id", "digest", "n_shingles", "set_key")
        .join(named, F.col("set_key") == F.col("_set"), "left")
        .select(
            "doc_id",
            "digest",
            "n_shingles",
            own.alias("component_id"),
            F.col("doc_id").eqNullSafe(own).alias("kept"),
            F.coalesce(F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.digest") == F.col("digest")), F.lit(True)).alias("first"),
        )
    )


def deduplicate(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns; texts without words stay, one for each id."""
    at, its_id, its_digest = (fresh(docs, n) for n in ("_digest", "_id", "_kept"))
    kept = group(docs, rule, doc_id, text).filter("first").select(F.col("doc_id").alias(its_id), F.col("digest").alias(its_digest)).distinct()
    rows = docs.withColumn(at, digest(whole(F.col(text))))
    return (
        rows.join(kept, (F.col(at) == F.col(its_digest)) & F.col(doc_id).eqNullSafe(F.col(its_id)), "left_semi")
        .dropDuplicates([doc_id, at])
        .drop(at)
    )


def report(docs: DataFrame) -> DataFrame:
    """Components at a similarity of 0.85 on shingles of three words."""
    grouped = group(docs.select("doc_id", "text"), Rule(size=3, percent=85))
    return grouped.select("doc_id", "n_shingles", "component_id", "kept")
