"""Removal of passages that repeat across documents, by fixed-block anchors.

A passage counts as repeated if ``WINDOW`` (13) consecutive words of it also occur in a document with a smaller id. Each
document is cut into blocks of ``BLOCK`` (7) words that do not overlap. Wherever a window of 13 words lies, a whole
block of its document lies in it, so two equal windows have an anchor: a block of the one that is equal to some 7
words of the other, at the same offset.

1. Documents are packed into chunks, written once. Of each chunk the hashes of all rolling windows of 7 words go to
   buckets of the hash range; those at block borders are marked as the index, all are probes.
2. A bucket tells each chunk which of its hashes are anchors: held by a block, and found somewhere else as well.
3. Chunks extend their anchors: of each, the 13-word windows that hold it are looked up by 128-bit fingerprints,
   which meet in buckets with the smallest id that the chunk has for each. A bucket tells a chunk which of its windows
   an earlier document holds.
4. Confirmed windows that overlap or touch grow together into maximal repeats, whose words go.

What leaves a chunk is distinct, however often a passage stands in it, so a hash that every document has reaches its
bucket once a chunk; pairs of documents are never formed. A truncated hash of 7 words only lets
further windows be looked up. Two different windows of 13 words would be taken for equal with a probability of about
2**-120 a pair.

Null texts, and texts of less than 13 words, lose nothing. Windows are judged on the input, not on what is left. A missing
id comes after all others; rows of one id, and rows without any, do not take from each other. Repeated rows are alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col
from stepledger.llm.common import WORD, whole
from stepledger.settings import store

WINDOW = 13  # words of the shortest repeat
BLOCK = (WINDOW + 1) // 2  # the largest block that every window of that length holds whole
CHUNK_CHARS = 4_000_000  # a chunk ends here; one text may be longer
BUCKET_CHARS = 24_000_000  # of texts, for each bucket

FIND = re.compile(WORD).findall
FACTOR = np.uint64(0x9E3779B97F4A7C15)
IN_BLOCK, AGAIN = np.uint32(1), np.uint32(2)  # flags in the two lowest bits of a probe
NO_ID = np.iinfo(np.int64).max


class Numbering(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _packed(chunk_chars: int):
    """Rows (chunk, chars, body): a body is an Arrow stream of ids and texts."""
    schema = pa.schema([("chunk", pa.binary()), ("chars", pa.int64()), ("body", pa.binary())])

    def body(parts: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in parts:
                out.write_batch(part)
        return sink.getvalue().to_pybytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            chars = pa.compute.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(chars)
            start = 0
            while start < batch.num_rows:
                gone = int(ends[start]) - int(chars[start])
                # What fits into the chunk; at least one text into an empty one.
                stop = int(np.searchsorted(ends, gone + chunk_chars - size, side="right"))
                stop = max(stop, start + 1) if not waiting else max(stop, start)
                if stop > start:
                    waiting.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1]) - gone
                    start = stop
                if start < batch.num_rows:
                    yield _rows(schema, [(uuid.uuid4().bytes, size, body(waiting))])
                    waiting, size = [], 0
        if waiting:
            yield _rows(schema, [(uuid.uuid4().bytes, size, body(waiting))])

    return packed


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    return h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring words."""
    n = max(len(h) - size + 1, 0)
    made = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        made = made * FACTOR + h[k : k + n]
    return _mixed(made)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``keys``."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)


def _order(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The order by both lanes; the first alone decides unless two fingerprints share it."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    return np.lexsort((two, one)) if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])) else order


class Chunk:
    """The words of a chunk's documents in a row, and hashes of them."""

    def __init__(self, body: bytes, buckets: int):
        import xxhash

        table = pa.ipc.open_stream(body).read_all()
        self.buckets = buckets
        self.ids = table.column("id").to_pylist()
        self.words = [FIND(t) for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        numbers = Numbering()
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(self.words)), dtype=np.int64, count=int(self.sizes.sum()))
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        self.one, self.two = lanes[flat, 0], lanes[flat, 1]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.rank = np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)

    def whole(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those places whose next ``size`` words are of one document that has a window."""
        doc = self.doc[at]
        return at[(at + size <= self.starts[doc] + self.sizes[doc]) & (self.sizes[doc] >= WINDOW)]

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all rolling windows of a block's length, and for each its bucket and shortened hash in one number."""
        at = self.whole(np.arange(len(self.doc)), BLOCK)
        h = _rolled(self.one, BLOCK)[at]
        return at, (_bucket(h, self.buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFC))

    def windows(self, hits: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows that hold an anchor: buckets, both lanes and smallest ids, in order; for each place its window."""
        at, probe = self.probes()
        # Sorted in each bucket, so altogether.
        known = np.concatenate(
            [(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, dtype=np.uint32).astype(np.uint64) for b, k in sorted(hits)]
        )
        anchors = np.zeros(len(self.doc) + 1, dtype=np.int64)
        anchors[at[known[np.minimum(np.searchsorted(known, probe), len(known) - 1)] == probe] + 1] = 1
        before = np.cumsum(anchors)
        at = self.whole(np.arange(len(self.doc)), WINDOW)
        at = at[before[at + WINDOW - BLOCK + 1] > before[at]]
        one, two, rank = _rolled(self.one, WINDOW)[at], _rolled(self.two, WINDOW)[at], self.rank[self.doc[at]]
        order = _order(one, two)  # so in order of buckets, too
        one, two = one[order], two[order]
        first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, dtype=np.int64)
        of = np.full(len(self.doc), -1)
        of[at[order]] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(one)]))
        least = np.minimum.reduceat(rank[order], first) if len(first) else rank[:0]
        return _bucket(one[first], self.buckets).astype(np.int64), one[first], two[first], least, of


def _split(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    first = _groups(buckets)
    for a, b in zip(first.tolist(), np.r_[first[1:], len(buckets)].tolist()):
        yield int(buckets[a]), a, b


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, schema)], schema=schema)


def _probed(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("probes", pa.binary())])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body"))):
                made = Chunk(body, buckets)
                at, probe = made.probes()
                in_block = (at - made.starts[made.doc[at]]) % BLOCK == 0
                order = np.argsort(probe, kind="stable")
                probe, in_block = probe[order], in_block[order]
                first = _groups(probe)
                if not len(first):
                    continue
                again = np.diff(np.r_[first, len(probe)]) > 1
                flags = np.bitwise_or.reduceat(in_block, first) * IN_BLOCK + again * AGAIN
                probe = probe[first]
                short = (probe & np.uint64(0xFFFFFFFF)).astype(np.uint32) | flags.astype(np.uint32)
                yield _rows(schema, [(b, chunk, short[i:j].tobytes()) for b, i, j in _split(probe >> np.uint64(32))])

    return probed


def _anchored(table: pa.Table) -> pa.Table:
    """Of a bucket's probes, for each chunk, those that are anchors."""
    chunks = table.column("chunk").to_pylist()
    parts = [np.frombuffer(p, dtype=np.uint32) for p in table.column("probes").to_pylist()]
    flat = np.concatenate(parts)
    key = flat & ~(IN_BLOCK | AGAIN)
    order = np.argsort(key, kind="stable")
    first = _groups(key[order])
    flags = np.bitwise_or.reduceat(flat[order], first)
    count = np.diff(np.r_[first, len(flat)])
    anchor = ((flags & IN_BLOCK) > 0) & ((count > 1) | ((flags & AGAIN) > 0))
    is_anchor = np.empty(len(flat), dtype=bool)
    is_anchor[order] = np.repeat(anchor, count)
    ends = np.cumsum([len(p) for p in parts])
    bucket = table.column("bucket")[0].as_py()
    rows = [(c, bucket, key[e - len(p) : e][is_anchor[e - len(p) : e]].tobytes()) for c, p, e in zip(chunks, parts, ends.tolist())]
    schema = pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("hits", pa.binary())])
    return pa.Table.from_batches([_rows(schema, [r for r in rows if r[2]])])


def _extended(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("one", pa.binary()), ("two", pa.binary()), ("least", pa.binary())])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body, hits in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body", "hits"))):
                bucket, one, two, least, _ = Chunk(body, buckets).windows([(h["bucket"], h["hits"]) for h in hits])
                yield _rows(
                    schema, [(b, chunk, one[i:j].tobytes(), two[i:j].tobytes(), least[i:j].tobytes()) for b, i, j in _split(bucket)]
                )

    return extended


def _confirmed(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, for each chunk, a bit whether an id below the chunk's smallest holds the window, too."""
    parts = [np.frombuffer(p, dtype=np.int64) for p in table.column("least").to_pylist()]
    one, two = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.uint64) for c in ("one", "two"))
    least = np.concatenate(parts)
    order = _order(one, two)
    a, b = one[order], two[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    earlier = np.empty(len(least), dtype=bool)
    lowest = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.r_[first, len(order)]))
    earlier[order] = lowest < least[order]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    bucket = table.column("bucket")[0].as_py()
    rows = [
        (c, bucket, np.packbits(earlier[e - len(p) : e]).tobytes()) for c, p, e in zip(table.column("chunk").to_pylist(), parts, ends)
    ]
    return pa.Table.from_batches([_rows(pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("bits", pa.binary())]), rows)])


def _cut(buckets: int, shape: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, hits, flags in zip(*(batch.column(c).to_pylist() for c in ("body", "hits", "flags"))):
                chunk = Chunk(body, buckets)
                gone = np.zeros(len(chunk.doc) + 1, dtype=bool)
                if hits:
                    bucket, _, _, least, of = chunk.windows([(h["bucket"], h["hits"]) for h in hits])
                    bits = {f["bucket"]: f["bits"] for f in flags or ()}
                    earlier = np.zeros(len(bucket), dtype=bool)
                    for b, i, j in _split(bucket):
                        earlier[i:j] = np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=j - i).astype(bool)
                    at = np.flatnonzero(of >= 0)
                    at = at[earlier[of[at]] | (chunk.rank[chunk.doc[at]] > least[of[at]])]
                    edge = np.zeros(len(chunk.doc) + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    gone = np.cumsum(edge) > 0
                rows = []
                for i, words, start in zip(chunk.ids, chunk.words, chunk.starts.tolist()):
                    own = gone[start : start + len(words)]
                    edges = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2).tolist()
                    kept = [w for w, g in zip(words, own.tolist()) if not g] if edges else words
                    rows.append((i, len(words), [{"start": a, "end": b} for a, b in edges], " ".join(kept)))
                yield _rows(shape, rows)

    return cut


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``n_words``, ``repeats`` (word spans, end exclusive) and ``kept``.

    ``kept`` is the words outside the repeats, joined by one space. The id is a whole number. ``chunk_chars`` bounds the
    texts that a task holds at a time, but for a longer text.
    """
    spark = docs.sparkSession
    rows = docs.select(col(doc_id).cast("long").alias("id"), whole(col(text)).alias("text"))
    chunks = store(rows.mapInArrow(_packed(chunk_chars), "chunk binary, chars long, body binary"))
    chars = chunks.agg(F.sum("chars")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    bodies = chunks.select("chunk", "body")
    probes = bodies.mapInArrow(_probed(buckets), "bucket int, chunk binary, probes binary")
    anchors = probes.groupBy("bucket").applyInArrow(_anchored, "chunk binary, bucket int, hits binary")
    # For one chunk at most a number for each of its words.
    hits = store(anchors.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hits")).alias("hits")))
    windows = bodies.join(hits, "chunk").mapInArrow(
        _extended(buckets), "bucket int, chunk binary, one binary, two binary, least binary"
    )
    confirmed = windows.groupBy("bucket").applyInArrow(_confirmed, "chunk binary, bucket int, bits binary")
    flags = confirmed.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("repeats", span), ("kept", pa.string())])
    return (
        bodies.join(hits, "chunk", "left")
        .join(flags, "chunk", "left")
        .mapInArrow(_cut(buckets, shape), "doc_id long, n_words long, repeats array<struct<start:long,end:long>>, kept string")
    )


def report(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
