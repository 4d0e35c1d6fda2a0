"""Prediction by partial matching: code lengths of whole texts under a byte-context trie of the corpus.

A text is one run of bytes, words and gaps alike, closed by an end symbol. Each byte is coded after the ``ORDER`` bytes
before it, whatever words they belong to. A symbol not seen in a context costs an escape, as likely as the context has
kinds of symbols, and is sought in the next shorter one, where the symbols of the longer context are excluded; one
that no context has seen is as likely as any other such.

The trie is the counts of all five-byte grams of the training texts: a shorter context's counts are sums of longer ones.
The code length of a byte depends on its gram alone, so it is worked out once for every distinct gram of the corpus.
Nothing of the corpus is held in one place:

1. Documents are packed into chunks, written once. Each chunk sends its distinct grams and words, with their training
   counts, to buckets of a hash range, which add them up and note where each chunk's keys stand among them.
2. Grams are regrouped by the last two bytes of their context, under which all longer contexts nest; what shorter
   contexts need are at most 65,536 counts, which every task gets.
3. The buckets give each chunk, by the noted places, the code lengths of its grams and the counts of its words, and chunks
   add them up by text. So a chunk is taken apart twice: to send its keys, and to add up what they are worth.

What leaves a chunk is distinct, so a word of every text reaches its bucket once a chunk. Null counts as the empty text,
whose code is the end symbol; equal texts have equal scores. Very long texts are chunks of their own. Without
training texts every symbol is equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col
from stepledger.llm.common import whole
from stepledger.llm.repeats import BUCKET_CHARS, CHUNK_CHARS, FACTOR, _groups, _order, _packed, _rows, _split
from stepledger.settings import store

ORDER = 4  # bytes of the longest context
SYMBOLS = 256
# Bytes that UTF-8 never uses stand before a text and close it.
PAD, END = b"\xff", b"\xfb"
GRAM, WORD = 0, 1  # kinds of keys
KEY_BYTES = {GRAM: 8, WORD: 16}


def grams(text: bytes) -> list[bytes]:
    """Each byte of a text, and its end, after the ``ORDER`` bytes before it."""
    s = PAD * ORDER + text + END
    return [s[i : i + ORDER + 1] for i in range(len(text) + 1)]


class Chunk:
    """The grams and words of a chunk's documents: distinct keys in order of their buckets, and where each one stands."""

    def __init__(self, body: bytes, buckets: int):
        table = pa.ipc.open_stream(body).read_all()
        self.ids = table.column("id").to_pylist()
        self.held = np.array(table.column("held").to_pylist(), dtype=bool)
        # bytes.lower() changes A-Z alone.
        texts = [t.encode().lower() for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self._words(texts, buckets)
        self._grams(texts, buckets)
        pa.default_memory_pool().release_unused()  # a worker stays, and what Arrow keeps for it adds up

    def _grams(self, texts: list[bytes], buckets: int) -> None:
        flat = np.frombuffer(b"".join(chain.from_iterable((PAD * ORDER, t, END) for t in texts)), dtype=np.uint8)
        # Windows that begin in a text's end symbol or run over it into the next text's padding are none.
        real = np.ones(len(flat), dtype=bool)
        real[np.cumsum(self.sizes + ORDER)[:, None] - np.arange(1, ORDER + 1)] = False
        n = len(flat) - ORDER
        made = np.zeros(n, dtype=np.uint64)
        for k in range(ORDER + 1):
            made <<= np.uint64(8)
            made |= flat[k : k + n]
        made = made[real[:n]]
        encoded = pa.array(made).dictionary_encode()  # by hashing: there are few distinct ones
        of, keys = encoded.indices.to_numpy(), encoded.dictionary.to_numpy()
        order, self.gram_bucket = self._by_bucket((keys * FACTOR) ^ ((keys * FACTOR) >> np.uint64(29)), buckets)
        self.grams, self.gram_of = keys[order], self._renumbered(order, of)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)

    def _words(self, texts: list[bytes], buckets: int) -> None:
        import xxhash

        words = [t.split() for t in texts]  # bytes are split at the blanks of ``WORD``, and at no others
        self.n_words = np.array([len(w) for w in words], dtype=np.int64)
        self.word_doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words)
        encoded = pa.array(list(chain.from_iterable(words)), pa.large_binary()).dictionary_encode()
        of, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_numpy(zero_copy_only=False)
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        order, self.word_bucket = self._by_bucket(lanes[:, 0], buckets)
        self.words, self.word_of = lanes[order], self._renumbered(order, of)

    @staticmethod
    def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order].astype(np.int64)

    @staticmethod
    def _renumbered(order: np.ndarray, of: np.ndarray) -> np.ndarray:
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return place[of]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the distinct grams and words."""
        return (
            np.bincount(self.gram_of[~self.held[self.doc]], minlength=len(self.grams)),
            np.bincount(self.word_of[~self.held[self.word_doc]], minlength=len(self.words)),
        )


KEYS = "bucket int, kind int, chunk binary, keys binary, counts binary"


def _keyed(buckets: int):
    """A row for each chunk, bucket and kind: the distinct keys and their training counts."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body"))):
                chunk = Chunk(body, buckets)
                kinds = zip((GRAM, WORD), (chunk.gram_bucket, chunk.word_bucket), (chunk.grams, chunk.words), chunk.counts())
                rows = []
                for kind, bucket, keys, n in kinds:
                    parts = _split(bucket) if len(bucket) else ()
                    rows += [(b, kind, name, keys[i:j].tobytes(), n[i:j].tobytes()) for b, i, j in parts]
                yield _rows(schema, rows)

    return keyed


def _known(kind: int, keys: bytes) -> np.ndarray:
    """Keys as sortable values: grams as numbers, words as pairs of lanes."""
    flat = np.frombuffer(keys, dtype=np.uint64)
    return flat if kind == GRAM else flat.view([("a", np.uint64), ("b", np.uint64)])


def _sorted(keys: np.ndarray) -> np.ndarray:
    """The order of the keys; pairs are sorted by their first lane, which is much cheaper."""
    return _order(keys["a"], keys["b"]) if keys.dtype.names else np.argsort(keys)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each key its place among them."""
    order = _sorted(keys)
    firsts = _groups(keys[order])
    of = np.empty(len(keys), dtype=np.int32)
    of[order] = np.repeat(np.arange(len(firsts), dtype=np.int32), np.diff(np.r_[firsts, len(keys)]))
    return keys[order[firsts]], of


def _summed(table: pa.Table) -> pa.Table:
    """The keys of one bucket and kind in order, each once, with their summed counts; then the places of each chunk's keys.

    The keys make one binary, which holds less than 2**31 bytes, so a place fits into four.
    """
    bucket, kind = table.column("bucket")[0].as_py(), table.column("kind")[0].as_py()
    parts = table.column("keys").to_pylist()
    keys, of = _distinct(_known(kind, b"".join(parts)))
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, of, np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64))
    ends = np.cumsum([len(p) for p in parts]) // KEY_BYTES[kind]
    rows = [(bucket, kind, None, keys.tobytes(), n.tobytes(), int(n.sum()), int((n > 0).sum()), None)]
    for chunk, i, j in zip(table.column("chunk").to_pylist(), np.r_[0, ends[:-1]], ends):
        rows.append((bucket, kind, chunk, None, None, None, None, of[i:j].tobytes()))
    return pa.Table.from_batches([_rows(SUMMED, rows)])


SUMMED = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]
    + [("total", pa.int64()), ("kinds", pa.int64()), ("places", pa.binary())]
)
SUMMED_NAMES = "bucket int, kind int, chunk binary, keys binary, counts binary, total long, kinds long, places binary"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of the last two bytes of the grams."""
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for keys, counts in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts"))):
            np.add.at(total, (np.frombuffer(keys, np.uint64) & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(counts, np.int64))
    pair = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], names=["pair", "n"])


def _by_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of a bucket, dealt by the last two bytes of their contexts."""
    schema = pa.schema([("ends", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
            g, n = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
            ends = ((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(ends, kind="stable")
            ends, g, n = ends[order], g[order], n[order]
            yield _rows(schema, [(e, bucket, g[i:j].tobytes(), n[i:j].tobytes()) for e, i, j in _split(ends)])


def code_lengths(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of each gram after the others.

    ``grams`` are all those whose contexts end in the same two bytes, distinct, with their training ``counts``;
    ``pairs`` the counts of all grams of two bytes.
    """
    last = (grams & np.uint64(0xFF)).astype(np.int64)
    n4 = counts.astype(np.float64)
    _, of4 = np.unique(grams >> np.uint64(8), return_inverse=True)
    short, of_short = np.unique(grams & np.uint64(0xFFFFFFFF), return_inverse=True)  # three bytes of context
    short_last = (short & np.uint64(0xFF)).astype(np.int64)
    n3 = np.bincount(of_short, n4)
    _, of3 = np.unique(short >> np.uint64(8), return_inverse=True)
    n2 = np.bincount(short_last, n3, SYMBOLS)
    n1 = pairs.reshape(SYMBOLS, SYMBOLS)[int((int(grams[0]) >> 8) & 0xFF)].astype(np.float64)
    n0 = pairs.reshape(SYMBOLS, SYMBOLS).sum(axis=0).astype(np.float64)
    own3 = of3[of_short]
    # For each order: count of the symbol, of all symbols, of kinds, and what the next shorter context counts of its symbols.
    orders = [
        (n4, np.bincount(of4, n4)[of4], np.bincount(of4, n4 > 0)[of4], np.bincount(of4, (n4 > 0) * n3[of_short])[of4]),
        (n3[of_short], np.bincount(of3, n3)[own3], np.bincount(of3, n3 > 0)[own3], np.bincount(of3, (n3 > 0) * n2[short_last])[own3]),
        (n2[last], n2.sum(), (n2 > 0).sum(), n1[n2 > 0].sum()),
        (n1[last], n1.sum(), (n1 > 0).sum(), n0[n1 > 0].sum()),
        (n0[last], n0.sum(), (n0 > 0).sum(), 0.0),
    ]
    p, found = np.ones(len(grams)), np.zeros(len(grams), dtype=bool)
    hidden, hidden_kinds = np.zeros(len(grams)), np.zeros(len(grams))
    for n, total, kinds, below in orders:
        n, total, kinds, below = (np.broadcast_to(x, len(grams)) for x in (n, total, kinds, below))
        there = (kinds > 0) & ~found
        escape = kinds - hidden_kinds
        every = total - hidden + escape
        share = np.maximum(every, 1e-300)
        p = np.where(there & (n > 0), p * n / share, np.where(there & (every > 0), p * escape / share, p))
        found = found | (there & (n > 0))
        hidden, hidden_kinds = np.where(kinds > 0, below, hidden), np.where(kinds > 0, kinds, hidden_kinds)
    p = np.where(found, p, p / (SYMBOLS - hidden_kinds))
    return np.log10(p)


def _coded(pairs: np.ndarray):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def coded(table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        grams = np.frombuffer(b"".join(parts), np.uint64)
        lengths = code_lengths(grams, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64), pairs)
        ends = np.cumsum([len(p) // 8 for p in parts]).tolist()
        rows = [(b, GRAM, p, lengths[e - len(p) // 8 : e].tobytes()) for b, p, e in zip(table.column("bucket").to_pylist(), parts, ends)]
        return pa.Table.from_batches([_rows(schema, rows)])

    return coded


def _given_back(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each chunk the values of its keys in one bucket and kind, in its own order."""
    schema = pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("kind", pa.int32()), ("values", pa.binary())])
    if not asked.num_rows:
        return schema.empty_table()
    bucket, kind = asked.column("bucket")[0].as_py(), asked.column("kind")[0].as_py()
    keys = _known(kind, b"".join(known.column("keys").to_pylist()))
    values = np.frombuffer(b"".join(known.column("values").to_pylist()), dtype=np.int64)  # eight bytes of either kind
    values = values[_sorted(keys)]
    rows = [(c, bucket, kind, values[np.frombuffer(p, np.int32)].tobytes()) for c, p in zip(asked.column("chunk").to_pylist(), asked.column("places").to_pylist())]
    return pa.Table.from_batches([_rows(schema, rows)])


def _scored(buckets: int, tokens: int, kinds: int, ends: int, shape: pa.Schema):
    # The end of a text is a token like the words, and was counted with every training text.
    every, distinct = tokens + ends, kinds + (ends > 0)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (every + distinct + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, given in zip(*(batch.column(c).to_pylist() for c in ("body", "given"))):
                chunk = Chunk(body, buckets)
                found = {(g["kind"], g["bucket"]): g["values"] for g in given or ()}
                values = []
                for kind, bucket, dtype in ((GRAM, chunk.gram_bucket, np.float64), (WORD, chunk.word_bucket, np.int64)):
                    parts = [np.frombuffer(found[kind, b], dtype) for b, _, _ in (_split(bucket) if len(bucket) else ())]
                    values.append(np.concatenate(parts) if parts else np.zeros(0, dtype))
                n = len(chunk.ids)
                score = np.bincount(chunk.doc, values[0][chunk.gram_of], n)
                count = values[1][chunk.word_of]
                known = np.bincount(chunk.word_doc, count > 0, n).astype(np.int64) + (ends > 0)
                plain = np.bincount(chunk.word_doc, base(count), n) + base(np.array(ends))
                rows = zip(chunk.ids, chunk.held.tolist(), (chunk.n_words + 1).tolist(), known.tolist(), [every] * n, plain.tolist(), score.tolist())
                yield _rows(shape, list(rows))

    return scored


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Every row's score under the trie of the rows not ``held``, and under their plain token counts.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, the last two as log10. A null condition
    counts as not held. ``chunk_chars`` bounds the texts that a task holds at a time, but for a longer text.
    """
    spark = docs.sparkSession
    rows = docs.select(col(doc_id).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), whole(col(text)).alias("text"))
    ends = rows.filter(~F.col("held")).count()
    chunks = store(rows.mapInArrow(_packed(chunk_chars), "chunk binary, chars long, body binary"))
    chars = chunks.agg(F.sum("chars")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    bodies = chunks.select("chunk", "body")
    made = store(bodies.mapInArrow(_keyed(buckets), KEYS).groupBy("bucket", "kind").applyInArrow(_summed, SUMMED_NAMES))
    summed = made.filter(F.col("chunk").isNull())
    asked = made.filter(F.col("chunk").isNotNull()).select("bucket", "kind", "chunk", "places")
    tokens, kinds = summed.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    of_grams = summed.filter(F.col("kind") == GRAM).select("bucket", "keys", "counts")
    # At most a row for each two bytes.
    found = of_grams.mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(1 << 16, dtype=np.int64)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    dealt = of_grams.mapInArrow(_by_ends, "ends int, bucket int, keys binary, counts binary")
    lengths = dealt.groupBy("ends").applyInArrow(_coded(pairs), "bucket int, kind int, keys binary, values binary")
    counts = summed.filter(F.col("kind") == WORD).select("bucket", "kind", "keys", F.col("counts").alias("values"))
    known = lengths.unionByName(counts).groupBy("bucket", "kind")
    given = asked.groupBy("bucket", "kind").cogroup(known).applyInArrow(_given_back, "chunk binary, bucket int, kind int, values binary")
    # For one chunk at most eight bytes for each of its distinct grams and words.
    by_chunk = given.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "values")).alias("given"))
    shape = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
        + [("base_score", pa.float64()), ("score", pa.float64())]
    )
    named = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return bodies.join(by_chunk, "chunk", "left").mapInArrow(_scored(buckets, int(tokens), int(kinds), ends, shape), named)


def report(docs: DataFrame, held: Column) -> DataFrame:
    """Every document under the model of those not ``held``."""
    return score(docs.select("doc_id", "text", held.alias("held_out")), F.col("held_out"))
