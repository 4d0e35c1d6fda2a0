"""Byte-level BPE by recursive queries: each task encodes its words in a DuckDB database of its own.

A text is cut by the tokenizer's pattern. The distinct pieces of a batch become rows of (word,
position, token), first one token for each byte; a recursive query joins neighbouring tokens to the
merge table, contracts each word's leftmost pair of minimum rank, and goes on with the words that
still have a pair until none has. Decoding joins ids to the vocabulary and aggregates them in order.

A recursive query keeps the rows of every round, at most half the square of a word's bytes: parts are bounded by that
sum, so that a query holds about ``ROWS_AT_ONCE`` rows. Pieces of more than ``SHORT`` bytes, which a query would take a
round for each merge of, go through a heap of their pairs instead: the same contractions, in n log n steps.

Like the public library, a piece that is a token as a whole is that token. Null counts as the empty text, which has
no ids; a batch is bounded by bytes, but for one longer text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import col
from stepledger.llm.common import fresh, whole

WORDS_AT_ONCE = 20_000  # distinct words of one recursive query
SHORT = 256  # bytes of the longest word in it
ROWS_AT_ONCE = 4_000_000  # of all its rounds, about
DOCS_AT_ONCE = 1_024
CHARS_AT_ONCE = 2_000_000  # a batch ends at either; one text may be longer
KEPT_WORDS = 150_000  # in each of two generations of remembered words

# A place is word * 4096 + position. The least of rank * 4096 + position is the leftmost pair of minimum rank.
ENCODE = """
WITH RECURSIVE step(round, x, t, k) AS (
  SELECT 0, a.w * 4096::BIGINT + a.p, a.t, merges.k
  FROM symbols a LEFT JOIN symbols b ON b.w = a.w AND b.p = a.p + 1
  LEFT JOIN merges ON merges.l = a.t AND merges.r = b.t
  UNION ALL
  (WITH best AS (
     SELECT x // 4096 AS w, min(k::BIGINT * 4096 + x % 4096) AS b FROM step WHERE k IS NOT NULL GROUP BY 1),
   contracted AS (
     SELECT round + 1 AS round, CASE WHEN x % 4096 > b % 4096 THEN x - 1 ELSE x END AS x,
            CASE WHEN x % 4096 = b % 4096 THEN (b // 4096)::INTEGER ELSE t END AS t
     FROM step JOIN best ON x // 4096 = w WHERE x % 4096 <> b % 4096 + 1)
   SELECT a.round, a.x, a.t, merges.k
   FROM contracted a LEFT JOIN contracted b ON b.x = a.x + 1
   LEFT JOIN merges ON merges.l = a.t AND merges.r = b.t)
)
SELECT x // 4096 AS w, t
FROM step JOIN (SELECT x // 4096 AS w, max(round) AS round FROM step GROUP BY 1) AS last
  ON last.w = x // 4096 AND last.round = step.round
ORDER BY x
"""

DECODE = """
SELECT w, string_agg(hex, '' ORDER BY p) AS hex
FROM coded JOIN vocabulary ON vocabulary.t = coded.t
GROUP BY w
"""


def read_ranks(path: str) -> bytes:
    """The rank file as it is; it travels to the tasks, which need no copy of their own."""
    with open(path, "rb") as f:
        return f.read()


class Coder:
    """Merge table, vocabulary and remembered words of one Python worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        import tempfile

        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.young: dict[str, tuple[bytes, bytes]] = {}  # ids and decoded bytes
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir()})
        pairs = [
            (a, b, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None
        ]
        left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*pairs))
        self._keep("merges", l=left, r=right, k=rank)
        self._keep(
            "vocabulary",
            t=np.array(list(self.ranks.values()), dtype=np.int32),
            hex=[token.hex() for token in self.ranks],
        )

    def _keep(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed; none is empty or a token as a whole."""
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = np.arange(sizes.sum(), dtype=np.int64) - np.repeat(starts, sizes) + 1
        tokens = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.db.register("symbols", pa.table({"w": owner, "p": place, "t": tokens}))
        found = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("symbols")
        ends = 4 * np.cumsum(np.bincount(np.asarray(found["w"]), minlength=len(words)))
        packed = np.asarray(found["t"]).astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _encode_long(self, piece: bytes) -> bytes:
        """Ids of one piece: its pairs wait in a heap by rank, then place; a pair whose tokens have changed is passed over."""
        n, rank_of = len(piece), self.ranks.get
        token: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if token[i] is None or j >= n or token[i] + token[j] != both:
                continue
            token[i], token[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank_of(pair := token[a] + token[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, pair))
        return np.array([self.ranks[t] for t in token if t is not None], dtype="<u4").tobytes()

    def _decode(self, ids: Sequence[bytes]) -> list[bytes]:
        sizes = np.array([len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.db.register("coded", pa.table({"w": owner, "p": np.arange(len(flat)), "t": flat}))
        found = self.db.execute(DECODE).fetchnumpy()
        self.db.unregister("coded")
        out = [b""] * len(ids)
        for w, text in zip(found["w"].tolist(), found["hex"]):
            out[w] = bytes.fromhex(text)
        return out

    def _learn(self, words: set[str]) -> None:
        """Remember the ids and the decoded bytes of ``words``."""
        young, old = self.young, self.old
        fresh = []
        for w in words:
            if w not in young:
                known = old.get(w)
                if known is None:
                    fresh.append(w)
                else:
                    young[w] = known
        whole_tokens, short, long = [], [], []
        for w in fresh:
            b = w.encode()
            (whole_tokens if b in self.ranks else short if len(b) <= SHORT else long).append((w, b))
        for part in _bounded(whole_tokens):
            self._remember(part, [self.ranks[b].to_bytes(4, "little") for _, b in part])
        for part in _bounded(short):
            self._remember(part, self._encode([b for _, b in part]))
        for part in _bounded(long):
            self._remember(part, [self._encode_long(b) for _, b in part])

    def _remember(self, part: list[tuple[str, bytes]], ids: list[bytes]) -> None:
        for (w, _), x, back in zip(part, ids, self._decode(ids)):
            self.young[w] = (x, back)

    def code(self, texts: Sequence[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and their decoded bytes."""
        cut = [self.pieces(t) for t in texts]
        self._learn(set().union(*cut))
        get = self.young.__getitem__
        out = []
        for ws in cut:
            got = list(map(get, ws))
            out.append((b"".join([x for x, _ in got]), b"".join([x for _, x in got])))
        if len(self.young) > KEPT_WORDS:  # words not asked for since the last turn go
            self.old, self.young = self.young, {}
        return out


def _bounded(words: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """Parts of bounded number and rows of all rounds."""
    part, size = [], 0
    for w in words:
        rows = len(w[1]) ** 2 // 2
        if part and (len(part) >= WORDS_AT_ONCE or size + rows > ROWS_AT_ONCE):
            yield part
            part, size = [], 0
        part.append(w)
        size += rows
    if part:
        yield part


_CODERS: dict[tuple[int, str], Coder] = {}


def _coder(rank_file: bytes, pattern: str) -> Coder:
    key = (hash(rank_file), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(rank_file, pattern)
    return _CODERS[key]


def batches(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of bounded number and length."""
    part, chars = [], 0
    for t in texts:
        t = t.as_py()
        if part and (len(part) >= DOCS_AT_ONCE or chars + len(t) > CHARS_AT_ONCE):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


def _coded(docs: DataFrame, path: str, pattern: str, text: Column | None, out: str, packed: bool) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    others = [c for c in docs.columns if c != out]
    ids_type = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    struct = T.StructType([T.StructField("ids", ids_type), T.StructField("decoded", T.BinaryType())])
    shape = T.StructType([*[docs.schema[c] for c in others], T.StructField(out, struct)])

    def coded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in rows:
            at = 0
            for part in batches(batch.column(0)):
                made = coder.code(part)
                ids = [i for i, _ in made]
                if packed:
                    given = pa.array(ids, pa.binary())
                else:
                    ends = np.cumsum([0, *[len(i) // 4 for i in ids]])
                    given = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                both = pa.StructArray.from_arrays([given, pa.array([d for _, d in made], pa.binary())], names=["ids", "decoded"])
                columns = [c.slice(at, len(part)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, both], names=[*batch.schema.names[1:], out])
                at += len(part)

    t = fresh(docs, "_t")
    rows = docs.select(whole(F.col("text") if text is None else text).alias(t), *[col(c) for c in others])
    return rows.mapInArrow(coded, shape)


def encode(docs: DataFrame, path: str, pattern: str, text: Column | None = None, out: str = "bpe") -> DataFrame:
    """``docs`` with the struct ``out``: ``ids`` array<int> and ``decoded`` binary, the bytes those ids stand for.

    Null counts as the empty text, which has no ids. ``path`` names a rank file of base64 tokens and
    their ranks, ``pattern`` cuts the text before the merges. Rows are not shuffled, and leave a task in batches of
    bounded size.
    """
    return _coded(docs, path, pattern, text, out, packed=False)


def pack(docs: DataFrame, path: str, pattern: str, text: Column | None = None, out: str = "bpe") -> DataFrame:
    """As ``encode``, with the ids as the bytes of little-endian unsigned 32-bit integers."""
    return _coded(docs, path, pattern, text, out, packed=True)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = pack(docs.select("doc_id", "text"), path, pattern)
    ids, decoded = F.col("bpe")["ids"], F.col("bpe")["decoded"]
    return coded.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
