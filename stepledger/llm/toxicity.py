"""Toxicity by class-conditional Kneser-Ney models of the spelling of words.

Two models, of toxic and of ordinary texts, spell words byte by byte. Each discounts the counts of its
class and gives what that frees to one shared model, a Kneser-Ney model of both classes' counts that backs
off through continuation counts; so an expression that neither class shows often is about as likely in
both. The difference of the two log-likelihoods is taken per word: over the whole text, normalised by its
length, over its most toxic word, and over its three most toxic words that differ. A logistic curve fitted to labelled texts
that the models have not seen turns the three into a probability.

The models and the curve are fitted to at most ``LABELLED`` labelled rows, chosen by a hash of the id.
All grams of those rows count, however rare: they are a table of 64-bit numbers, brought together once by the last two
bytes of their contexts, under which all levels nest; tasks hold the differences as sorted arrays of 16 bytes a gram. Every text is then scored as a
whole, in the task that reads it. ``differences`` is the same for small counts in memory.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.llm.common import WORD, fold_text, whole
from stepledger.settings import release, store

LABELLED = 60_000  # rows, about; all of them where there are fewer
ORDER = 8  # bytes of a gram, the last of which is predicted; as many as a 64-bit number has
DISCOUNT = 0.75
RIDGE = 1.0
KEPT_WORDS = 300_000  # a worker remembers, and a task sums before it passes them on

# Bytes that UTF-8 never uses open and close a word.
OPEN, CLOSE = b"\xfe", b"\xfc"
FIND = re.compile(WORD).findall


def grams(word: str) -> list[bytes]:
    s = OPEN * (ORDER - 1) + word.encode() + CLOSE
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


class Level:
    """Counts of grams of one length, and of each context its total and its number of continuations."""

    def __init__(self, counts: dict[bytes, int]):
        self.counts = counts
        self.contexts: dict[bytes, list[int]] = {}
        for g, n in counts.items():
            c = self.contexts.setdefault(g[:-1], [0, 0])
            c[0] += n
            c[1] += 1

    def probability(self, gram: bytes, below: float) -> float:
        """Discounted, the rest shared out as ``below`` says; ``below`` for a context not seen."""
        context = self.contexts.get(gram[:-1])
        if context is None:
            return below
        total, kinds = context
        return (max(self.counts.get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * kinds * below) / total

    def freed(self, context: bytes) -> float:
        """The part of a context that its discounts leave to others; all of it for a context not seen."""
        total, kinds = self.contexts.get(context, (1, 1 / DISCOUNT))
        return DISCOUNT * kinds / total


def differences(counts: list[tuple[bytes, int, int]]) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """log-likelihood in toxic texts less that in ordinary ones, of each gram and, for grams not counted, of each context.

    ``counts``: gram, occurrences in ordinary texts, occurrences in toxic texts. What the shared model says cancels
    out for grams that neither class has counted: a class that knows the context gives them its freed part
    of it, a class that does not all of it.
    """
    ordinary, toxic = (Level({g: c[k] for g, *c in counts if c[k]}) for k in (0, 1))
    pooled = {g: a + b for g, a, b in counts}
    shared = [Level(pooled)]
    for _ in range(ORDER - 1):  # of shorter grams, in how many longer ones they end
        pooled = dict(Counter(g[1:] for g in pooled))
        shared.append(Level(pooled))
    of_gram = {}
    for g, _, _ in counts:
        p = 1 / 256
        for k in range(ORDER - 1, -1, -1):
            p = shared[k].probability(g[k:], p)
        of_gram[g] = log(toxic.probability(g, p)) - log(ordinary.probability(g, p))
    of_context = {c: log(toxic.freed(c)) - log(ordinary.freed(c)) for c in {*toxic.contexts, *ordinary.contexts}}
    return of_gram, of_context


def _short_grams(counted: DataFrame) -> np.ndarray:
    """What the shared model says of grams of two bytes, by gram. They are 65,536 at most, so the driver works them out."""
    tails = counted.select(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("tail")).distinct()
    found = tails.groupBy(F.col("tail").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    pair, n = (found.column(c).to_numpy() for c in ("pair", "n"))
    singles = np.bincount(pair & 255, minlength=256)
    one = (np.maximum(singles - DISCOUNT, 0.0) + DISCOUNT * np.count_nonzero(singles) / 256) / max(singles.sum(), 1)
    total, kinds = np.bincount(pair >> 8, n, 256), np.bincount(pair >> 8, minlength=256)
    two = np.zeros(1 << 16)
    two[pair] = (np.maximum(n - DISCOUNT, 0.0) + DISCOUNT * kinds[pair >> 8] * one[pair & 255]) / total[pair >> 8]
    return two


def _contexts(grams: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Contexts of sorted grams, the number of each gram's own, and of each context totals and continuations by counts."""
    contexts, own = np.unique(grams >> np.uint64(8), return_inverse=True)
    n = len(contexts)
    return contexts, own, [(np.bincount(own, c, n), np.bincount(own, c > 0, n)) for c in counts]


def _worked_out(two: np.ndarray):
    """Differences of the grams that share the last two bytes of their context: all their levels nest in one group."""

    def worked_out(table: pa.Table) -> pa.Table:
        grams = table.column("gram").to_numpy().view(np.uint64)
        counts = [table.column(c).to_numpy().astype(np.float64) for c in ("ordinary", "toxic")]
        levels, g, n = [], grams, counts[0] + counts[1]
        for size in range(ORDER, 2, -1):  # of shorter grams, in how many longer ones they end
            _, own, ((total, kinds),) = _contexts(g, n)
            shorter, at, times = np.unique(g & np.uint64((1 << 8 * (size - 1)) - 1), return_inverse=True, return_counts=True)
            levels.append((n, total[own], kinds[own], at))
            g, n = shorter, times.astype(np.float64)
        p = two[g.astype(np.int64)]
        for n, total, kinds, at in reversed(levels):
            p = (np.maximum(n - DISCOUNT, 0.0) + DISCOUNT * kinds * p[at]) / total
        contexts, own, sums = _contexts(grams, *counts)
        of_gram, of_context = np.zeros(len(grams)), np.zeros(len(contexts))
        for sign, c, (total, kinds) in zip((-1, 1), counts, sums):
            known, every = total > 0, np.maximum(total, 1)
            here = (np.maximum(c - DISCOUNT, 0.0) + DISCOUNT * kinds[own] * p) / every[own]
            of_gram += sign * np.log(np.where(known[own], here, p))
            of_context += sign * np.log(np.where(known, DISCOUNT * kinds / every, 1.0))
        keys = np.concatenate([grams, contexts]).view(np.int64)
        is_gram = np.arange(len(keys)) < len(grams)
        return pa.table({"is_gram": is_gram, "key": keys, "d": np.concatenate([of_gram, of_context])})

    return worked_out


def _table_differences(counted: DataFrame) -> DataFrame:
    """``differences`` of a written table (gram as a number, ordinary, toxic): ``is_gram``, ``key``, ``d``.

    Grams of three bytes and more have their contexts among those that end in the same two bytes, so one shuffle
    by these brings all levels together; the sample bounds the largest group.
    """
    ends = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("ends")
    worked_out = _worked_out(_short_grams(counted))
    return counted.groupBy(ends).applyInArrow(worked_out, "is_gram boolean, key long, d double")


def _sorted(differences: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and differences of grams, then of contexts."""
    found = differences.toArrow()
    is_gram = found.column("is_gram").to_numpy()
    keys, d = (found.column(c).to_numpy() for c in ("key", "d"))
    parts = []
    for which in (is_gram, ~is_gram):
        order = np.argsort(keys[which])
        parts.append((keys[which][order], d[which][order]))
    return parts[0], parts[1]


NONE = (np.zeros(0, np.int64), np.zeros(0))


def _lookup(of: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and their values."""
    known, d = of
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, d[at]


class Speller:
    """Differences of words and texts; a worker remembers its words."""

    def __init__(self, of_gram: tuple[np.ndarray, np.ndarray], of_context: tuple[np.ndarray, np.ndarray]):
        self.of_gram = of_gram
        self.of_context = of_context
        self.words: dict[str, float] = {}

    def spell(self, words: list[str]) -> list[float]:
        """The difference of each word, summed over its grams."""
        coded = [OPEN * (ORDER - 1) + w.encode() + CLOSE for w in words]
        sizes = np.array([len(c) for c in coded])
        stops = np.cumsum(sizes)
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(coded), np.uint8), ORDER)
        inside = np.ones(len(windows), bool)
        for back in range(1, ORDER):  # windows that run on into the next word
            inside[stops[:-1] - back] = False
        keys = np.ascontiguousarray(windows[inside]).view(">u8").ravel().astype(np.uint64)
        there, d = _lookup(self.of_gram, keys.view(np.int64))
        context, freed = _lookup(self.of_context, (keys >> np.uint64(8)).view(np.int64))
        d = np.where(there, d, np.where(context, freed, 0.0))
        starts = np.concatenate([[0], np.cumsum(sizes - (ORDER - 1))[:-1]])
        return np.add.reduceat(d, starts).tolist()

    def features(self, texts: list[str]) -> list[tuple[float, float, float]]:
        """Mean difference of a word, the largest, and the mean of the three largest that differ; zeros without words."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known, out = self.words, []
        for text in texts:
            words = FIND(fold_text(text))
            if not words:
                out.append((0.0, 0.0, 0.0))
                continue
            found = list(map(known.get, words))
            if None in found:
                new = [w for w in dict.fromkeys(words) if w not in known]
                known.update(zip(new, self.spell(new)))
                found = [known[w] for w in words]
            top = nlargest(3, set(found))
            out.append((sum(found) / len(found), top[0], sum(top) / len(top)))
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the texts as numbers, with their counts in ordinary and in toxic texts."""
    schema = pa.schema([("gram", pa.int64()), ("ordinary", pa.int64()), ("toxic", pa.int64())])
    words = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        made: dict[bytes, list[int]] = {}
        for k, counter in enumerate(words):
            for w, n in counter.items():
                for g in grams(w):
                    made.setdefault(g, [0, 0])[k] += n
            counter.clear()
        columns = [[int.from_bytes(g, "big", signed=True) for g in made], [a for a, _ in made.values()], [b for _, b in made.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words[toxic].update(FIND(fold_text(text)))
            if len(words[0]) + len(words[1]) > KEPT_WORDS:
                yield flush()
    yield flush()


@dataclass
class Classifier:
    words: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # sorted keys and differences of grams, of contexts
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the constant and the features

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.middle) / self.spread
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the first that of the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(words, spark, keep: list[str]):
    """A function for mapInArrow: the ``keep`` columns and the three features of ``text``."""
    shared = spark.sparkContext.broadcast(words)
    name = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SPELLERS:
            _SPELLERS.clear()
            _SPELLERS[name] = Speller(*shared.value)
        speller = _SPELLERS[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = speller.features(part.column("text").to_pylist())
                columns = [pa.array(c, pa.float64()) for c in zip(*found)] if found else [pa.array([], pa.float64())] * 3
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], *columns], names=[*keep, "f0", "f1", "f2"]
                )

    return made


_SPELLERS: dict[str, Speller] = {}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Fit to the ``usable`` rows of ``labels``, a condition on its columns; a document with several labels is toxic if one says so.

    Four in five of the sampled rows train the models, the others the curve. Null labels are passed over. With
    labels of one kind only, or none, every text gets the share of toxic labels.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(usable & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("toxic"))
    )
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000))
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(5))
    sample = known.filter(place < F.lit(1_000_000 * min(1.0, LABELLED / max(total, 1)))).withColumn("fold", fold)
    # About LABELLED short rows at most, whatever the size of the tables; so the texts stay where they are.
    texts = docs.select(F.col(doc_id).alias("_doc"), whole(F.col(text)).alias("text")).join(
        F.broadcast(sample), F.col("_doc") == F.col("_id")
    )
    share = (toxic + 1) / (total + 2)
    plain = Classifier((NONE, NONE), np.zeros(3), np.ones(3), np.array([log(share / (1 - share)), 0.0, 0.0, 0.0]))
    if toxic in (0, total):
        return plain
    counted = store(
        texts.filter("fold > 0")
        .select("text", "toxic")
        .mapInArrow(_count_words, "gram long, ordinary long, toxic long")
        .groupBy("gram")
        .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    # The sample bounds both: at most a gram for each byte of its texts.
    words = _sorted(_table_differences(counted))
    release(counted)
    rows = (
        texts.filter("fold = 0")
        .select("toxic", "text")
        .mapInArrow(_features(words, spark, ["toxic"]), "toxic int, f0 double, f1 double, f2 double")
        .toArrow()
    )
    x = np.column_stack([rows.column(c).to_numpy() for c in ("f0", "f1", "f2")])
    y = rows.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return plain
    order = np.lexsort((y, *x.T))  # the same sums whatever order the rows came in
    x, y = x[order], y[order]
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Classifier(words, middle, spread, logistic((x - middle) / spread, y))


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns with ``score``, the probability that the text is toxic. Null counts as the empty text."""
    rows = docs.select(*[F.col(c) for c in keep], whole(F.col(text)).alias("text"))
    features = _features(model.words, docs.sparkSession, list(keep))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in features(batches):
            x = np.column_stack([batch.column(c).to_numpy() for c in ("f0", "f1", "f2")])
            columns = [*[batch.column(c) for c in keep], pa.array(model.probability(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(scored, ", ".join([*kept, "score double"]))


def report(docs: DataFrame, labels: DataFrame, held) -> DataFrame:
    """Every document under the classifier of the labels that ``held``, a function of the id column, leaves."""
    model = fit(docs, labels, ~held(F.col("doc_id")))
    rows = docs.select("doc_id", "text", held(F.col("doc_id")).alias("held_out"))
    scored = score(rows, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
