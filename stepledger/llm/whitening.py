"""Whitening of embeddings by their leading principal components.

Three reads of the vectors, none of which shuffles them. The first sums each dimension; the second sums the
products of the centred entries, one matrix for each task, added up entry by entry on Spark; the
last projects every vector. Only the d by d covariance reaches the driver (d: the dimension, whatever the
number of rows), and only d by k numbers are broadcast.

There Householder reflections make the covariance tridiagonal, bisection on Sturm counts finds its leading
eigenvalues, and inverse iteration their vectors. Vectors of eigenvalues that lie close together are made
orthogonal to each other in every iteration; the reflections then carry them back.

Vectors that are null, or hold a null or non-finite entry, are left out. Vectors of another length than the
commonest (of ties the longest) cannot share its components and are left out, too. Equal vectors count each.
Components whose eigenvalue is not above ``LEAST`` of the greatest are noise of the arithmetic: they have no scale
to divide by and are not given, so vectors that are all equal, or of length 0, have no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.columns import col
from stepledger.llm.common import fresh

LEADING = 32
LEAST = 1e-10
EPS = np.finfo(np.float64).eps
# Fixed values of the query: entries become whole numbers as floor(64 * c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
FITS = float(2**52)  # whole numbers below are exact as doubles


# Symmetric eigenproblem on the driver.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections of a symmetric matrix."""
    a = np.array(a, dtype=np.float64)
    n = len(a)
    mirrors: list[np.ndarray | None] = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if not np.any(x[1:]):
            mirrors.append(None)
            continue
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        a[k + 1, k] = x[0] - 2 * v[0] * (v @ x)
        rest = a[k + 1 :, k + 1 :]
        u = rest @ v
        w = 2 * (u - (v @ u) * v)
        rest -= np.outer(v, w)
        rest -= np.outer(w, v)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each shift the number of eigenvalues below it: the negative terms of its Sturm sequence."""
    tiny = np.finfo(np.float64).tiny / EPS
    q = diagonal[0] - shifts
    below = (q < 0).astype(np.int64)
    for d, e2 in zip(diagonal[1:], off**2):
        q = d - shifts - e2 / np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, each halved down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    span = max(np.abs(diagonal).max() + reach.max(), np.finfo(np.float64).tiny)
    low, high = np.full(k, -span), np.full(k, span * (1 + 4 * EPS))
    place = n - 1 - np.arange(k)  # among the rising eigenvalues
    while True:
        middle = (low + high) / 2
        open_ = (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + EPS * EPS * span) & (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = counts_below(diagonal, off, middle) <= place
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; pivots below ``floor`` are raised to it."""
    n = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(main[i]):  # the next row becomes the pivot
            factor = main[i] / below
            main[i], main[i + 1], upper_i = below, upper[i] - factor * main[i + 1], main[i + 1]
            second[i], next_upper = upper[i + 1], -factor * upper[i + 1]
            upper[i], upper[i + 1] = upper_i, next_upper
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(main[i]) < floor:
                main[i] = floor
            factor = below / main[i]
            main[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= upper[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= second[i] * x[i + 2]
        x[i] /= main[i]
        if abs(x[i]) > 1e200:  # only the direction counts
            x *= 1e-200
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one column for each of the falling ``values``."""
    n, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    start = np.random.default_rng(13)
    out = np.empty((n, len(values)))
    cluster, before = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        # Equal values are told apart a little, so that their solves differ.
        before = value = min(value, before - 4 * EPS * norm) if j > cluster else value
        x = start.uniform(-1, 1, n)
        for _ in range(5):
            x = solve_shifted(diagonal, off, value, x / np.linalg.norm(x), EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for i in range(cluster, j):
                    x -= (out[:, i] @ x) * out[:, i]
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n, k = len(matrix), min(k, len(matrix))
    size = np.abs(matrix).max(initial=0.0)
    if not k or size == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        if v is not None:
            part = vectors[at + 1 :]
            part -= 2 * np.outer(v, v @ part)
    return values * size, vectors


# Sums over the vectors, in the tasks.


def _rows(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each length among the batch's vectors."""
    lists = batch.column(at)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        which = np.flatnonzero(sizes == d)
        yield int(d), which, flat[starts[which, None] + np.arange(d)] if len(which) < len(sizes) else flat.reshape(-1, d)


def _exact_sums(x: np.ndarray) -> list:
    """Sums of the columns; of whole numbers exact, as their halves of 32 bits cannot overflow."""
    if x.dtype.kind == "f":
        return x.sum(axis=0).tolist()
    high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
    return [(h << 32) + v for h, v in zip(high, low)]


def _summed(whole: bool):
    from decimal import Decimal

    kind = pa.decimal128(38, 0) if whole else pa.float64()
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(kind)), ("most", pa.float64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, which, x in _rows(batch):
                n, sums, most = found.get(d, (0, [0] * d, 0.0))
                top = float(np.abs(x).max(initial=0))
                found[d] = (n + len(which), [a + b for a, b in zip(sums, _exact_sums(x))], max(most, top))
        made = [(d, n, [Decimal(s) for s in sums] if whole else sums, most) for d, (n, sums, most) in found.items()]
        columns = zip(schema, zip(*made)) if made else ((f, []) for f in schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for f, v in columns], schema=schema)

    return summed


@dataclass
class Mean:
    """Number, exact sums and mean of the vectors. The mean is ``base + rest``: whole vectors lose no digit against ``base``."""

    n: int
    sums: list
    base: np.ndarray
    rest: np.ndarray
    most: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest


def _products(mean: Mean, weights: np.ndarray | None):
    """Upper triangle of the summed products of what ``centred`` (projected on ``weights``) gives, and, in the last row, its sums."""
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for d, _, x in _rows(batch):
                if d != len(mean.base):
                    continue
                y = mean.centred(x) if weights is None else mean.centred(x) @ weights
                part = np.vstack([y.T @ y, y.sum(axis=0)])
                total = part if total is None else total + part
        rows = [] if total is None else [total[i, i if i < total.shape[1] else 0 :].tolist() for i in range(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, schema.field("row").type)], schema=schema)

    return products


def _covariance(vectors: DataFrame, mean: Mean, weights: np.ndarray | None, size: int) -> np.ndarray:
    """Covariance, divisor n, of the centred (and projected) vectors: ``size`` squared numbers to the driver."""
    parts = vectors.mapInArrow(_products(mean, weights), "i int, row array<double>")
    entries = parts.select("i", F.posexplode("row").alias("p", "v")).groupBy("i", "p").agg(F.sum("v").alias("v")).toArrow()
    i, p, v = (entries.column(c).to_numpy() for c in ("i", "p", "v"))
    last = np.zeros(size)
    last[p[i == size]] = v[i == size]
    made = np.zeros((size, size))
    inside = i < size
    made[i[inside], i[inside] + p[inside]] = v[inside]
    made = made + np.triu(made, 1).T
    return made / mean.n - np.outer(last / mean.n, last / mean.n)


@dataclass
class Whitening:
    """What ``fit`` learns. ``weights`` project centred vectors on the components, over the roots of their eigenvalues."""

    mean: Mean
    values: np.ndarray
    trace: float
    weights: np.ndarray

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its entries are finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _only(df: DataFrame, vector: str) -> DataFrame:
    """The usable vectors, as longs where their entries are whole numbers, else as doubles."""
    kind = df.schema[vector].dataType
    entry = "bigint" if isinstance(kind.elementType, T.IntegralType) else "double"
    return df.filter(usable(col(vector))).select(col(vector).cast(f"array<{entry}>").alias("v"))


def _is_whole(df: DataFrame, vector: str) -> bool:
    return isinstance(df.schema[vector].dataType.elementType, T.IntegralType)


def fit(df: DataFrame, vector: str, k: int = LEADING) -> Whitening | None:
    """Mean and up to ``k`` leading components of the usable vectors of ``df``; None without any."""
    vectors, whole = _only(df, vector), _is_whole(df, vector)
    parts = vectors.mapInArrow(_summed(whole), f"d int, n long, sums array<{'decimal(38,0)' if whole else 'double'}>, most double")
    lengths = parts.groupBy("d").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    # One row: the commonest length.
    found = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not found:
        return None
    d, n = found[0].d, found[0].n
    totals = parts.filter(F.col("d") == d).select(F.posexplode("sums").alias("p", "s")).groupBy("p").agg(F.sum("s").alias("s")).collect()
    sums = [r.s for r in sorted(totals, key=lambda r: r.p)]
    if whole:
        sums = [int(s) for s in sums]
        base = [(2 * s + n) // (2 * n) for s in sums]  # the nearest whole number
        rest = [(s - n * b) / n for s, b in zip(sums, base)]
        mean = Mean(n, sums, np.array(base, dtype=np.int64), np.array(rest, dtype=np.float64), found[0].most)
    else:
        mean = Mean(n, sums, np.array(sums, dtype=np.float64) / n, np.zeros(d), found[0].most)
    covariance = _covariance(vectors, mean, None, d)
    values, components = leading(covariance, k)
    real = values > LEAST * values.max(initial=0.0)
    values, components = values[real], components[:, real]
    return Whitening(mean, values, float(np.trace(covariance)), components / np.sqrt(values))


def identity_error(df: DataFrame, vector: str, fitted: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, without sign; None without components."""
    k = len(fitted.values)
    if not k:
        return None
    return float(np.abs(_covariance(_only(df, vector), fitted.mean, fitted.weights, k) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str, fitted: Whitening | None, out: str = "whitened") -> DataFrame:
    """The rows of ``df`` whose vector the components fit, with the array ``out``: the whitened vector, a double for each component."""
    others = [c for c in df.columns if c != out]
    shape = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.ArrayType(T.DoubleType()))])
    if fitted is None:
        return df.sparkSession.createDataFrame([], shape)
    model = df.sparkSession.sparkContext.broadcast((fitted.mean, fitted.weights))
    v = fresh(df, "_v")
    entry = "bigint" if _is_whole(df, vector) else "double"
    d = len(fitted.mean.base)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, weights = model.value
        k = weights.shape[1]
        for batch in batches:
            for _, _, x in _rows(batch):  # all of one length
                z = mean.centred(x) @ weights
                ends = pa.array(np.arange(0, len(z) * k + 1, max(k, 1)) if k else np.zeros(len(z) + 1), pa.int32())
                arrays = pa.ListArray.from_arrays(ends, pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], arrays], names=[*batch.schema.names[1:], out])

    rows = df.filter(usable(col(vector)) & (F.size(col(vector)) == d))
    rows = rows.select(col(vector).cast(f"array<{entry}>").alias(v), *[col(c) for c in others])
    return rows.mapInArrow(projected, shape)


def _deviation(x: Column, mean: Mean) -> Column:
    """Sum over the dimensions of (n * x - S) squared: exact, null where it does not fit a long."""
    d, n = len(mean.sums), mean.n
    widest = max((max(abs(n * int(mean.most) + s), abs(n * int(mean.most) - s)) for s in map(abs, mean.sums)), default=0)
    kind = "bigint" if d * widest * widest < 2**63 else "decimal(38,0)"
    sums = F.array(*[F.lit(s).cast(kind) for s in mean.sums]).cast(f"array<{kind}>")
    apart = F.zip_with(x, sums, lambda a, s: F.lit(n).cast(kind if kind == "bigint" else "decimal(18,0)") * a - s)
    total = F.aggregate(apart, F.lit(0).cast(kind), lambda t, a: (t + a * a).cast(kind))
    return total.try_cast("bigint")


def report(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = LEADING) -> DataFrame:
    """One row for each usable vector and component; entries of 2**52 and more after scaling are no whole numbers and count as non-finite."""
    # Null where there is no such number, so that the vector is left out.
    entry = lambda c: F.when(F.abs(SCALE * c.cast("double")) < FITS, F.floor(SCALE * c.cast("double")) + SHIFT)
    x = embeddings.select(col(vec_id).alias("vec_id"), F.transform(col(vector), entry).alias("x"))
    fitted = fit(x, "x", k)
    error = None if fitted is None else identity_error(x, "x", fitted)
    made = whiten(x, "x", fitted)
    if fitted is None or not len(fitted.values):
        made, deviation, explained = made.filter("false"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    else:
        deviation = _deviation(F.col("x"), fitted.mean)
        explained = F.element_at(F.array(*map(F.lit, fitted.explained)), F.col("component"))
    return (
        made.withColumn("deviation", deviation)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
        .withColumn("component", F.col("place") + 1)
        .select(
            "vec_id",
            "component",
            F.lit(None if fitted is None else fitted.mean.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained.alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
