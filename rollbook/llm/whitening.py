"""Embedding whitening by spectrum slicing.

Entries c become whole numbers x = floor(256 c).  Over the distinct x vectors
(the fit list) Spark adds up the exact count n and sums S, and then, in a
second pass, the covariance V of the vectors minus their mean.  V has d x d
numbers, d the vectors' length, and is worked on by itself: the number of
negative pivots of the symmetric factorisation V - s I = L D L' is the number
of eigenvalues below s (inertia), so bisection by counts isolates the leading
eigenvalues one by one; Rayleigh quotient iteration then converges
cubically from within each interval, and counts on both sides of the result
certify its number.  Eigenvalues that lie closer than 1e-13 of the largest
cannot be told apart by counts; they are one cluster, whose vectors are taken
orthogonal to each other.

``fit`` passes one matrix per task to the driver's side of the plan through
partial sums that Spark groups by matrix row, never the vectors.  ``apply``
projects every row.

Defined results: rows whose vector is null, or holds null or non-finite
entries or ones whose x does not fit in 53 bits, take no part.  So do rows
of another length than the most frequent one (ties: the longer).  Repeated
rows and equal vectors under different ids count once in the fit and all get
their rows; null ids are kept.  Components whose eigenvalue is not above
d * 2^-52 of the trace do not exist and give no rows: one distinct vector
alone, an empty table or the empty vector give none.  Further columns do not
matter."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rollbook.llm.common import stored

SCALE = 256
EXACT = 2.0 ** 53


# ---- Symmetric matrices -------------------------------------------------

def inertia(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``a`` above ``shift``: positive
    pivots of the L D L' factorisation of ``a - shift I``, with 1 x 1 and 2 x 2
    pivots chosen by Bunch and Kaufman's rule so that the entries stay bounded."""
    a = a - shift * np.eye(len(a))
    alpha, positive, k, n = (1 + 17 ** 0.5) / 8, 0, 0, len(a)
    tiny = np.finfo(float).tiny

    def swap(i, j):
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1:, k])
        r = k + 1 + int(np.argmax(below)) if len(below) else k
        w = below[r - k - 1] if len(below) else 0.0
        two = False
        if abs(a[k, k]) < alpha * w:
            column = np.abs(a[k:, r])
            column[r - k] = 0
            other = column.max()
            if abs(a[k, k]) * other < alpha * w * w:
                if abs(a[r, r]) >= alpha * other:
                    swap(k, r)
                else:
                    two = True
                    swap(k + 1, r)
        if two:
            p, c = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            positive += 1  # such a pivot has one eigenvalue of each sign
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(p, c.T)
            k += 2
        else:
            p = a[k, k]
            if p > 0:
                positive += 1
            if abs(p) > tiny:
                c = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(c, c / p)
            k += 1
    return positive


def _rayleigh(a: np.ndarray, low: float, high: float, known: list[np.ndarray], top: float) -> tuple[float, np.ndarray]:
    """An eigenpair in [low, high], orthogonal to ``known``."""
    random = np.random.default_rng(len(known))
    q = np.array(known).reshape(-1, len(a))

    def clean(v):
        for _ in range(2):
            v = v - q.T @ (q @ v)
        return v / np.linalg.norm(v)

    def solve(shift, v):
        for nudge in (0.0, 1e-16, 1e-15, 1e-14):
            try:
                out = np.linalg.solve(a - (shift + nudge * top) * np.eye(len(a)), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(out).all():
                return clean(out)
        return v

    v = clean(random.standard_normal(len(a)))
    shift = (low + high) / 2
    for _ in range(3):  # inverse iteration first, so that the quotient starts inside the interval
        v = solve(shift, v)
    e = float(v @ a @ v)
    for _ in range(20):
        if not low <= e <= high:
            e = shift
        v = solve(e, v)
        e, last = float(v @ a @ v), e
        if np.linalg.norm(a @ v - e * v) <= 4e-16 * top * len(a) ** 0.5 or e == last:
            break
    return e, v


def leading(a: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """The ``most`` largest eigenvalues above the rounding level, falling, with unit vectors."""
    d = len(a)
    trace = float(np.trace(a)) if d else 0.0
    least = d * 2.0 ** -52 * trace
    if not trace > 0:
        return []
    bound = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin: no eigenvalue lies above
    counts = {least: inertia(a, least), bound: 0}
    found: list[tuple[float, np.ndarray]] = []
    tight = 1e-13 * bound
    while len(found) < min(most, counts[least]):
        k = len(found)  # the next one is number k from above
        low = max(s for s, c in counts.items() if c > k)
        high = min(s for s, c in counts.items() if c <= k)
        # Slice until the interval holds number k alone and is narrow beside its gap, or is a cluster.
        while high - low > tight and not (counts[low] == k + 1 and counts[high] == k and high - low <= 1e-3 * (high - _above(counts, k + 1))):
            middle = (low + high) / 2
            counts[middle] = inertia(a, middle)
            if counts[middle] > k:
                low = middle
            else:
                high = middle
        in_cluster = counts[low] - k
        pairs = []
        for _ in range(min(in_cluster, most - k)):
            pairs.append(_rayleigh(a, low, high, [v for _, v in found + pairs], bound))
        for number, (e, _) in enumerate(pairs):
            # Certify: fewer than k + in_cluster + 1 eigenvalues from just below on, at most k above.
            margin = 4 * max(tight, 1e-13 * abs(e))
            if not (inertia(a, e + margin) <= k + number and inertia(a, e - margin) >= k + number + 1):
                raise ArithmeticError(f"eigenvalue {k + number + 1} was not isolated")
        found += sorted(pairs, key=lambda p: -p[0])
    return found


def _above(counts: dict[float, int], k: int) -> float:
    """The largest known shift with more than ``k`` eigenvalues above it: a bound for number k + 1."""
    return max((s for s, c in counts.items() if c > k), default=min(counts))


# ---- Fit and apply ------------------------------------------------------

@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a row each
    trace: float
    identity_error: float


def whole(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``id_col`` and the long array ``x`` of the rows that take part."""
    v = F.col(vector_col)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < EXACT / SCALE))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    valid = rows.where(v.isNotNull() & good).select(F.col(id_col), x.alias("x"))
    # One row a length: the most frequent, then the longest.
    size = (valid.groupBy(F.size("x").alias("length")).count()
            .agg(F.max(F.struct("count", "length"))["length"].alias("length")))
    return valid.join(F.broadcast(size), F.size("x") == F.col("length")).select(id_col, "x")


def _matrices(batches):
    for batch in batches:
        x = batch.column(0)
        width = len(x[0]) if len(x) else 0
        yield batch.num_rows, x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _sums(batches):
    for n, x in _matrices(batches):
        if n and x.shape[1]:
            small = int(np.abs(x).max()) * n < 2 ** 63
            total = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]), pa.int32()), pa.array([n] * x.shape[1], pa.int64()),
                                              pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["at", "n", "s"])


def _moments(frame: DataFrame, rows_of) -> np.ndarray:
    """Sum over tasks and batches of the square matrices that ``rows_of`` makes
    of each batch's vectors, added up by Spark one matrix row at a time."""
    def run(batches):
        total = None
        for n, x in _matrices(batches):
            if n:
                part = rows_of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(batches):
        total, at = None, None
        for b in batches:
            at = b.column(0)[0].as_py() if b.num_rows else at
            if b.num_rows:
                part = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).sum(axis=0)
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["i", "row"])

    def add_table(key, t):
        return pa.Table.from_batches(list(add(t.to_batches())))

    shape = "i int, row array<double>"
    rows = frame.select("x").mapInArrow(run, shape).groupBy("i").applyInArrow(add_table, shape).collect()  # one square matrix
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def fit(rows: DataFrame, components: int = 4) -> tuple[Whitening | None, DataFrame]:
    """The whitening of ``whole`` rows, and those rows (written once)."""
    rows = stored(rows, "whole-vectors")
    fitted = stored(rows.select("x").distinct(), "fit-list")
    # Exact sums by place: d rows a batch, added up as decimals.
    sums = fitted.mapInArrow(_sums, "at int, n long, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    if not sums:
        return None, rows
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    mean = np.array([s / n for s in total])

    def squares(x):
        y = x - mean
        return y.T @ y

    v = _moments(fitted, squares) / n
    v = (v + v.T) / 2
    pairs = leading(v, components)
    if not pairs:
        return None, rows
    values, vectors = np.array([e for e, _ in pairs]), np.array([p for _, p in pairs])
    vectors *= np.where(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    turn = (vectors / np.sqrt(values)[:, None]).T

    def whitened(x):
        w = np.concatenate([(x - mean) @ turn, np.ones((len(x), 1))], axis=1)  # the last row and column: sums, count
        return w.T @ w

    m = _moments(fitted, whitened)
    middle = m[-1, :-1] / n
    error = float(np.abs(m[:-1, :-1] / n - np.outer(middle, middle) - np.eye(len(pairs))).max())
    return Whitening(n, total, values, vectors, float(np.trace(v)), error), rows


def apply(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """``id_col``, ``component``, ``n``, ``deviation`` (decimal: sum over places of
    (n x - S)^2, exact), ``whitened``, ``explained`` and ``identity_error``:
    a row for each of the ``whole`` rows and each component."""
    schema = T.StructType([
        T.StructField("id", rows.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    n, sums = model.n, model.sums
    mean = np.array([s / n for s in sums])
    turn, k = (model.vectors / np.sqrt(model.values)[:, None]).T, len(model.values)
    explained, error = model.values / model.trace, model.identity_error

    def run(batches):
        for batch in batches:
            rows_, x = next(_matrices([batch.select([1])]))
            if not rows_:
                continue
            if len(sums) * (n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))) ** 2 < 2 ** 63:
                apart = n * x - np.array(sums, dtype=np.int64)
                deviation = pa.array((apart * apart).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            else:  # beyond 64 bits: Python's whole numbers
                apart = n * x.astype(object) - np.array(sums, dtype=object)
                deviation = pa.array([Decimal(int(s)) for s in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(rows_), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), rows_), pa.int32()), pa.array(np.full(rows_ * k, n), pa.int64()),
                deviation.take(at), pa.array(((x - mean) @ turn).reshape(-1), pa.float64()), pa.array(np.tile(explained, rows_), pa.float64()),
                pa.array(np.full(rows_ * k, error), pa.float64())], names=schema.names)

    return rows.select(id_col, "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
