"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Components are whole numbers after scaling, so the sums and the centred scatter matrix of the distinct vectors are exact:
tasks subtract the rounded mean before they multiply, and add up integers. The scatter is factored as L L' with diagonal
pivoting, which also shows its rank; rotations from the right make the columns of L orthogonal. Their squared norms are
then the eigenvalues, and the normalised columns the components, with small eigenvalues as accurate as large ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stage

#: Products of two numbers below this, and few of them, are exact in double precision.
SMALL = 1 << 26
#: Bits that a sum of products may have: decimals of 38 digits hold it.
BITS = 124
#: Vectors that are multiplied together.
ROWS = 4096
_WHOLE, _FRACTION = pa.decimal128(38, 0), pa.decimal128(38, 18)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of n rows and rank columns with L L' = a, for a symmetric positive semidefinite matrix. The largest remaining
    diagonal element is next; it ends when that is lost in rounding."""
    n = len(a)
    rest = np.diag(a).astype(float).copy()
    factor, floor = np.zeros((n, n)), n * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(n):
        p = int(np.argmax(rest))
        if not rest[p] > floor:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / math.sqrt(rest[p])
        column[rest == -np.inf] = 0.0
        column[p] = math.sqrt(rest[p])
        factor[:, k] = column
        rest -= column * column
        rest[p] = -np.inf
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and left singular vectors of a matrix of full column rank: pairs of columns are rotated
    until all are orthogonal to working precision. The pairs of a round are disjoint and rotated together."""
    a = factor.copy()
    k = a.shape[1]
    seats = np.arange(k + k % 2)
    done = k < 2
    for _ in range(sweeps):
        if done:
            break
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            # The odd one out sits idle; the column with the larger norm comes first.
            real = (p < k) & (q < k)
            p, q = p[real], q[real]
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            size = np.sqrt(alpha * beta)
            apart = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, float(apart.max(initial=0.0)))
            turn = apart > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        done = worst < 4e-16 * math.sqrt(len(a))
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    norms, a = norms[order], a[:, order]
    return norms, a / norms


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch by the length of its vectors, which lie in column ``at``."""
    column = batch.column(at)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == dim)
        for cut in range(0, len(own), ROWS):
            rows = own[cut : cut + ROWS]
            yield dim, rows, flat[starts[rows][:, None] + np.arange(dim)]


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sums and bounds by place of a task's vectors."""
    found: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in _blocks(batch, 0):
            low, high = x.min(axis=0), x.max(axis=0)
            # Halves of 32 bits, so that no sum wraps.
            sums = ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            if dim not in found:
                found[dim] = [0, np.zeros(dim, object), low, high]
            at = found[dim]
            found[dim] = [at[0] + len(x), at[1] + sums, np.minimum(at[2], low), np.maximum(at[3], high)]
    for dim, (n, sums, low, high) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(list(map(Decimal, sums)), _WHOLE), pa.array(low), pa.array(high)],
            ["dim", "place", "n", "sum", "low", "high"],
        )


class Fit:
    """Number, sums and bounds of the distinct vectors of one length; later their components too."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]) -> None:
        self.n, self.sums = n, sums
        self.middle = [(2 * s + n) // (2 * n) for s in sums]
        self.apart = max(max(h - m, m - l) for l, h, m in zip(low, high, self.middle))
        #: Sums of products lose this many bits, none unless components are huge.
        self.shift = max(0, 2 * self.apart.bit_length() + n.bit_length() - BITS)
        self.largest = max(max(abs(l), abs(h)) for l, h in zip(low, high))
        self.vectors, self.values, self.explained = np.zeros((0, len(sums))), np.zeros(0), np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the vectors' distance from the mean, as whole numbers of whatever size they need."""
        if self.n * self.largest + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``centred``; null where it is no long."""
        away = self.centred(x)
        if away.dtype == object or len(self.sums) * int(np.abs(away).max()) ** 2 >= 1 << 63:
            away = away.astype(object)
        total = (away * away).sum(axis=1).tolist()
        return [t if t < 1 << 63 else None for t in total]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component. Every row is added up by itself, so equal rows give equal results."""
        away = self.centred(x)
        away = (away / self.n).astype(np.float64)
        return np.stack([(away * v).sum(axis=1) / math.sqrt(e) for v, e in zip(self.vectors, self.values)], axis=1) if len(self.values) else np.zeros((len(x), 0))


def _scatter(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Products of vectors less the rounded mean, added up without rounding."""
    if x.dtype == object or int(np.abs(x).max(initial=0)) >= 1 << 61 or int(np.abs(middle).max(initial=0)) >= 1 << 61:
        away = x.astype(object) - middle.astype(object)
    else:
        away = x - middle
    large = np.abs(away).max(axis=1) >= SMALL
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for row in away[large]:
        row = row.astype(object)
        out += row[:, None] * row[None, :]
    few = away[~large].astype(np.float64)
    if len(few):
        step = max(1, (1 << 53) // max(1, int(np.abs(few).max()) ** 2))
        for at in range(0, len(few), step):
            part = few[at : at + step]
            out += (part.T @ part).astype(np.int64)
    return out


def _scatter_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _blocks(batch, 0):
                middle = np.array(shared.value[dim].middle, np.int64)
                found[dim] = found.get(dim, 0) + _scatter(x, middle)
        for dim, total in found.items():
            i, j = np.triu_indices(dim)
            values = [Decimal(int(v) >> shared.value[dim].shift) for v in total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, _WHOLE)], ["dim", "i", "j", "v"])

    return run


def _decompose(shared, keep: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        dim = int(cells["dim"].iloc[0])
        fit = shared.value[dim]
        a = np.zeros((dim, dim))
        off = [s - fit.n * m for s, m in zip(fit.sums, fit.middle)]
        for i, j, v in zip(cells["i"].tolist(), cells["j"].tolist(), cells["v"].tolist()):
            # What the rounding of the mean has added goes again; one division rounds, once.
            a[i, j] = a[j, i] = (fit.n * (int(v) << fit.shift) - off[i] * off[j]) / fit.n
        norms, vectors = one_sided_jacobi(pivoted_cholesky(a))
        trace = math.fsum(np.diag(a)) / fit.n
        out = []
        for number in range(min(keep, len(norms))):
            v, e = vectors[:, number], float(norms[number]) ** 2 / fit.n
            v = v if v[np.argmax(np.abs(v))] > 0 else -v
            out.append((dim, number + 1, v.tolist(), e, e / trace))
        return pd.DataFrame(out, columns=["dim", "component", "vector", "e", "explained"])

    return run


def _moment_batches(shared):
    """Sums of whitened vectors and of their products, in decimals, whose order of addition does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[float]] = {}
        for batch in batches:
            for dim, _, x in _blocks(batch, 0):
                w = shared.value[dim].whitened(x)
                ones = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                for i in range(1, ones.shape[1]):
                    for j in range(i + 1):
                        found.setdefault((dim, i, j), []).append(math.fsum(ones[:, i] * ones[:, j]))
        keys = list(found)
        columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
        sums = [Decimal(repr(math.fsum(found[k]))).quantize(Decimal(1).scaleb(-18)) for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, _FRACTION)], ["dim", "i", "j", "v"])

    return run


def _whiten_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = shared.value
        for batch in batches:
            for dim, rows, x in _blocks(batch, 1):
                fit = fits[dim]
                k = len(fit.values)
                if not k:
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                deviation = fit.deviations(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(k * len(x), fit.n)),
                        pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                        pa.array(fit.whitened(x).ravel()),
                        pa.array(np.tile(fit.explained, len(x))),
                        pa.array(np.full(k * len(x), errors[dim])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, scale: float = 256.0, keep: int = 4) -> DataFrame:
    """vec_id, component (from 1, at most ``keep``), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite component go; the others are scaled and rounded down to longs (the
    nearest long where that is none). Means and covariances are over the distinct vectors, divisor n; equal vectors under
    several ids are whitened each, as are rows that repeat a vec_id, and a null vec_id stays. deviation is the exact sum of
    squares of n times the distance from the mean, null beyond the range of a long. A component's largest entry is
    positive. There are as many components as the scatter has rank at most: none for empty vectors or where all
    vectors are equal. Vectors of different lengths are fitted apart; the driver holds sums and components of each
    length, of which a table of embeddings has one or a few, and scatter matrices are factored in tasks. identity_error is
    measured on the whitened distinct vectors. Extra columns are ignored; an empty table gives an empty table.
    """
    spark, own = vectors.sparkSession, "embedding"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(own).cast("array<double>").alias(own))
    rows = rows.filter(F.col(own).isNotNull() & F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("vec_id", F.transform(own, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))
    rows = stage(rows, "scaled")
    fit_list = stage(rows.select("x").distinct(), "distinct")

    sums = fit_list.mapInArrow(_sum_batches, "dim int, place int, n long, sum decimal(38,0), low long, high long")
    sums = sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"))
    by_dim: dict[int, list] = {}
    for r in sums.orderBy("dim", "place").collect():
        by_dim.setdefault(r["dim"], []).append(r)
    fits = {dim: Fit(of[0]["n"], [int(r["sum"]) for r in of], [r["low"] for r in of], [r["high"] for r in of]) for dim, of in by_dim.items()}
    shared = spark.sparkContext.broadcast(fits)

    cells = fit_list.mapInArrow(_scatter_batches(shared), "dim int, i int, j int, v decimal(38,0)")
    cells = cells.groupBy("dim", "i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    parts = cells.groupBy("dim").applyInPandas(_decompose(shared, keep), "dim int, component int, vector array<double>, e double, explained double")
    for dim, of in pd.DataFrame(parts.collect(), columns=parts.columns).sort_values("component").groupby("dim"):
        fit = fits[dim]
        fit.vectors, fit.values, fit.explained = np.stack(of["vector"].to_list()), of["e"].to_numpy(), of["explained"].to_numpy()
    shared = spark.sparkContext.broadcast(fits)

    moments = fit_list.mapInArrow(_moment_batches(shared), "dim int, i int, j int, v decimal(38,18)")
    moments = {(r["dim"], r["i"], r["j"]): float(r["v"]) for r in moments.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()}
    errors: dict[int, float] = dict.fromkeys(fits, 0.0)
    for (dim, i, j), v in moments.items():
        if j:
            n = fits[dim].n
            covariance = v / n - moments[dim, i, 0] / n * (moments[dim, j, 0] / n)
            errors[dim] = max(errors[dim], abs(covariance - (i == j)))
    discard(fit_list)
    model = spark.sparkContext.broadcast((fits, errors))
    return rows.mapInArrow(_whiten_batches(model), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
