"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

Entries become integers x = floor(SCALE c) + SHIFT. The fit list holds each distinct x vector once: n vectors, sums S. A pass
over it multiplies the covariance by a narrow block Q: each task adds up y'(yQ) over its vectors, y = (n x - S) / n being
centred in integers first, and the tasks' d rows are summed in a shuffle. The driver holds d x k numbers only.

A filter is a Chebyshev polynomial of the covariance, by its three-term recurrence, one pass a degree; it is small over
the spectrum that is not wanted, between a lower bound (from a short Lanczos run) and the block's least Ritz value, and
grows fast above. After each filter the block is orthonormalised (QR) and rotated (Rayleigh-Ritz). It ends once the residuals
|Vq - eq| of the wanted pairs certify them: each lies within its residual of an eigenvalue. The block holds as many
further columns as wanted ones, from a random start, so that no wanted eigenvalue stays out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import matrix, sound, usual_size

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Degree of a filter, Lanczos steps for the lower bound, and filters at most before an error is raised.
DEGREE, STEPS, ROUNDS = 10, 10, 60
#: Residuals of so much of the largest eigenvalue certify a pair. Rounding may forbid that; then residuals that no longer
#: shrink are accepted below SETTLED.
CERTIFIED, SETTLED = 1e-14, 1e-11
#: An eigenvalue below this part of the largest is rounding, and its direction can't be whitened.
RANK = 1e-12


@dataclass
class Whitener:
    n: int
    width: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def quantised(df: DataFrame, column: str = "embedding", x: str = "x") -> DataFrame:
    """df without the rows whose vector is null, has null or non-finite entries, is empty or not of the commonest length; x added (array of long)."""
    df = df.where(sound(column))
    width = usual_size(df, column)
    return df.where(F.size(column) == width).withColumn(x, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _block_sums(fit: DataFrame, width: int, columns: int, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over the fit list of make(x rows), a matrix of `columns` columns, summed in each task and then row by row in a shuffle."""
    names = [f"c{j}" for j in range(columns)]
    dtype = np.int64 if kind == "long" else np.float64

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(matrix(batch.column(0), width, np.int64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(columns)]], ["i", *names])

    summed = fit.select("x").mapInArrow(partial, f"i int, {', '.join(f'{c} {kind}' for c in names)}").groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    rows = sorted(summed.collect())
    return np.array([r[1:] for r in rows], dtype).reshape(len(rows), columns)


def lower_bound(product: Callable[[np.ndarray], np.ndarray], width: int, rng: np.random.Generator) -> float:
    """A value about or below the least eigenvalue, not below 0: the least Ritz value of a Lanczos run less its residual."""
    basis = [(v := rng.normal(size=width)) / np.linalg.norm(v)]
    diagonal, off = [], []
    for _ in range(min(STEPS, width)):
        w = product(basis[-1][:, None])[:, 0]
        diagonal.append(basis[-1] @ w)
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        off.append(np.linalg.norm(w))
        if off[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / off[-1])
    k = len(diagonal)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off[: k - 1], 1) + np.diag(off[: k - 1], -1))
    return max(0.0, values[0] - off[-1] * abs(vectors[-1, 0]))


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of degree DEGREE of V, times q: at most 1 on [low, high], 1 at top. vq: V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    if half <= 1e-14 * top:
        return vq - middle * q
    scale = first = half / (top - middle)
    before, now = q, (vq - middle * q) * (scale / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - scale)
        before, now = now, 2 * (after / half) * (product(now) - middle * now) - scale * after * before
        scale = after
    return now


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the `wanted` largest eigenvalues of a symmetric non-negative matrix, known by its product only."""
    rng = np.random.default_rng(12)
    k = min(width, 2 * wanted)
    wanted = min(width, wanted)
    q = np.linalg.qr(rng.normal(size=(width, k)))[0]
    low, was = (lower_bound(product, width, rng) if k < width else 0.0), np.inf
    for _ in range(ROUNDS):
        vq = product(q)
        h = q.T @ vq
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        worst = np.linalg.norm(vq - q * theta, axis=0)[:wanted].max()
        if worst <= CERTIFIED * theta[0] or worst <= SETTLED * theta[0] and worst > was / 2:
            return theta[:wanted], q[:, :wanted]
        was = worst
        q = np.linalg.qr(filtered(product, q, vq, min(low, theta[-1]), theta[-1], theta[0]))[0]
    raise RuntimeError(f"the components are not certified after {ROUNDS} filters: residual {was:g}")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Whitener of the rows' x vectors (column x: array of long, one length, no nulls); None if there is none."""
    distinct = settle(rows.select("x").distinct())
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return None
    sums = _block_sums(distinct, width, 1, lambda x: x.sum(axis=0)[:, None], "long")[:, 0]
    model = Whitener(n, width, sums, np.empty(0), np.empty((width, 0)), 0.0)

    def product(q: np.ndarray) -> np.ndarray:
        model.passes += 1
        return _block_sums(distinct, width, q.shape[1], lambda x, y=model.centred: (c := y(x)).T @ (c @ q), "double") / n

    model.trace = float(_block_sums(distinct, width, 1, lambda x, y=model.centred: (y(x) ** 2).sum(axis=0)[:, None], "double").sum() / n)
    if model.trace == 0:
        return model
    values, vectors = leading_pairs(product, width, components)
    kept = values > RANK * values[0]
    model.values, model.vectors = values[kept], vectors[:, kept]
    k = int(kept.sum())
    mean = _block_sums(distinct, width, 1, lambda x, z=model.whitened: z(x).sum(axis=0)[:, None], "double")[:, 0] / n
    second = _block_sums(distinct, width, k, lambda x, z=model.whitened: (c := z(x) - mean).T @ c, "double") / n
    model.identity_error = float(np.abs(second - np.eye(k)).max())
    return model


def deviations(x: np.ndarray, model: Whitener) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2; null where it exceeds a long."""
    gap = model.n * x - model.sums
    if gap.size and float(np.abs(gap).max()) ** 2 * model.width < 2**62:
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum(int(g) ** 2 for g in row) for row in gap]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitener | None, id_column: str = "vec_id") -> DataFrame:
    """A row for each row and component, numbered from 1 by falling eigenvalue: n, deviation, whitened, explained, identity_error.

    Null and repeated ids are kept as they are; equal vectors get equal values. Components of eigenvalue 0 can't be
    whitened and give no rows: of one distinct vector, or of none, the result is empty.
    """
    schema = f"{id_column} {rows.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = len(model.values) if model else 0
    if not k:
        return rows.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), model.width, np.int64)
            m, again = len(x), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(x, model), pa.int64()).take(pa.array(again)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(id_column, "x").mapInArrow(project, schema)
