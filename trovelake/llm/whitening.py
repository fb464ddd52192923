"""Whitening of integer vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred fit list X is never formed.  A step takes one pass over its stored rows: with a
right vector v a task computes its part of u = Xv and, of this u, of the product X'u, and only
|u|^2 and X'u are summed.  The left vectors U are as long as the list, so they are kept as
U = XW by their short combinations W; the products G = X'U of earlier passes then give every
inner product that full reorthogonalisation needs, as U'(Xw) = G'w.  Both sides are
reorthogonalised twice in each step.

The singular values of the small bidiagonal matrix are the deviations.  One Krylov space
shows one direction of each repeated value, so after it further runs start at random,
orthogonal to all that was found, until a run finds no larger value than the last one wanted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.tables import stored

COMPONENTS = 16
#: Variances below this share of the largest are rounding, and no component.
RANK = 1e-13
_SEED = 20011
_EPS = 2.0**-52
#: Rows that are centred at once.
_ROWS = 4096


def _matrices(lists: pa.Array, dimension: int) -> Iterator[np.ndarray]:
    for low in range(0, len(lists), _ROWS):
        part = lists.slice(low, _ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dimension)


class Centre:
    """The size n of the fit list and the exact sums S of its dimensions."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as long, or as Python integers where a long is too short."""
        most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        if self.n * most + max(map(abs, self.sums)) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.n).astype(np.float64)


def _sums(fit: DataFrame, dimension: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work`` (``size`` doubles for a matrix of rows) over the fit list; tasks add up theirs first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in _matrices(batch.column(0), dimension):
                total += work(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype="i4")), pa.array(total)], names=["i", "s"])

    rows = fit.mapInArrow(task, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[rows.column("i").to_numpy()] = rows.column("s").to_numpy()
    return out


def _centre(fit: DataFrame, dimension: int) -> Centre:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimension, object)
        for batch in batches:
            for x in _matrices(batch.column(0), dimension):
                n += len(x)
                small = len(x) == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 1 << 48
                sums += (x if small else x.astype(object)).sum(axis=0).astype(object)
        values = [Decimal(int(s)) for s in [*sums, n]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dimension + 1, dtype="i4")), pa.array(values, pa.decimal128(38, 0))], names=["i", "s"])

    total = fit.mapInArrow(task, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    found = {r.i: int(r.s) for r in total.collect()}
    return Centre(found[dimension], [found[i] for i in range(dimension)])


def bidiagonalise(
    multiply: Callable[[np.ndarray], tuple[float, np.ndarray]], found: np.ndarray, want: int, rng: np.random.Generator, exact: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors of X in the space orthogonal to the columns of ``found``.

    ``multiply(w)`` gives |Xw|^2 and X'Xw.  The run ends when the residuals of the ``want``
    leading ones are rounding (``exact``) or small, or when the Krylov space is exhausted;
    then all its values are returned.
    """

    def cleared(r: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for space in spaces:
                r = r - space @ (space.T @ r)
        return r

    dimension = len(found)
    right = np.zeros((dimension, 0))
    short, products = right, right  # W and G
    alphas: list[float] = []
    betas: list[float] = []
    r = cleared(rng.standard_normal(dimension), found)
    r /= np.linalg.norm(r)
    while True:
        right = np.c_[right, r]
        w = r
        for _ in range(2):
            w = w - short @ (products.T @ w)
        square, product = multiply(w)
        alpha, scale = math.sqrt(square), max([*alphas, *betas, 0.0])
        closed = alpha <= 1e-12 * scale or alpha == 0
        if not closed:
            alphas.append(alpha)
            short, products = np.c_[short, w / alpha], np.c_[products, product / alpha]
        steps = len(alphas)
        small = np.zeros((steps, right.shape[1]))
        small[range(steps), range(steps)] = alphas
        small[range(len(betas)), range(1, len(betas) + 1)] = betas
        if not steps:
            return np.zeros(0), right[:, :0]
        beta = 0.0
        if not closed:
            r = cleared(product / alpha, found, right)
            beta = float(np.linalg.norm(r))
            closed = beta <= 1e-12 * max(alphas) or right.shape[1] + found.shape[1] == dimension
        if closed or (steps >= want and (steps < 128 or steps % 8 == 0)):
            left, values, turned = np.linalg.svd(small, full_matrices=False)
            residual = beta * np.abs(left[-1])
            if closed or residual[:want].max() <= (_EPS if exact else 1e-8) * values[0]:
                keep = len(values) if closed else want
                return values[:keep], right @ turned[:keep].T
        betas.append(beta)
        r = r / beta


def principal(fit: DataFrame, centre: Centre, dimension: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues of the covariance of the fit list and their unit vectors, as columns."""

    def multiply(w: np.ndarray) -> tuple[float, np.ndarray]:
        def both(x: np.ndarray) -> np.ndarray:
            rows = centre(x)
            u = rows @ w
            return np.r_[u @ rows, u @ u]

        sums = _sums(fit, dimension, both, dimension + 1)
        return max(float(sums[-1]), 0.0), sums[:-1]

    rng = np.random.default_rng([_SEED, dimension])
    values, vectors = np.zeros(0), np.zeros((dimension, 0))
    while len(values) < dimension:
        first = not len(values)
        last = values[k - 1] * (1 + 1e-13) if len(values) >= k else 0.0
        new, directions = bidiagonalise(multiply, vectors, k if first else 1, rng, exact=first)
        if not first and len(new) and new[0] > last:  # another direction of a repeated value: exactly
            new, directions = bidiagonalise(multiply, vectors, 1, rng, exact=True)
        new_ones = new > max(last, math.sqrt(RANK) * max(values.max(initial=0), new.max(initial=0)))
        if not new_ones.any():
            break
        values, vectors = np.r_[values, new[new_ones]], np.c_[vectors, directions[:, new_ones]]
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values[:k] ** 2 / centre.n, vectors[:, :k]


def whiten(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """Project vectors of long (vec_id, x) on the principal components of their distinct values, with variance 1.

    The fit list holds each distinct x once.  One row per vector and component: vec_id,
    component (from 1, by falling eigenvalue e of the covariance with divisor n), n,
    ``deviation`` (decimal: the sum of (n x - S)^2, exact; null beyond 38 digits), ``whitened``
    ((x - S/n) on the component, over sqrt(e)), ``explained`` (e / trace) and
    ``identity_error`` (largest entry of |covariance of whitened - identity|, the same in all
    rows).  A component has either sign, the same for all rows; of equal eigenvalues any
    orthogonal directions are taken.

    Directions without variance are no components, so a list of one distinct vector gives no
    row.  Rows with a null x, a null in x or an empty x take no part; a null vec_id stays null
    and repeated rows or ids are rows of their own.  Vectors of different lengths are lists of
    their own.  Other columns are not read; an empty table gives no rows.
    """
    if components < 1:
        raise ValueError("components must be positive")
    rows = vectors.select("vec_id", F.col("x").cast("array<long>").alias("x"))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()) & (F.size("x") > 0))
    lists = stored(rows.select("x").distinct())
    lengths = sorted(r.d for r in lists.groupBy(F.size("x").alias("d")).agg(F.count("*")).collect())
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    parts = [_whitened(rows.where(F.size("x") == d), lists.where(F.size("x") == d), d, components, schema) for d in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def _whitened(rows: DataFrame, fit: DataFrame, dimension: int, k: int, schema: str) -> DataFrame:
    centre = _centre(fit, dimension)
    variances, axes = principal(fit, centre, dimension, k)
    k = len(variances)
    scaled = axes / np.sqrt(variances)

    def check(x: np.ndarray) -> np.ndarray:
        own = centre(x)
        white = own @ scaled
        return np.r_[(white.T @ white).ravel(), (own * own).sum()]

    sums = _sums(fit, dimension, check, k * k + 1)
    error = float(np.abs(sums[:-1].reshape(k, k) / centre.n - np.eye(k)).max(initial=0))
    explained = variances * centre.n / sums[-1] if k else variances

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices(batch.column(1), dimension):
                offsets = centre.offsets(x)
                white = (offsets / centre.n).astype(np.float64) @ scaled
                ids = batch.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                at += len(x)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))),
                    pa.array(np.full(len(x) * k, centre.n)), _squares(offsets).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def _squares(offsets: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row."""
    most = max(abs(int(offsets.max())), abs(int(offsets.min()))) if offsets.size else 0
    if offsets.shape[1] * most * most < 1 << 63 and offsets.dtype != object:
        return pa.array((offsets * offsets).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = offsets.astype(object)
    values = [int(v) for v in (exact * exact).sum(axis=1)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], pa.decimal128(38, 0))
