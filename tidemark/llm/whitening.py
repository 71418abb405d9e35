"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi rotations.

Three passes over the vectors, each task keeping sums of its own: exact sums per dimension,
the scatter of the centred vectors, and the projections. Between them the driver holds one
matrix of dimension x dimension, whatever the number of rows. The scatter is factored as
P'AP = LL' with the largest diagonal element first; rotating the columns of L until all are
orthogonal makes their squared norms the eigenvalues and the columns, scaled to length 1, the
components. Small eigenvalues keep their relative precision, as no squares of L are formed.

Vectors are centred at the rounded means first, which is exact in whole numbers. So the
scatter is a sum of whole numbers, and the same however rows are dealt to tasks, as long as it
is below 2^53; what the rounding left, at most a half, is taken off the small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import finite_vectors
from tidemark.session import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries beyond are held there, so that every whole number fits a long.
LARGEST = 1 << 61
#: Variance below this share of all is the rounding of constant directions.
NO_VARIANCE = 1e-12
EXACT = pa.decimal128(38, 0)


def whole_numbers(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * v), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT


def of_dimension(vectors: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of one dimension as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def dimension_sums(vectors: DataFrame) -> DataFrame:
    """(d, pos, n, s): for each dimension d that occurs, the number of vectors and the exact sum at each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            v = batch.column(0)
            sizes = pc.list_value_length(v)
            for d in pc.unique(sizes).to_pylist():
                x = whole_numbers(of_dimension(v.filter(pc.equal(sizes, d)), d)) if d else np.zeros((0, 0), np.int64)
                n, s = sums.get(d, (0, np.zeros(d, object)))
                # a batch's sums are whole numbers below 2^63 after a shift by 2^20, Python's beyond
                sums[d] = n + len(x), s + (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & ((1 << 20) - 1)).sum(axis=0).astype(object)
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(t)) for t in s], EXACT)], ["d", "pos", "n", "s"]
            )

    return vectors.select("v").mapInArrow(run, "d int, pos int, n long, s decimal(38,0)").groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def scatter(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """The sum of (x - centre)(x - centre)' over vectors of the centre's dimension."""
    dimension = len(centre)
    i, j = np.tril_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            y = (whole_numbers(of_dimension(batch.column(0), dimension)) - centre).astype(np.float64)
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = vectors.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    matrix = np.zeros((dimension, dimension))
    matrix[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["s"].to_numpy()
    return np.tril(matrix) + np.tril(matrix, -1).T


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``matrix[order][:, order] = L L'``, the largest rest of the diagonal first, stopped when nothing is left."""
    n = len(matrix)
    a, order, rest = matrix.copy(), np.arange(n), np.diag(matrix).copy()
    factor = np.zeros((n, n))
    smallest = n * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= smallest:
            return factor[:, :k], order
        for x in (order, rest):
            x[[k, p]] = x[[p, k]]
        factor[[k, p], :k] = factor[[p, k], :k]
        factor[k, k] = np.sqrt(rest[k])
        column = a[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = column / factor[k, k]
        rest[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times rotations that leave its columns orthogonal to working precision."""
    u = np.asfortranarray(factor)
    r, eps = u.shape[1], np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                a, b, g = u[:, p] @ u[:, p], u[:, q] @ u[:, q], u[:, p] @ u[:, q]
                if abs(g) <= eps * np.sqrt(a * b):
                    continue
                turned = True
                z = (b - a) / (2 * g)
                t = np.copysign(1.0, z) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                u[:, p], u[:, q] = c * (u[:, p] - t * u[:, q]), c * (t * u[:, p] + u[:, q])
        if not turned:
            break
    return u


def principal_components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows), largest first; a component's largest entry is positive."""
    factor, order = pivoted_cholesky(covariance)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((0, len(covariance)))
    u = one_sided_jacobi(factor)
    values = (u**2).sum(axis=0)
    place = np.argsort(-values, kind="stable")
    rows = np.zeros((len(values), len(covariance)))
    rows[:, order] = (u / np.sqrt(values)).T[place]
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return values[place], rows


def exact_deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """The sums of (n * y - rest)^2 over the dimensions, exactly."""
    bound = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if len(rest) * bound * bound < 1 << 62:
        z = n * y - np.asarray(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    return [min(sum((n * int(a) - b) ** 2 for a, b in zip(row, rest, strict=True)), 10**38 - 1) for row in y]


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of
    another dimension than most have (ties: the smaller one). A null key is a key, repeated rows
    count as often as they occur, other columns are left out. Directions without variance are
    no components: with one vector, or equal ones only, the result is empty, as for an empty
    table. ``deviation`` is decimal(38,0); beyond that it is held at the largest.
    ``identity_error`` is measured on the whitened rows by Spark's centred covariance.
    """
    spark = embeddings.sparkSession
    vectors = finite_vectors(embeddings, key, vector)
    kind = dict(vectors.dtypes)["id"]
    sums = written(dimension_sums(vectors), "dimension-sums")
    most = sums.where("pos = 0").orderBy(F.desc("n"), "d").first()
    found = np.zeros(0)
    if most is not None:
        n, dimension = most["n"], most["d"]
        totals = [int(r["s"]) for r in sums.where(F.col("d") == dimension).orderBy("pos").collect()]  # one row per dimension
        centre = [(2 * s + n) // (2 * n) for s in totals]
        rest = [s - n * c for s, c in zip(totals, centre, strict=True)]
        vectors = vectors.where(F.size("v") == dimension)
        middle, shift = np.asarray(centre, np.int64), np.asarray([r / n for r in rest])
        covariance = scatter(vectors, middle) / n - np.outer(shift, shift)
        spread = float(np.trace(covariance))
        found, axes = principal_components(covariance)
        keep = found[:components] > NO_VARIANCE * spread
        found, axes = found[:components][keep], axes[:components][keep]
    if not len(found):
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    projection = (axes / np.sqrt(found)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole_numbers(of_dimension(batch.column(1), dimension)) - middle
            w = (y - shift) @ projection
            exact = pa.array([Decimal(z) for z in exact_deviations(y, n, rest)], EXACT)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], ["id", "deviation", "w"])

    white = written(vectors.select("id", "v").mapInArrow(run, f"id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    pairs = [(a, b) for a in range(len(found)) for b in range(a + 1)]
    spreads = [F.abs(F.covar_pop(F.col("w")[a], F.col("w")[b]) - float(a == b)) for a, b in pairs]
    error = white.agg(F.greatest(*spreads, F.lit(0.0), F.lit(0.0))).first()[0]
    shares = F.array(*(F.lit(float(e / spread)) for e in found))
    rows = white.select("id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return rows.select(
        F.col("id").alias(key), (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("c") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
