"""Embedding whitening with components from FEAST contour integration.

Vectors are rounded to integers and the distinct ones are the fit list. Its sums are exact, and its covariance is added up from centred
blocks: one matrix per task, merged row by row. What follows is bounded by the dimension, not by the rows: Sturm counts (the inertia of
the shifted tridiagonal form) locate eigenvalues and put interval ends into gaps, each interval is solved by itself in a task (quadrature of
complex shifted solves around it projects a random block onto its eigenspace, Rayleigh-Ritz extracts the pairs), and a result is taken
only if its number of eigenvalues is the inertia count of the interval and all residuals are at rounding level.
"""

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from carrierlake.session import cut_lineage

from .common import query

#: Integers per unit. The constant that the contract adds to every integer drops out of all results.
SCALE = 64.0
#: Integers beyond this saturate.
MOST = 1 << 62
COMPONENTS = 16
#: Eigenvalues that an interval is meant to hold, and quadrature points on the upper half of its circle.
AT_ONCE = 6
POINTS = 12
#: Residuals, relative to the norm of the covariance and the dimension's root, that count as converged.
CONVERGED = 2e-15
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# rows as integer vectors


def encoded(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, dim, code): finite vectors as integers. A code is one byte of width, then the integers in the smallest width that holds them all,
    so equal codes of one dimension are equal vectors.
    """
    rows = table.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where("v is not null and size(v) > 0").where(finite)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy()
            lengths = np.array([len(x) for x in batch.column("v")], np.int64)
            begins = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(values[begins[at][:, None] + np.arange(dim)] * SCALE), -MOST, MOST).astype(np.int64)
                most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
                width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
                codes = [bytes([w]) + row.astype(f"<i{w}").tobytes() for w, row in zip(width.tolist(), x)]
                ids = batch.column("id").take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array([dim] * len(at), pa.int32()), pa.array(codes, pa.binary())], names=["id", "dim", "code"])

    return rows.mapInArrow(encode, "id bigint, dim int, code binary")


def decoded(codes: pa.Array, dim: int) -> np.ndarray:
    """Codes as a matrix of int64."""
    out = np.empty((len(codes), dim), np.int64)
    raw = codes.to_pylist()
    width = np.array([c[0] for c in raw], np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(raw[i][1:] for i in at), f"<i{w}").reshape(len(at), dim)
    return out


# sums over all rows, merged per dimension


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, sums per dimension) as integers of any size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = decoded(batch.column("code"), dim)
            if len(x):
                n += len(x)
                small = int(np.abs(x).max()) < MOST // len(x)
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
        if n:
            columns = [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(s) for s in sums])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s"])

    parts = fit.mapInArrow(partial, "i int, n bigint, s string")
    total = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (total[0].n, [int(r.s) for r in total]) if total else (0, [])


def matrix_sum(fit: DataFrame, size: int, block: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum over tasks of the ``size``-column matrix that ``block`` adds up from the codes of a batch; its rows are merged apart."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = block(batch.column("code"))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "part"])

    def merged(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(parts.column("part").to_pylist()), np.float64).reshape(-1, size)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})

    rows = fit.mapInArrow(partial, "i int, part binary").groupBy("i").applyInArrow(merged, "i int, part binary").collect()
    return np.array([np.frombuffer(r.part, np.float64) for r in sorted(rows, key=lambda r: r.i)])


# eigenpairs of one symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of a tridiagonal matrix similar to the symmetric a, by reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += math.copysign(norm, x[0])
        u = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ u
        p -= (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, p) + np.outer(p, u))
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues below each shift: negative pivots of the shifted matrix (Sylvester)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - shifts
    count = (q < 0).astype(np.int64)
    with np.errstate(over="ignore"):
        for d, o in zip(diagonal[1:], off):
            q = d - shifts - o * o / np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
    return count


def located(diagonal: np.ndarray, off: np.ndarray) -> np.ndarray:
    """All eigenvalues in falling order, each bisected on its own inertia counts."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(n, (diagonal - reach).min()), np.full(n, (diagonal + reach).max())
    wanted = np.arange(n)[::-1]  # so many lie below it
    for _ in range(64):
        middle = (low + high) / 2
        above = inertia(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def intervals(values: np.ndarray, k: int, at_once: int = AT_ONCE) -> list[tuple[float, float, int]]:
    """(low, high, count): intervals with ends in gaps that hold the k largest of the falling values, more only where no gap divides them."""
    n, norm = len(values), max(abs(values[0]), abs(values[-1]), np.finfo(float).tiny)
    gaps = np.append(values[:-1] - values[1:], norm)  # below the last there is room
    out, at, high = [], 0, values[0] + max(gaps[0], 1e-3 * norm)
    while at < min(k, n):
        ends = np.arange(at, n)
        divides = ends[gaps[ends] > 1e-10 * norm]
        near = divides[divides < at + at_once]
        end = int(near[np.argmax(gaps[near])] if len(near) else divides[0])
        low = values[end] - gaps[end] / 2
        out.append((float(low), float(high), end + 1 - at))
        at, high = end + 1, low
    return out


def contour_pairs(a: np.ndarray, low: float, high: float, count: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``count`` eigenvalues of a in [low, high].

    The block of trial vectors doubles until the pairs found are as many as the inertia count and their residuals are at rounding level;
    a block of full size spans the whole space, so the search ends.
    """
    n = len(a)
    nodes, weights = np.polynomial.legendre.leggauss(points)
    theta = np.pi / 2 * (1 - nodes)  # upper half circle; conjugate points give the real part
    centre, radius = (low + high) / 2, (high - low) / 2
    arc = radius * np.exp(1j * theta)
    norm = np.abs(a).sum(axis=0).max()
    rng = np.random.default_rng(n)
    size = min(n, count + max(2, count // 2))
    while True:
        block = rng.standard_normal((n, size))
        for _ in range(30):
            if size < n:
                block = sum(w / 2 * np.real(z * np.linalg.solve((centre + z) * np.eye(n) - a, block)) for w, z in zip(weights, arc))
            basis, kept, _ = np.linalg.svd(block, full_matrices=False)
            basis = basis[:, kept > 1e-14 * kept[0]] if kept[0] > 0 else basis
            values, inner = np.linalg.eigh(basis.T @ a @ basis)
            vectors = basis @ inner
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == count and (size == n or residual.max() <= CONVERGED * norm * math.sqrt(n)):
                return values[inside], vectors[:, inside]
            if size == n:
                break
            block = vectors
        if size == n:
            raise ArithmeticError(f"{inside.sum()} eigenvalues in an interval whose inertia counts {count}")
        size = min(n, 2 * size)


def eigenpairs(spark: SparkSession, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows): the k largest, falling; the largest entry of a vector is positive. One task per interval."""
    found = intervals(located(*tridiagonal(a)), k)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                values, vectors = contour_pairs(a, *found[i])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([np.ascontiguousarray(v).tobytes() for v in vectors.T], pa.binary())], names=["e", "v"])

    pairs = spark.range(0, len(found), 1, len(found)).mapInArrow(solve, "e double, v binary").collect()
    pairs = sorted(((r.e, np.frombuffer(r.v, np.float64)) for r in pairs), key=lambda p: (-p[0], p[1].tobytes()))[:k]
    vectors = np.array([v * math.copysign(1.0, v[np.argmax(np.abs(v))]) for _, v in pairs])
    return np.array([e for e, _ in pairs]), vectors


# whitening


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2; null where a long can't hold it."""
    base = [s // n for s in sums]
    most = max(max(abs(int(x[:, i].max()) - b), abs(int(x[:, i].min()) - b)) for i, b in enumerate(base)) + 1
    if x.shape[1] * (n * most) ** 2 < 1 << 63:
        apart = n * (x - np.array(base, np.int64)) - np.array([s - n * b for s, b in zip(sums, base)], np.int64)
        return (apart * apart).sum(axis=1).tolist()
    totals = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [t if t < 1 << 63 else None for t in totals]


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: its integer vector whitened, over the distinct integer vectors of the table.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part; of several vector lengths, the one of most rows
    (of equal ones the longest) is whitened and the others take no part. Repeated rows give repeated results and count once in the fit; a null
    id stays null. Components without variance (an eigenvalue at rounding level, so also those of a single distinct vector) have no
    whitened value and are left out. Entries whose integer exceeds 2^62 saturate; a deviation that exceeds a long is null. An empty
    table gives an empty table.
    """
    spark = table.sparkSession
    codes = cut_lineage(encoded(table, id_column, vector))
    common = codes.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dim = common.dim
    rows = codes.where(F.col("dim") == dim)
    fit = cut_lineage(rows.select("code").distinct())
    n, sums = exact_sums(fit, dim)
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def centred(found: pa.Array) -> np.ndarray:
        return decoded(found, dim) - mean

    def gram(x: np.ndarray) -> np.ndarray:
        return x.T @ x

    covariance = matrix_sum(fit, dim, lambda c: gram(centred(c))) / n
    values, vectors = eigenpairs(spark, (covariance + covariance.T) / 2, min(components, dim))
    trace = float(np.trace(covariance))
    varies = values > dim * np.finfo(float).eps * trace
    values, vectors = values[varies], vectors[varies]
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    project = (vectors / np.sqrt(values)[:, None]).T
    middle = matrix_sum(fit, k, lambda c: (centred(c) @ project).sum(axis=0, keepdims=True))[0] / n
    error = float(np.abs(matrix_sum(fit, k, lambda c: gram(centred(c) @ project - middle)) / n - np.eye(k)).max())

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = decoded(batch.column("code"), dim)
            place = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("id").take(place),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(place),
                pa.array(((x - mean) @ project).ravel()),
                pa.array(np.tile(values / trace, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.select("id", "code").mapInArrow(transform, RESULT)


@query("op12_whitening")
def op12(spark, folder):
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
