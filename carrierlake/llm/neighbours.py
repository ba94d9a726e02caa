"""Approximate nearest neighbours by a block matrix join with error bounds.

Vectors are scaled to unit length and quantised to int8, and travel in packed blocks laid out in a grid: row blocks are copied along their
grid row, query blocks along their grid column, and each cell holds a bounded number of both. A tile is the int8 matrix product of one
block pair; the distance of its entries from the true cosines is bounded by stored residual norms. Only pairs whose upper bound reaches
the k-th best of their query so far are computed again in double precision, so nothing of the result is lost. A cell merges its tiles in
heaps and returns k rows per query; a window with a group limit merges the cells.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from carrierlake.session import cut_lineage

from .common import query

QUERY_ROWS = 256
BLOCK_ROWS = 1024
#: Blocks of either kind that a cell is meant to hold.
CELL = 8

PACKED = "block bigint, dim int, ids binary, codes binary, scales binary, residuals binary, vectors binary"
PARTS = (("ids", np.int64), ("codes", np.int8), ("scales", np.float64), ("residuals", np.float64), ("vectors", np.float64))


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v as doubles): rows with an id and a vector of finite components that are not all zero."""
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where("id is not null and size(v) > 0").where(finite).where(F.exists("v", lambda x: x != 0))


def unit_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, residual norms); the largest component is divided out first, so squares can't overflow."""
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    scales = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    return codes, scales, np.linalg.norm(unit - codes * scales[:, None], axis=1)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) of one task in blocks of ``size``; a block holds vectors of one length."""

    def pack(batches):
        first, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def close(dim):
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for i in range(0, len(ids), size):
                some = np.ascontiguousarray(vectors[i : i + size])
                arrays = [x.tobytes() for x in (ids[i : i + size], *unit_codes(some), some)]
                columns = [pa.array([first + made]), pa.array([dim], pa.int32()), *[pa.array([x], pa.binary()) for x in arrays]]
                made += 1
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("v")])
            values, ids = batch.column("v").flatten().to_numpy(), batch.column("id").to_numpy()
            begins = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                held.setdefault(dim, []).append((ids[at], values[begins[at][:, None] + np.arange(dim)]))
                if sum(len(x[0]) for x in held[dim]) >= size:
                    yield from close(dim)
        for dim in list(held):
            yield from close(dim)

    return rows.mapInArrow(pack, PACKED)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision; a row's sums do not depend on the other rows. Scaling keeps squares in range."""
    x, y = (v / np.ldexp(1.0, np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def tile(q: dict, c: dict, dim: int, heaps: list[list], k: int) -> None:
    """Merge the rows of block c into the heaps of the queries of block q: each the k best (-score, id) found so far, in order."""
    # int8 products are exact in float32 while dim * 127^2 < 2^24, else float64 holds them
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    dots = (q["codes"].reshape(-1, dim).astype(exact) @ c["codes"].reshape(-1, dim).astype(exact).T).astype(np.float64)
    about = dots * q["scales"][:, None] * c["scales"][None, :]
    # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'| with unit x and y, |x'| <= 1 + |x - x'|
    bound = q["residuals"][:, None] + (1 + q["residuals"][:, None]) * c["residuals"][None, :] + 1e-9
    own = q["ids"][:, None] == c["ids"][None, :]
    low = np.where(own, -np.inf, about - bound)
    place = max(low.shape[1] - k, 0)
    kth = np.partition(low, place, axis=1)[:, place] if low.shape[1] >= k else np.full(len(low), -np.inf)
    so_far = np.array([-h[k - 1][0] - 1e-9 if len(h) >= k else -np.inf for h in heaps])
    i, j = np.nonzero((about + bound >= np.maximum(kth, so_far)[:, None]) & ~own)
    scores = cosines(q["vectors"].reshape(-1, dim)[i], c["vectors"].reshape(-1, dim)[j]) if len(i) else np.empty(0)
    starts = np.searchsorted(i, np.arange(len(heaps) + 1))
    for n in range(len(heaps)):
        a, b = starts[n], starts[n + 1]
        heaps[n] = heapq.nsmallest(k, [*heaps[n], *zip((-scores[a:b]).tolist(), c["ids"][j[a:b]].tolist())])


def nearest(table: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table`` nearest each row of ``queries`` by cosine, its own id left out.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
    without id; vectors of different length are not compared. Rows that repeat an id are candidates of their own; queries that repeat one
    count once. Fewer than k candidates give fewer rows, empty tables an empty table.
    """
    blocks = cut_lineage(packed(usable(table, id_column, vector), block_rows))
    asked = cut_lineage(packed(usable(queries, id_column, vector).dropDuplicates(["id"]), query_rows))
    high, wide = (max(1, math.ceil(x.count() / CELL)) for x in (blocks, asked))

    def along(side: DataFrame, own: str, own_size: int, other: str, other_size: int) -> DataFrame:
        placed = side.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(own_size)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_size - 1).cast("bigint"))))

    def cell(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows, asks = ([{"dim": r["dim"]} | {n: np.frombuffer(r[n], t) for n, t in PARTS} for r in x.to_pylist()] for x in (left, right))
        found = []
        for q in asks:
            heaps: list[list] = [[] for _ in range(len(q["ids"]))]
            for c in rows:
                if c["dim"] == q["dim"]:
                    tile(q, c, q["dim"], heaps, k)
            found += [(n, vec, -s) for n, heap in zip(q["ids"].tolist(), heaps) for s, vec in heap]
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    rows = along(blocks, "r", high, "c", wide).groupBy("r", "c")
    found = rows.cogroup(along(asked, "c", wide, "r", high).groupBy("r", "c")).applyInArrow(cell, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op9_neighbours")
def op9(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(table, table.where("vec_id % 50 = 0"), 5)
