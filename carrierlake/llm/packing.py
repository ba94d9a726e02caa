"""Packing by cutting-stock column generation.

Documents become token ids; a document longer than a sequence gives whole sequences and a remainder. Remainders are counted by length, at
most one number per length, which is all the driver sees. A linear program over patterns (how many pieces of each size class fill one
sequence) is solved by column generation: the duals price the classes and a knapsack over the capacity proposes the next pattern. The
solution is rounded down, and pieces, ranked within their class, take the slots of the patterns by arithmetic on their rank. What rounding
leaves over is laid end to end and cut to fill the gaps of the patterns exactly, so a sequence has no padding while such pieces last.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from carrierlake.session import cut_lineage

from .common import documents, query
from .tokens import default_vocabulary, encoder, slices

CAPACITY = 4096
END_ID = 2
#: Size classes: a piece of length n counts as ceil(n / UNIT) units of the sequence's CAPACITY / UNIT.
UNIT = 32
#: Rows of one group where running sums are formed in two steps, and pieces of one length that are ranked together.
GROUP = 50_000
RANKED = 1_000

PIECES = "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(PIECES): each document's ids with the end id, cut into whole sequences and a remainder; ids little-endian unsigned 32-bit."""

    def cut(batches):
        tokens = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ends, ids = tokens.encode(part.column("text"), end_id)
                wide = ids.astype("<u4")
                sizes = np.diff(ends, prepend=0)
                pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(ends)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(sizes[of] - start, capacity)
                at = (ends - sizes)[of] + start
                # the pieces lie one after the other in the ids: no copy per piece
                offsets = np.append(at, len(wide)).astype(np.int32) * 4
                blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(wide)])
                columns = [part.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(sizes[of]), blobs]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_pattern(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: (value, count per class) of the most valuable filling; class i has size i + 1."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, int)
    for room in range(1, size + 1):
        sizes = np.arange(1, min(room, len(values)) + 1)
        gains = values[sizes - 1] + best[room - sizes]
        at = int(gains.argmax())
        best[room], last[room] = (gains[at], sizes[at]) if gains[at] > best[room - 1] else (best[room - 1], 0)
    counts, room = np.zeros(len(values), int), size
    while room > 0:
        if last[room]:
            counts[last[room] - 1] += 1
        room -= last[room] or 1
    return float(best[size]), counts


def solve_patterns(demand: np.ndarray, size: int, most: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Column generation for the fewest sequences: (pattern, times) with sum of times * pattern = demand, times >= 0.

    A basis of one pattern per demanded class, started from patterns of a single class; every step prices the classes by the basis, asks
    the knapsack for a pattern worth more than one sequence and swaps it in. Every basis on the way is a full solution, so a stop at ``most``
    steps would only cost padding.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    wanted = demand[classes].astype(float)
    basis = np.diag(size // (classes + 1)).astype(float)
    times = wanted / np.diag(basis)
    for _ in range(most):
        prices = np.linalg.solve(basis.T, np.ones(len(classes)))
        values = np.full(size, -1.0)
        values[classes] = prices
        worth, counts = best_pattern(values, size)
        if worth <= 1 + 1e-9:
            break
        entering = counts[classes].astype(float)
        step = np.linalg.solve(basis, entering)
        ratios = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratios.argmin())
        times = times - ratios[leaving] * step
        times[leaving] = ratios[leaving]
        times = np.maximum(times, 0)
        basis[:, leaving] = entering
    out = []
    for column, n in zip(basis.T, times):
        pattern = np.zeros(size, int)
        pattern[classes] = column.round().astype(int)
        out.append((pattern, float(n)))
    return out


def slot_plan(histogram: dict[int, int], capacity: int, unit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((class, first rank, end rank, first sequence, slots per sequence), number of sequences) from counts by length.

    Within a class, ranks go from the longest piece down, so the lengths that stay over, and the gaps that the others leave, follow from
    the histogram. Times are rounded down after a scale that is lowered until what is left over fills those gaps.
    """
    size = capacity // unit
    demand, lengths = np.zeros(size, int), {}
    for length, n in sorted(histogram.items(), reverse=True):
        c = -(-length // unit)
        demand[c - 1] += n
        lengths.setdefault(c, []).append((length, n))
    patterns, total = solve_patterns(demand, size), sum(x * n for x, n in histogram.items())
    for scale in [1.0, *(1 - 0.002 * i for i in range(1, 101)), *(0.8 - 0.02 * i for i in range(1, 41)), 0.0]:
        times = [math.floor(n * scale + 1e-9) for _, n in patterns]
        used = np.array([p * n for (p, _), n in zip(patterns, times)]).sum(axis=0) if patterns else np.zeros(size, int)
        laid = 0
        for c, rows in lengths.items():
            left = int(used[c - 1])
            for length, n in rows:
                laid += length * min(left, n)
                left -= min(left, n)
        if total - laid >= sum(times) * capacity - laid:
            break
    slots, taken, sequence = [], np.zeros(size, int), 0
    for (pattern, _), n in zip(patterns, times):
        if n:
            for c in np.flatnonzero(pattern):
                slots.append((int(c) + 1, int(taken[c]), int(taken[c] + n * pattern[c]), sequence, int(pattern[c])))
                taken[c] += n * pattern[c]
            sequence += n
    return slots, sequence


def running(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """rows with ``out``: sum of ``value`` over smaller ``order`` (dense whole numbers): sums per group of rows first, then inside."""
    group = F.floor(F.col(order) / GROUP)
    rows = rows.withColumn("_group", group)
    sums = rows.groupBy("_group").agg(F.sum(value).alias("_sum"))
    before = sums.select(F.col("_group"), (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_group").orderBy(order)) - F.col(value)
    return rows.withColumn("_inside", inside).join(before, "_group").withColumn(out, F.col("_before") + F.col("_inside")).drop("_group", "_inside", "_before")


def ranked_pieces(pieces: DataFrame, histogram: dict[int, int], unit: int) -> DataFrame:
    """(piece, length, class, rank): ranks within a class from the longest piece down, dense from 0.

    A length is spread over as many salts as its count asks for; their counts give each salt its first rank.
    """
    spark = pieces.sparkSession
    before, seen = [], {}
    for length, n in sorted(histogram.items(), reverse=True):
        c = -(-length // unit)
        before.append((length, c, seen.get(c, 0), math.ceil(n / RANKED)))
        seen[c] = seen.get(c, 0) + n
    starts = F.broadcast(spark.createDataFrame(before, "length int, class int, first bigint, salts bigint"))  # one row per length, at most the capacity
    salted = pieces.join(starts, "length").select("piece", "length", "class", "first", F.pmod(F.xxhash64("piece"), F.col("salts")).alias("salt"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece")) - 1
    placed = salted.withColumn("own", own).join(offsets, ["length", "salt"])
    return placed.select("piece", "length", "class", (F.col("first") + F.col("offset") + F.col("own")).alias("rank"))


def overlaps(fillers: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """Cuts of the fillers (piece, at, length) that fill the gaps (sequence_id, offset, at, length) of one line; ``at`` is the place on it."""
    cell = lambda c: F.floor(c / capacity)
    both = lambda rows: rows.withColumn("cell", F.explode(F.sequence(cell(F.col("at")), cell(F.col("at") + F.col("length") - 1))))
    f = both(fillers.where("length > 0")).select("cell", "piece", F.col("at").alias("f_at"), (F.col("at") + F.col("length")).alias("f_end"))
    g = both(gaps.where("length > 0")).select("cell", "sequence_id", "offset", F.col("at").alias("g_at"), (F.col("at") + F.col("length")).alias("g_end"))
    begin, end = F.greatest("f_at", "g_at"), F.least("f_end", "g_end")
    met = f.join(g, "cell").where((begin < end) & (cell(begin) == F.col("cell")))
    return met.select("piece", (begin - F.col("f_at")).alias("cut"), (end - begin).cast("int").alias("take"), "sequence_id", (F.col("offset") + begin - F.col("g_at")).alias("offset"))


def packing_plan(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """(piece, cut, take, sequence_id, offset) for every piece (piece, length); a piece may be cut into several."""
    spark = pieces.sparkSession
    parts = pieces.where(F.col("length") < capacity)
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity - 1 rows
    numbered = F.col("piece").cast("bigint")
    if not histogram:
        return pieces.select("piece", F.lit(0).cast("bigint").alias("cut"), F.col("length").alias("take"), numbered.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    slots, sequences = slot_plan(histogram, capacity, unit)
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1)], "class int, low bigint, high bigint, base bigint, per bigint")  # classes squared rows at most
    ranked = cut_lineage(ranked_pieces(parts, histogram, unit))
    slot = ranked.join(F.broadcast(table), "class", "left").where("rank >= low and rank < high")
    slot = slot.select("piece", "length", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("per"))).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "piece")
    laid = cut_lineage(slot.withColumn("offset", F.sum("length").over(inside) - F.col("length")))
    # gaps of the pattern sequences on one line, then new sequences for what is over
    sums = laid.groupBy("sequence_id").agg(F.sum("length").alias("offset"))
    gaps = running(sums.withColumn("length", capacity - F.col("offset")), "sequence_id", "length", "at")
    top = table.groupBy("class").agg(F.max("high").alias("top"))
    over = ranked.join(F.broadcast(top), "class", "left").where(F.col("rank") >= F.coalesce("top", F.lit(0)))
    counts = over.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"))
    firsts = counts.select("class", "low", (F.sum("n").over(Window.orderBy("class")) - F.col("n")).alias("first"))  # one row per class
    over = over.join(F.broadcast(firsts), "class").select("piece", "length", (F.col("first") + F.col("rank") - F.col("low")).alias("number"))
    fillers = cut_lineage(running(over, "number", "length", "at"))
    gaps = cut_lineage(gaps)
    gap_sum = gaps.agg(F.sum("length")).first()[0] or 0
    left = (fillers.agg(F.sum("length")).first()[0] or 0) - gap_sum
    more = gaps.select("sequence_id", "offset", "at", "length")
    if left > 0:
        whole, rest = divmod(left, capacity)
        base = sequences
        fresh = spark.range(whole).select((F.col("id") + base).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), (F.col("id") * capacity + gap_sum).alias("at"), F.lit(capacity).cast("bigint").alias("length"))
        powers, at = [], gap_sum + whole * capacity
        for bit in reversed(range(capacity.bit_length())):  # the last rest as powers of two, which need no padding
            if rest >> bit & 1:
                powers.append((base + whole + len(powers), 0, at, 1 << bit))
                at += 1 << bit
        more = more.unionByName(fresh)
        if powers:
            more = more.unionByName(spark.createDataFrame(powers, "sequence_id bigint, offset bigint, at bigint, length bigint"))
        sequences = base + whole + len(powers)
    cuts = overlaps(fillers, more, capacity)
    plain = laid.select("piece", F.lit(0).cast("bigint").alias("cut"), F.col("length").alias("take"), "sequence_id", "offset")
    full = pieces.where(F.col("length") == capacity).select("piece", F.lit(0).cast("bigint").alias("cut"), F.col("length").alias("take"), (numbered + sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return plain.unionByName(cuts.select(plain.columns)).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece, ids little-endian unsigned 32-bit.

    Every row of ``docs`` is packed once: rows with one doc_id are packed apart, null text is the end id alone, null doc_id stays null. Numbers
    of whole sequences are not dense. An empty table gives an empty table. ``capacity`` must be a power of two and a multiple of ``unit``.
    """
    pieces = tokenised(docs, vocabulary or default_vocabulary(), end_id, capacity)
    pieces = cut_lineage(pieces.withColumn("piece", F.monotonically_increasing_id()))
    plan = packing_plan(pieces.select("piece", "length"), capacity, unit)
    joined = pieces.join(plan, "piece")
    ids = F.when(F.col("take") == F.col("length"), F.col("ids")).otherwise(F.substring("ids", (4 * F.col("cut") + 1).cast("int"), (4 * F.col("take")).cast("int")))
    return joined.select("doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("take").cast("long").alias("length"), "doc_tokens", "sequence_id", "offset", ids.alias("ids"))


@query("op5_packing")
def op5(spark, folder):
    packed = pack_documents(documents(spark, folder))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
