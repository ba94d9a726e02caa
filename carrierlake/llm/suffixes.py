"""Suffix dedup: windows of a fixed number of bytes that occur earlier, by a depth-limited radix sort of suffixes.

A window (the first ``depth`` bytes of a suffix) belongs to its anchor: the leftmost of its ``gram``-byte strings with the least hash. Equal
windows have equal anchors at equal places, so suffixes are dealt by anchor, about one per 35 bytes, in packed arrays; an anchor
that occurs once ends there, and with it all of its suffixes. What is left are stretches of bytes around repeated anchors. Equal
stretches meet in one aggregate (by 128 bits of hash); different ones of one anchor are sorted suffix by suffix, eight bytes a pass from
the most significant, where suffixes that are alone leave after every pass. Groups equal after ``depth`` bytes are the repeated windows;
the first place keeps its bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from carrierlake.session import cut_lineage, discard, release

from .common import documents, query
from .jaccard import from_planes, mixed, planes
from .tokens import slices

DEPTH = 100
GRAM = 32
#: An anchor that occurs more often in one batch is dealt as a mark; its places stay with their documents.
COMMON = 8
#: An anchor with more different stretches is compared window by window in aggregates, not within one task.
MOST_STRETCHES = 20_000

DEALT = "bucket int, ids binary, docs binary, hashes binary, places binary, marks binary, digests binary, sizes binary"
FOUND = "kind int, doc_id bigint, h bigint, a int, lo int, hi int, n_bytes bigint, sha binary"
DOCUMENT, PLACE = range(2)
KEYED = "h bigint, key bigint, doc_id bigint, a int, lo int, hi int"


def anchors(data: np.ndarray, ends: np.ndarray, depth: int, gram: int):
    """(text, hash, place, first start, last start) of the anchors of texts that end at ``ends``; starts are those of their windows."""
    n, width = len(data), depth - gram + 1
    if n < depth:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    with np.errstate(over="ignore"):
        h = mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        done = 1
        while done < gram:  # strings of done bytes to strings of done + step bytes
            step = min(done, gram - done)
            h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> np.uint64(29)))
            done += step
        h = mixed(h)
    bits = np.uint64(int(len(h)).bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # hash, then place: the leftmost of equal ones
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    begins = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), np.maximum(ends - begins - depth + 1, 0))
    starts = np.concatenate([np.arange(b, e - depth + 1) for b, e in zip(begins, ends) if e - b >= depth] or [np.empty(0, np.int64)])
    at = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(at))[1:] - 1
    own = text[first]
    return own, h[at[first]], at[first] - begins[own], starts[first] - begins[own], starts[last] - begins[own]


def dealt_anchors(docs: DataFrame, buckets: int, depth: int, gram: int) -> DataFrame:
    """One pass over the text, two kinds of rows (DEALT), each packed per batch.

    bucket 0 and up: anchors of one hash range with their places (place, and how far before it its windows start), and ``marks``: hashes
    of anchors common in the batch. Below 0: documents with ``sizes`` and SHA-256 ``digests``, and the places of common anchors, which
    they keep; ``marks`` tells ids that are not null.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length())
    names = [c.split()[0] for c in DEALT.split(", ")]

    def deal(batches):
        holder = -1 - TaskContext.get().partitionId() % buckets
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary())
                sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(part.column("doc_id"), 0).to_numpy()
                raw = texts.to_pylist()
                shas = [hashlib.sha256(x).digest() for x in raw]
                digests = np.array([int.from_bytes(x[:8], "little") for x in shas], np.uint64)
                d, h, a, lo, hi = anchors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes), depth, gram)
                d, h, a, lo, hi = (x[known[d]] for x in (d, h, a, lo, hi))  # rows without doc_id have no order: they meet nobody
                place = np.stack([a, a - lo, a - hi], axis=1).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                sorted_h = h[order]
                first = np.ones(len(h), bool)
                first[1:] = sorted_h[1:] != sorted_h[:-1]
                runs = np.flatnonzero(first)
                lengths = np.diff(np.append(runs, len(h)))
                often = np.zeros(len(h), bool)
                often[order] = np.repeat(lengths > COMMON, lengths)
                marks = sorted_h[runs[lengths > COMMON]]
                mine = np.flatnonzero(often)
                rows = [(holder, ids.tobytes(), d[mine].astype(np.uint32).tobytes(), h[mine].tobytes(), place[mine].T.tobytes(), known.tobytes(), b"".join(shas), sizes.tobytes())]
                rest = order[~often[order]]
                rh = h[rest]
                edges = np.arange(buckets).astype(np.uint64)
                cuts, mark_cuts = np.append(np.searchsorted(rh >> shift, edges), len(rh)), np.append(np.searchsorted(marks >> shift, edges), len(marks))
                for b in range(buckets):
                    here, m = rest[cuts[b] : cuts[b + 1]], marks[mark_cuts[b] : mark_cuts[b + 1]]
                    if not len(here) and not len(m):
                        continue
                    used, at = np.unique(d[here], return_inverse=True)
                    at = at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                    offsets = [place[here, 0].tobytes(), *[place[here, i].astype(np.uint8 if depth <= 255 else np.uint32).tobytes() for i in (1, 2)]]
                    rows.append((b, planes(ids[used]), at.tobytes(), planes(h[here]), b"".join(offsets), m.tobytes(), digests[used].tobytes(), None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(deal, DEALT)


def found_table(kind: int, length: int, **columns) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "h": pa.int64(), "a": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "n_bytes": pa.int64(), "sha": pa.binary()}
    return pa.table({"kind": pa.array(np.full(length, kind, np.int32))} | {c: columns[c] if c in columns else pa.nulls(length, t) for c, t in kinds.items()})


def place_table(ids: np.ndarray, h: np.ndarray, place: np.ndarray) -> pa.Table:
    a, lo, hi = place.astype(np.int32)
    return found_table(PLACE, len(ids), doc_id=pa.array(ids), h=pa.array(h.view(np.int64)), a=pa.array(a), lo=pa.array(a - lo), hi=pa.array(a - hi))


def repeated_places(dealt: DataFrame, depth: int) -> DataFrame:
    """(FOUND): every document, and the places of anchors that occur twice or more in different texts or in one; of copies the smallest doc_id."""

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            out = []
            for row in table.to_pylist():
                ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
                shas = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
                out.append(found_table(DOCUMENT, len(ids), doc_id=pa.array(ids, mask=~np.frombuffer(row["marks"], bool)), n_bytes=pa.array(sizes), sha=pa.array(shas, pa.binary())))
                place = np.frombuffer(row["places"], np.uint32).reshape(3, -1)
                out.append(place_table(ids[np.frombuffer(row["docs"], np.uint32)], np.frombuffer(row["hashes"], np.uint64), place))
            return pa.concat_tables(out)
        parts, marks = [], [np.empty(0, np.uint64)]
        small = np.uint8 if depth <= 255 else np.uint32
        for row in table.to_pylist():
            h, ids = from_planes(row["hashes"], np.uint64), from_planes(row["ids"], np.int64)
            at = np.frombuffer(row["docs"], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
            a = np.frombuffer(row["places"], np.uint32, len(h))
            before = np.frombuffer(row["places"], small, 2 * len(h), 4 * len(h)).reshape(2, -1).astype(np.uint32)
            parts.append((h, np.frombuffer(row["digests"], np.uint64)[at], ids[at], np.concatenate([a[None], before])))
            marks.append(np.frombuffer(row["marks"], np.uint64))
        h, digest, ids, place = (np.concatenate(x, axis=-1) for x in zip(*parts))
        order = np.lexsort((ids, place[0], digest, h))
        h, digest, ids, place = h[order], digest[order], ids[order], place[:, order]
        fresh = np.ones(len(h), bool)  # not the same place of a copy
        fresh[1:] = (h[1:] != h[:-1]) | (digest[1:] != digest[:-1]) | (place[0, 1:] != place[0, :-1])
        h, ids, place = h[fresh], ids[fresh], place[:, fresh]
        again = np.isin(h, np.unique(np.concatenate(marks)))
        same = h[1:] == h[:-1]
        again[1:] |= same
        again[:-1] |= same
        return place_table(ids[again], h[again], place[:, again])

    return dealt.groupBy("bucket").applyInArrow(find, FOUND)


def stretch_keys(texts: DataFrame, depth: int) -> DataFrame:
    """(KEYED) from (doc_id, text, places): a 64-bit key of the bytes of each anchor's windows and of where the anchor lies in them."""

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, places = row["text"].encode(), row["places"]
                keys = [
                    int.from_bytes(hashlib.blake2b(data[p["lo"] : p["hi"] + depth], digest_size=8, salt=(p["a"] - p["lo"]).to_bytes(8, "little")).digest(), "little", signed=True)
                    for p in places
                ]
                columns = [[p["h"] for p in places], keys, [row["doc_id"]] * len(places), *[[p[c] for p in places] for c in ("a", "lo", "hi")]]
                kinds = (pa.int64(),) * 3 + (pa.int32(),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in KEYED.split(", ")])

    return texts.mapInArrow(cut, KEYED)


STRETCH = "h bigint, doc_id bigint, a int, lo int, hi int, m bigint, bytes binary"


def stretches(texts: DataFrame, depth: int) -> DataFrame:
    """(STRETCH) from (doc_id, text, places): the bytes of an anchor's windows, from its first start to the end of its last window."""

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, places = row["text"].encode(), row["places"]
                blobs = [data[p["lo"] : p["hi"] + depth] for p in places]
                columns = [[p["h"] for p in places], [row["doc_id"]] * len(places), *[[p[c] for p in places] for c in ("a", "lo", "hi", "m")], blobs]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in STRETCH.split(", ")])

    return texts.mapInArrow(cut, STRETCH)


def radix_groups(buffer: bytes, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix numbers, group) of suffixes that share their first ``depth`` bytes and their given group with another.

    ``at`` are offsets in ``buffer``. Each pass orders by the next eight bytes within the groups so far; suffixes alone in a group leave.
    """
    digits = np.ndarray((len(buffer) + 1,), ">u8", buffer + b"\0" * 8, strides=(1,))
    left = np.arange(len(at))
    for begin in [*range(0, depth - 8, 8), depth - 8]:
        digit = digits[at[left] + begin]
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new)
        stays = np.bincount(number)[number] > 1
        left, group = left[stays], number[stays]
        if not len(left):
            break
    return left, group


def sorted_windows(reps: DataFrame, buckets: int, depth: int) -> DataFrame:
    """(doc_id, begin, end): bytes of windows that another stretch of the same anchor holds earlier, by radix passes within hash ranges."""

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = table.column("bytes").to_pylist()
        h, doc, a, lo, hi = (table.column(c).to_numpy() for c in ("h", "doc_id", "a", "lo", "hi"))
        sizes = np.array([len(b) for b in blobs])
        counts = hi - lo + 1
        of = np.repeat(np.arange(len(blobs)), counts)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = lo[of] + shift
        _, anchor = np.unique(h, return_inverse=True)
        # windows of one anchor that begin equally far before it
        group = anchor[of] * (depth + 1) + (a[of] - start)
        left, same = radix_groups(b"".join(blobs), (np.cumsum(sizes) - sizes)[of] + shift, group, depth)
        order = np.lexsort((start[left], doc[of[left]], same))
        left, same = left[order], same[order]
        later = np.zeros(len(left), bool)
        later[1:] = same[1:] == same[:-1]
        gone = left[later]
        order = np.lexsort((start[gone], of[gone]))
        gone = gone[order]
        new = np.ones(len(gone), bool)
        new[1:] = (of[gone[1:]] != of[gone[:-1]]) | (start[gone[1:]] != start[gone[:-1]] + 1)
        first = np.flatnonzero(new)
        last = np.append(first, len(gone))[1:] - 1
        return pa.table({"doc_id": doc[of[gone[first]]], "begin": start[gone[first]].astype(np.int64), "end": start[gone[last]].astype(np.int64) + depth})

    dealt = reps.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(find, "doc_id bigint, begin bigint, end bigint")


def aggregated_windows(reps: DataFrame, depth: int) -> DataFrame:
    """As ``sorted_windows`` for anchors of very many stretches: every window is a key of its own in an aggregate and a join."""
    one = reps.select("h", "doc_id", "a", "lo", "bytes", F.explode(F.sequence("lo", "hi")).alias("start"))
    one = one.select("h", "doc_id", (F.col("a") - F.col("start")).alias("before"), "start", F.substring("bytes", F.col("start") - F.col("lo") + 1, F.lit(depth)).alias("window"))
    keys = ["h", "before", "window"]
    first = one.groupBy(*keys).agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = one.join(first, keys).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return later.select("doc_id", F.col("start").cast("long").alias("begin"), (F.col("start") + depth).cast("long").alias("end"))


REMOVED = "doc_id bigint, n_removed bigint, n_spans bigint, kept binary"


def removed(texts: DataFrame) -> DataFrame:
    """(REMOVED) from (doc_id, text, spans): the bytes that no span covers."""

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, out, at, runs = row["text"].encode(), [], 0, 0
                for begin, end in sorted((s["begin"], s["end"]) for s in row["spans"]):
                    if begin > at or not runs:
                        out.append(data[at:begin])
                        runs += 1
                    at = max(at, end)
                out.append(data[at:])
                kept = b"".join(out)
                columns = [[row["doc_id"]], [len(data) - len(kept)], [runs], [kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_removed", "n_spans", "kept"])

    return texts.mapInArrow(cut, REMOVED)


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, buckets: int | None = None, most: int = MOST_STRETCHES) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, n_bytes, sha, first; texts: doc_id, text, spans of those with repeated windows).

    ``first`` is the smallest doc_id of the same text: a copy of at least ``depth`` bytes is removed whole, so copies need no sorting.
    Texts are never written to scratch: every step that needs bytes joins ``docs``, which is read four times. Each step's shuffle files and
    tables go as soon as the next one no longer reads them, so the disk holds one shuffle of the text at a time.
    """
    spark = docs.sparkSession
    if buckets is None:  # enough ranges for every shuffle task, a power of two
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = 1 << max(5, (2 * tasks - 1).bit_length())
    found = cut_lineage(repeated_places(dealt_anchors(docs, buckets, depth, gram), depth))
    release(spark)
    whole = found.where(F.col("kind") == DOCUMENT).select("doc_id", "n_bytes", F.lower(F.hex("sha")).alias("sha"))
    sizes = cut_lineage(whole.join(whole.groupBy("sha").agg(F.min("doc_id").alias("first")), "sha"))
    release(spark)
    # an id with several different texts has no one text to compare
    own = sizes.groupBy("doc_id").agg(F.min("sha").alias("low"), F.max("sha").alias("high"), F.min("first").alias("first"))
    own = own.where("doc_id = first and low = high").select("doc_id")
    places = found.where(F.col("kind") == PLACE).select("doc_id", "h", "a", "lo", "hi").join(own, "doc_id")
    listed = places.groupBy("doc_id").agg(F.collect_set(F.struct("h", "a", "lo", "hi")).alias("places"))  # bounded by the text
    texts = docs.where("text is not null").select("doc_id", "text")
    keyed = cut_lineage(stretch_keys(texts.join(listed, "doc_id"), depth))
    discard(found)
    place = F.struct("doc_id", "a", "lo", "hi")
    same = cut_lineage(keyed.groupBy("h", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    release(spark)
    copies = keyed.select("h", "key", place.alias("place")).join(same.where("n > 1").select("h", "key", "first"), ["h", "key"])
    covered = copies.where(F.col("place") != F.col("first")).select("place.doc_id", F.col("place.lo").cast("long").alias("begin"), (F.col("place.hi") + depth).cast("long").alias("end"))
    covered = cut_lineage(covered)
    discard(keyed)
    several = same.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = same.join(several, "h").select("first.doc_id", F.struct("h", "first.a", "first.lo", "first.hi", "m").alias("place"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # bounded by the text
    reps = cut_lineage(stretches(texts.join(wanted, "doc_id"), depth).distinct())
    discard(same)
    windows = cut_lineage(sorted_windows(reps.where(F.col("m") <= most), buckets, depth).unionByName(aggregated_windows(reps.where(F.col("m") > most), depth)))
    discard(reps)
    per_doc = covered.unionByName(windows).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # bounded by the text
    return sizes, texts.join(per_doc, "doc_id")


def deduplicated_bytes(docs: DataFrame, depth: int = DEPTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per document.

    Every byte covered by a ``depth``-byte string that also starts earlier (smaller doc_id, or earlier in the same document) goes. ``kept`` holds
    the remaining bytes where something went from the middle of a text, else null: then all of the text stayed (n_removed = 0) or none.
    Null text counts as empty. Rows that repeat a doc_id and its text are one document; an id with different texts keeps its bytes unless an
    earlier document is the same text. Rows without doc_id keep all bytes and take none. An empty table gives an empty table.
    """
    sizes, texts = repeated_spans(docs, depth, **options)
    joined = sizes.join(removed(texts).dropDuplicates(["doc_id"]), "doc_id", "left")
    gone = (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= depth)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(~gone, F.col("kept")).alias("kept"),
    )


@query("op8_suffixes")
def op8(spark, folder):
    return deduplicated_bytes(documents(spark, folder)).drop("kept")
