r"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, verified once per pair, and components.

One pass over the text turns each document into its set of 64-bit shingle hashes. The sets are dealt by hash range as packed arrays (not
as one row per shingle), where document frequencies are counted; only shingles of at least two documents come back. A shingle of one
document is the rarest there is, so it heads its document's order and needs no row: the number of such shingles alone says where the
prefix of shared ones ends, and most documents have no shared shingle in their prefix at all. An intersection holds shared shingles
only, so they suffice for verification and the text is never read again.

Copies meet once: documents of one set are one representative. In a posting list of m members, m - 1 pairs with a pivot come before any
other; pairs inside one component of the links found so far are not needed for components and are never made, so a group of near copies
costs its size, not its square.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.session import cut_lineage, discard

from .common import documents, query
from .tokens import slices

WIDTH = 5
PER_CENT = 75
#: A shingle that more than so many documents of one batch share is dealt as a count; its documents keep it beside them.
COMMON = 8
#: Cells of the counts by hash range that the suffix filter compares.
CELLS = 16
#: Rounds of pivot pairs before the remaining pairs across components.
PIVOTS = 2

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scramble, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct shingles of a batch, by hash, then doc; a text of fewer words is one shingle of all of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), object)
    words = pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy()] if len(names) else np.empty(0, np.uint64)
    real = (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0) if len(flat) else np.empty(0, bool)
    words, owner = words[real], owner[real]
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(len(words) - width + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = rolled * BASE + words[k : k + n]
        inside = np.arange(n) + width <= ends[owner[:n]]
        hashes, docs = [mixed(rolled[inside])], [owner[:n][inside]]
        for length in range(1, width):
            short = np.flatnonzero(counts == length)
            if len(short):
                at = ends[short] - length
                whole = np.full(len(short), length, np.uint64)
                for k in range(length):
                    whole = whole * BASE + words[at + k]
                hashes.append(mixed(whole))
                docs.append(short)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[keep].astype(np.int64), h[keep]


DEALT = "bucket int, ids binary, docs binary, hashes binary, counts binary, sizes binary, digests binary"
COUNTED = "kind int, doc_id bigint, h bigint, df bigint, n bigint, digest_a bigint, digest_b bigint"
DOCUMENT, SHARED, HELD, COMMON_DF = range(4)


def planes(values: np.ndarray) -> bytes:
    """Eight-byte numbers with their bytes of one rank together: the high ones of ordered numbers compress well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def dealt_shingles(docs: DataFrame, buckets: int, width: int = WIDTH, common: int = COMMON) -> DataFrame:
    """One pass over the text, two kinds of rows (DEALT), each packed per batch.

    bucket 0 and up: (hash, document) pairs of one hash range: ``ids``, ``docs`` (places in ids), ``hashes``; a shingle common in its batch
    stands there once without documents, with its ``counts``. Below 0: documents with set ``sizes``, order-free 128-bit ``digests`` of
    their sets, and ``hashes``: the common shingles of each (``counts`` of them), which it keeps; ``docs`` marks ids that are not null.
    """
    shift = np.uint64(64 - int(math.log2(buckets)))
    names = [c.split()[0] for c in DEALT.split(", ")]

    def deal(batches):
        holder = -1 - TaskContext.get().partitionId() % buckets
        for batch in batches:
            for part in slices(batch):
                d, h = shingle_sets(part.column("text"), width)
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(part.column("doc_id"), 0).to_numpy()
                n = np.bincount(d, minlength=len(ids))
                digests = np.zeros((2, len(ids)), np.uint64)
                by_doc = np.argsort(d, kind="stable")
                if len(h):
                    with np.errstate(over="ignore"):
                        for i, salt in enumerate((np.uint64(1), np.uint64(0x5851F42D4C957F2D))):
                            digests[i, n > 0] = np.add.reduceat(mixed(h[by_doc] ^ salt), (np.cumsum(n) - n)[n > 0])
                d, h = d[known[d]], h[known[d]]  # rows without doc_id meet nobody
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                runs = np.flatnonzero(first)
                lengths = np.diff(np.append(runs, len(h)))
                often = lengths > common
                is_common = np.repeat(often, lengths)
                held_d, held_h = d[is_common], h[is_common]
                order = np.argsort(held_d, kind="stable")
                held_n = np.bincount(held_d, minlength=len(ids)).astype(np.uint32)
                rows = [(holder, ids.tobytes(), known.tobytes(), held_h[order].tobytes(), held_n.tobytes(), n.astype(np.int64).tobytes(), digests.tobytes())]
                rh, rd = h[~is_common], d[~is_common]
                ch, cn = h[runs[often]], lengths[often]
                edges = np.arange(buckets).astype(np.uint64)
                cuts = np.append(np.searchsorted(rh >> shift, edges), len(rh))
                common_cuts = np.append(np.searchsorted(ch >> shift, edges), len(ch))
                for b in range(buckets):
                    i, j, k, m = cuts[b], cuts[b + 1], common_cuts[b], common_cuts[b + 1]
                    if i == j and k == m:
                        continue
                    used, places = np.unique(rd[i:j], return_inverse=True)
                    places = places.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                    rows.append((b, planes(ids[used]), places.tobytes(), planes(np.concatenate([rh[i:j], ch[k:m]])), cn[k:m].astype(np.uint32).tobytes(), None, None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(deal, DEALT)


def counted_table(kind: int, length: int, **columns) -> pa.Table:
    names = [c.split()[0] for c in COUNTED.split(", ")][1:]
    arrays = [pa.array(np.full(length, kind, np.int32))] + [columns[c] if c in columns else pa.nulls(length, pa.int64()) for c in names]
    return pa.table(arrays, names=["kind", *names])


def count_shingles(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(COUNTED) of one hash range, or the documents of some batches with the common shingles they hold."""
    if key[0].as_py() < 0:
        out = []
        for row in table.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            known = np.frombuffer(row["docs"], bool)
            a, b = np.frombuffer(row["digests"], np.int64).reshape(2, -1)
            out.append(counted_table(DOCUMENT, len(ids), doc_id=pa.array(ids, mask=~known), n=pa.array(np.frombuffer(row["sizes"], np.int64)), digest_a=pa.array(a), digest_b=pa.array(b)))
            held = np.frombuffer(row["hashes"], np.int64)
            out.append(counted_table(HELD, len(held), doc_id=pa.array(np.repeat(ids, np.frombuffer(row["counts"], np.uint32))), h=pa.array(held)))
        return pa.concat_tables(out)
    parts = []
    for row in table.to_pylist():
        body, ids = from_planes(row["hashes"], np.uint64), from_planes(row["ids"], np.int64)
        counts = np.frombuffer(row["counts"], np.uint32)
        docs = np.frombuffer(row["docs"], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        times = np.concatenate([np.zeros(len(docs), np.int64), counts])  # 0: one document
        parts.append((body, np.concatenate([ids[docs], np.zeros(len(counts), np.int64)]), times))
    h, i, k = map(np.concatenate, zip(*parts))
    order = np.argsort(h, kind="stable")
    h, i, k = h[order], i[order], k[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    runs = np.flatnonzero(first)
    df = np.add.reduceat(np.maximum(k, 1), runs)
    each = np.repeat(df, np.diff(np.append(runs, len(h))))
    out = []
    for kind, keep in ((SHARED, (each > 1) & (k == 0)), (COMMON_DF, k > 0)):
        some = {"h": pa.array(h[keep].view(np.int64)), "df": pa.array(each[keep])}
        out.append(counted_table(kind, int(keep.sum()), **some, **({"doc_id": pa.array(i[keep])} if kind == SHARED else {})))
    return pa.concat_tables(out)


def least_overlap(a: Column, b: Column, per_cent: int) -> Column:
    """Least intersection of linked sets of sizes a and b."""
    return F.ceil((a + b) * per_cent / (100 + per_cent) - F.lit(1e-9))


def candidate_sets(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(every document: doc_id, n, rep; representatives with shared prefix shingles: id, n, alone, shared, cells).

    ``shared`` is the array of (df, h) in rare-first order, after ``alone`` shingles that no other document has; ``cells`` counts them by
    hash range, for the suffix filter.
    """
    spark = docs.sparkSession
    if buckets is None:  # enough ranges for every shuffle task, a power of two
        buckets = 1 << max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    counted = cut_lineage(dealt_shingles(docs, buckets, width).groupBy("bucket").applyInArrow(count_shingles, COUNTED))
    of = lambda kind, *columns: counted.where(F.col("kind") == kind).select(*columns)
    ids = F.col("doc_id").isNotNull()
    pairs = of(SHARED, "doc_id", "h", "df").unionByName(of(HELD, "doc_id", "h").join(of(COMMON_DF, "h", "df").distinct(), "h").select("doc_id", "h", "df"))
    sets = of(DOCUMENT, "doc_id", "n", "digest_a", "digest_b")
    reps = sets.groupBy("n", "digest_a", "digest_b").agg(F.min("doc_id").alias("rep"))
    rep = F.when(ids, F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    members = cut_lineage(sets.join(reps, ["n", "digest_a", "digest_b"]).withColumn("rep", rep))
    # an id with several different sets has no one set to link by
    alike = members.where(ids & (F.col("n") > 0)).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("n").alias("n"), *[f(F.struct("digest_a", "digest_b")).alias(a) for f, a in ((F.min, "low"), (F.max, "high"))])
    firsts = alike.where((F.col("doc_id") == F.col("rep")) & (F.col("low") == F.col("high")))
    members = members.select("doc_id", "rep", "n")
    # the shared prefix is not empty only where the shingles of no other document are fewer than the prefix
    prefix = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1
    many = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("shared"))
    found = many.join(firsts.select(F.col("doc_id"), "n"), "doc_id").withColumn("alone", F.col("n") - F.size("shared"))
    sets = cut_lineage(with_cells(found.where(F.col("alone") < prefix).select(F.col("doc_id").alias("id"), "n", "alone", "shared")))
    discard(counted)
    return members, sets


def with_cells(sets: DataFrame) -> DataFrame:
    """sets with ``cells``: how many shared shingles lie in each of CELLS hash ranges."""

    def count(batches):
        for batch in batches:
            lists = batch.column("shared")
            lengths = pc.list_value_length(lists).to_numpy()
            h = pc.struct_field(lists.flatten(), "h").to_numpy().view(np.uint64)
            cell = np.repeat(np.arange(len(lengths)), lengths) * CELLS + (h % np.uint64(CELLS)).astype(np.int64)
            counts = np.bincount(cell, minlength=len(lengths) * CELLS).astype(np.int32)
            cells = pa.ListArray.from_arrays(np.arange(0, len(counts) + 1, CELLS, dtype=np.int32), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return sets.mapInArrow(count, "id bigint, n bigint, alone bigint, shared array<struct<df:bigint,h:bigint>>, cells array<int>")


def postings(sets: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """(h, id, n, pos, cells) of prefix shingles."""
    prefix = (F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1 - F.col("alone")).cast("int")
    rows = sets.select("id", "n", "alone", "cells", F.posexplode(F.slice("shared", 1, prefix)).alias("at", "s"))
    return rows.select(F.col("s.h").alias("h"), "id", "n", (F.col("alone") + F.col("at")).alias("pos"), "cells")


def may_link(a: str, b: str, per_cent: int) -> Column:
    """Length, positional and suffix filter for the postings a and b of one shingle."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = least_overlap(na, nb, per_cent)
    sizes = (100 * F.least(na, nb) >= per_cent * F.greatest(na, nb)) & (1 + F.least(na - F.col(f"{a}.pos") - 1, nb - F.col(f"{b}.pos") - 1) >= need)
    common = F.aggregate(F.zip_with(F.col(f"{a}.cells"), F.col(f"{b}.cells"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return sizes & (common >= need)


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """(a, b, linked, distance) of distinct pairs, by their whole sets of shared shingles."""
    hashes = sets.select("id", "n", F.transform("shared", lambda s: s["h"]).alias("hs"))
    left, right = hashes.toDF("a", "na", "ha"), hashes.toDF("b", "nb", "hb")
    both = pairs.dropDuplicates(["a", "b"]).join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.select("a", "b", (100 * F.col("common") >= per_cent * union).alias("linked"), (1 - F.col("common") / union).alias("distance"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every node of ``links`` (a, b): alternating large and small stars until the stars stay; comp is the smallest id."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        last, edges = edges, cut_lineage(small.distinct())
        discard(last, collect=False)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())


def jaccard_links(sets: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Links (a, b), written, that give the components of all links between representatives.

    Every pair of linked sets shares a prefix shingle. Pairs with a list's pivot are verified first, with another pivot in the next round;
    then, in lists that still hold several components, the members outside the list's largest one meet the members of other components. A
    pair is left out only if it is in one component already, if a filter rules it out, or by the triangle inequality of the Jaccard
    distance: with distances to one pivot that differ by more than the limit, two sets can't be within it.
    """
    posts = postings(sets, per_cent)
    lists = posts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    posts = cut_lineage(posts.join(lists, "h"))
    checked, links, comps, scratch = None, None, None, [posts]
    for turn in range(PIVOTS):
        now = posts
        if comps is not None:
            now = open_lists(posts, comps)
        key = F.struct("id", "n", "pos", "cells") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "n", "pos", "cells")
        pivot = now.groupBy("h").agg(F.min(key).alias("p"))
        met = now.alias("x").join(pivot.select("h", "p.*").alias("p"), "h").where(F.col("x.id") != F.col("p.id"))
        if comps is not None:
            met = met.drop("comp")
        pairs = met.where(may_link("x", "p", per_cent)).select(F.least("x.id", "p.id").alias("a"), F.greatest("x.id", "p.id").alias("b"), F.col("p.id").alias("pivot"))
        done = cut_lineage(verified(pairs.select("a", "b"), sets, per_cent))
        scratch.append(done)
        checked = done if checked is None else checked.unionByName(done)
        links = checked.where("linked").select("a", "b")
        comps = cut_lineage(components(links))
        scratch.append(comps)
    now = cut_lineage(open_lists(posts, comps))
    largest = now.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"))
    minor = now.join(largest, "h").where("comp <> main").drop("main")
    met = minor.alias("x").join(now.alias("y"), "h").where(F.col("x.comp") != F.col("y.comp")).where(may_link("x", "y", per_cent))
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    pairs = cut_lineage(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
    far = far_apart(pairs, checked, 1 - per_cent / 100)
    rest = cut_lineage(verified(pairs.join(far, ["a", "b"], "left_anti"), sets, per_cent))
    found = cut_lineage(links.unionByName(rest.where("linked").select("a", "b")))
    discard(*scratch, now, pairs, rest)
    return found


def open_lists(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings with comp, of the lists that hold more than one component."""
    placed = posts.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spread = placed.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h")
    return placed.join(spread, "h")


def far_apart(pairs: DataFrame, checked: DataFrame, limit: float) -> DataFrame:
    """Pairs whose known distances to a common third set differ by more than the limit."""
    known = checked.select(F.col("a").alias("id"), F.col("b").alias("third"), "distance").union(checked.select("b", "a", "distance"))
    x = known.toDF("a", "third", "da")
    y = known.toDF("b", "third", "db")
    return pairs.join(x, "a").join(y, ["b", "third"]).where(F.abs(F.col("da") - F.col("db")) > limit + 1e-9).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``; the component is named by its smallest doc_id.

    Null text, or text without words, has an empty set and is linked with nothing. Rows that repeat a doc_id and its set are one document;
    an id with different sets is linked by equal sets only. Rows without doc_id are linked with nothing and have a null component.
    An empty table gives an empty table.
    """
    members, sets = candidate_sets(docs, width, per_cent, buckets)
    links = jaccard_links(sets, per_cent)
    comps = components(links)
    discard(sets, links)
    joined = members.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without doc_id stay; so do repeated rows of a kept id."""
    groups = near_duplicates(docs, **options)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_kept"), "left").where("doc_id is null or _kept is not null").drop("_kept")


ORACLE = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM worded, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


@query("op6_jaccard", ORACLE)
def op6(spark, folder):
    return near_duplicates(documents(spark, folder))
