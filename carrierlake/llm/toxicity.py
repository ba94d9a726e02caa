"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, distance-weighted votes, calibration.

Terms are the lower-case words of a bounded sample of labelled rows; each counts once, whole. Their document frequencies are counted over all
documents. A weight is (1 + log tf) * idf, times the squared relevance of the word for the label (1 plus its log-odds where positive,
learned from the same rows). Labelled examples of one vector are one entry with counts, so ties at the k-th neighbour are never cut.

Entries are laid out so that similar ones share a block. Every posting list is kept by block, with the largest weight of each block. The lists of
the most common terms, which hold most postings that a query meets, are dense rows, multiplied for many queries at once. A query
first adds block maxima of the other lists to its largest dense sum of a block, which bounds the cosine of any entry there; it opens the blocks of the largest bounds, then every other one
whose bound reaches the k-th best cosine of those, so what is skipped can't belong to the result. Cosines are sums in double precision. Votes are weighted by
cosine and mapped to probabilities by an isotonic fit of leave-one-out votes. A score is a function of the text alone.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from carrierlake.session import cut_lineage

from .common import bounded_sample, documents, query, text_of
from .tokens import slices

#: Bounds of what is learned from: labelled rows, and their (word, row) pairs and bytes of words; rows of the smallest hash are taken.
MOST_LABELLED = 4_000
MOST_PAIRS = 2_500_000
MOST_BYTES = 25_000_000
NEIGHBOURS = 25
BLOCK = 64
#: Blocks that a query opens first; their k-th best cosine decides which others are opened.
OPENED = 8
#: Most terms whose lists are dense rows, the share of entries that hold such a term at least, and queries that meet the rows together.
DENSE, DENSE_SHARE, TOGETHER = 512, 1 / 32, 64
CUT = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Stretches of ASCII and Latin letters, whose words Arrow finds as WORD does, and what parts these words in lower case.
LATIN, BETWEEN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]+$", "[^a-zß-öø-ÿ]+"
#: Sums of one cosine differ by less than this, whatever the order of its terms.
SLACK = 1e-9


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


# what is learned from


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows; a repeated doc_id counts once, with its largest label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return bounded_sample(cut_lineage(rows.select(F.col("doc_id").cast("bigint"), "y")), most)


def sampled_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, digest, words, times): sorted words of each sampled id's text, joined by newlines, and their counts. Of several texts of one
    id the one of the smallest digest counts.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id")  # MOST_LABELLED ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [sorted(word_counts(t).items()) for t in part.column("text").to_pylist()]
                words = ["\n".join(w for w, _ in x) for x in found]
                times = [np.array([c for _, c in x], np.uint32).tobytes() for x in found]
                digests = [hashlib.blake2b(w.encode() + t, digest_size=16).digest() for w, t in zip(words, times)]
                columns = [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(words, pa.string()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "words", "times"])

    counted = texts.mapInArrow(count, "doc_id bigint, digest binary, words string, times binary")
    return counted.groupBy("doc_id").agg(F.min(F.struct("digest", "words", "times")).alias("x")).select("doc_id", "x.*")


def learned_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], list[tuple]]:
    """(words, rows) of the bounded sample; a row is (terms ascending, counts, 1, y, doc_id), a term the place of its word."""
    sample = cut_lineage(labelled_sample(labels, label, most))
    counts = cut_lineage(sampled_counts(docs, sample).join(F.broadcast(sample), "doc_id"))
    sizes = counts.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("words").alias("bytes"), (F.octet_length("times") / 4).alias("pairs"))
    order = sorted(sizes.collect(), key=lambda r: (r.h, r.doc_id))
    fits = (np.cumsum([r.bytes for r in order]) <= MOST_BYTES) & (np.cumsum([r.pairs for r in order]) <= MOST_PAIRS)
    if not fits.all():
        counts = counts.where(F.xxhash64("doc_id") <= order[max(int(fits.sum()) - 1, 0)].h)
    learned = counts.select("doc_id", "y", "words", "times").orderBy("doc_id").toArrow()
    place: dict[str, int] = {}
    rows = []
    for batch in learned.to_batches():
        for i in range(batch.num_rows):  # one row's words at a time
            doc, y, words, times = (c[i].as_py() for c in batch.columns)
            terms = np.array([place.setdefault(w, len(place)) for w in words.split("\n")] if words else [], np.int32)
            by = np.argsort(terms)
            rows.append((terms[by], np.frombuffer(times, np.uint32).astype(np.int32)[by], 1, y, doc))
    return list(place), rows


class Vocabulary:
    """Words in order; the table of places is made where it is first used."""

    def __init__(self, words: list[str]):
        self.text, self.size, self._place = "\n".join(words), len(words), None

    def __getstate__(self):
        return {"text": self.text, "size": self.size, "_place": None}

    @property
    def place(self) -> dict[str, int]:
        if self._place is None:
            self._place = {w: i for i, w in enumerate(self.text.split("\n") if self.size else [])}
        return self._place

    def terms_of(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, terms): the known words of each stretch without white space, in one array."""
        latin = pc.match_substring_regex(stretches, LATIN)
        found = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(stretches.filter(latin)), BETWEEN, " "))
        others = [WORD.findall(x.lower()) for x in stretches.filter(pc.invert(latin)).to_pylist()]
        counts = np.concatenate([pc.list_value_length(found).to_numpy(), [len(x) for x in others]]).astype(np.int64)
        coded = pa.concat_arrays([found.flatten(), pa.array([w for x in others for w in x], pa.string())]).dictionary_encode()
        place = self.place
        places = np.fromiter((place.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        terms = places[coded.indices.to_numpy()]
        known = np.concatenate([[0], np.cumsum(terms >= 0)])
        ends = known[np.cumsum(counts)]
        starts = known[np.cumsum(counts) - counts]
        order = np.argsort(~latin.to_numpy(zero_copy_only=False), kind="stable")
        own = np.empty(len(order), np.int64)
        own[order] = np.arange(len(order))
        return starts[own], (ends - starts)[own], terms[terms >= 0]

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, terms, counts): each text's terms, ascending, and their counts, one text after the other. Null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        starts, lengths, terms = self.terms_of(coded.dictionary)
        codes = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        met = terms[ranges(starts[codes], lengths[codes])]
        keys, counts = np.unique(np.repeat(owner, lengths[codes]) * max(self.size, 1) + met, return_counts=True)
        docs, found = np.divmod(keys, max(self.size, 1))
        return np.searchsorted(docs, np.arange(len(texts)), side="right"), found, counts

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms ascending, counts) of a text."""
        return self.vectors(pa.array([text], pa.string()))[1:]


#: Terms whose counts travel in one row.
CHUNK = 4096


def document_frequencies(docs: DataFrame, shared, size: int) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each term of the shared vocabulary of that size); a task sends its counts in chunks of terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rows = shared.value, 0
        seen = np.zeros(-(-(vocabulary.size + 1) // CHUNK) * CHUNK, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch):
                seen += np.bincount(vocabulary.vectors(part.column("text"))[1], minlength=len(seen))
        seen[vocabulary.size] = rows
        chunks = seen.reshape(-1, CHUNK)
        held = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([chunks[i].tobytes() for i in held], pa.binary())], names=["chunk", "seen"])

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for part in parts:
            for x in part.column("seen").to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "seen"])

    form = "chunk int, seen binary"
    merged = docs.select(text_of().alias("text")).mapInArrow(count, form).groupBy("chunk").applyInArrow(merge, form).collect()
    df = np.zeros(-(-(size + 1) // CHUNK) * CHUNK, np.int64)
    for r in merged:
        df[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.seen, np.int64)
    return int(df[size]), df[:size]


# the index


class Entries:
    """Distinct example vectors in rows of ``terms`` and ``counts``, with n examples, t of them positive, and the smallest doc_id of them."""

    def __init__(self, rows):
        """``rows``: (terms ascending, counts, n, t, doc_id). Rows without terms are counted in ``empty``."""
        found: dict[bytes, list] = {}
        self.empty = [0, 0]
        for terms, counts, n, t, doc in rows:
            terms, counts = np.asarray(terms, np.int32), np.asarray(counts, np.int32)
            if not len(terms):
                self.empty = [self.empty[0] + n, self.empty[1] + t]
                continue
            entry = found.setdefault(hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest(), [terms, counts, 0, 0, doc])
            entry[2:] = entry[2] + n, entry[3] + t, min(entry[4], doc)
        order = list(found.values())
        self.ends = np.concatenate([[0], np.cumsum([len(e[0]) for e in order])]).astype(np.int64)
        self.terms = np.concatenate([e[0] for e in order]) if order else np.empty(0, np.int32)
        self.counts = np.concatenate([e[1] for e in order]) if order else np.empty(0, np.int32)
        self.n, self.t = np.array([e[2] for e in order], float), np.array([e[3] for e in order], float)
        self.example = np.array([e[4] for e in order], np.int64)

    def __len__(self):
        return len(self.n)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[i], self.ends[i + 1])
        return self.terms[at], self.counts[at]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def reorder(self, order: np.ndarray) -> None:
        lengths = np.diff(self.ends)[order]
        flat = ranges(self.ends[order], lengths)
        self.terms, self.counts = self.terms[flat], self.counts[flat]
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.n, self.t, self.example = self.n[order], self.t[order], self.example[order]


def relevance(entries: Entries, size: int) -> np.ndarray:
    """1 plus the log-odds of the label where positive, with one pseudo-entry of the base rate; an entry counts once, by its share of positives."""
    if not len(entries):
        return np.ones(size)
    share = entries.t / entries.n
    base = share.mean()
    if not 0 < base < 1:
        return np.ones(size)
    n = np.bincount(entries.terms, minlength=size)
    t = np.bincount(entries.terms, share[entries.owners()], size)
    return 1 + np.maximum(0, np.log((t + base) / (n - t + 1 - base) * (1 - base) / base))


def unit_weights(terms: np.ndarray, counts: np.ndarray, value: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * value[terms]
    return w / math.sqrt((w * w).sum())


class Index:
    """Entries behind posting lists that are cut into blocks of entries, with the largest weight of each block."""

    def __init__(self, value: np.ndarray, entries: Entries, base: float, k: int = NEIGHBOURS, block: int = BLOCK):
        """``value``: what one occurrence of each term weighs."""
        self.value, self.k, self.base, self.block, self.entries, self._dense = value, k, base, block, entries, None
        self._lay()
        if len(entries) > 2 * block:
            entries.reorder(self._neighbourhoods())
            self._lay()

    def _lay(self) -> None:
        entries, size, n = self.entries, len(self.value), len(self.entries)
        self.entry = self.weight = self.most = self.first = self.length = self.of_block = None  # the former layout
        owner = entries.owners().astype(np.int32)
        weight = np.empty(len(entries.terms))
        for i in range(n):
            at = slice(entries.ends[i], entries.ends[i + 1])
            weight[at] = unit_weights(entries.terms[at], entries.counts[at], self.value)
        order = np.argsort(entries.terms, kind="stable")  # by term, then entry
        terms = entries.terms[order]
        self.entry, self.weight = owner[order], weight[order]
        del owner, weight, order
        place = self.entry // self.block
        begins = np.ones(len(terms), bool)
        begins[1:] = (place[1:] != place[:-1]) | (terms[1:] != terms[:-1])
        first = np.flatnonzero(begins)
        self.first = first.astype(np.int32)
        self.length = np.diff(np.append(first, len(place))).astype(np.int32)
        self.of_block = (self.entry[first] // self.block).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.ends = np.searchsorted(terms[first], np.arange(size + 1))
        self.blocks = -(-n // self.block)

    def _neighbourhoods(self) -> np.ndarray:
        """Entries by their nearest of about sqrt(n) leaders: similar ones become neighbours, so block maxima are tight."""
        n = len(self.entries)
        leaders = np.arange(0, n, max(1, math.isqrt(n)))
        rank = np.full(n, -1)
        rank[leaders] = np.arange(len(leaders))
        held = rank[self.entry] >= 0
        before = np.concatenate([[0], np.cumsum(held)])
        whose, weight = rank[self.entry[held]], self.weight[held]
        begins = before[np.append(self.first, len(self.entry))[self.ends]]  # of each term's leaders
        nearest = np.empty(n, np.int64)
        for i in range(n):
            terms, counts = self.entries.row(i)
            lengths = begins[terms + 1] - begins[terms]
            flat = ranges(begins[terms], lengths)
            near = np.bincount(whose[flat], weight[flat] * np.repeat(unit_weights(terms, counts, self.value), lengths), len(leaders))
            nearest[i] = np.argmax(near)
        return np.lexsort((np.arange(n), nearest))

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    @property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each term or -1, rows over the entries) of the most common terms; made where it is first used."""
        if self._dense is None:
            held = np.diff(np.append(self.first, len(self.entry))[self.ends])
            common = np.argsort(-held, kind="stable")[:DENSE]
            common = common[held[common] >= max(DENSE_SHARE * len(self.entries), 1)]
            row, rows = np.full(len(held), -1), np.zeros((len(common), len(self.entries)))
            row[common] = np.arange(len(common))
            begins = np.append(self.first, len(self.entry))[self.ends[common]]
            for i, (a, n) in enumerate(zip(begins, held[common])):
                rows[i, self.entry[a : a + n]] = self.weight[a : a + n]
            self._dense = row, rows
        return self._dense

    def common_sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms of each query (terms, weights) add to its cosine with each entry."""
        row, rows = self.dense
        asked = np.zeros((len(queries), len(rows)))
        for i, (terms, q) in enumerate(queries):
            at = row[terms]
            asked[i, at[at >= 0]] = q[at >= 0]
        return asked @ rows

    def last_of(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The cosine at which entries, nearest first, hold k examples; 0 if they hold fewer."""
        full = int(np.searchsorted(np.cumsum(self.entries.n[found]), self.k))
        return float(cosines[full]) if full < len(found) else 0.0

    def nearest(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines), nearest first: as many as hold k examples, and every entry tied with the last."""
        return next(self.all_nearest([(terms, counts)]))

    def all_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query (terms, counts), in order."""
        for i in range(0, len(queries), TOGETHER):
            some = [(terms, unit_weights(terms, counts, self.value)) for terms, counts in queries[i : i + TOGETHER]]
            for (terms, q), sums in zip(some, self.common_sums(some)):
                rare = self.dense[0][terms] < 0
                yield self._nearest(terms[rare], q[rare], sums)

    def _nearest(self, terms: np.ndarray, q: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of a query of rare terms and their weights, given the sums of its common ones."""
        lists = self.ends[terms + 1] - self.ends[terms]
        held = ranges(self.ends[terms], lists)
        asked = np.repeat(q, lists)
        block = self.of_block[held]
        begins = np.arange(0, len(sums), self.block)
        bound = np.bincount(block, self.most[held] * asked, self.blocks) + np.maximum.reduceat(sums, begins)
        order = np.argsort(-bound, kind="stable")
        found, cosines, last = np.empty(0, np.int64), np.empty(0), 0.0
        for now in (order[:OPENED], order[OPENED:]):
            now = now[(bound[now] > 0) & (bound[now] >= last - SLACK)]
            if not len(now):
                break
            opened = np.zeros(self.blocks, bool)
            opened[now] = True
            own = np.flatnonzero(opened[block])
            lists = held[own]
            lengths = self.length[lists]
            flat = ranges(self.first[lists], lengths)
            near = sums + np.bincount(self.entry[flat], self.weight[flat] * np.repeat(asked[own], lengths), len(sums))
            more = np.flatnonzero(near >= max(last - SLACK, 1e-300))
            more = more[opened[more // self.block]]
            found, cosines = np.concatenate([found, more]), np.concatenate([cosines, near[more]])
            rank = np.lexsort((self.entries.example[found], -cosines))
            found, cosines = found[rank], cosines[rank]
            last = self.last_of(found, cosines)
            keep = cosines >= last - SLACK
            found, cosines = found[keep], cosines[keep]
        return found, cosines

    def vote(self, n: np.ndarray, t: np.ndarray, cosines: np.ndarray) -> float:
        """Cosine-weighted share of positives, with one example's weight of the base rate."""
        return float(((cosines * t).sum() + self.base) / ((cosines * n).sum() + 1))

    def own_votes(self, which: list[int]) -> list[tuple[float, int, float]]:
        """(leave-one-out vote, label, how many examples) of the entries ``which``."""
        votes = []
        for i, (found, cosines) in zip(which, self.all_nearest([self.entries.row(i) for i in which])):
            own, n, t = found == i, self.entries.n[i], self.entries.t[i]
            votes += [(self.vote(self.entries.n[found] - own, self.entries.t[found] - own * y, cosines), y, times) for y, times in ((1, t), (0, n - t)) if times]
        return votes

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]], curve: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list]]:
        """(probability, evidence) of each query (terms, counts): the nearest three entries as (an example's doc_id, cosine, examples, positives)."""
        e = self.entries
        nearest = self.all_nearest([(terms, counts) for terms, counts in queries if len(terms)]) if len(e) else iter(())
        out = []
        for terms, _ in queries:
            if not len(terms) or not len(e):
                out.append(((e.empty[1] + self.base) / (e.empty[0] + 1), []))
                continue
            found, cosines = next(nearest)
            value = float(np.interp(self.vote(e.n[found], e.t[found], cosines), *curve))
            out.append((value, [(int(e.example[i]), float(c), int(e.n[i]), int(e.t[i])) for i, c in zip(found[:3], cosines[:3])]))
        return out


def calibration(votes: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of labels on leave-one-out votes (pool adjacent violators), with a pseudo-example at either end."""
    blocks: list[list[float]] = []
    for x, y, times in [(0.0, 0, 1), *sorted(votes), (1.0, 1, 1)]:
        blocks.append([x * times, y * times, times])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(spark: SparkSession, shared, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The calibration of a shared index of so many entries; they are asked in tasks."""
    if not count:
        return calibration([])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.own_votes(batch.column("id").to_pylist())
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vote", "y", "times"])

    rows = spark.range(0, count, 1, -(-count // 500)).mapInArrow(votes, "vote double, y int, times double").collect()
    return calibration([tuple(r) for r in rows])


def learned_index(docs: DataFrame, labels: DataFrame, label: str, most: int, k: int):
    """(shared vocabulary, shared index, calibration)."""
    context = docs.sparkSession.sparkContext
    words, rows = learned_rows(docs, labels, label, most)
    vocabulary, entries = Vocabulary(words), Entries(rows)
    del words, rows
    n, t = entries.n.sum() + entries.empty[0], entries.t.sum() + entries.empty[1]
    if t in (0, n):  # one label: nothing to tell apart
        entries, vocabulary = Entries([((), (), int(n), int(t), 0)]), Vocabulary([])
    shared = context.broadcast(vocabulary)  # MOST_BYTES
    total, df = document_frequencies(docs, shared, vocabulary.size)
    value = (np.log((total + 1) / (df + 1)) + 1) * relevance(entries, vocabulary.size) ** 2
    index = context.broadcast(Index(value, entries, t / n if n else 0.0, k))  # MOST_PAIRS
    return shared, index, calibrated(docs.sparkSession, index, len(entries))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, k: int = NEIGHBOURS, keep: list[str] | None = None) -> DataFrame:
    """(row, score, evidence): every row of ``docs`` (its columns ``keep``, else all), scored by its whole text.

    ``labels`` (doc_id, label 0/1) are the rows to learn from; other labels, null ids and ids without a document are left out. Null and
    empty texts, and texts that share no word with any example, get the rate of examples without words. Equal texts get equal scores, and a row
    carries its own, whatever its doc_id. Without labels of both kinds every score is the base rate. An empty table gives an empty table.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    source = docs.select(kept.alias("row"), text_of().alias("text"))
    vocabulary, index, curve = learned_index(docs, labels, label, most, k)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("examples", pa.int64()), ("positive", pa.int64())]))
    names = ("doc_id", "cosine", "examples", "positive")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ends, terms, counts = vocabulary.value.vectors(part.column("text"))
                found = index.value.scores(list(zip(np.split(terms, ends[:-1]), np.split(counts, ends[:-1]))), curve)
                evidence = pa.array([[dict(zip(names, e)) for e in x] for _, x in found], kind)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([s for s, _ in found], pa.float64()), evidence], names=["row", "score", "evidence"])

    form = "score double, evidence array<struct<doc_id:bigint,cosine:double,examples:bigint,positive:bigint>>"
    return source.mapInArrow(score, StructType([source.schema["row"], *StructType.fromDDL(form).fields]))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


@query("op1_toxicity")
def op1(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity_scores(documents(spark, folder).select("doc_id", "text"), learnable(labels), keep=["doc_id"]).select("row.doc_id", "score", "evidence")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "evidence")
