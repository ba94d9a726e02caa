"""Operators with Python in tasks: brute force over whole tables, exact round trips, held-out accuracy, and edge rows."""

import hashlib
import itertools
import os
import sys
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from test_scans import SCHEMA, odd_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from carrierlake.llm import jaccard, neighbours, packing, queries, suffixes, tokenfile, tokens, toxicity  # noqa: E402
from carrierlake.session import scratch_folder  # noqa: E402

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def plain():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text, end: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


# token files


def test_op7_round_trip(spark, docs, plain):
    rows = sorted(queries.QUERIES["op7_tokenfile"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs)
    start = 0
    for r in rows:
        ids = plain(docs[r.doc_id], 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_on_odd_rows(spark, odd, plain):
    path = f"{scratch_folder(spark)}/odd-{uuid.uuid4().hex}"
    tokenfile.write_token_files(odd, path, end_id=7)
    got = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in tokenfile.read_token_files(spark, path).collect())
    assert got == sorted((r[0] is not None, r[0] or 0, plain(r[1], 7).tobytes()) for r in odd_rows())
    assert tokenfile.read_document(spark, path, 3) == [plain("word", 7).tolist()]
    assert len(tokenfile.read_document(spark, path, 5)) == 3 and tokenfile.read_document(spark, path, 99) == []


def test_token_files_of_an_empty_table(spark, odd):
    path = f"{scratch_folder(spark)}/none-{uuid.uuid4().hex}"
    tokenfile.write_token_files(odd.limit(0), path)
    assert tokenfile.read_token_files(spark, path).count() == 0


def test_encoder_equals_tokenizer(plain):
    import pyarrow as pa

    texts = ["", " ", "á, b", "İstanbul's!? don't. x!,y ..., 12.5, é. É, <|endoftext|> \x0b\x1c a b it's, 's. ＡＢ, ㎏. 1, ﬁ.", None, "\n\na", "ÀÉ ÷× straße. ǅ,  x y,", "é, ñ."]
    small = tokens.Encoder(tokens.default_vocabulary(), cache=3)
    for _ in range(3):  # the cache overflows and is trimmed
        ends, ids = small.encode(pa.array(texts), 2)
        for text, a, b in zip(texts, [0, *ends], ends):
            assert ids[a:b].tolist() == plain(text, 2).tolist()


# packing


def packed_well(rows, wanted):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(wanted)
    padding = tokens_ = 0
    for key, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        tokens_ += at
    return by_doc, padding, tokens_


def test_op5_contract(spark, docs, plain):
    ids = {k: plain(t, 2) for k, t in docs.items()}
    by_doc, padding, total = packed_well(queries.QUERIES["op5_packing"](spark, FOLDER).collect(), ids)
    assert total == sum(map(len, ids.values())) and padding <= 0.02 * total
    for key, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[key])
            assert r.ids_crc32 == zlib.crc32(ids[key][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[key])


def test_packing_odd_rows(odd, plain):
    rows = packing.pack_documents(odd).collect()
    by_doc, _, total = packed_well(rows, {r[0] for r in odd_rows()})
    assert total == sum(len(plain(r[1], 2)) for r in odd_rows())
    assert sum(r.length for r in by_doc[5]) == 3 * len(plain(odd_rows()[5][1], 2))
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_one_hot_length(spark):
    """A third of all pieces of one length, more than one rank group; every piece lies in one place."""
    rows = [(i, 700 if i % 3 else 1 + i % 4095) for i in range(6000)]
    pieces = spark.createDataFrame(rows, "piece bigint, length int")
    old = packing.GROUP, packing.RANKED
    packing.GROUP, packing.RANKED = 500, 100
    try:
        plan = packing.packing_plan(pieces).collect()
    finally:
        packing.GROUP, packing.RANKED = old
    taken, filled = defaultdict(list), defaultdict(int)
    for r in plan:
        taken[r.piece].append((r.cut, r.take))
        filled[r.sequence_id] += r.take
    for piece, length in rows:
        at = 0
        for cut, take in sorted(taken[piece]):
            assert cut == at
            at += take
        assert at == length
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in filled.values()) <= 0.01 * sum(n for _, n in rows)


def test_column_generation_meets_the_bound():
    rng = np.random.default_rng(3)
    demand = rng.integers(0, 40, 128)
    patterns = packing.solve_patterns(demand, 128)
    assert np.allclose(sum(p * n for p, n in patterns), demand)
    least = max((demand * np.arange(1, 129)).sum() / 128, demand[64:].sum() + demand[63] / 2)  # no two pieces above half share a sequence
    assert least - 1e-6 <= sum(n for _, n in patterns) <= 1.03 * least + 1
    small = packing.solve_patterns(np.array([0, 0, 0, 4, 0, 4, 0, 0, 0, 0]), 10)  # sizes 4 and 6 of 10
    assert sum(n for _, n in small) == pytest.approx(4)


# n-gram join


def shingles(text):
    words = brute.SPACED.findall((text or "").translate(brute.LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    for pair in {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted(map(root, pair))
            parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_op6_against_all_pairs(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op6_jaccard"](spark, FOLDER).collect()}
    assert got == brute_components(docs)


def near_corpus():
    """Chains at the limit, a large group of near copies, a passage most documents share, exact copies, edge texts."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts, passage = [None, "", "one two", "One TWO", "a b c d e", "A b\tc d e"], word(30)
    base = word(60)
    for _ in range(150):  # near copies: two words differ
        copy = list(base)
        for at in rng.integers(0, 60, 2):
            copy[at] = word(1)[0]
        texts.append(" ".join(copy))
    for i in range(12):  # a chain whose ends are far apart
        texts.append(" ".join(f"c{x}" for x in range(3 * i, 3 * i + 60)))
    texts += [" ".join(passage + word(8)) for _ in range(60)] + [" ".join(word(8) + passage) for _ in range(20)]
    texts += [" ".join(passage)] * 5
    return dict(enumerate(texts))


def test_near_duplicates_of_a_hard_corpus(spark):
    texts = near_corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, buckets=64).collect()}
    assert got == brute_components(texts)
    kept = jaccard.deduplicated(df, buckets=64).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in got.values()})


def test_near_duplicates_on_odd_rows(spark, odd):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = brute_components({r[0]: r[1] for r in odd_rows() if r[0] is not None})
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.deduplicated(odd).columns == odd.columns
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.id: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: root(k) for k in parent}


# suffix dedup


def brute_dedup(texts, depth):
    seen, out = set(), {}
    for key in sorted(texts):
        data = (texts[key] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - depth + 1):
            window = data[s : s + depth]
            if window in seen:
                gone[s : s + depth] = True
            seen.add(window)
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_op8_by_brute_force(spark, docs):
    assert suffix_rows(queries.QUERIES["op8_suffixes"](spark, FOLDER)) == brute_dedup(docs, 100)


def suffix_corpus():
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdef é\n"), n))
    shared, edge = text(260), text(100)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, edge, edge[:99], "q" + edge, edge + "q", shared, shared, shared[1:], "é" * 120]
    texts += [text(50) + shared[i : i + 120 + i] + text(40) for i in range(0, 60, 3)]
    texts += [text(20) + edge + text(rng.integers(0, 300)) + edge for _ in range(12)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("most", [1, 20_000])
def test_suffixes_of_a_hard_corpus(spark, most):
    """Both ways for anchors of many stretches: radix passes in a task, and aggregates window by window."""
    texts = suffix_corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert suffix_rows(suffixes.deduplicated_bytes(df, buckets=64, most=most)) == brute_dedup(texts, 100)


def test_suffixes_on_odd_rows(odd):
    rows = suffixes.deduplicated_bytes(odd).collect()
    assert len(rows) == odd.count()
    want = brute_dedup({r[0]: r[1] for r in odd_rows() if r[0] is not None}, 100)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert suffixes.deduplicated_bytes(odd.limit(0)).count() == 0


def test_suffixes_keep_no_texts_in_scratch(spark, monkeypatch):
    """The tables between the steps hold what repeats, not the texts around it."""
    rng = np.random.default_rng(5)
    text = lambda n: bytes(rng.integers(33, 127, n, np.uint8)).decode()
    shared = text(150)
    texts = {i: text(6000) + shared + text(2000) for i in range(40)}
    write, tables, held = suffixes.cut_lineage, [], []

    def kept(df):
        tables.append(write(df))
        files = [os.path.join(d, f) for t in tables for d, _, names in os.walk(t._scratch_path.removeprefix("file://")) for f in names]
        held.append(sum(map(os.path.getsize, files)))
        return tables[-1]

    monkeypatch.setattr(suffixes, "cut_lineage", kept)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert suffix_rows(suffixes.deduplicated_bytes(df)) == brute_dedup(texts, 100)
    assert 0 < max(held) < sum(map(len, texts.values())) / 2


# neighbours


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        scores = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in good if j != i and len(w) == len(v))
        out[i] = scores[:k]
    return out


def test_op9_by_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = {i: v for i, v in brute_nearest(rows, 5).items() if i % 50 == 0}
    got = defaultdict(list)
    for r in sorted(queries.QUERIES["op9_neighbours"](spark, FOLDER).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((-round(r.score, 12), r.vec_id))
    assert got == want


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None])]
    rows += [(10, [1.0, 1.0, 1.0]), (11, [2.0**-990] * 2), (12, [2.0**990] * 2), (13, [-1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for size in (1, 3, 1024):
        got = defaultdict(list)
        for r in sorted(neighbours.nearest(df, df, 3, query_rows=size, block_rows=size).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append(r.vec_id)
        assert got[1] == [2, 11, 12] and got[11] == [12, 1, 2] and got[13] == [3, 11, 12] and 10 not in got and not {4, 5, 6, 7, 8, 9, None} & set(got)
    assert neighbours.nearest(df.limit(0), df.limit(0), 3).count() == 0


# toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        ranks[score == s] = ranks[score == s].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_op1_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"  # enough labelled rows of every language
    rows = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [k for k in labels if k in rows and rows[k].held_out]
    y, s = np.array([labels[k] for k in held]), np.array([rows[k].score for k in held])
    assert auc(s, y) > 0.95 and ((s >= 0.3) == y).mean() > 0.95


def random_entries(rng, words=60, n=700):
    rows = []
    for i in range(n):
        terms = np.sort(rng.choice(words, rng.integers(1, 6), replace=False))
        rows.append((terms, rng.integers(1, 4, len(terms)), 1, int(rng.random() < 0.4), i))
    return toxicity.Entries([*rows, ((), (), 3, 1, 0)])


@pytest.mark.parametrize("block", [1, 3, 16, 64, 1000])
def test_index_is_exact(block):
    """Entries found through block maxima are those of a full search, ties at the k-th included."""
    rng = np.random.default_rng(4)
    value = rng.uniform(0.1, 9, 60) ** 2
    index = toxicity.Index(value, random_entries(rng), 0.4, k=10, block=block)
    e, opened = index.entries, 0
    assert e.empty == [3, 1] and e.n.sum() == 700
    vectors = np.zeros((len(e), 60))
    for i in range(len(e)):
        vectors[i, e.row(i)[0]] = toxicity.unit_weights(*e.row(i), value)
    for _ in range(120):
        terms = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        counts = rng.integers(1, 5, len(terms))
        q = np.zeros(60)
        q[terms] = toxicity.unit_weights(terms, counts, value)
        cosines = vectors @ q
        order = np.argsort(-cosines, kind="stable")
        enough = np.searchsorted(np.cumsum(e.n[order]), 10)
        want = {i for i in range(len(e)) if cosines[i] >= cosines[order[enough]] - 1e-9 and cosines[i] > 0}
        found, got = index.nearest(terms, counts)
        assert set(found.tolist()) == want and np.allclose(got, cosines[found])
        opened += len(found)


def test_vectors_of_texts():
    vocabulary = toxicity.Vocabulary(["ab", "c", "é"])
    terms, counts = vocabulary.vector("Ab é c2c ab_AB zz É")
    assert terms.tolist() == [0, 1, 2] and counts.tolist() == [3, 2, 2]
    assert not len(toxicity.Vocabulary([]).vector("ab")[0])


def test_bounded_sample(spark):
    """min(n, rows) rows at every size, also where most rows are equal."""
    from carrierlake.llm.common import bounded_sample

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS a", "id % 3 = 0 AS b")
    for n in (0, 1, 10, 999, 2999, 5000):
        got = [tuple(r) for r in bounded_sample(rows, n).collect()]
        assert len(got) == min(n, 3000)
        assert set(got) <= {tuple(r) for r in rows.collect()}
    assert bounded_sample(rows.limit(0), 5).count() == 0


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (None, 1), (4, None), (5, 7)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and rows[0].row.asDict().keys() == set(odd.columns)
    by = defaultdict(set)
    for r in rows:
        by[r.row.text].add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[""] == by[" \n\t "] == by[None]
    assert toxicity.toxicity_scores(odd.limit(0), labels).count() == 0
    assert len({r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()}) == 1


def test_toxicity_within_its_bounds(spark, monkeypatch):
    """Fewer examples, pairs or bytes than there are: the rest is left out and everything is still scored."""
    docs = spark.createDataFrame([(i, f"plain words {i} " + ("foul vile rotten" if i % 4 == 0 else "calm quiet")) for i in range(200)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 AS int) AS toxic")
    for name, bound in (("MOST_PAIRS", 300), ("MOST_BYTES", 1200)):
        with monkeypatch.context() as m:
            m.setattr(toxicity, name, bound)
            _, learned = toxicity.learned_rows(docs, labels, "toxic", 150)
            assert 10 < len(learned) < 100
            rows = toxicity.toxicity_scores(docs, labels, most=150).collect()
            assert {r.row.doc_id for r in rows if r.score >= 0.5} == {i for i in range(200) if i % 4 == 0}


def test_toxic_rows_go_by_their_own_text(spark, tmp_path):
    """Rows without id are judged, and of rows with one id only the toxic one goes."""
    texts = [("foul vile rotten" if i % 4 == 0 else "calm quiet") + f" words of text {i}" for i in range(80)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs += [(None, texts[0], None, None, None), (None, texts[1], None, None, None), (1, texts[4], "en", "s", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, frame, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d[0], d[1]) for d in docs if "foul" not in (d[1] or "")), key=str)


def test_toxicity_reads_every_word(spark):
    """Texts without any word that marks the label still have neighbours: those of the same ordinary words."""
    topics = ["river stone harbour bridge", "violin sonata chamber tempo", "glacier summit ridge valley"]
    texts = [f"{topics[i % 3]} {topics[i % 3].split()[i % 4]} extra{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "summit valley ridge", "stone bridge"])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and i % 2 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    rows = {r.row.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(len(rows[i].evidence) == 3 for i in rows)
    assert all(e.doc_id % 3 == 2 for e in rows[60].evidence) and all(e.doc_id % 3 == 0 for e in rows[61].evidence)
    assert rows[61].score > rows[60].score


# pipeline


def test_pipeline_stage_by_stage(spark, plain):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{scratch_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, FOLDER).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == source.columns
    before, after = seen["toxicity"]
    scores = {r.row.doc_id: r.score for r in toxicity.toxicity_scores(source, toxicity.learnable(spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()}
    assert {r.doc_id for r in after} == {k for k, s in scores.items() if s < toxicity.CUT}
    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after} == {c for _, c in brute_components({r.doc_id: r.text for r in before}).values()}
    before, after = seen["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert set(texts) == {r.doc_id for r in before}
    for r in before:
        spans = brute.secret_spans(r.text)
        assert not brute.secret_spans(texts[r.doc_id]) and (spans or texts[r.doc_id] == r.text or "[secret]" in texts[r.doc_id])
    before, after = seen["mixing"]
    size = lambda rows: sum(len(brute.SPACED.findall(r.text)) for r in rows)
    assert size(after) == pytest.approx(1.5 * size(before), rel=0.05) and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["packing"]
    wanted = defaultdict(int)
    for r in before:
        wanted[r.doc_id] += len(plain(r.text, 2))
    by_doc, padding, total = packed_well(after, wanted)
    assert {k: sum(r.length for r in v) for k, v in by_doc.items()} == dict(wanted) and padding <= 0.02 * total
