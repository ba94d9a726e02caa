"""Conversation repair, whitening and personal data: brute force over whole tables, exact checks, and edge rows."""

import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_scans import SCHEMA, odd_rows  # noqa: E402

from carrierlake.llm import conversations, personal, queries, whitening  # noqa: E402

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


# personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(text):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(text)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_op13_against_the_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_personal"](spark, FOLDER).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        counts = [sum(s[0] == k for s in want) for k, _ in PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) | {""}


def test_spans_on_random_texts():
    """Dense strings of the characters that the patterns care about."""
    rng = random.Random(11)
    for _ in range(4000):
        alphabet = rng.choice(["0123456789.", "01 -+().", "ab@.-", "a1@. +-(", "0123456789 -", "é1@b.%_+ ", "https://a:@b.c0 "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        got = [(personal.KINDS[k], a, b) for a, k, b in personal.personal_spans(text) if k < personal.BASE]
        assert got == base_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("see https://bob:s3cret@host.example/x", "url_login", "https://bob:s3cret@host.example"), ("ssh://git@10.0.0.1 now", "url_login", "ssh://git@10.0.0.1"),
        ("IBAN: DE89 3704 0044 0532 0130 00 THANKS", "iban", "DE89 3704 0044 0532 0130 00"), ("iban GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("SSN 123-45-6789", "ssn", "123-45-6789"), ("Account number: 0012-345678", "account", "0012-345678"), ("acct #99887766", "account", "99887766"),
    ],
)
def test_cues(text, kind, found):
    assert found in [text[a:b] for a, k, b in personal.personal_spans(text) if personal.KINDS[k] == kind]


@pytest.mark.parametrize("text", ["IBAN DE89 3704 0044 0532 0130 01", "SSN 000-12-3456", "accountant 12345678", "https://host/a@b", "the account was closed", "my ssns 123-45-6789"])
def test_invalid_identifiers(text):
    assert not [s for s in personal.personal_spans(text) if s[1] >= personal.BASE]


def test_personal_data_on_odd_rows(spark):
    odd = spark.createDataFrame([*odd_rows(), (90, "9" * 20000 + ".1.1.1 " + "a." * 20000 + "@" * 3, "s", 1, "b", 2, "s", 3, 4), (91, "é 1.2.3.4 " * 5000, None, 1, "b", 2, "s", 3, 4)], SCHEMA)
    rows = personal.find_personal_data(odd).collect()
    assert len(rows) == odd.count() and rows[0].row.asDict().keys() == set(odd.columns)
    for r in rows:
        assert [(personal.KINDS[s.kind], s.start, s.end) for s in r.spans if s.kind < personal.BASE] == base_spans(r.row.text)
    assert personal.find_personal_data(odd.limit(0)).count() == 0


# whitening


def whitened_by_hand(vectors):
    """(rows usable, integer matrix, values, vectors) by a dense solver over the distinct integer vectors."""
    keep = [i for i, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors if i in set(keep)}
    fit = np.array(sorted(set(map(tuple, x.values()))), float)
    centred = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1], basis[:, ::-1]


def agrees(rows, vectors, k):
    x, fit, values, basis = whitened_by_hand(vectors)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    assert len(rows) == len(x) * k
    by = {(r.vec_id, r.component): r for r in rows}
    ids = sorted(x)
    mean = fit.mean(axis=0)
    for c in range(1, k + 1):
        got = np.array([by[i, c].whitened for i in ids])
        want = (np.array([x[i] for i in ids], float) - mean) @ basis[:, c - 1] / math.sqrt(values[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert by[ids[0], c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    for i in ids:
        r = by[i, 1]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[i], sums)) and r.identity_error < 1e-9


def test_op12_against_a_dense_solver(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agrees(queries.QUERIES["op12_whitening"](spark, FOLDER).collect(), vectors, 16)


def test_whitening_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(0, 3, 5)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 1.0, 2.0, 3.0, 4.0]), (105, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in [*good, good[7], *bad]], "vec_id bigint, embedding array<double>, code string, dim int")
    rows = whitening.whiten(table).collect()
    assert len(rows) == 61 * 5 and not {r.vec_id for r in rows} & {r[0] for r in bad}
    agrees({(r.vec_id, r.component): r for r in rows}.values(), good, 5)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0  # one vector has no variance
    assert len(whitening.whiten(table.where("vec_id in (3, 4)")).collect()) == 2  # two have one direction


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i * i), -float(i)]) for i in range(5)] + [(9, [1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x = [[64 * int(a), 64 * int(b)] for a, b in (v for _, v in rows[:5])]
    sums = [sum(c) for c in zip(*x)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table.where("vec_id < 9")).collect()}
    assert got == {i: sum((5 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}
    assert {r.vec_id for r in whitening.whiten(table).collect() if r.deviation is None}


def test_contour_finds_what_the_dense_solver_finds():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for values in (np.arange(40.0), np.repeat([5.0, 3.0, 1.0, 0.0], 10), np.concatenate([[1e6, 1.0, 1.0 - 1e-9], np.full(37, 1e-6)]), 0.9 ** np.arange(40)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        diagonal, off = whitening.tridiagonal(a)
        assert np.allclose(whitening.located(diagonal, off), np.sort(values)[::-1], atol=1e-12 * abs(values).max())
        shift = np.array([0.5, 2.5, 4.5])
        assert whitening.inertia(diagonal, off, shift).tolist() == [(values < s).sum() for s in shift]
        found = whitening.intervals(whitening.located(diagonal, off), 12)
        assert sum(c for *_, c in found) >= 12
        pairs = [whitening.contour_pairs(a, *i) for i in found]
        got = np.sort(np.concatenate([v for v, _ in pairs]))[::-1]
        assert np.allclose(got, np.sort(values)[::-1][: len(got)], atol=1e-12 * abs(values).max())
        basis = np.concatenate([v for _, v in pairs], axis=1)
        assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-7)


# conversations


def by_hand(rows):
    """The contract for one conversation by trying all edits row by row; rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def follows(made):
        return re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] if r else "?" for r, _ in made)) is not None

    best = {(): (0, "", ())}  # frontier: last role letter pattern -> cheapest

    def state(made):
        return made[-1][0][:1] if made else ""

    def keep(table, key, item):
        if key not in table or item[:2] < table[key][:2]:
            table[key] = item

    def insert(table):
        for _ in range(3):
            for key, (cost, audit, made) in list(table.items()):
                role = "assistant" if key == "u" else "user"
                keep(table, role[0], (cost + 2, audit + "I", (*made, (role, ""))))
        return table

    best = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for key, (cost, audit, made) in best.items():
            keep(new, key, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            for name, letter, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                longer = (*made, (name, text))
                if name[:1] in ("s", "u", "a") and follows(longer):
                    keep(new, name[:1], (cost + price + (fault == "truncated"), audit + letter, longer))
        best = insert(new)
    cost, audit, made = min(best[k] for k in ("", "a") if k in best)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1))
    return out


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_op11_against_trying_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.QUERIES["op11_conversations"](spark, FOLDER)) == {k: by_hand(v) for k, v in damage(rows).items()}


def random_rows(n, conversations_, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["a.", "b!", "c", "", " ", None, "d?", "e. ", "f\n", "long " * 40 + "."]
    return [(rng.choice(conversations_), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_repair_of_random_rows(spark, block, monkeypatch):
    """Nulls everywhere, ties of turns, repeated rows, blocks of any size and a conversation that holds most rows."""
    rows = random_rows(500, [None, *range(40)], 3) + random_rows(700, [99], 4)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, times int, digest string")
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    damaged, times = conversations.damaged(table)
    assert result(conversations.repair_conversations(damaged, times=times)) == {k: by_hand(v) for k, v in damage(rows).items()}
    assert conversations.repair_conversations(table.limit(0)).count() == 0


def test_prefix_order_and_collisions(monkeypatch):
    """Comparison by lifting equals string order, also where every hash collides."""
    for prime in (conversations.PRIME, 3):
        monkeypatch.setattr(conversations, "PRIME", prime)
        rng = random.Random(prime)
        audits = conversations.Audits()
        nodes, words = [audits.root()], [""]
        for _ in range(400):
            i, letter = rng.randrange(len(nodes)), rng.choice("DIKR")
            nodes.append(audits.extend(nodes[i], letter))
            words.append(words[i] + letter)
        for i, j in itertools.product(rng.sample(range(401), 60), repeat=2):
            assert audits.less(nodes[i], nodes[j]) == (words[i] < words[j])
            assert audits.text(nodes[i]) == words[i]
