"""Plain Python versions of the contracts, for comparison with the queries."""

import hashlib
import re

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
WORD2 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def secret_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind order, kind, end) of base spans."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def secret_row(text: str | None):
    spans = secret_spans(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    counts = [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)


def license_row(text: str | None):
    words = WORD2.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        want = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def quality_row(text: str | None):
    text = text or ""
    words = SPACED.findall(text)
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for starts in seen.values() if len(starts) > 1 for i in starts for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed
