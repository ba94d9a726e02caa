r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, digits, ``+`` before a digit, and words that announce an identifier.
From each anchor a local parser reads outward once, fixes the boundaries and validates what it read: e-mail (outward from the at-sign),
IPv4 address, payment card (Luhn) and phone number, and, as additions of the method, credentials inside URLs, IBANs (mod 97), social
security numbers and account numbers behind their cue words. Parsers are anchored and possessive, and a scan never returns to text that a
parser of the same kind has consumed, so the work is linear in the text.
"""

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import documents, query, text_of
from .tokens import slices

#: Base kinds in the order of the contract, then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "ssn", "account")
BASE = 4
EMAIL, IP, CARD, PHONE, LOGIN, IBAN, SSN, ACCOUNT = range(len(KINDS))

#: Anchors beside at-signs, digits and ``+digit``.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "mysql://", "redis://", "amqp://", "mongodb://")
CUES = {"iban": IBAN, "ssn": SSN, "social security": SSN, "account": ACCOUNT, "acct": ACCOUNT, "konto": ACCOUNT, "cuenta": ACCOUNT, "compte": ACCOUNT}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9]++")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN_AT = re.compile(r"[^\s/@:?#]++(?::[^\s/@?#]*+)?@(?:[A-Za-z0-9-]++\.)*+[A-Za-z0-9-]++")
BETWEEN = re.compile(r"(?:[ \t]*+(?:[:=#.]|no\b|nr\b|number\b|num\b|id\b))*+[ \t]*+", re.IGNORECASE)
IBAN_RUN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN_RUN = re.compile(r"([0-9]{3})[ -]?([0-9]{2})[ -]?([0-9]{4})(?![0-9])")
ACCOUNT_RUN = re.compile(r"[A-Z]{0,4}[0-9](?:[ -]?[0-9]){5,19}(?![A-Za-z0-9])")


@cache
def anchors():
    """The automaton; values are (what the parser is, length of the pattern). Cues stand in three cases, so texts needn't be folded."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
        found.add_word(f"+{digit}", ("+", 2))
    for scheme in SCHEMES:
        found.add_word(scheme, ("://", len(scheme)))
    for cue, kind in CUES.items():
        for word in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check; every second digit from the right is doubled."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def behind_cue(text: str, begin: int, end: int, kind: int) -> tuple[int, int] | None:
    """Boundaries of the identifier that a whole cue word announces, or None."""
    if (begin and (text[begin - 1].isalnum() or text[begin - 1] == "_")) or (end < len(text) and text[end].isalnum()):
        return None
    at = BETWEEN.match(text, end).end()
    if at == end:
        return None
    if kind == IBAN:
        m = IBAN_RUN.match(text, at)
        while m and not valid_iban(m[0]):  # the run may have taken following capital groups
            cut = m[0].rfind(" ")
            m = IBAN_RUN.fullmatch(text, at, at + cut) if cut > 0 else None
    elif kind == SSN:
        m = SSN_RUN.match(text, at)
        m = m if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" else None
    else:
        m = ACCOUNT_RUN.match(text, at)
    return (at, m.end()) if m else None


def personal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind. Spans of one kind don't overlap."""
    found = []
    past = [0] * len(KINDS)  # where each kind's scan goes on
    for last, (what, length) in anchors().iter(text):
        begin, end = last + 1 - length, last + 1
        if what == "0":
            if begin >= past[IP]:
                if m := ADDRESS.match(text, begin):
                    past[IP] = m.end()
                    if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.groups()):  # four digits decide
                        found.append((begin, IP, m.end()))
                else:
                    past[IP] = DIGITS.match(text, begin).end()
            if begin >= past[CARD]:
                if m := CARD_RUN.match(text, begin):
                    past[CARD] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and passes_luhn(digits):
                        found.append((begin, CARD, m.end()))
        elif what == "@":
            start = begin
            while start > past[EMAIL] and text[start - 1] in LOCAL:
                start -= 1
            if start < begin and (m := DOMAIN.match(text, end)):
                past[EMAIL] = m.end()
                found.append((start, EMAIL, m.end()))
        elif what == "+":
            if begin >= past[PHONE] and (m := PHONE_RUN.match(text, begin)):
                past[PHONE] = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((begin, PHONE, m.end()))
        elif what == "://":
            if begin >= past[LOGIN] and (m := LOGIN_AT.match(text, end)):
                past[LOGIN] = m.end()
                found.append((begin, LOGIN, m.end()))
        elif begin >= past[what] and (span := behind_cue(text, begin, end, what)):
            past[what] = span[1]
            found.append((span[0], what, span[1]))
    return sorted(set(found))


def find_personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, spans): the input row (its columns ``keep``, else all) and its spans as (start, kind, end), kind an index of ``KINDS``.

    Null or empty text has no spans; repeated rows give repeated results, an empty table none; other columns may have any name or value.
    Texts are read whole, whatever their length.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    source = docs.select(kept.alias("row"), text_of().alias("text"))
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ends, flat = [0], []
                for text in part.column("text").to_pylist():
                    flat += personal_spans(text)
                    ends.append(len(flat))
                table = np.array(flat, np.int64).reshape(-1, 3)
                columns = [pa.array(table[:, i], f.type) if f.type == pa.int64() else pa.array(table[:, i].astype(np.int32)) for i, f in enumerate(span)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(span)))
                yield pa.RecordBatch.from_arrays([part.column("row"), lists], names=["row", "spans"])

    result = StructType([source.schema["row"], *StructType.fromDDL("spans array<struct<start:bigint,kind:int,end:bigint>>").fields])
    return source.mapInArrow(scan, result)


def joined_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op13_personal")
def op13(spark, folder):
    found = find_personal_data(documents(spark, folder).select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
