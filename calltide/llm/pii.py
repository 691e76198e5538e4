"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) always keep their confirmed spans. Further kinds (iban, ssn) are reported when their
score, a prior plus what context words within ``CONTEXT`` characters add, reaches ``THRESHOLD``. Context only raises a
score: an account that mod-97 confirms needs none, a social security number, which has no check digit, does. All patterns are
possessive or anchored, so that a text of a million equal characters costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches

#: Kinds in the order that ties of start are listed in.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
THRESHOLD = 0.6
CONTEXT = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
BOOST = 0.3
#: Words that make a kind likelier when they stand near a span.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}+")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The IBAN check: country and check digits moved to the end, letters as 10..35, remainder 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each @ outwards: linear in the text."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        free = tail.end() if tail else at + 1
        if tail:
            yield start, free
        at = text.find("@", free)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def ibans(text: str) -> list[tuple[int, int]]:
    """Confirmed accounts in their order, each as long as its country says; of an unknown country the longest that ends with a token.

    Accounts of known countries come first, and others only between them, since these try many ends. What follows an
    account, or does not confirm, is looked at again; a start reads at most 64 characters: linear.
    """
    found: list[tuple[int, int]] = []
    others = []

    def confirmed(places: list[int], n: int) -> bool:
        after = text[places[n - 1] + 1 : places[n - 1] + 2]
        return not (after.isascii() and after.isalnum()) and mod97("".join(text[k] for k in places[:n]))

    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.match(text, m.end())
        if not rest:
            continue
        places = [k for k in range(m.start(), rest.end()) if text[k] != " "]
        known = IBAN_LENGTHS.get(m[0][:2])
        if not known:
            others.append(places)
        elif m.start() >= (found[-1][1] if found else 0) and known <= len(places) and confirmed(places, known):
            found.append((m.start(), places[known - 1] + 1))
    out, k = [], 0
    for places in others:
        while k < len(found) and found[k][0] <= places[0]:
            out.append(found[k])
            k += 1
        if places[0] >= (out[-1][1] if out else 0):
            end = next((n for n in range(len(places), 14, -1) if (k == len(found) or places[n - 1] < found[k][0]) and confirmed(places, n)), 0)
            if end:
                out.append((places[0], places[end - 1] + 1))
    return out + found[k:]


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, in no order."""
    for start, end in emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()


def scan(text: str) -> list[Span]:
    """All reported spans in order of start, then kind; base kinds whatever their score, others from THRESHOLD on."""
    found = []
    for kind, start, end in candidates(text):
        near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
        score = min(1.0, PRIOR[kind] + BOOST * any(w in near for w in CONTEXT_WORDS[kind]))
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append(Span(kind, start, end, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and ``spans`` array<struct<kind,start,end,score>>; offsets in code points, end exclusive.

    A null or empty text has no spans. Each row is taken on its own, so repeated rows and ids give repeated results;
    ids may be null or of any type.
    """
    bound_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in scan(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind string, start long, end long, score double>>")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for s in scan(text):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
            at = s.end
    return "".join([*out, text[at:]])


def summary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans and the list of all spans, one row per document."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, text, doc_id).select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed([s for s in spans if s.kind in BASE_KINDS]).encode()).hexdigest()
