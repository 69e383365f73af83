"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds, in order: email, ip, card, phone are the base. The method adds iban (mod-97), secret (access keys
and passwords after a word that names them) and ssn. Each proposed span starts from the score of its
kind; a passed checksum raises it, and words within WINDOW letters on either side that speak for its kind raise,
those that speak against any lower it, always within 0 and 1. Base spans stand whatever their score; added ones need
KEEP.

Spans of one kind are found from left to right and do not overlap. Offsets are code points, the end
exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows each give a row; a null id
stays null; other columns are not read, or, when redacting, are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")
#: Score from which an added span counts, and the letters before and after it that count as context.
KEEP, WINDOW = 0.5, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins inside a run of digits could as well begin at its start, so the run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_NAMED = re.compile(r"(?i:password|passwd|secret|token|api[_-]?key) ?[=:] ?([^\s,;]{8,})")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: What a kind's spans start from, and what a passed checksum and words for and against them are worth.
START = {"email": 0.7, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.5, "secret": 0.8, "ssn": 0.4}
CHECKED, CONTEXT = 0.3, 0.3
_FOR = {
    "email": ("mail", "e-mail", "contact", "write to"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "credit", "visa", "mastercard", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "whatsapp"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("password", "passwd", "secret", "token", "key", "api", "login"),
    "ssn": ("ssn", "social security", "social-security"),
}
_AGAINST = ("order", "invoice", "version", "serial", "isbn", "ticket")
_begins = lambda words: re.compile("(?<![a-z])(?:" + "|".join(map(re.escape, words)) + ")")
_SPEAKS, _DENIES = {kind: _begins(words) for kind, words in _FOR.items()}, _begins(_AGAINST)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Walk from one at sign to the next; what stands before it is extended to the left."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def score(text: str, kind: str, start: int, end: int, checked: bool = False) -> float:
    """Score of one span of a kind by its checksum and the words around it; words count where they begin."""
    value = START[kind] + CHECKED * checked
    near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
    value += CONTEXT * bool(_SPEAKS[kind].search(near)) - CONTEXT * bool(_DENIES.search(near))
    return round(min(1.0, max(0.0, value)), 2)


def _proposed(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind's place in KINDS, start, end, whether a checksum confirms it); what fails its checksum is left out."""
    yield from ((0, a, b, False) for a, b in _emails(text))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                yield 1, *m.span(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield 2, *m.span(), True
    if "+" in text:
        yield from ((3, *m.span(), False) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15)
    yield from ((4, *m.span(), True) for m in _IBAN.finditer(text) if mod97(m.group().replace(" ", "")))
    found = [m.span() for m in _KEY.finditer(text)] if "AKIA" in text else []
    if "=" in text or ":" in text:
        found += [m.span(1) for m in _NAMED.finditer(text)]
    last = -1
    for a, b in sorted(found):
        if a >= last:
            yield 5, a, b, False
            last = b
    if "-" in text:
        yield from ((6, *m.span(), False) for m in _SSN.finditer(text))


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(kind's place in KINDS, start, end, score), sorted."""
    scored = ((k, a, b, score(text, KINDS[k], a, b, checked)) for k, a, b, checked in _proposed(text))
    return sorted(s for s in scored if s[0] < len(BASE) or s[3] >= KEEP)


def joined(found: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): spans of every whole text as an array of (kind, start, end, score)."""
    kind = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"

    def run(batches):
        inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for k, a, b, s in spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, inner)], ["id", "found"])

    source = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return source.mapInArrow(run, f"id long, found {kind}").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text, and their scores in that order."""
    as_text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    scores = F.concat_ws(",", F.transform("found", lambda x: F.format_number(x["score"], 2)))
    return found.select(id_col, *map(of, BASE), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"), scores.alias("scores"))


def redacted(text: str) -> str:
    """Spans replaced by their kind; of spans that overlap the earlier, then the longer one counts."""
    out, at = [], 0
    for k, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = b
    return "".join([*out, text[at:]]) if out else text


def redact(text: Column) -> Column:
    """A column of whole texts with their personal data replaced; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t))

    return run(text)


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
