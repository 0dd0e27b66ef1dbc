"""Personal data in texts: patterns propose spans, validators confirm them, words nearby decide.

Base spans are what the patterns of four kinds match from left to right and a validator confirms:
emails; dotted addresses whose parts are at most 255; card numbers of 14 to 19 digits with a right
Luhn sum; phone numbers of 10 to 15 digits behind a plus sign. They always stay.

Further patterns propose what these miss: numbers inside a match that its validator turned down
(two card numbers side by side, a phone number followed by other figures), account numbers whose
rest modulo 97 is right and whose length is their country's, national phone numbers and social
security numbers. Every span has a score: what its pattern is worth, what its validator adds, and
``CONTEXT`` more or less for words within ``NEAR`` code points that speak for or against its kind.
Proposals below ``ACCEPT`` go, and so do those that overlap a base span or a better proposal.

Every pattern takes time in proportion to the text, whatever it holds: stretches of digits are
taken whole or not at all, and emails are found from their @ sign outwards.

Defined cases: a null text counts as empty and has no spans; rows that repeat an id stay rows of
their own; ids are carried only; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm.common import text_or_empty

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
NEAR, CONTEXT, ACCEPT = 40, 0.25, 0.7

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A stretch of digits is consumed whole, so that none is looked at from each of its digits.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_GROUPED_CARD = re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_NORTH_AMERICAN = re.compile(r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}")

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
# Words that speak for a kind, and words that speak for figures of another sort.
FOR = {
    "email": ["email", "e-mail", "mail", "contact", "write", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "client", "login"],
    "card": ["card", "credit", "debit", "visa", "mastercard", "amex", "payment", "tarjeta", "carte", "karte"],
    "phone": ["phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact", "teléfono", "telefon", "téléphone"],
    "iban": ["iban", "account", "bank", "transfer", "konto", "cuenta", "compte"],
    "ssn": ["ssn", "social", "security"],
}
AGAINST = {
    "email": [],
    "ip": ["version", "release", "build", "section", "chapter"],
    "card": ["order", "invoice", "isbn", "serial", "tracking", "part"],
    "phone": ["order", "invoice", "isbn", "serial", "part", "version"],
    "iban": ["serial", "part"],
    "ssn": ["order", "invoice", "serial", "part"],
}
_FOR, _AGAINST = (
    {k: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", re.I) if words else None
     for k, words in lists.items()} for lists in (FOR, AGAINST))
# What a pattern of a kind is worth, and what the validator adds.
_WORTH = {"email": (0.8, 0.0), "ip": (0.5, 0.1), "card": (0.5, 0.4), "phone": (0.6, 0.1)}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(account: str) -> bool:
    """Length of the country, and the rest modulo 97, of an account number without spaces."""
    if IBAN_LENGTHS.get(account[:2]) != len(account):
        return False
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    begin, at = 0, text.find("@")
    while at >= 0:
        before = text[begin:at]
        start = begin + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        # No name reaches over an @ sign.
        begin = domain.end() if domain else at + 1
        at = text.find("@", begin)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _without(text: str, start: int, end: int) -> str:
    return "".join(_DIGITS.findall(text, start, end))


def _base(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Confirmed matches of the base patterns, and those that were turned down."""
    good = [("email", *m) for m in _emails(text)]
    bad = []
    for m in _IP.finditer(text):
        if m[1] and all(map(_small, m[0].split("."))):
            good.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _without(text, m.start(), m.end())
            fine = 14 <= len(digits) <= 19 and luhn(digits)
            (good if fine else bad).append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        fine = 10 <= len(_without(text, m.start(), m.end())) <= 15
        (good if fine else bad).append(("phone", m.start(), m.end()))
    return good, bad


def _free(text: str, m: re.Match) -> bool:
    """Not the end of a longer number or word."""
    return m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "+.-")


def _proposed(text: str, bad: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, worth) of spans that the base patterns miss."""
    for kind, start, end in bad:
        if kind == "phone":
            for m in _NORTH_AMERICAN.finditer(text, start, end):
                yield "phone", m.start(), m.end(), 0.7
            continue
        for m in _DIGITS.finditer(text, start, end):
            if 14 <= len(m[0]) <= 19 and luhn(m[0]):
                yield "card", m.start(), m.end(), 0.8
        for m in _GROUPED_CARD.finditer(text, start, end):
            if _free(text, m) and luhn(_without(text, m.start(), m.end())):
                yield "card", m.start(), m.end(), 0.6
    for m in _NATIONAL.finditer(text):
        if _free(text, m):
            yield "phone", m.start(), m.end(), 0.5
    for m in _SOCIAL.finditer(text):
        if _free(text, m):
            yield "ssn", m.start(), m.end(), 0.5
    for m in _ACCOUNT.finditer(text):
        length = IBAN_LENGTHS.get(m[0][:2])
        if not length or not _free(text, m):
            continue
        # The pattern may run into the words behind the number.
        plain, end = "", m.start()
        while len(plain) < length and end < m.end():
            plain += text[end].strip()
            end += 1
        if iban(plain) and not text[end:end + 1].isalnum():
            yield "iban", m.start(), end, 0.9


def _context(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}"
    score = CONTEXT if _FOR[kind].search(around) else 0.0
    against = _AGAINST[kind]
    return score - CONTEXT if against and against.search(around) else score


def spans_of(text: str) -> list[Span]:
    """All spans of a text, by start, then kind. Places are code points, the end is exclusive."""
    good, bad = _base(text)
    out = [
        Span(kind, start, end, min(1.0, sum(_WORTH[kind]) + max(0.0, _context(text, kind, start, end))), True)
        for kind, start, end in good]
    proposed = [
        Span(kind, start, end, min(1.0, worth + _context(text, kind, start, end)), False)
        for kind, start, end, worth in _proposed(text, bad)]
    proposed = [p for p in proposed if p.score >= ACCEPT]
    if proposed:
        taken = bytearray(len(text))  # code points that a span covers
        for span in out:
            taken[span.start:span.end] = b"\1" * (span.end - span.start)
        for p in sorted(proposed, key=lambda p: (-p.score, p.start, p.end, KINDS.index(p.kind))):
            if taken.find(1, p.start, p.end) < 0:
                out.append(p)
                taken[p.start:p.end] = b"\1" * (p.end - p.start)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end, score, base) by start, then kind."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    span = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([rows.schema["id"], T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans_of(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "spans"])

    return rows.mapInArrow(find, schema)


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
