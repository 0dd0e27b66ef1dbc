"""Personal data against the patterns as they stand, and validators on known numbers."""

import hashlib
import random
import re
import time

import pytest

from drayage.llm import personal_data
from drayage.llm.common import table
from drayage.llm.personal_data import KINDS, iban, luhn, spans_of
from drayage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        letters = rng.choice(["a@.b-1", "01. -+()", "12.3@a", "0 4-", "1.2+3 (4)-@ü.y"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert [tuple(s[:3]) for s in spans_of(text) if s.base] == brute(text)


def test_validators():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert iban("GB82WEST12345698765432") and iban("DE89370400440532013000")
    assert not iban("GB82WEST12345698765433") and not iban("DE8937040044053201300") and not iban("ZZ82WEST12345698765432")


@pytest.mark.parametrize("text, kind, found", [
    ("4111111111111111 5500005555555559", "card", ["4111111111111111", "5500005555555559"]),
    ("4111-1111-1111-1111 5500-0055-5555-5559", "card", []),
    ("my visa cards: 4111-1111-1111-1111 5500-0055-5555-5559", "card", ["4111-1111-1111-1111", "5500-0055-5555-5559"]),
    ("+1 (826) 555-4081 190.137.223.204", "phone", ["+1 (826) 555-4081"]),
    ("order +1 (826) 555-4081 190.137.223.204", "phone", []),
    ("GB82 WEST 1234 5698 7654 32 or DE89370400440532013000.", "iban", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]),
    ("GB82 WEST 1234 5698 7654 33", "iban", []), ("XGB82WEST12345698765432", "iban", []),
    ("call (212) 555-0123 now", "phone", ["(212) 555-0123"]), ("(212) 555-0123", "phone", []),
    ("SSN: 123-45-6789", "ssn", ["123-45-6789"]), ("123-45-6789", "ssn", []), ("ssn 0123-45-6789", "ssn", []),
])
def test_proposals_and_their_context(text, kind, found):
    assert [text[s.start:s.end] for s in spans_of(text) if s.kind == kind and not s.base] == found


def test_scores_follow_the_words_nearby():
    plain, near, far = (spans_of(t)[0].score for t in (
        "1.2.3.4", "server 1.2.3.4", "server" + " " * personal_data.NEAR + "1.2.3.4"))
    assert near > plain == far
    assert spans_of("version 1.2.3.4")[0].base  # base spans stay whatever is near


@pytest.mark.parametrize("text", [
    "9" * 300_000, "a" * 300_000, "@" * 300_000, "1." * 100_000, "+1 (" * 50_000, "1 " * 100_000, "a." * 100_000 + "@",
    "AB12" * 50_000, "123-45-6789 ssn " * 10_000, "4111111111111111 " * 10_000])
def test_time_grows_with_the_text(text):
    started = time.monotonic()
    spans_of(text)
    assert time.monotonic() - started < 20


def test_defined_cases(docs):
    rows = [(1, None), (2, ""), (3, "Z" * 300_000), (4, "a@b.c"), (4, "a@b.c"), (None, "é a@b.c"), (None, "é a@b.c")]
    got = personal_data.personal_spans(docs(rows)).collect()
    assert sorted([(r["id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in got], key=repr) == sorted(
        [(i, [] if i == 3 else brute(t or "")) for i, t in rows], key=repr)  # no kind has a Z alone
    assert personal_data.personal_spans(docs(rows[:1]).limit(0)).collect() == []


def test_registered_query(spark):
    want = {}
    for r in table(spark, SF, "documents").collect():
        base = brute(r["text"] or "")
        want[r["doc_id"]] = (*[sum(s[0] == k for s in base) for k in KINDS[:4]], digest(base))
    got = QUERIES["op12_personal_data"](spark, SF)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = got.collect()
    assert {r["doc_id"]: tuple(r[1:6]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
        assert r["base_sha256"] != digest([]) or not sum(r[1:5])
