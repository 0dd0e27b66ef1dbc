"""Runs of repeated words against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from drayage.llm import periodic_runs
from drayage.llm.common import table
from drayage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=6, exponent=4):
    """All runs, period by period; a run belongs to its smallest period."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(least, exponent * q) and not smaller:
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def random_texts(rng):
    texts = []
    for _ in range(rng.randrange(1, 6)):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 30]))).encode() for _ in range(rng.randrange(60))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randrange(1, max(2, len(words) // 3))
            words = [w if i < a else words[min(len(words) - 1, a + (i - a) % p)] for i, w in enumerate(words)]
        texts.append(words * rng.choice([1, 1, 2]))
    return texts


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(300):
        texts = random_texts(rng)
        found = periodic_runs.text_runs(texts, least, exponent)
        got = [[] for _ in texts]
        for t, *run in zip(found.text, found.start, found.length, found.period, strict=True):
            got[t].append(tuple(map(int, run)))
        assert got == [brute_runs(t, least, exponent) for t in texts]


def test_suffixes_are_tested_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = [t for _ in range(20) for t in random_texts(rng)]
    whole = periodic_runs.text_runs(texts)
    monkeypatch.setattr(periodic_runs, "TESTED", 7)
    parts = periodic_runs.text_runs(texts)
    assert all(np.array_equal(a, b) for a, b in zip(vars(whole).values(), vars(parts).values(), strict=True))


def test_defined_cases(spark, docs):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a  a\ta\na a a"), (6, "a b a b a b a b"),
        (7, "a b a b a b a"), (8, "x " * 300_000), (9, "Z" * 300_000), (None, "ü ü ü ü ü ü end"), (None, "ü ü ü ü ü ü end"),
        (5, "a  a\ta\na a a"), (10, "1 2 2 2 2 2 2 1 2 2 2 2 2 2 1 2 2 2 2 2 2 1 2 2 2 2 2 2"),
        (11, "a b a b a b a b a b a b")]
    got = periodic_runs.periodic_runs(docs(rows)).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = [(0, 300_000, 1)] if i == 8 else brute_runs(words)
        kept = b"x" if i == 8 else brute_kept(words, runs)
        want.append((i, len(words), runs, kept.decode()))
    assert sorted([(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got], key=repr) == sorted(
        want, key=repr)
    assert periodic_runs.periodic_runs(docs(rows[:1]).limit(0)).collect() == []


def test_registered_query(spark):
    want = []
    for r in table(spark, SF, "documents").collect():
        words, h = (r["text"] or "").encode().split(), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 400 else [tuple(map(int, r)) for r in runs_by_shifts(words)]
        s, length, q = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{x[0]},{x[1]},{x[2]}\n" for x in runs)
        want.append((r["doc_id"], len(runs), s, length, q, None if q is None else 1000 * length // q,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_kept(words, runs)).hexdigest()))
    got = QUERIES["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(x[1] for x in want)


def runs_by_shifts(words):
    """Brute force for longer texts: the text compared with itself, shifted by every period."""
    number = np.unique(np.array(words, dtype=np.bytes_), return_inverse=True)[1]
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], number[:-q] == number[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edge[0::2], edge[1::2] + q, strict=True):
            if end - start >= max(6, 4 * q):
                found.setdefault((start, end), q)  # a multiple of the period has the same ends
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))
