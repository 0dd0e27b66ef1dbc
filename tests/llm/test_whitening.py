"""Spectra by rank-one updates against LAPACK, and whitened vectors against a plain computation."""

import math

import numpy as np
import pytest

from drayage.llm import whitening
from drayage.llm.common import table
from drayage.llm.queries import QUERIES
from drayage.llm.whitening import Spectrum

SF = "/root/testdata/sf0.001"


def vectors(rng, n, dims):
    x = np.floor(rng.normal(size=(n, dims)) * rng.uniform(0.1, 200, dims)).astype(np.int64)
    if dims == 8:
        x[:, 3], x[:, 5] = x[:, 2], 7  # no variance of its own
        x[n // 2:] = x[0]
    return x


@pytest.mark.parametrize("n, dims", [(1, 5), (2, 1), (30, 2), (100, 8), (40, 64), (3000, 64)])
def test_spectra_equal_lapack(n, dims):
    x = vectors(np.random.default_rng(n), n, dims)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    by_blocks = Spectrum.empty(dims)
    for k in range(0, n, 700):
        by_blocks = by_blocks.with_vectors(x[k:k + 700])
    halves = Spectrum.empty(dims).with_vectors(x[:n // 2 + 1])
    if n // 2 + 1 < n:
        halves = halves.with_spectrum(Spectrum.empty(dims).with_vectors(x[n // 2 + 1:]))
    size = max(np.abs(scatter).max(), 1)
    for found in (by_blocks, halves):
        assert found.n == n and found.sums == x.sum(axis=0).tolist()
        assert np.abs(found.values - np.linalg.eigvalsh(scatter)).max() < 1e-12 * size
        assert np.abs(found.vectors.T @ found.vectors - np.eye(dims)).max() < 1e-12
        assert np.abs(found.vectors * found.values @ found.vectors.T - scatter).max() < 1e-12 * size


def test_a_rank_one_update_at_a_time():
    rng = np.random.default_rng(3)
    values, q, whole = np.zeros(6), np.eye(6), np.zeros((6, 6))
    for row in [*rng.normal(size=(9, 6)), np.zeros(6), np.eye(6)[2], np.eye(6)[2], np.ones(6) * 1e-12]:
        values, q = whitening.rank_one(values, q, row)
        whole += np.outer(row, row)
        assert np.all(np.diff(values) >= 0)
        assert np.abs(q * values @ q.T - whole).max() < 1e-13 * max(1, np.abs(whole).max())


def plain(rows, components=32):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], None, None
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = np.array([[(n * int(c) - int(s)) / n for c, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = int((e[:components] > 1e-13 * e.sum()).sum())
    return [(i, int(d), w) for (i, _), d, w in zip(kept, deviation, centred @ v[:, :k] / np.sqrt(e[:k]), strict=True)], e[:k] / e.sum(), n


def agrees(got, rows):
    want, shares, n = plain(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append(r)
    assert sorted(by_id, key=repr) == sorted({i for i, _, _ in want}, key=repr)
    components = {r["component"] for r in got}
    assert components == set(range(1, len(shares) + 1))
    found = {(r["id"], r["component"]): r for r in got}
    sign = {}
    for c in components:
        i, _, w = max(want, key=lambda x: abs(x[2][c - 1]))
        sign[c] = np.sign(w[c - 1] * found[i, c]["whitened"])
    for i, d, w in want:
        for c in components:
            r = found[i, c]
            assert r["n"] == n and r["deviation"] == d
            assert abs(r["whitened"] * sign[c] - w[c - 1]) < 1e-7 and abs(r["explained"] / shares[c - 1] - 1) < 1e-9
            assert r["identity_error"] < 1e-9


def frame(spark, rows, parts=3):
    return spark.createDataFrame(
        [(i, v, "x", 1.5) for i, v in rows], "vec_id long, embedding array<float>, component string, n double").repartition(parts)


def test_whitened_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [[float(np.float32(c)) for c in row] for row in rng.normal(size=(60, 5)) * [1, 2, 3, 0.5, 0.1]]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100, None), (101, [None, 1.0, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4)]
    rows += [(104 + k, base[0]) for k in range(40)]  # a hot vector
    agrees(whitening.whitened(frame(spark, rows, 40)).collect(), rows)


def test_defined_cases(spark):
    def count(rows):
        return whitening.whitened(frame(spark, rows)).count()

    assert count([]) == count([(1, None)]) == count([(1, [1.0, 2.0])]) == count([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == 0
    assert count([(1, [])]) == count([(1, [float("inf")])]) == 0
    # Other lengths and numbers beyond whole ones are left out, null and repeated ids stay.
    rows = [(1, [1.0, 2.0]), (None, [3.0, 2.0]), (None, [3.0, 5.0]), (1, [2.0, 2.0]), (4, [1.0]), (5, [1e30, 0.0]), (6, [])]
    assert count(rows) == 8


def test_deviations_are_exact_or_null():
    x = np.array([[3, 1 << 40], [0, 0]])
    n, sums = 5, [7, 1 << 40]
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.squared_deviations(x, n, sums).to_pylist() == [w if w < 1 << 63 else None for w in want]


def test_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    got = QUERIES["op13_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agrees(got.withColumnRenamed("vec_id", "id").collect(), rows)
