"""Repeated passages, exact copies and near copies against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from drayage.llm import exact_dedup, ngram_join, repeats, suffix_dedup
from drayage.llm.components import components
from drayage.llm.shingles import shingle_sets

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join(rng.choice("the of an ration edna thé über to".split()) + str(rng.randrange(50)) for _ in range(n))


# --- repeated passages ---------------------------------------------------------------------------

def without_repeats(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[s:s + length] for s in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(rng):
    base, passage = [sentence(rng, rng.randrange(10, 120)) for _ in range(6)], sentence(rng, 14)
    rows = []
    for i in range(40):
        text, kind = rng.choice(base), rng.random()
        if kind < 0.3:
            words = text.split(" ")
            words[rng.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        elif kind < 0.5:
            text = f"{sentence(rng, 40)} {passage} {sentence(rng, 30)}"
        elif kind < 0.6:
            text = sentence(rng, 20) + text[rng.randrange(len(text) // 2):]
        rows.append((i, text))
    return rows + [
        (100, None), (101, ""), (102, "x" * 300), (103, "ab" * 200), (104, sentence(rng, 90) + passage + passage),
        (None, base[0]), (None, base[0]), (5, rows[5][1]), (106, "x" * 61), (107, "x" * 59)]


def test_repeats_equal_brute_force(docs):
    rows = passages(random.Random(4))
    got = suffix_dedup.remove_repeats(docs(rows), length=60, widths=(21, 3, 1))
    found = sorted([tuple(r)[:5] for r in got.collect()], key=repr)
    assert found == without_repeats(rows, 60)


def test_repeats_of_production_length(docs):
    rng = random.Random(5)
    shared = sentence(rng, 100)
    rows = [(1, sentence(rng, 50) + shared), (2, shared + sentence(rng, 50)), (3, sentence(rng, 300)), (4, shared.encode()[:399].decode(errors="ignore"))]
    found = {r["id"]: r for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    assert found[1]["n_removed"] >= len(shared.encode()) and found[3]["n_removed"] == found[4]["n_removed"] == 0
    assert sorted(tuple(r)[:5] for r in found.values()) == without_repeats(rows, 400)


@pytest.mark.parametrize("size, repeat", [(300, False), (399, False), (400, True), (500, True)])
def test_passages_below_and_above_the_length(docs, size, repeat):
    rng = random.Random(size)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(size))
    rows = [(i, f"{sentence(rng, 60)}{chr(65 + i)}{passage}{chr(75 + i)}{sentence(rng, 60)}") for i in range(4)]
    rows.append((9, sentence(rng, 200)))
    found = {r["id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    assert found == {i: size if repeat and i < 9 else 0 for i, _ in rows}


def test_no_rows(docs):
    empty = docs([(1, "x")]).limit(0)
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.drop_copies(empty).collect() == []
    assert ngram_join.near_components(empty).collect() == []


def test_anchors_do_not_depend_on_where_texts_are_cut():
    rng = random.Random(6)
    text = sentence(rng, 900).encode() + b"z" * 700
    whole = [np.stack([a.place, a.lo, a.hi]) for a in repeats.anchors([text], 100)]
    cut = [np.stack([a.place, a.lo, a.hi]) for a in repeats.anchors([text], 100, chunk=500)]
    assert len(cut) > 5 and np.array_equal(np.concatenate(whole, 1), np.concatenate(cut, 1))
    owned = sum(int((a.hi - a.lo + 1).sum()) for a in repeats.anchors([text], 100))
    assert owned == len(text) - 99


@pytest.mark.parametrize("widths", [(21, 3), (20, 3, 1), (900, 1)])
def test_unusable_widths(docs, widths):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs([(1, "x")]), widths=widths)


# --- exact copies --------------------------------------------------------------------------------

def test_exact_copies(docs):
    rows = [(3, "a  b"), (1, "a b"), (2, "a\t\nb"), (7, None), (6, ""), (None, "a b"), (9, " a b"), (3, "a  b"), (4, "A b")]
    for fan_in in (2, 16):
        found = exact_dedup.exact_duplicates(docs(rows, 5), fan_in=fan_in).collect()
        by_text = collections.defaultdict(list)
        for r in found:
            by_text[bytes(r["digest"])].append(r)
        assert sorted((sorted(str(r["id"]) for r in g), g[0]["keep_id"], g[0]["group_size"]) for g in by_text.values()) == [
            (["1", "2", "3", "3", "None"], 1, 5), (["4"], 4, 1), (["6", "7"], 6, 2), (["9"], 9, 1)]
        assert all(sum(r["kept"] for r in g) == 1 for g in by_text.values())
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(docs(rows), fan_in=1)


def test_dropping_copies_keeps_one_row_and_all_columns(docs):
    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (None, "q"), (None, "q"), (5, None)]
    df = docs(rows)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "a b"), ("5", None), ("None", "q")]


def test_a_text_of_many_copies_is_one_row_a_run(spark, docs):
    df = docs([(i, "same") for i in range(400)] + [(i, f"t{i}") for i in range(400, 500)], 8)
    found = exact_dedup.exact_duplicates(df).filter("group_size = 400")
    assert found.count() == 400 and found.filter("kept").first()["id"] == 0


# --- near copies ---------------------------------------------------------------------------------

def word_set(text, words=4):
    found = WORDS.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def groups(rows, percent=85, words=4):
    sets = [word_set(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    members = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        members[root(i)].append(key)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted([(rows[i][0], len(sets[i]), first[root(i)]) for i in range(len(rows))], key=repr)


def near_rows(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))] for _ in range(8)]
    rows = []
    for i in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words = words[:max(3, int(len(words) * rng.uniform(0.8, 1)))]
        rows.append((i, ("  " if rng.random() < 0.1 else " ").join(words)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "a b"), (904, "A  b"), (None, "a b"), (None, "zz"),
                   (3, rows[3][1]), (3, rows[9][1]), (905, "a")]


def test_near_components_equal_brute_force(docs):
    rows = near_rows(random.Random(7))
    got = ngram_join.near_components(docs(rows))
    assert sorted([(r["id"], r["n"], r["component_id"]) for r in got.collect()], key=repr) == groups(rows)
    words = got.filter("n > 0")
    assert words.filter("kept").count() == words.select("component_id", "n").filter("kept").count()


def test_one_document_of_each_group_stays(docs):
    rows = near_rows(random.Random(8))
    df = docs(rows)
    kept = ngram_join.drop_near_copies(df, words=4, percent=85)
    assert kept.columns == df.columns
    want = {c for _, n, c in groups(rows) if n}
    found = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in found if i not in (900, 901, 902)]) == len(want) and {900, 901, 902} <= set(found)


def test_shingles_of_short_and_empty_texts():
    found, begins = shingle_sets([b"", b"A b", b"a  B", b"a b c d", b"a b c d a b c d a", b" \t"])
    sets = [set(found[begins[i]:begins[i + 1]].tolist()) for i in range(6)]
    assert [len(s) for s in sets] == [0, 1, 1, 1, 4, 0] and sets[1] == sets[2] and sets[3] < sets[4]


@pytest.mark.parametrize("words", [1, 4, 9])
@pytest.mark.parametrize("texts", [
    [b"abc"], [b"one two"], [b"a", b"b"], [b"Z" * 300_000], [b"", b"a b c", b" "], [b"a b c d e"], [b"a b c d", b"e"]])
def test_shingles_of_fewer_words_than_one_shingle_has(texts, words):
    found, begins = shingle_sets(texts, words)
    assert np.diff(begins).tolist() == [len(word_set(t.decode(), words)) for t in texts] and len(found) == begins[-1]


def test_near_components_of_few_words(docs):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (None, "one two"), (5, "Z" * 300_000), (6, "a")]
    for parts in (1, 7):
        found = ngram_join.near_components(docs(rows, parts)).collect()
        assert sorted([(r["id"], r["n"], r["component_id"]) for r in found], key=repr) == sorted(
            [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 1, 3), (5, 1, 5), (6, 1, 6)], key=repr)


def test_executors_start_no_worker_for_empty_tables(docs, monkeypatch):
    found = ngram_join.near_components(df := docs(near_rows(random.Random(3)))).collect()

    def refuse(*_, **__):
        raise AssertionError("a table made from a Python list")

    monkeypatch.setattr(type(df.sparkSession), "createDataFrame", refuse)
    assert collections.Counter(ngram_join.near_components(df).collect()) == collections.Counter(found)


def test_cutting_takes_little_more_memory_than_the_texts():
    rng = random.Random(4)
    texts = pa.array([sentence(rng, 400).encode() for _ in range(1000)])
    tracemalloc.start()
    for _, chunk in ngram_join._chunks(texts):
        shingle_sets(chunk, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 2_000_000 and peak < 24_000_000


def test_a_path_is_walked_from_where_the_last_one_left_it():
    own = np.arange(0, 200, 2)
    walk = ngram_join._Walk(own, 85)
    rng = random.Random(9)
    paths = []
    for _ in range(300):
        one = set(rng.sample(list(own), rng.randrange(80, 101))) | {rng.randrange(1, 200, 2) for _ in range(rng.randrange(20))}
        paths.append(np.array(sorted(one)))
    for path in sorted(paths, key=lambda p: p.tolist()):
        both = len(set(path) & set(own))
        assert walk.linked(path) == (100 * both >= 85 * (len(path) + len(own) - both))


def test_subtrees_without_a_link_are_left(monkeypatch):
    rng = random.Random(11)
    visits, linked = [], ngram_join._Walk.linked
    monkeypatch.setattr(ngram_join._Walk, "linked", lambda self, path: visits.append(1) or linked(self, path))
    for k in range(200):
        own = np.array(sorted(rng.sample(range(200), rng.randrange(1, 60))))
        starts = [rng.sample(range(120), 30) for _ in range(3)] + [list(own[:rng.randrange(len(own) + 1)])]
        tree = sorted((np.array(sorted({*rng.choice(starts), *rng.sample(range(120, 200), rng.randrange(1, 6))}
                                       if rng.random() < 0.7 else set(own) ^ {rng.randrange(200)} or {1}))
                       for _ in range(40)), key=lambda p: p.tolist())
        want = [i for i, p in enumerate(tree)
                if 100 * len(both := set(p) & set(own)) >= 85 * (len(p) + len(own) - len(both))]
        common = ngram_join.common_beginnings(tree)
        assert ngram_join.first_link(own, tree, common, 85) == (want[0] if want else -1)
        walk = ngram_join._Walk(own, 85)
        assert [i for i, p in enumerate(tree) if walk.linked(p)] == want
    visits.clear()
    tree = [np.array([*range(30), 100 + i]) for i in range(256)]
    assert ngram_join.first_link(np.arange(50, 82), tree, ngram_join.common_beginnings(tree), 85) == -1
    assert len(visits) == 1


def test_documents_without_a_partner_in_reach_are_left_out(spark):
    rng = random.Random(3)
    sizes = {u: rng.choice([rng.randint(1, 60), rng.randint(150, 900), 400, 401]) for u in range(150)}
    held = {u: {s for s in range(12) if rng.random() < 0.4} for u in sizes}
    rows = spark.createDataFrame(
        [(s, u, sizes[u]) for u in sizes for s in held[u]], "shingle long, u long, n long")
    able = {r["u"] for r in ngram_join._able_among(rows, 85).collect()}

    def shared_needed(a, b):
        return max(1, -(-85 * (a + b) // 185) - -(-85 * max(a, b) // 100) + 1)

    for u in sizes:
        for v in sizes:
            if u < v and 100 * min(sizes[u], sizes[v]) >= 85 * max(sizes[u], sizes[v]):
                if len(held[u] & held[v]) >= shared_needed(sizes[u], sizes[v]):
                    assert {u, v} <= able
    # One shingle of many sizes, none of which is in reach of another one, links nobody.
    apart = spark.createDataFrame([(1, i, int(100 * 1.2 ** i)) for i in range(30)], "shingle long, u long, n long")
    assert ngram_join._able_among(apart, 85).collect() == []
    # Two of one size are partners by one shingle only if they are small.
    twins = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (2, 2, 500), (2, 3, 500)], "shingle long, u long, n long")
    assert sorted(r["u"] for r in ngram_join._able_among(twins, 85).collect()) == [0, 1]


def test_components(spark):
    rng = random.Random(10)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 300), (300, 200), (500, 400), (400, 400)]
    rng.shuffle(links)
    found = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {300: 100, 200: 100, 500: 400}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
