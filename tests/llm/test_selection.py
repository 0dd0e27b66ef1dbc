"""Toxicity, quality rules and mixing."""

import collections
import math
import random
import zlib

import pyarrow as pa
import pytest

from drayage.llm import mixing, quality_rules, toxicity

# --- toxicity ------------------------------------------------------------------------------------

PLAIN = "the a on with and that it was for by here there river stone house walk light".split()


def labelled(rng, n=600):
    """Texts whose label hangs on insults; a group is named more often in the toxic ones."""
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grobian", "grobians", "fool"])
        if rng.random() < (0.8 if toxic else 0.1):
            words[rng.randrange(30)] = "muslims"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = labelled(random.Random(1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return rows, toxicity.train(docs, labels), docs, labels


def score(model, text):
    return model.score(toxicity.Features(set(model.weights)).of(text))


def test_learns_the_words_and_not_the_group(trained):
    rows, model, _, _ = trained
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((score(model, t) >= 0.5) == bool(y) for _, t, y in held) >= 0.97 * len(held)
    neutral = "the house here was for muslims and it was light"
    assert score(model, neutral) < 0.5
    assert abs(score(model, neutral) - score(model, neutral.replace("muslims", "christians"))) < 0.1


def test_without_the_penalty_the_group_carries_weight(trained):
    rows, _, _, _ = trained
    features = toxicity.Features()
    to = toxicity.swaps()
    found = [features.of(t) for _, t, _ in rows]
    other = [features.of(toxicity.swapped(t, to) or t) for _, t, _ in rows]
    chosen = sorted(set(toxicity.word_features("muslims")) | set(toxicity.word_features("fool")))
    within = [[sorted(s & set(chosen)) for s in x] for x in (
        found, [b - a for a, b in zip(found, other, strict=True)], [a - b for a, b in zip(found, other, strict=True)])]
    free = toxicity.fit([r[2] for r in rows], *within, chosen, counterfactual=0.0)
    held = toxicity.fit([r[2] for r in rows], *within, chosen, counterfactual=10.0)
    weight = lambda m: sum(m.weights[f] for f in toxicity.word_features("muslims"))
    assert weight(free) > 1.0 and abs(weight(held)) < 0.2


def test_scoring_any_text(spark, trained):
    _, model, _, _ = trained
    rows = [(1, None, 0.1), (2, "", 0.2), (None, "you fool", 0.3), (1, "Fool!" + " stone" * 50_000, 0.4)]
    df = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string, score_ double"), model)
    got = {r["score_"]: r["score"] for r in df.collect()}
    assert got[0.1] == got[0.2] < 0.5 < got[0.4] and 0.5 < got[0.3] <= 1.0
    assert toxicity.scored(df.limit(0).drop("score"), model).collect() == []


def test_texts_are_scored_where_they_are(trained):
    _, model, _, _ = trained
    (got,) = toxicity.scorer(model).func(iter([pa.array(["you fool", None, ""])]))
    assert got.to_pylist() == [score(model, t) for t in ("you fool", "", "")]


def test_odd_labels(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(i, 0) for i in range(20)], 0.0), ([(i, 1) for i in range(20)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(
            [*labels, (99, 1), (None, 1), (3, 7), (4, None)], "doc_id long, toxic int"))
        assert math.isclose(model.score(set()), share, abs_tol=1e-6)


def test_held_out_is_a_hash_of_the_id(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", toxicity.held_out(rows["doc_id"])).collect()}
    assert got.pop(None) is True
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


# --- quality rules -------------------------------------------------------------------------------

def counted(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked))


def test_counts_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c a b c", "é é é é", "x\n\nx\n \nx", "a#*$%&|<> b c", "one two"]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\t", "\x0b", "日"]) for _ in range(rng.randrange(60))))
    for t in texts:
        assert quality_rules.text_counts(t)[:5] == counted(t), repr(t)


def test_exact_bound():
    # With no hit the bound p solves (1 - p)^n = error.
    for n, error in ((10, 0.05), (500, 1e-4)):
        assert math.isclose(quality_rules.upper_bound(0, n, error), 1 - error ** (1 / n), rel_tol=1e-6)
    p = quality_rules.upper_bound(3, 50, 0.05)
    tail = sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4))
    assert math.isclose(tail, 0.05, rel_tol=1e-6)
    assert quality_rules.upper_bound(0, 0, 0.1) == quality_rules.upper_bound(5, 5, 0.1) == 1.0


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
        good = i % 5 != 0
        if not good:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "x"))
        labels.append((i, int(good)))
    rows += [(5000, None, "en", "x"), (5001, "short", "en", "x"), (5001, "short", "zz", "x"),
             (None, "a b c " * 40, "en", "x"), (5002, " ".join(f"v{k}%%%" for k in range(60)), "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    return quality_rules.judged(docs, spark.createDataFrame(
        [*labels, (1, 9), (77777, 0)], "doc_id long, quality int")), labels


def test_rules_reject_bad_and_keep_good(rated):
    got, labels = rated
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r["id"]].append(r)
    assert all(found[i][0]["kept"] == bool(good) for i, good in labels)
    assert not found[5000][0]["kept"] and found[5000][0]["base_failed"] and len(found[5001]) == 2
    assert found[None][0]["base_failed"] and found[5002][0]["kept"]  # a stratum without labels rejects nothing


def test_rules_together_stay_within_the_loss(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
        bad = i % 4 == 0
        # Good documents, 3% each of different ones, and bad ones look the same to one rule each.
        kind = i // 4 % 2 if bad else rng.randrange(33)
        if kind == 0:
            words = [w + "%%%" for w in words]
        if kind == 1:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    good = dict(labels)
    lost = [r["broken"] for r in got.collect() if good[r["id"]] and not r["kept"]]
    assert 0 < len(lost) <= 0.05 * sum(good.values())
    counts = quality_rules.with_counts(docs.drop("lang"), "text", {c: c for c in quality_rules._COUNTS})
    found = quality_rules.controlled_cutoffs(counts.selectExpr(
        "'en' AS stratum", "cast(doc_id % 4 <> 0 AS int) AS good", "*")).collect()
    assert len(found) == 1 and found[0]["bound"] <= 0.05


def test_provable_hits_are_those_within_the_bound():
    for n, error in ((40, 0.05), (300, 1e-3), (900, 1e-6)):
        want = [h for h in range(n) if quality_rules.upper_bound(h, n, error) <= 0.05]
        assert quality_rules.provable_hits(n, 0.05, error) == max(want, default=-1)


def test_repeated_labels_and_texts_prove_nothing_more(spark):
    rng = random.Random(6)

    def kept(rows, labels):
        docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
        return {r["id"]: r["kept"] for r in quality_rules.judged(
            docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def text(mark=""):
        return " ".join(f"w{rng.randrange(10_000)}{mark}" for _ in range(60))

    good, bad = [(i, text()) for i in range(60)], [(100 + i, text("%%%")) for i in range(60)]
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    assert all(kept(good + bad, labels).values())  # 60 good ones are too few
    assert all(kept(good + bad, labels * 20).values())
    copies = [(1000 * k + i, t) for k in range(1, 20) for i, t in good]
    assert all(kept(good + bad + copies, labels + [(i, 1) for i, _ in copies]).values())
    # As many different ones are enough; then a bad text that is labelled good as well counts as good.
    more = [(2000 + i, text()) for i in range(1200)]
    labels += [(i, 1) for i, _ in more]
    found = kept(good + bad + more, labels)
    assert all(found[i] for i, _ in good + more) and not any(found[i] for i, _ in bad)
    assert all(kept(good + bad + more, labels + [(i, 1) for i, _ in bad]).values())


def test_rules_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "%%% " * 60, "en"), (2, "x", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["id"]: r["kept"] for r in quality_rules.judged(docs, none).collect()} == {1: False, 2: False}
    assert quality_rules.judged(docs.limit(0), none).collect() == []


# --- mixing --------------------------------------------------------------------------------------

def targets(sizes):
    """Shares the total in turns until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [(5, 2, 1)[k % 3] for k in range(len(order))], strict=True))
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        level = left / free if free else 0
        new = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= new


def test_mix(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        source = rng.choice(["b", "a", "a", "a", "tiny" if i % 50 == 0 else "c", None, "é"])
        rows.append((i, " ".join("w" for _ in range(rng.randrange(1, 200))), source, i, 0.5))
    rows += [(None, "x y", "a", 1, 0.5), (3, None, "a", 1, 0.5), (3, "", "empty", 1, 0.5), (7, rows[7][1], rows[7][2], 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, rate double").repartition(4)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(200, 0.03 * want[s]) for s in want)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed_sizes(docs.repartition(7)).collect()), key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_sizes(docs).collect() == [] and mixing.mix(docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r["id"], r["taken"], r["target"]) for r in mixing.mixed_sizes(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
