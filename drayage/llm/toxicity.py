"""Toxicity: a linear classifier with a counterfactual penalty.

Features are the distinct words of a text (letters only, lower case) and their beginnings of three
to six letters, which carry inflected forms. Learning takes at most ``max_rows`` labelled rows, those
with the smallest hash of their id. Features are counted over these rows by label, the ``max_features``
with the strongest association (chi-square at least ``min_chi2``) are kept, and a logistic
regression is fitted to them.

Counterfactuals: in every labelled text that mentions an identity term, the terms are swapped for
others of their group. The squared change of the score under the swap is added to the loss, so a
mention as such cannot carry weight: what the label owes to the words around it is learned, what it
owes to the name of a group is not. The counterfactual rows need no labels of their own.

Scoring is a map over whole texts. The model is ``max_features`` numbers at most and travels with
the tasks.

Defined cases: a null text scores as an empty one, by the intercept alone; labels other than 0 and
1, and labels without a document, are ignored; an id labelled both ways counts as 1; without rows
of both labels the score is the share of 1 among them, 0 without any; an empty table gives an empty
result; columns of any name pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.common import SMALL_BATCHES, settings, stage, text_or_empty

MAX_ROWS = 20_000
MAX_FEATURES = 4_096
MIN_CHI2 = 12.0
MIN_ROWS = 3
L2 = 1e-4
# Weight of the squared score change under a swap.
COUNTERFACTUAL = 1.0
PREFIXES = range(3, 7)
CACHE = 200_000

#: Terms that name groups; each is swapped for the next of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf"), ("elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    return (zlib.crc32(b"w" + word.encode()),
            *(zlib.crc32(b"p" + word[:n].encode()) for n in PREFIXES if len(word) >= n))


class Features:
    """Features of a text; what single tokens give is remembered, up to ``CACHE`` tokens."""

    def __init__(self, wanted: set[int] | None = None) -> None:
        self.wanted, self.seen = wanted, {}

    def of_token(self, token: str) -> tuple[int, ...]:
        found = self.seen.get(token)
        if found is None:
            found = tuple(f for w in _LETTERS.findall(token) for f in word_features(w)
                          if self.wanted is None or f in self.wanted)
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[token] = found
        return found

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for token in set(text.lower().split()):
            if found := self.of_token(token):
                out.update(found)
        return out


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]), strict=True)}


def swapped(text: str, to: dict[str, str]) -> str | None:
    """The text with its identity terms swapped; None if it has none."""
    low, n = text.lower(), 0

    def other(m: re.Match) -> str:
        nonlocal n
        n += m[0] in to
        return to.get(m[0], m[0])

    out = _LETTERS.sub(other, low)
    return out if n else None


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(found))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, label) of at most ``max_rows`` rows that are not held out, by smallest hash of the id."""
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(
        "label in (0, 1) and id is not null").filter(~held_out(F.col("id")))
    one = clean.groupBy("id").agg(F.max("label").alias("label"))
    return stage(one.orderBy(F.xxhash64("id"), "id").limit(max_rows), "toxicity-sample")


def training_rows(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Label, features, and the features gained and lost under a swap. ``sample`` is bounded by
    ``max_rows`` and broadcast, so texts are not shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(
        F.broadcast(sample), "id").select("label", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, to = Features(), swaps()
        for batch in batches:
            found, gained, lost = [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                own = features.of(text)
                other = swapped(text, to)
                changed = own if other is None else features.of(other)
                found.append(sorted(own))
                gained.append(sorted(changed - own))
                lost.append(sorted(own - changed))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), *[pa.array(x, pa.list_(pa.int64())) for x in (found, gained, lost)]],
                names=["label", "found", "gained", "lost"])

    with settings(docs.sparkSession, SMALL_BATCHES):
        return stage(rows.mapInArrow(
            build, "label int, found array<bigint>, gained array<bigint>, lost array<bigint>"), "toxicity-rows")


def strong_features(rows: DataFrame, max_features: int = MAX_FEATURES, min_chi2: float = MIN_CHI2) -> list[int]:
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not toxic or toxic == n:
        return []
    counts = rows.select("label", F.explode("found").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).filter(F.col("n") >= MIN_ROWS)
    a, b = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    c, d = F.lit(float(toxic)) - a, F.lit(float(n - toxic)) - b
    spread = (a + b) * (c + d) * F.lit(float(toxic) * float(n - toxic))
    chi2 = F.when(spread > 0, F.lit(float(n)) * F.pow(a * d - b * c, F.lit(2.0)) / spread).otherwise(0.0)
    best = counts.withColumn("chi2", chi2).filter(F.col("chi2") >= min_chi2)
    return [r["f"] for r in best.orderBy(F.desc("chi2"), "f").limit(max_features).collect()]


def _sparse(lists: list[list[int]], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    row = [i for i, x in enumerate(lists) for _ in x]
    col = [place[f] for x in lists for f in x]
    return np.array(row, np.int64), np.array(col, np.int64)


def fit(labels: list[int], found: list[list[int]], gained: list[list[int]], lost: list[list[int]],
        features: list[int], l2: float = L2, counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> Model:
    """Logistic regression by gradient steps with momentum on all rows, the swap penalty included."""
    y = np.array(labels, np.float64)
    n = len(y)
    if n == 0 or y.min() == y.max() or not features:
        share = float(y.mean()) if n else 0.0
        return Model(math.log((share + 1e-9) / (1 - share + 1e-9)))
    place = {f: i for i, f in enumerate(features)}
    k = len(features)
    row, col = _sparse(found, place)
    gain, drop = _sparse(gained, place), _sparse(lost, place)
    pairs = max(1, sum(1 for g, x in zip(gained, lost, strict=True) if g or x))
    w, b = np.zeros(k), math.log(y.mean() / (1 - y.mean()))
    mw, vw, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], n)
        off = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        grad = np.bincount(col, off[row], k) + l2 * w
        change = np.bincount(gain[0], w[gain[1]], n) - np.bincount(drop[0], w[drop[1]], n)
        pull = 2 * counterfactual * change / pairs
        grad += np.bincount(gain[1], pull[gain[0]], k) - np.bincount(drop[1], pull[drop[0]], k)
        gb = off.sum()
        mw, vw = 0.9 * mw + 0.1 * grad, 0.999 * vw + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 + t / 200)
        w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return Model(float(b), {f: float(w[i]) for f, i in place.items()})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    sample = training_sample(labels, id_col, label_col, max_rows)
    rows = training_rows(docs, sample, id_col, text_col)
    features = strong_features(rows, max_features)
    kept = F.array(*[F.lit(f) for f in features]) if features else F.array().cast("array<bigint>")
    # At most ``max_rows`` rows of the few strong features each has.
    small = rows.select("label", *[F.array_intersect(c, kept).alias(c) for c in ("found", "gained", "lost")]).collect()
    small.sort(key=lambda r: (r["label"], r["found"], r["gained"], r["lost"]))
    return fit([r["label"] for r in small], *[[r[c] for r in small] for c in ("found", "gained", "lost")], features)


def scorer(model: Model) -> Callable[[Column], Column]:
    # Not in pandas, which would hold all texts of a batch a second time.
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(set(model.weights))
        for texts in batches:
            yield pa.array([model.score(features.of(t.as_py() or "")) for t in texts], pa.float64())

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    return docs.withColumn(score_col, scorer(model)(text_or_empty(text_col)))
