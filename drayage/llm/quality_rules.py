"""Quality rules whose cutoffs are controlled on labelled holdouts.

Each rule is a ratio of a document (higher is worse) and a cutoff. For every stratum a set of cutoffs
is chosen, one for each of some rules. The labelled good documents above each cutoff are counted; their
sum is at least the number that the set rejects, and the exact (Clopper-Pearson) upper bound of that
share of the good documents must stay below ``max_loss``. The confidence is split evenly over strata,
sizes of sets and sets of a size (Bonferroni), so with probability ``confidence`` no stratum loses
more than ``max_loss`` of its good documents to all its rules together. Of the sets that do, the one is
taken that rejects most labelled bad documents, counted by rule, good ones counting ``PRICE`` times
against it, with the laxest of equal cutoffs; a rule without a gain, and a stratum with too few labels to
prove anything, rejects nothing.

Counting is one pass over the documents, in tasks; the labelled part becomes counts per stratum,
rule and candidate before anything else happens, and the cutoffs are found per stratum in tasks.

Defined cases: a null text has no words and all counts 0; a null stratum is a stratum of its own;
labels other than 0 and 1 and labels without a document are ignored; rows that repeat an id are judged
one by one; an empty table gives an empty result, and without labels only the base rules reject.

An exact bound needs independent trials, so a text is one trial of its stratum, however often its id is
labelled, its id is repeated, or other ids have the same text; a text labelled both good and bad counts
as good, which can only make a set of cutoffs harder to prove.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.common import stage

MIN_WORDS = 50
MAX_LOSS = 0.05
CONFIDENCE = 0.95
# What one good document rejected weighs against bad ones.
PRICE = 3
# Candidate cutoffs of every ratio, in steps that double in two parts.
GRID = tuple(round(0.01 * 2 ** (k / 2), 6) for k in range(0, 17))

_SYMBOLS = b"#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
           "n_upper", "n_letters"]
_FIELDS = [pa.field(c, pa.int64()) for c in _COUNTS]
_UPPER, _LETTER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")

#: Rule name and the ratio it looks at. A ratio without a base is 0.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "capitals": ("n_upper", "n_letters"),
}


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    # Bytes that do not continue a character are as many as the characters.
    chars = sum(map(len, words))
    if not raw.isascii():
        chars = len(text) - (len(raw) - chars)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines, seen, repeated = 0, set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return (n, chars, symbols, repeated, repeat_words(words), lines,
            len(_UPPER.findall(text)), len(_LETTER.findall(text)))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    marked = bytearray(n)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            marked[i:i + 3] = b"\x01\x01\x01"
            marked[j:j + 3] = b"\x01\x01\x01"
    return marked.count(1)


def with_counts(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """Adds the counts under the given names; all other columns but the text pass through."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for c in _COUNTS:
        schema = schema.add(names[c], "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t.as_py()) for t in batch.column(text_col)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest] + [pa.array(c, pa.int64()) for c in columns],
                names=rest + [names[c] for c in _COUNTS])

    return docs.mapInArrow(count, schema)


def ratio(rule: str, names: dict[str, str] | None = None) -> Column:
    top, base = ((names or {}).get(c, c) for c in RULES[rule])
    return F.when(F.col(base) > 0, F.col(top) / F.col(base)).otherwise(0.0)


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int = MIN_WORDS) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > 50 * n_words)


def upper_bound(hits: int, n: int, error: float) -> float:
    """Exact upper confidence bound of a share with ``hits`` of ``n``: the p at which so few hits
    have probability ``error``."""
    if n <= 0 or hits >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(hits + 1)]
    low, high = hits / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p >= 1.0:
            break
        tail = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(tail)
        if top + math.log(sum(math.exp(t - top) for t in tail)) > math.log(error):
            low = p
        else:
            high = p
    return high


def provable_hits(n: int, max_loss: float, error: float) -> int:
    """The most hits of ``n`` whose upper bound is within ``max_loss``, -1 if none are."""
    if n <= 0 or max_loss <= 0:
        return -1
    if max_loss >= 1:
        return n
    total, whole = -math.inf, math.lgamma(n + 1)
    for k in range(n):
        term = (whole - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                + k * math.log(max_loss) + (n - k) * math.log1p(-max_loss))
        top = max(total, term)
        total = top + math.log(math.exp(total - top) + math.exp(term - top))
        if total > math.log(error):
            return k - 1
    return n - 1


def best_set(row: dict, limits: list[int]) -> tuple[list[tuple[str, float]], int]:
    """The (rule, cutoff) pairs with the best gain together and the good documents above them, which are
    at most ``limits[k]`` for ``k`` pairs."""
    choices = []
    for rule in RULES:
        # From the laxest on, a stricter cutoff has no fewer good documents above it.
        found = [(0, 0, None)]
        for i in reversed(range(len(GRID))):
            bad, good = int(row[f"{rule}_0_{i}"]), int(row[f"{rule}_1_{i}"])
            if bad - PRICE * good > found[-1][0]:
                found.append((bad - PRICE * good, good, (rule, GRID[i])))
        choices.append(found)
    best, chosen, hits = 0, [], 0
    for one in product(*choices):
        gain = sum(c[0] for c in one)
        if gain > best:
            pairs, good = [c[2] for c in one if c[2]], sum(c[1] for c in one)
            if good <= limits[len(pairs)]:
                best, chosen, hits = gain, pairs, good
    return chosen, hits


def controlled_cutoffs(labelled: DataFrame, max_loss: float = MAX_LOSS,
                       confidence: float = CONFIDENCE) -> DataFrame:
    """From labelled rows (stratum, good, counts): rows of (stratum, rule, cutoff, bound, tests). The
    bound is that of the stratum's whole set."""
    passed = labelled.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    above = [F.sum(F.when((ratio(r) > c) & (F.col("good") == g), 1).otherwise(0)).alias(f"{r}_{g}_{i}")
             for r in RULES for g in (0, 1) for i, c in enumerate(GRID)]
    counts = stage(passed.groupBy("stratum").agg(
        F.sum("good").cast("long").alias("n_good"), *above), "rule-counts")
    strata = max(1, counts.count())
    tests = [strata * len(RULES) * math.comb(len(RULES), k) * len(GRID) ** k for k in range(len(RULES) + 1)]

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                n = int(row["n_good"])
                limits = [provable_hits(n, max_loss, (1.0 - confidence) / t) for t in tests]
                chosen, hits = best_set(row, limits)
                if chosen:
                    t = tests[len(chosen)]
                    bound = upper_bound(hits, n, (1.0 - confidence) / t)
                    out += [(row["stratum"], *pair, bound, t) for pair in chosen]
            yield pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "bound", "tests"])

    return counts.mapInPandas(choose, "stratum string, rule string, cutoff double, bound double, tests long")


def trials(counted: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row of (stratum, good, counts) for each labelled text of a stratum."""
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).filter(
        "good in (0, 1)").groupBy("id").agg(F.max("good").alias("good"))
    return counted.join(good, "id").groupBy("stratum", "digest").agg(
        F.max("good").alias("good"), *[F.first(c).alias(c) for c in _COUNTS])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           stratum_col: str = "lang", label_col: str = "quality", max_loss: float = MAX_LOSS,
           confidence: float = CONFIDENCE) -> DataFrame:
    """For every row: id, stratum, the counts, ``base_failed``, the rules it breaks, ``kept``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                       F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"), text.alias("text"))
    counted = stage(with_counts(rows, "text", {c: c for c in _COUNTS}), "text-counts")
    cutoffs = stage(controlled_cutoffs(trials(counted, labels, id_col, label_col), max_loss, confidence), "rule-cutoffs")
    wide = cutoffs.groupBy(F.col("stratum").alias("of")).agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    found = counted.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = F.filter(
        F.array(*[F.when(ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return found.select("id", "stratum", *_COUNTS, failed.alias("base_failed"), broken.alias("broken"),
                        (~failed & (F.size(broken) == 0)).alias("kept"))


