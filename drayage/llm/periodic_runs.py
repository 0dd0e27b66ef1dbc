"""Stretches of words that repeat with a period, and texts without their repetitions.

The words of a text are numbered, and names of all stretches of 1, 2, 4, ... words are made by
sorting pairs of names (a pair is the name of the first and of the second half), until every suffix
has a name of its own: its place in the suffix array (ISA). Common prefixes of neighbouring suffixes
(LCP) follow from the names by halving. An LCP interval of depth d holds the suffixes that share
their first d words; its bounds are the nearest smaller LCP values on both sides, so no tree is
built. Its children are cut off by the places where the LCP is d.

Branching test: for every suffix i of the children, but for the largest child of each interval, it
is looked up whether ISA[i + d] or ISA[i - d] lies in the interval and in another child. If so, d
words are followed by themselves, and the next word differs: a square that cannot be rotated to the
right. Squares are rotated to the left as far as the names allow, which gives whole runs; runs of
the same words found for a multiple of their period are merged into the one of smallest period.

A text in which no four words occur twice has no run of six words, and is done with after two
rounds of names. All steps are numpy operations over some hundred thousand words at a time; a text
is never cut. A text needs some 300 bytes of memory a word while it is worked on.

Defined cases: a null text counts as empty; texts of fewer words than ``min_length`` have no runs;
ids are carried only, so null and repeated ids are rows of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm.common import text_or_empty

MIN_LENGTH, MIN_EXPONENT = 6, 4
# Bytes of text whose words are sorted together, and suffixes tested together.
CHUNK, TESTED = 2 << 20, 2_000_000
# A run of MIN_LENGTH words and MIN_EXPONENT periods holds a stretch of 2**SHORT words twice.
SHORT = 2


@dataclass
class Runs:
    """Arrays with a value for each run, in order of text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _named(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of pairs, in their order, and how many there are."""
    seen, names = np.unique(first * (len(first) + 1) + second, return_inverse=True)
    return names.astype(np.int64), len(seen)


def _next_names(names: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Names of stretches of twice the width. Beyond the last word is 0, which sorts first."""
    second = np.zeros(len(names), np.int64)
    second[:-width or None] = names[width:] + 1
    return _named(names, second)


def _levels(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from every place; those of the last are unique.

    Stretches that leave their text are told apart by where they leave it, since the words of
    different texts have different names.
    """
    names, n = _named(text, words)
    levels, width = [names], 1
    while n < len(names):
        names, n = _next_names(names, width)
        width *= 2
        levels.append(names)
    return levels


def _common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in the order; -1 before the first and after the last."""
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        names = np.append(levels[k], -1)
        same = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(order))
        same &= names[np.minimum(a, len(order))] == names[np.minimum(b, len(order))]
        step = np.where(same, 1 << k, 0)
        a, b, length = a + step, b + step, length + step
    return np.concatenate([[-1], length, [-1]])


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places of the LCP array, the nearest places on both sides with a smaller value."""
    least = [lcp.astype(np.int32)]
    while 2 << (len(least) - 1) <= len(lcp):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    value = lcp[at]
    left, right = at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        row, step = least[k], 1 << k
        further = left - step
        left = np.where((further >= 0) & (row[np.clip(further, 0, len(row) - 1)] >= value), further, left)
        inside = right + step <= len(lcp)
        right = np.where(inside & (row[np.clip(right, 0, len(row) - 1)] >= value), right + step, right)
    return left - 1, right


def _smaller_children(lcp: np.ndarray, deepest: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, interval from, to, child from, to) of all children but the largest of each interval.

    ``deepest`` says for every place of the LCP array which depths matter there.
    """
    at = np.flatnonzero((lcp >= 1) & (lcp <= deepest))
    left, right = _bounds(lcp, at)
    order = np.lexsort((at, lcp[at], left))
    at, left, right = at[order], left[order], right[order]
    depth = lcp[at]
    if not len(at):
        return (at,) * 5
    new = np.concatenate([[True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])])
    which = np.cumsum(new) - 1  # the interval of each cut
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    # An interval with k cuts has k + 1 children.
    place = np.arange(len(at)) + which
    lo, hi = np.empty(len(at) + len(first), np.int64), np.empty(len(at) + len(first), np.int64)
    lo[place + 1], hi[place] = at, at
    lo[place[first]], hi[place[last] + 1] = left[first], right[first]
    of = np.repeat(np.arange(len(first)), last - first + 2)
    size = hi - lo
    begins = place[first]
    largest = np.flatnonzero(size == np.maximum.reduceat(size, begins)[of])
    small = np.ones(len(size), bool)
    small[largest[np.unique(of[largest], return_index=True)[1]]] = False
    of = of[small]
    return depth[first][of], left[first][of], right[first][of], lo[small], hi[small]


def _squares(order: np.ndarray, place: np.ndarray, children: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares whose next word differs from the one a period before."""
    depth, left, right, lo, hi = children
    total = np.cumsum(hi - lo)
    starts, periods, done = [], [], 0
    while done < len(depth):
        before = total[done - 1] if done else 0
        until = max(done + 1, int(np.searchsorted(total, before + TESTED, "right")))
        part = slice(done, until)
        size = (hi - lo)[part]
        begin = np.cumsum(size) - size
        one = np.repeat(np.arange(len(size)), size)
        suffix = order[lo[part][one] + np.arange(len(one)) - begin[one]]
        d = depth[part][one]
        for step in (1, -1):
            other = suffix + step * d
            inside = (other >= 0) & (other < len(order))
            found = place[np.clip(other, 0, len(order) - 1)]
            inside &= (found >= left[part][one]) & (found < right[part][one])
            inside &= (found < lo[part][one]) | (found >= hi[part][one])
            starts.append(np.minimum(suffix, other)[inside])
            periods.append(d[inside])
        done = until
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def word_runs(words: np.ndarray, text: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> Runs:
    """The runs of many texts. ``words`` are numbers of words, ``text`` the number of each one's text,
    which never falls."""
    if not len(words):
        return Runs(*(np.zeros(0, np.int64),) * 4)
    levels = _levels(words, text)
    place = levels[-1]
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))
    begins = np.searchsorted(text, text)  # where each word's text begins
    sizes = np.searchsorted(text, text, "right") - begins
    lcp = _common_prefixes(levels, order)
    deepest = np.concatenate([(sizes // min_exponent)[order], [0]])
    start, period = _squares(order, place, _smaller_children(lcp, deepest))
    end, first = start + 2 * period, begins[start]
    for k in range(len(levels) - 2, -1, -1):
        further = start - (1 << k)
        near = np.maximum(further, 0)
        same = (further >= first) & (levels[k][near] == levels[k][near + period])
        start = np.where(same, further, start)
    long = end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    start, end, period = start[by], end[by], period[by]
    return Runs(text[start], start - begins[start], end - start, period)


def repeating(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The texts in which some stretch of 2**SHORT words occurs twice."""
    names, n = _named(text, words)
    for k in range(SHORT):
        names, n = _next_names(names, 1 << k)
    return np.unique(text[np.bincount(names, minlength=n)[names] > 1])


def text_runs(split: list[list[bytes]], min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> Runs:
    """The runs of texts that are given as their words."""
    sizes = np.array([len(s) for s in split], np.int64)
    if not sizes.sum():
        return word_runs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    flat = pa.array([w for s in split for w in s], pa.large_binary())
    words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(split)), sizes)
    # Only then does every run hold a repeated stretch of that many words.
    if min_exponent >= 2 and min_length - max(1, min_length // min_exponent) >= 1 << SHORT:
        some = np.zeros(len(split), bool)
        some[repeating(words, text)] = True
        words, text = words[some[text]], text[some[text]]
    return word_runs(words, text, min_length, min_exponent)


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        held.append((text or b"").split())
        size += len(text or b"")
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row: id, n_words, runs (start, length and period in words, by start, then period) and
    ``collapsed``, the words outside the repetitions joined by single spaces."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        rows.schema["id"], T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.BinaryType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for split in _chunks(batch.column("text").to_pylist()):
                found = text_runs(split, min_length, min_exponent)
                offsets = np.searchsorted(found.text, np.arange(len(split) + 1)).astype(np.int32)
                collapsed = []
                for i, words in enumerate(split):
                    own = slice(offsets[i], offsets[i + 1])
                    if offsets[i] < offsets[i + 1]:
                        words = compress(words, kept_words(
                            len(words), found.start[own], found.length[own], found.period[own]))
                    collapsed.append(b" ".join(words))
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(c) for c in (found.start, found.length, found.period)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, len(split)), pa.array([len(s) for s in split], pa.int64()), runs,
                     pa.array(collapsed, pa.binary())], names=["id", "n_words", "runs", "collapsed"])
                done += len(split)

    return rows.mapInArrow(find, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
