"""Sets of word shingles as sorted hashes, for many texts at a time."""

from __future__ import annotations

import numpy as np

from drayage.llm.repeats import Hashes, mixed

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(texts: list[bytes], words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, one after the other, each sorted with its longest shingles first; and
    where each begins.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a text of fewer words
    is one shingle, one without words none.
    """
    raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    begins = np.zeros(len(texts) + 1, np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), begins
    solid = ~_SPACE[raw]
    change = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    start, end = change[0::2], change[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), begins
    word = Hashes(raw).of(start, end)
    text = np.searchsorted(ends_of_texts, start, "right")
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        joined = np.zeros(len(word), np.uint64)
        for k in range(words):
            left = max(0, len(word) - k)  # words that have another one k places on
            part = np.zeros(len(word), np.uint64)
            part[:left] = word[k:k + left]
            # Words of the next text do not count; short texts are hashed as far as they go.
            inside = np.zeros(len(word), bool)
            inside[:left] = text[k:k + left] == text[:left]
            joined += np.where(inside, mixed(part + np.uint64(k)) * _FACTORS[k % 4] + np.uint64(k + 1), np.uint64(0))
    index = np.arange(len(word)) - first[text]
    # The longest come first in the order of the numbers: 8 bits of length, then 55 of the hash.
    last = np.minimum(np.arange(len(word)) + words, first[text + 1]) - 1
    letters = np.concatenate([[0], np.cumsum(end - start)])
    size = np.minimum(letters[last + 1] - letters[:-1], 255).astype(np.uint64)
    joined = (mixed(joined) >> np.uint64(9)) | ((np.uint64(255) - size) << np.uint64(55))
    whole = index < np.maximum(count - words + 1, np.minimum(count, 1))[text]
    joined, text = joined[whole], text[whole]
    order = np.lexsort((joined, text))
    joined, text = joined[order], text[order]
    new = np.ones(len(joined), bool)
    new[1:] = (joined[1:] != joined[:-1]) | (text[1:] != text[:-1])
    joined, text = joined[new], text[new]
    begins[:] = np.searchsorted(text, np.arange(len(texts) + 1))
    return joined, begins


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of sorted sets, the part in which partners must share a shingle."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
