"""Sparse suffix tuples of texts: where a long repeat must show itself.

Every window of ``length`` bytes is owned by one of its own positions, the leftmost one whose
``SEED`` bytes have the smallest hash. Equal windows are owned at the same place, so a repeat can
only be between windows whose owners agree, and neighbouring windows mostly share their owner: of a
text, one position in about 190 owns windows. Such an anchor is a suffix tuple: where it is, which
windows it owns (as distances back from it), and hashes of bytes around it that stand for the names
of its prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEED = 16
# Text handled at a time; longer texts are cut, with as much overlap as an anchor sees.
CHUNK = 1 << 20
_PLACE = 22
_MASK = np.uint64((1 << _PLACE) - 1)
_ODD = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Hashes:
    """Hashes of any stretch of a buffer of bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _power_table(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTES[raw] * up[:len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Anchors:
    """Arrays with a value for each anchor: text, place in it, nearest and farthest window start."""

    text: np.ndarray
    place: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray  # place in the buffer
    hashes: Hashes


def _owners(hashes: Hashes, n: int, length: int) -> np.ndarray:
    """For every start of a window that lies in the buffer, the position that owns it."""
    width = length - SEED + 1
    seeds = np.arange(n - SEED + 1)
    keys = (hashes.of(seeds, seeds + SEED) & ~_MASK) | seeds.astype(np.uint64)
    size = -(-len(keys) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    return (np.minimum(right[:starts], left[width - 1:width - 1 + starts]) & _MASK).astype(np.int64)


def anchors(texts: list[bytes], length: int, chunk: int = CHUNK) -> Iterator[Anchors]:
    """The anchors of all texts, in pieces of bounded size."""
    held: list[tuple[int, int, int, int]] = []  # text, from, to, first place that counts
    size = 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > chunk:
            for at in range(0, len(text), chunk):
                first = max(0, at - length + SEED)
                yield from _of(texts, [(i, first, min(len(text), at + chunk + length), at)], length, at + chunk)
            continue
        if held and size + len(text) > chunk:
            yield from _of(texts, held, length, None)
            held, size = [], 0
        held.append((i, 0, len(text), 0))
        size += len(text)
    if held:
        yield from _of(texts, held, length, None)


def _of(texts: list[bytes], parts: list[tuple[int, int, int, int]], length: int,
        before: int | None) -> Iterator[Anchors]:
    raw = np.frombuffer(b"".join(memoryview(texts[i])[a:b] for i, a, b, _ in parts), np.uint8)
    n = len(raw)
    if n < length:
        return
    sizes = np.array([b - a for _, a, b, _ in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = Hashes(raw)
    owner = _owners(hashes, n, length)
    part = np.repeat(np.arange(len(parts)), sizes)[:len(owner)]
    inside = np.arange(len(owner)) + length <= (begins + sizes)[part]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return
    own, of = owner[starts], part[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    at, which = own[first], of[first]
    offset = np.array([a for _, a, _, _ in parts])[which] - begins[which]
    place = at + offset
    keep = place >= np.array([c for _, _, _, c in parts])[which]
    if before is not None:
        keep &= place < before
    text = np.array([i for i, _, _, _ in parts])[which]
    yield Anchors(text[keep], place[keep], (at - starts[last])[keep], (at - starts[first])[keep], at[keep], hashes)
