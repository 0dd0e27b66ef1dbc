"""Best-fit packing after a Martello-Toth reduction.

A packing depends on the lengths of the pieces only, and there are at most ``capacity`` lengths. So
the pieces are counted by length, a plan is made from these counts, and the pieces are dealt out to
the plan by their number among the pieces of their length. The counts and the plan are bounded by
the capacity, whatever the number of documents.

The plan: first the reduction. A set of pieces that contains a length w, and dominates every other
feasible set that contains it, is fixed for good, as often as its pieces last: w alone when nothing
else fits; w with the length that fills the sequence exactly; w with the largest length that fits,
when no two others fit beside w or no such two are longer together. Lengths are looked at from the
longest down. What is left goes to best fit, longest first: always into the open sequence with the
least room that still takes it. Sequences with the same room and the same piece are handled together.

Tokens: texts are cut at single spaces; the ids of such a part do not depend on its neighbours, so
they are looked up and only unseen parts are encoded. Texts with runs of white space or with special
tokens are encoded whole. Where the vocabulary also comes as ranks (a ``.tiktoken`` file beside the
tokenizer's), Latin parts are encoded with these, which gives the same ids in a third of the time;
everything else goes through the tokenizer.

Numbering: a task numbers its pieces by length as it goes; the staged table keeps these numbers, and
counts per task and length become offsets. No length is ever gathered in one task.

Defined cases: a null text is empty and gives one piece, the end token; rows that repeat an id are
packed like any other; a null id is passed on; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drayage.llm.common import SMALL_BATCHES, settings, stage, text_or_empty

CAPACITY = 1024
END_ID = 2
CACHE = 300_000
# Fixed value: the pattern that splits a text before the merges of a byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The first character beyond the Latin blocks.
_BEYOND_LATIN = "\u0250"
_RUNS = re.compile(r"\s\s")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian bytes, four for each id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import tiktoken

            lines = (line.split() for line in ranks.read_bytes().splitlines())
            self.fast = tiktoken.Encoding(
                path, pat_str=SPLIT, special_tokens={},
                mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in lines})
        self.first, self.later = _Known(self.whole), _Known(lambda part: self.whole(f" {part}"))

    def whole(self, text: str) -> bytes:
        if self.fast and (text.isascii() or max(text) < _BEYOND_LATIN) and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if _RUNS.search(text) or text[:1].isspace() or text[-1:].isspace() or any(s in text for s in self.special):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


class _Known(dict):
    """Ids of parts of texts. When there are ``CACHE``, the third that was met first stays: the
    frequent parts are among them."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find = find

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            kept = list(islice(self.items(), CACHE // 3))
            self.clear()
            self.update(kept)
        found = self[part] = self.find(part)
        return found


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first can be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, number): ``number`` counts within part and length."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = rows.select("id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"),
                       ("part", "integer"), ("number", "long")):
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts, end = encoder(tokenizer), [0] * (capacity + 1), array("I", [end_id]).tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            source, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = memoryview(find.ids(text.as_py()) + end)
                for k, (start, length) in enumerate(piece_cuts(len(ids) // 4, capacity)):
                    source.append(i)
                    out.append((k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), part, counts[length]))
                    counts[length] += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(source, pa.int32())),
                 *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "number"])

    with settings(docs.sparkSession, SMALL_BATCHES):
        return stage(rows.mapInArrow(cut, schema), "token-pieces")


@dataclass
class Plan:
    """Ranges of pieces of one length: piece ``first + i`` goes to sequence ``sequence + i``."""

    capacity: int
    sequences: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.rows.append((length, first, n, sequence, offset))
        self.used[length] = first + n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


class _Left:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def others(self, w: int, room: int) -> list[int]:
        """The two smallest lengths beside one piece of ``w`` that fit, singly, into the room."""
        out: list[int] = []
        for length in self.lengths:
            if length > room or len(out) >= 2:
                break
            out += [length] * min(2 - len(out), self.n[length] - (length == w))
        return out

    def largest(self, w: int, room: int) -> int:
        i = bisect.bisect_right(self.lengths, room) - 1
        if i >= 0 and self.lengths[i] == w and self.n[w] < 2:
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def best_two(self, w: int, room: int) -> int:
        """The largest sum of two pieces beside ``w`` within the room, 0 if none."""
        best, free = 0, [(x, self.n[x] - (x == w)) for x in self.lengths if x < room]
        free = [(x, n) for x, n in free if n > 0]
        i, j = 0, len(free) - 1
        while i <= j:
            total = free[i][0] + free[j][0]
            if total > room or (i == j and free[i][1] < 2):
                j -= 1
                continue
            best = max(best, total)
            i += 1
        return best


def reduce(left: _Left, plan: Plan) -> None:
    """Fixes dominating sets, from the longest length down."""
    for w in sorted(left.lengths, reverse=True):
        while left.n.get(w):
            room = plan.capacity - w
            small = left.others(w, room)
            if not small:
                n = left.n[w]
                plan.put(w, n, plan.open(n), 0)
                left.take(w, n)
                continue
            x = left.largest(w, room)
            dominates = x == room or len(small) < 2 or sum(small) > room
            if not dominates and small[0] * 3 > room:
                dominates = x >= left.best_two(w, room)
            if not dominates:
                break
            # Fewer pieces leave no longer two, so what dominates does so while both lengths last.
            n = left.n[w] // 2 if x == w else min(left.n[w], left.n[x])
            base = plan.open(n)
            plan.put(w, n, base, 0)
            left.take(w, n)
            plan.put(x, n, base, w)
            left.take(x, n)


def best_fit(left: _Left, plan: Plan) -> None:
    rooms: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def give(room: int, base: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                bisect.insort(sizes, room)
                rooms[room] = []
            rooms[room].append((base, n))

    for length in sorted(left.lengths, reverse=True):
        count = left.n[length]
        while count:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                room = sizes[i]
                base, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(i)
            else:
                room, n = plan.capacity, -(-count // (plan.capacity // length))
                base = plan.open(n)
            times = room // length
            full = min(n, count // times)
            for k in range(times if full else 0):
                plan.put(length, full, base, plan.capacity - room + k * length)
            give(room - times * length, base, full)
            count -= full * times
            if full < n:
                some = min(count, times)
                for k in range(some):
                    plan.put(length, 1, base + full, plan.capacity - room + k * length)
                if some:
                    give(room - some * length, base + full, 1)
                    count -= some
                give(room, base + full + bool(some), n - full - bool(some))
        left.take(length, left.n[length])


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    plan, left = Plan(capacity), _Left(counts)
    reduce(left, plan)
    best_fit(left, plan)
    return plan


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    counts = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(
            W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = packing_plan({r["length"]: r["n"] for r in totals}, capacity)
    by_length: dict[int, np.ndarray] = {}
    for row in sorted(plan.rows):
        by_length.setdefault(row[0], []).append(row[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for one in np.unique(lengths):
            at = np.flatnonzero(lengths == one)
            rows = by_length[int(one)]
            row = rows[np.searchsorted(rows[:, 0], numbers[at], "right") - 1]
            out[at, 0] = row[:, 2] + numbers[at] - row[:, 0]
            out[at, 1] = row[:, 3]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    numbered = pieces.join(before, ["part", "length"]).withColumn(
        "place", place(F.col("length"), F.col("number") + F.col("before")))
    return numbered.select("id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
