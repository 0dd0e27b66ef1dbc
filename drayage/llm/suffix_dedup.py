"""Long repeats across and within documents: external sorting of sparse suffix tuples.

A window of ``length`` bytes is a repeat if the same bytes also start anywhere else. Sorting a
suffix tuple for every byte would move some 25 bytes per byte of text through disk; this operator
sorts the sparse tuples of ``repeats`` instead and induces the other positions from them:

* An anchor stands for all windows it owns, given as a range of distances back from it. A tuple is
  such a range with the names of two prefixes: the bytes common to all its windows (core) and the
  bytes that cover them all (hull).
* Tuples are sorted by core, then hull, through the shuffle, which is the external queue: it spills
  to disk and no task holds more than it sorts in memory. One pass over a sorted run carries the
  last tuple and decides: a core of its own has no repeat; equal hulls are repeats as a whole; a
  core shared by different hulls is undecided.
* Undecided ranges are cut into shorter ones, whose core is longer and whose hull is shorter, and
  sorted again, with one tuple for every decided hull that shares their core. At width 1 core,
  hull and window are one, and everything is decided.

Before the shuffle, equal hulls of a batch of texts become one tuple, so a text with a third of all
copies is one tuple per task and anchor. Texts are shuffled once, to the ranges found in them; only
those with undecided ranges are looked at again.

Names are 64-bit hashes of the bytes they stand for.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing; rows that
repeat an id and text are copies of each other like any other; null ids are passed on; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm.common import stage, text_or_empty
from drayage.llm.repeats import SEED, Anchors, Hashes, anchors

LENGTH = 400
# The ranges of distances of one tuple, from the first sort to the last; each divides the one before.
WIDTHS = (196, 14, 1)
# Texts of a task that are combined before they leave it, in bytes.
GATHER = 16 << 20

_ALONE, _COPIES, _DECIDED = 1, 2, 0


def _tuple_schema(id_field: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("core", T.LongType()), T.StructField("hull", T.LongType()), T.StructField("lo", T.ShortType()),
        T.StructField("hi", T.ShortType()), T.StructField("state", T.ByteType()), T.StructField("place", T.LongType()),
        T.StructField("id", id_field.dataType), T.StructField("mark", T.LongType())])


def _ranges(a: Anchors, state: np.ndarray, width: int, length: int) -> dict[str, np.ndarray]:
    """Cuts the owned ranges along the multiples of ``width`` and names core and hull of each."""
    first, last = a.lo // width, a.hi // width
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    step = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    lo, hi = np.maximum(a.lo[of], step * width), np.minimum(a.hi[of], step * width + width - 1)
    at = a.at[of]
    core = a.hashes.of(at - step * width, at - step * width - width + 1 + length)
    return {"core": core ^ step.astype(np.uint64), "hull": a.hashes.of(at - hi, at - lo + length),
            "lo": lo, "hi": hi, "place": a.place[of], "text": a.text[of], "state": state[of]}


def _combined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One tuple for equal (core, hull, lo, hi); the others of its kind are decided."""
    rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.lexsort((rows["hi"], rows["lo"], rows["hull"], rows["core"]))
    rows = {k: v[order] for k, v in rows.items()}
    same = np.zeros(len(order), bool)
    same[1:] = True
    for k in ("core", "hull", "lo", "hi"):
        same[1:] &= rows[k][1:] == rows[k][:-1]
    copied = same.copy()
    copied[:-1] |= same[1:]
    # A kind with any decided or repeated tuple is one of copies; its first tuple speaks for it.
    kind = np.cumsum(~same) - 1
    known = np.zeros(kind[-1] + 1 if len(kind) else 0, bool)
    np.logical_or.at(known, kind, copied | (rows["state"] == _COPIES))
    state = np.where(known[kind], _COPIES, _ALONE)
    rows["state"] = np.where(same, _DECIDED, state).astype(np.int8)
    return rows


def _batch(rows: dict[str, np.ndarray], ids: pa.Array, marks: pa.Array) -> pa.RecordBatch:
    """Decided tuples need no partner, so they are dealt out by their place."""
    done = rows["state"] == _DECIDED
    core = np.where(done, rows["hull"] ^ rows["place"].astype(np.uint64), rows["core"])
    text = pa.array(rows["text"])
    return pa.RecordBatch.from_arrays([
        pa.array(core.view(np.int64)), pa.array(rows["hull"].view(np.int64)), pa.array(rows["lo"].astype(np.int16)),
        pa.array(rows["hi"].astype(np.int16)), pa.array(rows["state"]), pa.array(rows["place"].astype(np.int64)),
        ids.take(text), marks.take(text)], names=["core", "hull", "lo", "hi", "state", "place", "id", "mark"])


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Neighbouring batches together, or parts of one, of about ``size`` bytes of text."""
    held, held_size = [], 0
    for batch in batches:
        ends = np.cumsum([0, *[len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]])
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size - held_size, "right")) - 1)
            held.append(batch.slice(at, to - at))
            held_size += int(ends[to] - ends[at])
            at = to
            if held_size >= size:
                yield pa.Table.from_batches(held)
                held, held_size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def first_tuples(docs: DataFrame, length: int, width: int) -> DataFrame:
    """The tuples of whole texts, from rows of (id, mark, text as bytes)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, GATHER):
            texts = [t.as_py() for t in rows.column("text")]
            parts = [_ranges(a, np.full(len(a.at), _ALONE), width, length) for a in anchors(texts, length)]
            if parts:
                yield _batch(_combined(parts), rows.column("id").combine_chunks(), rows.column("mark").combine_chunks())

    return docs.mapInArrow(build, _tuple_schema(docs.schema["id"]))


def next_tuples(undecided: DataFrame, length: int, width: int) -> DataFrame:
    """The shorter tuples of the undecided ranges, from rows of (id, mark, text, ranges)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, GATHER):
            parts = []
            for i, (text, ranges) in enumerate(zip(rows.column("text"), rows.column("ranges").to_pylist(), strict=True)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                place, lo, hi, state = (np.array([r[k] for r in ranges], np.int64) for k in ("place", "lo", "hi", "state"))
                a = Anchors(np.full(len(place), i), place, lo, hi, place, Hashes(raw))
                parts.append(_ranges(a, state, width, length))
            if parts:
                yield _batch(_combined(parts), rows.column("id").combine_chunks(), rows.column("mark").combine_chunks())

    return undecided.select("id", "mark", "text", "ranges").mapInArrow(build, _tuple_schema(undecided.schema["id"]))


class _Run:
    """One pass over sorted tuples; holds the first tuple of the hull and the core at hand."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.core = self.kind = self.held = self.first = None
        self.kinds, self.copied = 0, False

    def _end_kind(self) -> None:
        if self.held is None:
            return
        if self.copied:
            self.out.append((_DECIDED, *self.held))
        speaker = (_COPIES if self.copied else _ALONE, *self.held)
        if self.kinds == 1:
            self.first = speaker
        else:
            if self.first is not None:
                self.out.append(self.first)
                self.first = None
            self.out.append(speaker)
        self.held = None

    def add(self, core: int, kind: tuple, state: int, row: tuple) -> None:
        if core != self.core:
            self._end_kind()
            self.first, self.core, self.kinds, self.kind = None, core, 0, None
        if kind != self.kind:
            self._end_kind()
            self.kind, self.kinds = kind, self.kinds + 1
            self.held, self.copied = row, state == _COPIES
        else:
            self.copied = True
            self.out.append((_DECIDED, *row))

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def decide(tuples: DataFrame) -> DataFrame:
    """Sorts tuples by core and hull. Returns the decided ranges (state 0) and, of undecided cores,
    one tuple for each hull: alone (1) or of copies (2)."""
    kept = ["core", "hull", "lo", "hi", "state", "place", "id", "mark"]
    ordered = tuples.select(*kept).repartition(F.col("core")).sortWithinPartitions("core", "hull", "lo", "hi")
    schema = T.StructType([
        T.StructField("state", T.ByteType()), T.StructField("place", T.LongType()), T.StructField("lo", T.ShortType()),
        T.StructField("hi", T.ShortType()), tuples.schema["id"], T.StructField("mark", T.LongType())])
    names = [f.name for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, kinds = _Run(), None
        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            core = batch.column("core").to_numpy()
            state = batch.column("state").to_numpy()
            # Tuples with a core of their own decide nothing; those at the ends of a batch may have
            # partners in the next.
            some = np.zeros(len(core), bool)
            some[1:] |= core[1:] == core[:-1]
            some[:-1] |= core[1:] == core[:-1]
            some[[0, -1]] = True
            some |= state == _COPIES
            done = np.flatnonzero(state == _DECIDED)
            if len(done):
                yield batch.take(pa.array(done)).select(names)
            part = batch.take(pa.array(np.flatnonzero(some & (state != _DECIDED))))
            columns = [part.column(c).to_pylist() for c in ("core", "hull", "lo", "hi", "state", "place", "id", "mark")]
            for c, h, lo, hi, s, place, key, mark in zip(*columns, strict=True):
                run.add(c, (h, lo, hi), s, (place, lo, hi, key, mark))
            if rows := run.take():
                yield _rows(rows, names, kinds)
        run.add(None, (), 0, ())
        run.held = None
        if rows := run.take():
            yield _rows(rows, names, kinds)

    return stage(ordered.mapInArrow(scan, schema), "suffix-tuples")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _by_text(found: DataFrame) -> DataFrame:
    """Decided and undecided ranges of each text, as lists."""
    one = F.struct("place", "lo", "hi", "state")
    return found.groupBy(F.col("id").alias("of_id"), F.col("mark").alias("of_mark")).agg(
        F.collect_set(F.when(F.col("state") == _DECIDED, F.struct("place", "lo", "hi"))).alias("decided"),
        F.collect_set(F.when(F.col("state") != _DECIDED, one)).alias("ranges"))


def _with_ranges(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    grouped = _by_text(found)
    return texts.join(grouped, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), how).drop(
        "of_id", "of_mark")


def merged_spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """The bytes of all windows of the ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["place"] - r["hi"], r["place"] - r["lo"] + length) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _digested(rows: DataFrame, length: int) -> DataFrame:
    """From (id, mark, text, decided): what is left of each text. The text stays where ranges are undecided."""
    open_ranges = "ranges" in rows.columns
    schema = T.StructType([
        rows.schema["id"], T.StructField("mark", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    passed = ["text", "ranges", "decided"] if open_ranges else []
    for c in passed:
        schema = schema.add(c, rows.schema[c].dataType)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, undecided = [], []
            ranges = batch.column("ranges") if open_ranges else [None] * len(batch)
            for text, decided, left in zip(batch.column("text"), batch.column("decided").to_pylist(), ranges, strict=True):
                undecided.append(left is not None and left.is_valid and len(left) > 0)
                raw = memoryview(text.as_buffer())
                spans = merged_spans(decided or [], length)
                sha, at = hashlib.sha256(), 0
                for start, end in spans:
                    sha.update(raw[at:start])
                    at = end
                sha.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), sha.hexdigest(), [list(s) for s in spans]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            mask = pa.array(undecided, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                 *[_where(mask, batch.column(c)) for c in passed]],
                names=[f.name for f in schema.fields])

    return rows.select("id", "mark", "text", "decided", *(["ranges"] if open_ranges else [])).mapInArrow(digest, schema)


def _where(mask: pa.Array, values: pa.Array) -> pa.Array:
    """The values where the mask is set, null elsewhere."""
    index = np.where(mask.to_numpy(zero_copy_only=False), np.arange(len(values)), -1)
    return values.take(pa.array(index, pa.int64(), mask=index < 0))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` in bytes."""
    if length <= 2 * SEED or widths[-1] != 1 or any(a % b for a, b in zip(widths, widths[1:], strict=False)):
        raise ValueError("length must exceed twice the seed, widths must divide each other down to 1")
    if widths[0] > length - SEED:
        raise ValueError("the first width leaves no core")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    found = decide(first_tuples(rows, length, widths[0]))
    first = stage(_digested(_with_ranges(rows, found, "left"), length), "repeat-texts")
    undecided = first.filter("text is not null")
    decided = None
    ranges = undecided.select("id", "mark", "text", "ranges")
    for width in widths[1:]:
        found = decide(next_tuples(ranges, length, width))
        done = found.filter(F.col("state") == _DECIDED)
        decided = done if decided is None else decided.unionByName(done)
        if width > 1:
            ranges = _with_ranges(
                undecided.select("id", "mark", "text"), found.filter(F.col("state") != _DECIDED), "inner").drop("decided")
    results = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    closed = first.filter("text is null").select(*results)
    if decided is None:
        return first.select(*results)
    more = _by_text(decided).select("of_id", "of_mark", F.col("decided").alias("more"))
    joined = undecided.select("id", "mark", "text", "decided").join(
        more, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    both = joined.withColumn("decided", F.concat("decided", F.coalesce("more", F.array().cast(
        joined.schema["decided"].dataType)))).drop("of_id", "of_mark", "more")
    return closed.unionByName(_digested(both, length).select(*results))
