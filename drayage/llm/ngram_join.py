"""Near duplicates by word n-gram sets: a prefix-tree join with a global order.

Order. Shingles that many texts share come last, before them the longest come first: long shingles
are rare ones, so the front of a set tells it apart. Which are shared by many is counted over all
documents: every task reports shingles it meets several times, and the most frequent of all, at
most ``max_frequent``, go to the end. Any order gives the same links; this one keeps groups small.

Candidates. Two sets can only be linked if they share a shingle in their prefixes, the first
``n - ceil(t n) + 1`` in order; sets of given sizes share a number of them that grows with the sizes.
Prefix shingles of one document only are dropped. Shingles of few documents are counted for every two
of them, those of many only for each document, and documents without any pair that can reach the
number go, before any text is shuffled.

Joining. A set is a path in a prefix tree. Candidates of a set are sorted by their paths, through
the shuffle, in blocks of bounded size, and walked in that order against the set: paths with a
common beginning share the overlap counted so far, and a subtree is left as soon as what remains of
either path cannot reach the overlap that is needed. A set with very many candidates gets as many
blocks.

Components. Documents with equal sets are one class without any join. Then, in rounds, the
candidates of each shingle are joined with one of them only, the centre of the round, so that a large
group of near copies becomes one component after as many joins as it has members. At the end every
document is joined with each other component that it shares enough prefix shingles with: documents of
the smaller component walk the tree of the larger one, laid out in blocks. So no link between
components is missed, and none within a component is needed.

Defined cases: a null text counts as empty; texts without words have empty sets and are linked with
nothing; texts of fewer words are one shingle; rows that repeat an id are separate documents, and
the smallest id of a component names it, null ids last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm.common import SHUFFLES_GO, SMALL_BATCHES, WORD, discard, keep_listed, settings, stage, text_or_empty
from drayage.llm.components import components
from drayage.llm.shingles import prefix_length, shingle_sets
from drayage.session import scratch_dir

MAX_FREQUENT = 1 << 20
# Seen so often among so many shingles of one task, a shingle is reported; so often in all, it may go
# to the end of the order.
REPORTED, SEEN_TOGETHER, FREQUENT = 3, 4_000_000, 16
# Documents in a block of a tree, and candidates that walk one copy of it.
BLOCK, WALKERS = 256, 4_096
# Documents of a shingle that are paired before anything is known of their components.
FEW = 16
# Leading bits of a size that tell the bands of sizes apart.
BAND_BITS = 7
ROUNDS = 2
# Bits of the map that keeps most texts without a candidate out of a shuffle.
LISTED_BITS = 1 << 24
# Texts cut into shingles at a time, in bytes. Their arrays are some 50 times as large, and a worker that
# is used again keeps what it once took.
CHUNK = 1 << 18
_LATE = np.uint64(1 << 63)


def _chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about ``size`` bytes, with the place of the first."""
    held, held_size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.as_py() or b""
        if held and held_size + len(raw) > size:
            yield first, held
            held, held_size, first = [], 0, i
        held.append(raw)
        held_size += len(raw)
    if held:
        yield first, held


def frequent_shingles(docs: DataFrame, words: int, max_frequent: int = MAX_FREQUENT) -> np.ndarray:
    """The most frequent shingles of all documents, at most ``max_frequent``, in order."""

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(found)
        every.sort()
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
        times = np.diff(np.append(new, len(every)))
        often = times >= REPORTED
        return pa.RecordBatch.from_arrays(
            [pa.array(every[new[often]].view(np.int64)), pa.array(times[often].astype(np.int64))],
            names=["shingle", "times"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for _, texts in _chunks(batch.column("text")):
                found.append(shingle_sets(texts, words)[0])
                if sum(map(len, found)) >= SEEN_TOGETHER:
                    yield told(found)
                    found = []
        if found:
            yield told(found)

    counts = stage(
        docs.select("text").mapInArrow(report, "shingle long, times long")
        .groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT), "frequent-shingles")
    sizes = sorted(counts.groupBy(F.floor(F.log2("times") * 4).alias("size")).count().collect(), reverse=True)
    least, total = None, 0
    for size, n in sizes:
        if total + n > max_frequent:
            break
        least, total = size, total + n
    if least is None:
        return np.zeros(0, np.uint64)
    rows = counts.filter(F.floor(F.log2("times") * 4) >= least).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles as signed numbers in the global order."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        shingles = np.where(frequent[at] == shingles, shingles | _LATE, shingles)
    return (shingles ^ _LATE).view(np.int64)


def document_sets(docs: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """Per row: id, mark, size and name of its set, and the prefix; equal sets of a task once."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("name", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = frequent.value, set()
        for batch in batches:
            sizes, names, parts, has = [], [], [], []
            for _, texts in _chunks(batch.column("text")):
                found, begins = shingle_sets(texts, words)
                n = np.diff(begins)
                keep = prefix_length(n, percent)
                found = ordered(found, late)
                for i in range(len(texts)):
                    one = np.sort(found[begins[i]:begins[i + 1]])
                    raw = one.view(np.uint64)
                    with np.errstate(over="ignore"):
                        name = (raw.sum(dtype=np.uint64).tobytes()
                                + (raw * (raw | np.uint64(1)) ^ (raw >> np.uint64(23))).sum(dtype=np.uint64).tobytes())
                    sizes.append(len(one))
                    names.append(name)
                    has.append(len(one) > 0 and (name, len(one)) not in seen)
                    seen.add((name, len(one)))
                    parts.append(one[:keep[i]] if has[-1] else one[:0])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), prefix],
                names=["id", "mark", "n", "name", "prefix"])

    return stage(docs.mapInArrow(cut, schema).withColumn("u", F.monotonically_increasing_id()), "shingle-sets")


def maybe_listed(rows: DataFrame, listed: DataFrame, bits: int = LISTED_BITS) -> DataFrame:
    """The rows whose ``mark`` is listed, and few others as long as far fewer than ``bits`` marks are.
    What is broadcast is a bitmap of that many bits, whatever the number of marks."""
    def place(mark: Column) -> tuple[Column, Column]:
        at = F.pmod(mark, F.lit(bits))
        return F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1))

    bucket, bit = place(F.col("of_mark"))
    bitmaps = listed.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    bucket, bit = place(F.col("mark"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        rows.join(F.broadcast(bitmaps), bucket == F.col("bucket"))
        .filter(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns))


def full_sets(texts: DataFrame, frequent, words: int) -> str:
    """Saves the whole sets of rows of (u, text), in order, as a table in buckets of u, so that the
    joins of all rounds shuffle their candidates only. Returns the name of the table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, done = frequent.value, set()
        for batch in batches:
            # Rows that repeat an id and a text are one path.
            first = [i for i, u in enumerate(batch.column("u").to_pylist()) if not (u in done or done.add(u))]
            batch = batch.take(pa.array(first, pa.int64()))
            for at, chunk in _chunks(batch.column("text")):
                found, begins = shingle_sets(chunk, words)
                found = ordered(found, late)
                for i in range(len(chunk)):
                    found[begins[i]:begins[i + 1]].sort()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u").slice(at, len(chunk)),
                     pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(found))], names=["u", "path"])

    spark = texts.sparkSession
    name, buckets = f"shingle_paths_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = texts.select("u", "text").mapInArrow(cut, "u long, path array<bigint>").repartition(buckets, "u")
    with settings(spark, SHUFFLES_GO):
        sets.write.bucketBy(buckets, "u").option("path", scratch_dir(spark, "shingle-paths")).saveAsTable(name)
    return name


def needed_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / F.lit(100 + percent)).cast("long")


def needed_shared(a: Column, b: Column, percent: int) -> Column:
    """How many prefix shingles sets of these sizes share at least if they are linked."""
    most = F.ceil(percent * F.greatest(a, b) / F.lit(100)).cast("long")
    return F.greatest(F.lit(1).cast("long"), needed_overlap(a, b, percent) - most + 1)


def fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def least_need(n: Column, least: Column, most: Column, percent: int) -> Column:
    """The smallest need towards partners of these sizes, null if none of them is in reach."""
    low = F.greatest(least, F.ceil(percent * n / F.lit(100)).cast("long"))
    high = F.least(most, F.floor(100 * n / F.lit(percent)).cast("long"))
    # The need falls towards both ends of the sizes; rounding can make it one less between.
    between = F.when(low < high, F.lit(1)).otherwise(F.lit(0))
    return F.when(low <= high, F.least(needed_shared(n, low, percent), needed_shared(n, high, percent)) - between)


def _able_among(rows: DataFrame, percent: int) -> DataFrame:
    """Documents that can have a partner by these shingles alone: one that shares k shingles at least
    needs k of them whose need, over the sizes of their other documents, is no more than k.

    The sizes of a shingle are kept by bands of less than two percent, 64 to every doubling and so some
    thousand at most, however many documents it has.
    """
    rows = rows.withColumn("band", F.expr(f"greatest(0, length(bin(n)) - {BAND_BITS})")).withColumn(
        "band", F.col("band") * (1 << BAND_BITS) + F.expr("shiftright(n, cast(band as int))"))
    bands = rows.groupBy("shingle", "band").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("docs"))
    sizes = bands.groupBy("shingle").agg(F.collect_list(F.struct("band", "least", "most", "docs")).alias("bands"))
    # A document that is alone in its band is not its own partner.
    others = F.filter("bands", lambda b: (b["docs"] > 1) | (b["band"] != F.col("band")))
    need = F.array_min(F.transform(others, lambda b: least_need(F.col("n"), b["least"], b["most"], percent)))
    needs = F.sort_array(F.collect_list("need"))
    return (
        rows.join(sizes, "shingle").withColumn("need", need).filter("need is not null")
        .groupBy("u").agg(needs.alias("needs"))
        .filter(F.exists(F.transform("needs", lambda need, i: need <= i + 1), lambda x: x)).select("u"))


def shared_prefixes(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(shingle, u, n) of prefix shingles that could link a document: shared, and enough of them.

    Shingles of at most ``FEW`` documents are counted for every two of them; of the others, which only
    large groups have in their prefixes, it is counted how many a document has. A pair whose shingles of
    few documents and possible others are too few is no candidate, and a document without one goes. Of
    documents with equal sets only the first takes part.
    """
    others = sets.filter(F.size("prefix") > 0).select("u", "name", "n").join(
        classes.select("name", "n", F.col("u").alias("first")), ["name", "n"]).filter("u <> first").select("u")
    rows = sets.filter(F.size("prefix") > 0).join(others, "u", "left_anti").select(
        "u", "n", F.explode("prefix").alias("shingle"))
    several = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rows = staged = stage(
        rows.join(several, "shingle").select("shingle", "u", "n", (F.col("df") > FEW).alias("many")), "shared-shingles")
    others = rows.groupBy("u").agg(F.count_if("many").alias("others"))
    few = rows.filter("not many").join(others, "u").select("shingle", "u", "n", "others")
    right = few.select("shingle", F.col("u").alias("v"), F.col("n").alias("m"), F.col("others").alias("vothers"))
    pairs = (
        few.join(right, "shingle").filter((F.col("u") < F.col("v")) & fits(F.col("n"), F.col("m"), percent))
        .groupBy("u", "v", "n", "m", F.least("others", "vothers").alias("others")).agg(F.count(F.lit(1)).alias("times"))
        .filter(F.col("times") + F.col("others") >= needed_shared(F.col("n"), F.col("m"), percent)))
    able = (
        pairs.select(F.explode(F.array("u", "v")).alias("u"))
        .unionByName(_able_among(rows.filter("many").drop("many"), percent)).distinct())
    out = stage(rows.drop("many").join(able, "u").select("shingle", "u", "n"), "shared-prefixes")
    discard(staged)
    return out


class _Walk:
    """The walk of one set's candidates in the order of their paths."""

    def __init__(self, own: np.ndarray, percent: int) -> None:
        self.own, self.percent = own, percent
        self.path, self.overlap, self.at = own[:0], np.zeros(1, np.int64), np.zeros(1, np.int64)
        # No path of any size that begins like the one in hand can be linked if it agrees so far (0: none).
        self.hopeless = 0
        # The same for the last path that was given.
        self.leave = 0

    def linked(self, path: np.ndarray) -> bool:
        n, m = len(path), len(self.own)
        d = self.hopeless
        if d and n >= d and path[d - 1] == self.path[d - 1] and np.array_equal(path[:d], self.path[:d]):
            self.leave = d
            return False
        self.leave = 0
        need = -(-self.percent * (n + m) // (100 + self.percent))
        if need > min(n, m):
            return False
        # What this path has in common with the last one that was walked is known.
        k = min(n, len(self.path))
        differ = np.flatnonzero(path[:k] != self.path[:k])
        common = int(differ[0]) if len(differ) else k
        bound = self.overlap[common] + min(n - common, m - self.at[common])
        if bound < need:
            return False
        rest = path[common:]
        place = np.searchsorted(self.own, rest)
        match = np.zeros(len(rest), np.int64)
        inside = place < m
        match[inside] = self.own[place[inside]] == rest[inside]
        self.path = path
        self.overlap = np.concatenate([self.overlap[:common + 1], self.overlap[common] + np.cumsum(match)])
        self.at = np.concatenate([self.at[:common + 1], place + match])
        # The best partner of a beginning has as many elements more as are left of the own path.
        left = m - self.at
        fails = np.flatnonzero(
            (self.overlap + left) * (100 + self.percent) < self.percent * (np.arange(n + 1) + left + m))
        self.hopeless = self.leave = int(fails[0]) if len(fails) else 0
        return bool(self.overlap[-1] >= need)


def common_beginnings(paths: list[np.ndarray]) -> list[int]:
    """How far each path agrees with the one before it."""
    out = [0] * len(paths)
    for i in range(1, len(paths)):
        k = min(len(paths[i - 1]), len(paths[i]))
        differ = np.flatnonzero(paths[i - 1][:k] != paths[i][:k])
        out[i] = int(differ[0]) if len(differ) else k
    return out


def first_link(own: np.ndarray, tree: list[np.ndarray], common: list[int], percent: int) -> int:
    """The place of the first of the sorted paths that ``own`` is linked with, -1 if none. Subtrees that
    cannot be linked are passed over."""
    walk, i = _Walk(own, percent), 0
    while i < len(tree):
        if walk.linked(tree[i]):
            return i
        i += 1
        while walk.leave and i < len(tree) and common[i] >= walk.leave:
            i += 1
    return -1


def joined(pairs: DataFrame, paths: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Of candidate pairs (u, v), those that are linked. ``u`` walks the tree of its ``v``."""
    pairs = stage(pairs.select("u", "v"), "candidate-pairs")
    blocks = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    part = F.pmod(F.hash("v"), F.col("blocks"))
    members = (
        pairs.join(blocks, "u").select("u", part.alias("part"), F.lit(1).alias("kind"), "v")
        .join(paths.withColumnRenamed("u", "v"), "v").select("u", "part", "kind", "v", "path"))
    own = (
        blocks.join(paths, "u")
        .select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("kind"),
                F.col("u").alias("v"), "path"))
    rows = own.unionByName(members).repartition(F.col("u"), F.col("part")).sortWithinPartitions(
        "u", "part", "kind", "path")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out_u, out_v = [], []
            column = batch.column("path")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            for i, (u, kind, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("u", "kind", "v")), strict=True)):
                path = values[offsets[i]:offsets[i + 1]]
                if kind == 0:
                    state = _Walk(path.copy(), percent)
                elif state.linked(path):
                    out_u.append(u)
                    out_v.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])

    return stage(rows.mapInArrow(walk, "u long, v long"), "near-links")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))


def centre_pairs(shared: DataFrame, roots: DataFrame, turn: int, percent: int) -> DataFrame:
    """Of every shingle whose documents are in several components, its centre with the others."""
    rows = _with_roots(shared, roots)
    order = F.col("u") if turn == 0 else F.xxhash64("u", F.lit(turn))
    centres = rows.groupBy("shingle").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.min(F.struct(order.alias("o"), F.col("u").alias("c"), F.col("n").alias("cn"), F.col("root").alias("croot"))).alias("best"),
    ).filter("low < high").select("shingle", "best.c", "best.cn", "best.croot")
    return (
        rows.join(centres, "shingle").filter((F.col("root") != F.col("croot")) & fits(F.col("n"), F.col("cn"), percent))
        .groupBy(F.col("c").alias("u"), F.col("u").alias("v"), F.col("cn"), F.col("n")).agg(F.count(F.lit(1)).alias("times"))
        .filter(F.col("times") >= needed_shared(F.col("n"), F.col("cn"), percent)).select("u", "v"))


def open_candidates(shared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(u, root) of every document with each other component, not smaller than its own, that it
    shares enough prefix shingles with to be linked to one of its documents."""
    members = _with_roots(shared.select("u").distinct(), roots)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    # One row a document meets the sizes, not one for each of its shingles.
    places = members.join(sizes, "root").select("u", F.struct("size", "root").alias("place"))
    rows = shared.join(places, "u")
    groups = rows.groupBy("shingle", "place").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    tops = groups.groupBy("shingle").agg(F.max("place").alias("top"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    # The largest component of a shingle is met by the others, so its documents stay out of the join.
    below = stage(rows.join(tops, "shingle").filter("place < top").select("shingle", "u", "n", "place"), "open-shingles")
    met = below.join(
        groups.join(tops.select("shingle"), "shingle").withColumnRenamed("place", "other"), "shingle"
    ).filter("place < other").withColumn("need", least_need(F.col("n"), F.col("least"), F.col("most"), percent))
    return (
        met.filter("need is not null").groupBy("u", F.col("other.root").alias("root"))
        .agg(F.count(F.lit(1)).alias("times"), F.min("need").alias("need")).filter("times >= need").select("u", "root"))


def joined_with_components(candidates: DataFrame, shared: DataFrame, roots: DataFrame, paths: DataFrame,
                           percent: int, block: int = BLOCK, walkers: int = WALKERS) -> DataFrame:
    """Links between documents and components. The documents of a component lie in blocks; every
    candidate walks the tree of each block. Components of many candidates are laid out several times."""
    candidates = stage(candidates, "open-candidates")
    rounds = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(walkers)).cast("int").alias("rounds"))
    members = _with_roots(shared.select("u").distinct(), roots).join(rounds, "root")
    blocks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    laid = members.join(blocks, "root").select(
        "root", F.pmod(F.hash("u"), F.col("blocks")).alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("turn"), F.lit(0).alias("kind"), "u")
    walking = candidates.join(rounds, "root").join(blocks, "root").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"),
        F.pmod(F.hash("u"), F.col("rounds")).alias("turn"), F.lit(1).alias("kind"), "u")
    rows = laid.unionByName(walking).join(paths, "u").repartition(
        F.col("root"), F.col("part"), F.col("turn")).sortWithinPartitions("root", "part", "turn", "kind", "path")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, common = None, [], []
        for batch in batches:
            out_u, out_v = [], []
            column = batch.column("path")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "part", "turn", "kind", "u")), strict=True)
            for i, (root, part, turn, kind, u) in enumerate(keys):
                path = values[offsets[i]:offsets[i + 1]]
                if (root, part, turn) != at:
                    at, tree, common = (root, part, turn), [], []
                if kind == 0:
                    tree.append((u, path.copy()))
                    continue
                if not common:
                    common = common_beginnings([p for _, p in tree])
                # One link to a component is enough.
                found = first_link(path, [p for _, p in tree], common, percent)
                if found >= 0:
                    out_u.append(u)
                    out_v.append(tree[found][0])
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])

    return stage(rows.mapInArrow(walk, "u long, v long"), "near-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    percent: int = 85, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, mark (a hash of the text), n (size of its set), component_id and ``kept``:
    true for one row of each component, and for all without words."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        sets, classes, roots = _joined_sets(docs, id_col, text_col, words, percent, rounds)
    with_roots = _with_roots(classes, roots)
    named_roots = with_roots.groupBy("root").agg(F.min("best").alias("first"))
    named_classes = with_roots.join(named_roots, "root").select(
        F.col("name").alias("of_name"), F.col("n").alias("of_n"), "first")
    out = sets.select("id", "mark", "n", "name", "u").join(
        named_classes, (F.col("name") == F.col("of_name")) & (F.col("n") == F.col("of_n")), "left")
    return out.select(
        "id", "mark", "n", F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n") == 0) | (F.col("u") == F.col("first.u"))).alias("kept"))


def _joined_sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int,
                 rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, their classes, and the roots of the classes that are linked with others."""
    spark: SparkSession = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    # At most ``max_frequent`` numbers.
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, words))
    sets = document_sets(rows, frequent, words, percent)
    best = F.struct(F.col("id").isNull().alias("late"), "id", "u")
    classes = stage(
        sets.filter("n > 0").groupBy("name", "n").agg(F.min("u").alias("u"), F.min(best).alias("best")), "set-classes")
    shared = shared_prefixes(sets, classes, percent)
    named = sets.select("u", "id", "mark").join(shared.select("u").distinct(), "u").select(
        F.col("u"), F.col("id").alias("of_id"), F.col("mark").alias("of_mark"))
    named = stage(named, "named-sets")
    texts = maybe_listed(rows, named).join(named, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    saved = full_sets(texts, frequent, words)
    try:
        paths = spark.table(saved)
        # Not made from a Python list, which would have every executor start workers to read nothing.
        links = spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
        roots = links.withColumnRenamed("v", "root")
        for turn in range(rounds):
            links = links.unionByName(joined(centre_pairs(shared, roots, turn, percent), paths, percent))
            roots = components(links)
        links = links.unionByName(joined_with_components(
            open_candidates(shared, roots, percent), shared, roots, paths, percent))
        discard(paths)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {saved}")  # all that was joined with it is staged
    discard(shared, named)
    return sets, classes, components(links)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                     percent: int = 85) -> DataFrame:
    """One document of each component, and all without words, with all their columns."""
    found = stage(near_components(docs, id_col, text_col, words, percent), "near-components")
    marks = found.groupBy("id", F.col("mark").alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("kept") & (F.col("n") > 0)).alias("stays")).filter("stays").drop("stays")
    text = text_or_empty(text_col)
    worded = F.regexp_like(text, F.lit(WORD))
    kept = keep_listed(docs.filter(worded), marks, F.xxhash64(text), id_col)
    return kept.unionByName(docs.filter(~worded))
