"""Chat formatting: layouts are recognised by a fingerprint of their schema.

A record is a JSON object. The paths of its fields (``messages[].content``) are collected, sorted
and hashed; the fingerprint picks a declarative mapping that says where the turns are. Records of a
known layout with extra fields match by the smallest known layout that their paths contain.
Turns then get canonical roles and a template:

    ### user: text</turn>\n

Inside texts and roles every backslash and every control string is preceded by a backslash, which
reading back undoes, so no text can end its turn or open another. The loss mask covers the text of
assistant turns, not the markers.

A conversation is formatted turn by turn, and read back as a stream of turns in order, so a very
long one never has to be held in a task.

Defined cases: a null text is an empty turn; a null role is the empty role; turns with the same
number follow by role, then text; null turn numbers come first; a null conversation id is one
conversation; a record whose layout is unknown has no turns and is returned with a null mapping.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\\|###|</turn>"
ROLE_CONTROL = CONTROL + r"|:|\n"
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns`` is the path of a list of turns ("" for a record that is one turn itself) with the
    names of the role and the text in it; or ``fixed`` lists (role, paths to join) in order.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("turn", ("role", "text"), "", "role", "text"),
    Mapping("turn_content", ("role", "content"), "", "role", "content"),
    Mapping("instruction", ("instruction", "output"), fixed=(
        ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("instruction", "input", "output"), fixed=(
        ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_completion", ("prompt", "completion"), fixed=(
        ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), fixed=(
        ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), fixed=(
        ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("question", "answer"), fixed=(
        ("user", ("question",)), ("assistant", ("answer",)))),
)
#: Names of the same role in different layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[field_paths(v, f"{at}[]") for v in value])
    return {at} if at else set()


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


_KNOWN = {fingerprint(m.paths): m for m in MAPPINGS}


def pick_mapping(paths: set[str], known: dict[str, tuple[str, Mapping | None]]) -> tuple[str, Mapping | None]:
    """The fingerprint of these paths and its mapping; ``known`` remembers what was seen before."""
    mark = fingerprint(paths)
    if mark not in known:
        inside = [m for m in MAPPINGS if set(m.paths) <= paths]
        known[mark] = (mark, _KNOWN.get(mark) or max(inside, key=lambda m: len(m.paths), default=None))
        if len(known) > 100_000:
            known.pop(next(iter(known)))
            return mark, _KNOWN.get(mark) or max(inside, key=lambda m: len(m.paths), default=None)
    return known[mark]


def _plain(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object, mapping: Mapping | None) -> list[tuple[str, str]]:
    if mapping is None or not isinstance(record, dict):
        return []
    if mapping.fixed:
        turns = [(role, "\n".join(t for t in (_plain(record.get(p)) for p in paths) if t or len(paths) == 1))
                 for role, paths in mapping.fixed]
    else:
        found = [record] if mapping.turns == "" else record.get(mapping.turns)
        turns = [(_plain(t.get(mapping.role)), _plain(t.get(mapping.text))) for t in found or [] if isinstance(t, dict)]
    return [(ROLES.get(role, role), text) for role, text in turns]


def canonical_turns(records: DataFrame, id_col: str, json_col: str, turn_col: str | None = None) -> DataFrame:
    """One row per turn: ``id``, ``turn``, ``part``, ``role``, ``text``, ``layout``, ``mapping``.

    ``turn`` comes from ``turn_col`` for layouts that keep one turn in a record. A record without
    turns gives one row with a null role and text.
    """
    turn = F.col(turn_col).cast("long") if turn_col else F.lit(0).cast("long")
    rows = records.select(F.col(id_col).alias("id"), turn.alias("turn"), F.col(json_col).alias("json"))
    schema = rows.drop("json").schema
    for name, kind in (("part", "integer"), ("role", "string"), ("text", "string"), ("layout", "string"), ("mapping", "string")):
        schema = schema.add(name, kind)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, Mapping | None]] = {}
        for batch in batches:
            source, part, role, text, layout, mapping = [], [], [], [], [], []
            for i, raw in enumerate(batch.column("json")):
                try:
                    record = json.loads(raw.as_py() or "null", strict=False)
                except ValueError:
                    record = None
                mark, found = pick_mapping(field_paths(record), known)
                turns = turns_of(record, found)
                for k, (r, t) in enumerate(turns or [(None, None)]):
                    source.append(i)
                    part.append(k)
                    role.append(r)
                    text.append(t)
                    layout.append(mark)
                    mapping.append(found.name if found else None)
            kept = batch.select(["id", "turn"]).take(pa.array(source, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(part, pa.int32()), pa.array(role, pa.string()), pa.array(text, pa.string()),
                 pa.array(layout, pa.string()), pa.array(mapping, pa.string())],
                names=["id", "turn", "part", "role", "text", "layout", "mapping"])

    return rows.mapInArrow(split, schema)


def escaped(text: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(text, f"({control})", r"\\$1")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` (the turn in the template) and where in it the loss counts."""
    role = F.coalesce(F.col("role"), F.lit(""))
    text = escaped(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(OPEN), escaped(role, ROLE_CONTROL), F.lit(BETWEEN))
    learned = role == LEARNED
    return turns.withColumns({
        "formatted": F.concat(head, text, F.lit(CLOSE)),
        "loss_from": F.when(learned, F.char_length(head)),
        "loss_to": F.when(learned, F.char_length(head) + F.char_length(text))})


_PLAIN = re.compile(rf"\\({ROLE_CONTROL})")
_HEAD_END = re.compile(rf"((?:[^\\:]++|\\(?:{ROLE_CONTROL}))*+): ")
_TEXT_END = re.compile(rf"((?:[^\\<]++|\\(?:{CONTROL})|<(?!/turn>))*+)</turn>\n")


def unescaped(text: str) -> str:
    return _PLAIN.sub(r"\1", text) if "\\" in text else text


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn in a formatted text."""
    at, out = 0, []
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        head = _HEAD_END.match(formatted, at + len(OPEN))
        text = _TEXT_END.match(formatted, head.end()) if head else None
        if not text:
            raise ValueError(f"the turn at {at} does not end")
        out.append((unescaped(head[1]), unescaped(text[1])))
        at = text.end()
    return out


class _Digest:
    def __init__(self) -> None:
        self.n = self.loss = self.chars = 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_from: int | None, loss_to: int | None) -> None:
        for role, text in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        if loss_from is not None:
            text = unescaped(formatted[loss_from:loss_to])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


_DIGESTS = [("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"),
            ("formatted_chars", "long")]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns say when they are read as one stream in order."""
    ordered = formatted.select("id", "turn", "part", "role", "text", "formatted", "loss_from", "loss_to")
    ordered = (
        ordered.repartition(F.col("id"))
        .sortWithinPartitions("id", "turn", "part", F.col("role"), F.col("text"))
        .select("id", "formatted", "loss_from", "loss_to"))
    schema = ordered.select("id").schema
    for name, kind in _DIGESTS:
        schema = schema.add(name, kind)
    columns = ["id", *[n for n, _ in _DIGESTS]]

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        kinds = None
        for batch in frames:
            kinds = [batch.schema.field("id").type, *[pa.int64() if k == "long" else pa.string() for _, k in _DIGESTS]]
            done = []
            ids, texts = batch.column("id").to_pylist(), batch.column("formatted").to_pylist()
            for key, text, lo, hi in zip(ids, texts, batch.column("loss_from").to_pylist(),
                                         batch.column("loss_to").to_pylist(), strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = key, _Digest()
                state.add(text, lo, hi)
            if done:
                yield _batch(done, columns, kinds)
        if state is not None:
            yield _batch([(now, *state.row())], columns, kinds)

    return ordered.mapInArrow(read, schema)


def _batch(rows: list[tuple], columns: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """The formatted text of every conversation, for training files that want one row each."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "part", "role", "text", "formatted")))
    return formatted.groupBy("id").agg(
        F.concat_ws("", F.transform(parts, lambda p: p["formatted"])).alias("formatted"))
