"""Chat formatting: a finite-state machine over roles and a declarative template.

A ``Template`` names the markers around a turn of each role, the roles under
the loss, and the machine: states, transitions by role and accepting states.
A role without a transition from the present state leads to ``ERROR``, which is
never left.  Every turn becomes segments (marker, text, marker), each with its
loss flag; only the texts of loss roles carry it.  Turns of other roles
are formatted too, under a marker that holds the role's name.

Control strings (the markers without outer spaces) inside texts and role names
are broken by the escape character after their first character, and escape
characters are doubled, so a formatted conversation holds control strings at
turn boundaries only and reads back exactly (``read_turns``).

A conversation may hold any share of the rows: turns are sorted over many
tasks by conversation and turn, and a task that starts within a conversation
follows the machine from every state at once; the state it was entered with is
filled in from the last states of the tasks before (one row a partition).
``digests`` reads the output back as a stream, a turn at a time; a SHA-256 of
one conversation is sequential by nature, so its turns pass one task in order,
but are never held together.

Cases: null texts and null roles are empty; a null conv_id is a conversation of
its own; turns are ordered by turn (null first), rows of one turn by role and a hash of
their text; repeated rows are turns of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.llm.common import written

ERROR = "error"


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (before, after); ``other``: (before, between, after)
    around the name and text of any other role."""

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    start: str
    transitions: dict[str, dict[str, str]]
    accept: frozenset[str]
    escape: str = "\\"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [m for pair in self.turns.values() for m in pair] + list(self.other)
        words = sorted({m.strip() for m in marks})
        if not all(words) or len(words) != len(marks):
            raise ValueError("markers must be distinct and hold more than white space")
        if len(self.escape) != 1 or any(self.escape in m for m in marks):
            raise ValueError("the escape is one character that no marker holds")
        for a in words:
            for b in words:
                if (a != b and b in a) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))) or len(a) < 2:
                    raise ValueError(f"markers must not overlap: {a} {b}")
        reached = {self.start, *self.transitions, *(s for t in self.transitions.values() for s in t.values())}
        object.__setattr__(self, "states", (*sorted(reached - {ERROR}), ERROR))

    @property
    def controls(self) -> list[str]:
        return sorted({m.strip() for pair in (*self.turns.values(), self.other) for m in pair})

    def next_state(self, state: str, role: str) -> str:
        return self.transitions.get(state, {}).get(role, ERROR)


CHAT = Template(
    turns={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST] "), "assistant": ("<s> ", " </s>\n")},
    other=("<role> ", " <says> ", " </role>\n"),
    loss=frozenset({"assistant"}),
    start="start",
    transitions={"start": {"system": "system", "user": "user"}, "system": {"user": "user"},
                 "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    accept=frozenset({"assistant"}),
)


def escaper(template: Template):
    """Breaks control strings and doubles escapes, reversibly."""
    e = template.escape
    start = re.compile("(?=" + "|".join(map(re.escape, template.controls)) + ")(.)", re.DOTALL)
    return lambda text: start.sub(lambda m: m.group(1) + e, text.replace(e, e + e))


def unescaper(template: Template):
    e = re.escape(template.escape)
    mark = re.compile(f"{e}({e}?)")
    return lambda text: mark.sub(lambda m: m.group(1), text)


def segments(template: Template, escape, role: str, text: str) -> list[tuple[str, bool]]:
    """Segments of one turn, with loss flags."""
    body = (escape(text), role in template.loss)
    if role in template.turns:
        before, after = template.turns[role]
        return [(before, False), body, (after, False)]
    before, between, after = template.other
    return [(before, False), (escape(role), False), (between, False), body, (after, False)]


def read_turns(pieces: Iterable[str], template: Template = CHAT) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, given in pieces
    of any size; holds one turn at a time."""
    undo = unescaper(template)
    turn = re.compile("|".join(
        [f"{re.escape(a)}(?P<r{i}>.*?){re.escape(b)}" for i, (a, b) in enumerate(template.turns.values())]
        + [f"{re.escape(template.other[0])}(?P<role>.*?){re.escape(template.other[1])}(?P<text>.*?){re.escape(template.other[2])}"]), re.DOTALL)
    names, rest = list(template.turns), ""
    for piece in pieces:
        rest += piece
        at = 0
        while m := turn.match(rest, at):
            at = m.end()
            if m["role"] is not None:
                yield undo(m["role"]), undo(m["text"])
            else:
                yield next((names[i], undo(m[f"r{i}"])) for i in range(len(names)) if m[f"r{i}"] is not None)
        rest = rest[at:]
    if rest:
        raise ValueError("the formatted text ends within a turn")


def _formatted(template: Template, kept: str):
    states = template.states
    place = {s: i for i, s in enumerate(states)}

    def run(batches):
        p, i, last, path = TaskContext.get().partitionId(), 0, None, list(range(len(states)))
        escape, first = escaper(template), True
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if first:
                    # the conversation may have begun in an earlier partition: one path per state
                    last, first, inside = conv, False, True
                elif conv != last:
                    last, inside, path = conv, False, [place[template.start]] * len(states)
                path = [place[template.next_state(states[s], role)] for s in path]
                parts = [{"text": t, "loss": flag} for t, flag in segments(template, escape, role, text)]
                out.append((conv, turn, p, i, inside, path, parts))
                i += 1
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 7
            part = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
            kinds = [batch.schema.field("conv_id").type, batch.schema.field("turn").type, pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["conv_id", "turn", "p", "i", "inside", "path", "segments"])
    return run, f"{kept}, p int, i long, inside boolean, path array<int>, segments array<struct<text:string,loss:boolean>>"


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, turn, p, i, segments, state) of every turn, ordered by (p, i);
    ``state`` is the machine's state after the turn."""
    spark = turns.sparkSession
    d = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    kept = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    run, schema = _formatted(template, kept)
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ordered = d.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    table = written(ordered.mapInArrow(run, schema))
    start = len(template.states) * [template.states.index(template.start)]
    ends = (table.groupBy("p").agg(F.min_by("conv_id", "i").alias("first"), F.max_by("conv_id", "i").alias("last"),
                                   F.max_by("path", "i").alias("path"), F.max_by("inside", "i").alias("inside")).orderBy("p").collect())
    entered, before, state = [], None, start[0]
    for r in ends:
        state = state if before is not None and before["last"] == r["first"] else start[0]
        entered.append((r["p"], state))
        state, before = (r["path"][state], r)
    enter = spark.createDataFrame(entered, "p int, entered int")
    names = F.array(*[F.lit(s) for s in template.states])
    after = F.col("path")[F.when(F.col("inside"), F.col("entered")).otherwise(F.lit(0))]
    return table.join(F.broadcast(enter), "p").select("conv_id", "turn", "p", "i", "segments", names[after].alias("state"))


def digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What a reader finds in the output, one row a conversation: (conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid,
    complete).  ``valid``: no turn out of order; ``complete``: ends in an
    accepting state as well."""
    kept = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
    undo = unescaper(template)

    def rows(batches):
        for batch in batches:
            for conv, parts, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segments", "state")), strict=True):
                yield conv, parts, state

    def conversations(batches):
        """One digest at a time; segments are passed on as they come."""
        stream = rows(batches)
        row = next(stream, None)
        while row is not None:
            conv, seen = row[0], {"loss": 0, "chars": 0, "state": row[2]}
            under, turns, n = hashlib.sha256(), hashlib.sha256(), 0

            def pieces(conv=conv, seen=seen, under=under):
                nonlocal row
                while row is not None and row[0] == conv:
                    for part in row[1]:
                        seen["chars"] += len(part["text"])
                        if part["loss"]:
                            plain = undo(part["text"])
                            seen["loss"] += len(plain)
                            under.update(plain.encode())
                    seen["state"] = row[2]
                    text = "".join(part["text"] for part in row[1])
                    row = next(stream, None)
                    yield text

            for role, text in read_turns(pieces(), template):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            yield (conv, n, turns.hexdigest(), seen["loss"], under.hexdigest(), seen["chars"], seen["state"] != ERROR, seen["state"] in template.accept)

    def run(batches):
        held, kind = [], None

        def emit():
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for found in conversations(typed()):
            held.append(found)
            if len(held) >= 10_000:
                yield emit()
                held = []
        if held:
            yield emit()

    ordered = formatted.select("conv_id", "p", "i", "segments", "state").repartition("conv_id").sortWithinPartitions("conv_id", "p", "i")
    return ordered.mapInArrow(run, f"conv_id {kept}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                   "formatted_chars long, valid boolean, complete boolean")
