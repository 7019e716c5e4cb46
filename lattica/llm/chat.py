"""Chat formatting: a finite-state machine over roles and a declarative template.

Control strings inside texts are escaped by built-in functions. Rows then go to their conversation's task in the order of turns,
where the machine checks each role against the state, and emits the template's segments with a loss flag each. Both it and the
reader, which recovers turns and loss text from the segments, keep a state and never a conversation, so one of any length fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import by_value, small_batches, table

by_value(__name__)

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around turns, roles whose text is under the loss, and the roles that may follow each state.

    ``turns`` has (open, close) of each known role; other roles are written out between ``other``'s first two marks, their text
    between its second and third. ``begin`` opens a conversation. ``follows`` has the roles allowed from each state, which is the
    last role or ``start``; a conversation is complete if it ends in one of ``final``. With ``loss_close`` the mark that closes a
    turn under the loss is under it too.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {"start": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )
    final: frozenset[str] = frozenset({"assistant"})
    loss_close: bool = False

    def __post_init__(self):
        marks = self.marks()
        if len(set(marks)) < len(marks) or any(len(m) < 2 or ESCAPE in m for m in marks):
            raise ValueError("marks must differ, have two characters or more and no backslash")
        for a in marks:
            for b in marks:
                if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"the marks {a!r} and {b!r} can overlap")

    def marks(self) -> list[str]:
        return [self.begin, *[m for pair in self.turns.values() for m in pair], *self.other]


def escaped(text: Column, template: Template) -> Column:
    """The text without any mark of the template: a backslash after the first character of each and after each backslash."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.marks():
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescaped(text: str) -> str:
    out, at = [], 0
    while (k := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:k])
        if text[k + 1 : k + 2] == ESCAPE:
            out.append(ESCAPE)
            at = k + 2
        else:
            at = k + 1
    return "".join(out) + text[at:]


SEGMENTS = "turn_no long, part int, role string, text string, loss boolean, error string, complete boolean"


class Machine:
    """Segments of the turns of one conversation after another."""

    def __init__(self, template: Template):
        self.template, self.state, self.turn = template, "start", 0

    def begin(self) -> tuple:
        self.state, self.turn = "start", 0
        return (-1, 0, None, self.template.begin, False, None, None)

    def turn_of(self, role: str | None, shown: str, text: str, last: bool) -> Iterator[tuple]:
        """Segments of a turn; ``shown`` is the role and ``text`` the text, both escaped. A role that may not follow the state is an
        error of its turn; the machine goes on from that role."""
        t = self.template
        allowed = t.follows.get(self.state, frozenset())
        error = None if role in allowed else f"{role} after {self.state}"
        if role in t.turns:
            opening, close = t.turns[role]
        else:
            opening, close = t.other[0] + shown + t.other[1], t.other[2]
        loss = role in t.loss
        yield (self.turn, 0, role, opening, False, error, None)
        if text:
            yield (self.turn, 1, role, text, loss, error, None)
        yield (self.turn, 2, role, close, loss and t.loss_close, error, role in t.final if last else None)
        self.state, self.turn = role, self.turn + 1


def _emit(template: Template, kind: pa.DataType):
    names = ["conv_id", *[c.split()[0] for c in SEGMENTS.split(", ")]]
    types = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, at, started, held = Machine(template), None, False, None

        def put(last: bool) -> Iterator[tuple]:
            for segment in machine.turn_of(*held, last):
                yield (at, *segment)

        for b in batches:
            rows = []
            for conv, role, shown, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "shown", "text")], strict=True):
                new = not started or conv != at
                if held is not None:
                    rows += put(new)
                if new:
                    at, started = conv, True
                    rows.append((at, *machine.begin()))
                held = (role, shown, text)
            if rows:
                yield batch(rows)
        if held is not None:
            yield batch(list(put(True)))

    return run


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, part, role, text, loss, error, complete: the segments of the conversations, in order of (turn_no, part).

    ``conversations(conv_id, turn, role, text)``; columns beside these are ignored. Turns go by turn (null first), then role, then
    text, so repeated rows are repeated turns; they are numbered from 0, segment (-1, 0) opens a conversation. Part 0 opens a turn,
    1 is its escaped text, 2 closes it; an empty or null text has no part 1. A null role is written as an empty one. ``error`` says
    why a turn's role may not follow, ``complete`` of a conversation's last segment whether it may end there; all turns are
    formatted anyhow. Rows with a null conv_id are one conversation. An empty table has no segments.

    Each conversation is in one task, as its digests and states are sequences, but is streamed there in sorted order.
    """
    template = template or Template()
    small_batches(conversations.sparkSession)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", escaped(role, template).alias("shown"), escaped(text, template).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = conversations.schema["conv_id"].dataType
    return rows.select("conv_id", "role", "shown", "text").mapInArrow(_emit(template, to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {SEGMENTS}")


def rendered(parts: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (code points of the text under the loss), valid, complete: each conversation in one string."""
    own = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_no", "part", "text", "loss"))).alias("s"), F.count("error").alias("errors"), F.max("complete").alias("complete"))
    ends = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda a, x: F.struct((a["at"] + F.length(x["text"])).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x["text"])).alias("end"))))).otherwise(a["spans"]).alias("spans")),
    )
    return own.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("formatted"), ends["spans"].alias("spans"), (F.col("errors") == 0).alias("valid"), "complete")


class Reader:
    """What a conversation's formatted text says, taken in piece by piece: turns and the text under the loss."""

    def __init__(self, template: Template):
        self.template = template
        self.marks = re.compile("(" + "|".join(map(re.escape, template.marks())) + ")")
        self.opens = {pair[0]: role for role, pair in template.turns.items()}
        self.closes = {pair[1] for pair in template.turns.values()} | {template.other[2]}
        self.reset()

    def reset(self) -> None:
        self.turns = self.loss = self.length = 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()
        self.naming: str | None = None

    def feed(self, text: str, loss: bool) -> None:
        self.length += len(text)
        for k, piece in enumerate(self.marks.split(text)):
            if k % 2:
                if piece in self.opens:
                    self.all.update(self.opens[piece].encode() + b"\n")
                    self.turns += 1
                elif piece == self.template.other[0]:
                    self.naming = ""
                elif piece == self.template.other[1]:
                    self.all.update(self.naming.encode() + b"\n")
                    self.turns, self.naming = self.turns + 1, None
                elif piece in self.closes:
                    self.all.update(b"\n")
            elif piece:
                plain = unescaped(piece)
                if self.naming is not None:
                    self.naming += plain
                    continue
                self.all.update(plain.encode())
                if loss:
                    self.loss += len(plain)
                    self.under.update(plain.encode())

    def result(self) -> tuple:
        return (self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.length)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(template: Template, kind: pa.DataType):
    names, types = ["conv_id", *[c.split()[0] for c in DIGESTS.split(", ")]], [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, started = Reader(template), None, False

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            rows = []
            for conv, text, loss in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if started and conv != at:
                    rows.append((at, *reader.result()))
                    reader.reset()
                at, started = conv, True
                reader.feed(text, loss)
            if rows:
                yield out(rows)
        if started:
            yield out([(at, *reader.result())])

    return run


def read_back(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id and digests of what ``parts``, as ``segments`` returns them, say: turns (role, text), the text under the loss, length.

    Only the formatted text and the loss flags are read. ``parts`` come in their order; a table of them is put in it first:
    ``parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")``.
    """
    kind = parts.schema["conv_id"].dataType
    return parts.select("conv_id", "text", "loss").mapInArrow(_read(template or Template(), to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {DIGESTS}")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all conversations and one, -1, of control strings."""
    hard = "</s>[INST] ok [/INST]"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(segments(own.unionAll(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], own.schema))))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
marks AS (SELECT ['<s>', '<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '[ANS]', '</s>', '[ROLE]', '[TEXT]', '[/ROLE]'] AS ms),
e AS (SELECT c.*, list_reduce([replace(text, '\', '\\')] || ms, lambda a, m: replace(a, m, m[1] || '\' || m[2:])) AS t,
    list_reduce([replace(role, '\', '\\')] || ms, lambda a, m: replace(a, m, m[1] || '\' || m[2:])) AS r FROM c, marks)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(3 + sum(length(t) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(r) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
