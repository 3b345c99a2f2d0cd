"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

A conversation is streamed, never gathered: rows are dealt by conversation, sorted by turn within a partition (Spark
spills the sort), and the machine holds a state of constant size. Control strings inside texts are escaped by a
backslash code that unescape() inverts exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows read and sent together at most, and characters that end a batch sent.
BATCH, BATCH_CHARS = 1024, 4_000_000


@dataclass(frozen=True)
class Turn:
    """What stands around a turn's text, and whether the text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: how each role is written; other: any role besides, its name escaped in place of {role}.

    moves: the machine's next state by state and role; final: states in which a conversation may end."""

    roles: Mapping[str, Turn]
    other: Turn
    controls: tuple[str, ...]
    moves: Mapping[str, Mapping[str, str]]
    start: str
    final: frozenset[str]

    @property
    def control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))

    def escape(self, text: str) -> str:
        """Backslashes are doubled, the n-th control string becomes backslash, n, semicolon."""
        numbers = {c: i for i, c in enumerate(self.controls)}
        return re.sub(r"\\|" + self.control.pattern, lambda m: "\\\\" if m[0] == "\\" else f"\\{numbers[m[0]]};", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(?:\\|(\d+);)", lambda m: "\\" if m[1] is None else self.controls[int(m[1])], text)

    def around(self, role: str) -> Turn:
        if role in self.roles:
            return self.roles[role]
        return Turn(self.other.before.replace("{role}", self.escape(role)), self.other.after, self.other.loss)


INSTRUCT = Template(
    roles={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=Turn("<<ROLE>>{role}<</ROLE>>\n", "\n<<END>>\n"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<END>>"),
    moves={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    final=frozenset({"answered"}),
)

SEGMENTS = "struct<conv_id:{0},segment:bigint,turn_no:bigint,text:string,loss:boolean,state:string,problem:string>"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns))


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: each conversation in one partition, by turn (nulls first), then role, then text."""
    chosen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of every conversation of turns (conv_id, turn, role, text), three a turn: mark, text, mark.

    loss is set on exactly the texts whose role is learned. state is the machine's after the turn; problem is null
    while the turn order is valid, then the first violation, to the conversation's end; its segments are still given.
    Null roles and texts are empty; an empty role is another role. Equal turn numbers: by role, then text. A null
    conv_id is a conversation too. Each conversation is in one partition, in order. An empty table gives no rows."""
    out = SEGMENTS.format(turns.schema["conv_id"].dataType.simpleString())
    key_type = to_arrow_type(turns.schema["conv_id"].dataType)
    frame = in_order(turns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, segment, number, state, problem = object(), 0, 0, template.start, None
            for conv, _, role, text in _rows(batches):
                if conv != held:
                    held, segment, number, state, problem = conv, 0, 0, template.start, None
                to = template.moves.get(state, {}).get(role)
                if to is None:
                    problem = problem or f"turn {number}: {role or 'no role'} after {state}"
                else:
                    state = to
                around = template.around(role)
                for part, loss in ((around.before, False), (template.escape(text), around.loss), (around.after, False)):
                    yield conv, segment, number, part, loss, state, problem
                    segment += 1
                number += 1

        schema = pa.schema([("conv_id", key_type), ("segment", pa.int64()), ("turn_no", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("problem", pa.string())])
        yield from _batches(rows(), schema)

    return frame.mapInArrow(run, out.removeprefix("struct<").removesuffix(">"))


def read_back(pieces: Iterable[str], template: Template) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation given in pieces, which may end at any mark."""
    by_open = {template.control.match(t.before)[0]: (role, t) for role, t in template.roles.items()}
    other_open = template.control.match(template.other.before)[0]
    pending = ""
    for piece in pieces:
        pending += piece
        while (m := template.control.match(pending)) is not None:
            if m[0] == other_open:
                head = re.compile("(.*?)".join(re.escape(p) for p in template.other.before.split("{role}")), re.S).match(pending)
                if head is None:
                    break
                role, turn, at = template.unescape(head[1]), template.other, head.end()
            else:
                role, turn = by_open[m[0]]
                at = len(turn.before)
            mark = template.control.search(turn.after)[0]
            end = pending.find(mark, at)
            end -= turn.after.index(mark)
            if end < at or len(pending) < end + len(turn.after):
                break
            yield role, template.unescape(pending[at:end])
            pending = pending[end + len(turn.after) :]
    if pending:
        raise ValueError("the text ends within a turn")


DIGESTS = "conv_id {0}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, problem string"


def digests(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What can be read back from format_segments(): one row per conversation, hashed as it streams by."""
    key, key_type = segments.schema["conv_id"].dataType.simpleString(), to_arrow_type(segments.schema["conv_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            source = _rows(batches)
            row = next(source, None)
            while row is not None:
                conv, chars, loss_chars, turns = row[0], 0, 0, 0
                all_turns, learned, last = hashlib.sha256(), hashlib.sha256(), row

                def pieces() -> Iterator[str]:
                    nonlocal row, chars, loss_chars, last
                    while row is not None and row[0] == conv:
                        _, _, _, text, loss, _, _ = last = row
                        chars += len(text)
                        if loss:
                            plain = template.unescape(text)
                            loss_chars += len(plain)
                            learned.update(plain.encode("utf-8", "surrogatepass"))
                        row = next(source, None)
                        yield text

                for role, text in read_back(pieces(), template):
                    turns += 1
                    all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                problem = last[6] or (None if last[5] in template.final else f"ends after {last[5]}")
                yield conv, turns, all_turns.hexdigest(), loss_chars, learned.hexdigest(), chars, problem is None, problem

        schema = pa.schema([("conv_id", key_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("problem", pa.string())])
        yield from _batches(rows(), schema)

    return segments.mapInArrow(run, DIGESTS.format(key))
