"""Chat formatting: a role machine checks the order of turns, a declarative template gives segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import map_arrow

#: Code points of formatted text that travel in one row, unless one turn is longer.
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are learned from, and which order of roles is right.

    ``heads`` opens a turn of a role and ``other`` one of any other role, with the role's name for ``{}``; ``tail`` closes
    a turn. ``controls`` are the strings that a reader takes for marks: inside texts and role names a backslash is put
    before each place where one begins, and before each backslash. ``moves`` gives for each state and role the next
    state; a role without a move leads to the state "wrong", which is never left. A conversation is valid if it ends in
    one of ``ends``.
    """

    heads: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role {}: "
    tail: str = " </turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>", ": ")
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    ends: tuple[str, ...] = ("assistant",)

    def states(self) -> list[str]:
        return sorted({s for s, _ in self.moves} | set(self.moves.values()) | {"start", "wrong"})

    def step(self, state: str, role: str) -> str:
        return self.moves.get((state, role), "wrong")

    def escape(self, text: str, controls: tuple[str, ...] | None = None) -> str:
        marks = "|".join(map(re.escape, self.controls if controls is None else controls))
        return re.sub(rf"(?={marks})|(?=\\)", r"\\", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn, each with its loss flag. A text's own ": " needs no mark."""
        head = self.heads.get(role)
        head = self.other.format(self.escape(role)) if head is None else head
        return [(head, False), (self.escape(text, tuple(c for c in self.controls if c != ": ")), role in self.learned), (self.tail, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, int, int]]:
        """The turns of formatted text: role, and where the escaped text begins and ends."""
        names = {head: role for role, head in self.heads.items()}
        opening, closing = self.other.split("{}")
        part = r"(?:\\.|(?!{}).)*?"
        head = "|".join(re.escape(h) for h in names)
        turn = re.compile(rf"(?:({head})|{re.escape(opening)}({part.format(re.escape(closing))}){re.escape(closing)})({part.format(re.escape(self.tail.strip()))}){re.escape(self.tail)}", re.DOTALL)
        at = 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError("not a formatted turn")
            yield names[m[1]] if m[1] is not None else unescape(m[2]), m.start(3), m.end(3)
            at = m.end()


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, role and text in order of conversation and turn, dealt out evenly however long a conversation is."""
    turns = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role"]
    # Texts order repeated turns only; a prefix orders them as the whole text does.
    return turns.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")


def format_turns(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """The segments of every turn: conv_id, turn, role, segment (place in the turn), text, loss.

    A missing text or role is empty; a role that the template has no head for is named in the mark. Rows without conv_id
    are one conversation. Repeated turns follow one another by role, then text. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                out += [(conv, turn, role, k, s, loss) for k, (s, loss) in enumerate(template.segments(role, text))]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "turn", "role", "segment", "text", "loss"])

    return map_arrow(ordered(rows), run, "conv_id long, turn long, role string, segment int, text string, loss boolean")


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Formatted text in chunks of whole turns: conv_id, part, chunk, formatted, spans (start, stop of learned text), moves.

    A range of the ordered turns may begin or end within a conversation, so a chunk carries, for every state that the role
    machine may be in before it, the state after it; the chunks of a conversation follow one another by part and chunk.
    """
    states = template.states()

    def run(batches):
        part = 0
        conv, chunk, text, spans, size, after = None, 0, [], [], 0, states

        def row():
            return (conv, chunk, "".join(text), [{"start": a, "stop": b} for a, b in spans], list(after))

        def pack(out):
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "chunk", "formatted", "spans", "moves"])

        out, held = [], 0
        for batch in batches:
            for c, role, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if text and (c != conv or size >= _CHUNK):
                    out.append(row())
                    held += size
                    chunk, text, spans, size, after = (chunk + 1 if c == conv else 0), [], [], 0, states
                conv = c
                for s, loss in template.segments(role, t):
                    if loss:
                        spans.append((size, size + len(s)))
                    text.append(s)
                    size += len(s)
                after = [template.step(s, role) for s in after]
                if held >= 8 * _CHUNK:
                    yield pack(out)
                    out, held = [], 0
        if text:
            out.append(row())
        if out:
            yield pack(out)

    chunks = map_arrow(ordered(rows).select("conv_id", "role", "text"), run,
                       "conv_id long, chunk int, formatted string, spans array<struct<start:long,stop:long>>, moves array<string>")
    return chunks.withColumn("part", F.spark_partition_id())


def read_back(chunks: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse formatted conversations and digest what is read: one row per conversation.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline of every turn), loss_chars and loss_sha256 (of the
    learned text), formatted_chars, valid (the machine accepts the order of roles). A conversation's chunks come one after
    the other, so the longest needs no more memory than its longest chunk.
    """
    states = template.states()
    start = states.index("start")

    def run(batches):
        conv, open_ = None, False
        turns, loss, n, learned, size, state = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, start
        out = []

        def close():
            out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), size, states[state] in template.ends))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "moves"))
            for c, formatted, spans, moves in zip(*columns, strict=True):
                if open_ and c != conv:
                    close()
                    turns, loss, n, learned, size, state = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, start
                conv, open_ = c, True
                for role, a, b in template.read(formatted):
                    turns.update(f"{role}\n{unescape(formatted[a:b])}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    text = unescape(formatted[s["start"] : s["stop"]])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    learned += len(text)
                size += len(formatted)
                state = states.index(moves[state])
            if len(out) > 10_000:
                yield _digests(out)
                out.clear()
        if open_:
            close()
        if out:
            yield _digests(out)

    rows = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "formatted", "spans", "moves")
    return map_arrow(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _digests(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
