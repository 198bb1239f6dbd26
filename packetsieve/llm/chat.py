"""Chat formatting with a grammar that reads back exactly what was written.

A conversation is a run of turns; each has marks of its own::

    conversation := turn*
    turn         := "<<SYS>> " text " <</SYS>>"      (system)
                  | "[INST] " text " [/INST]"        (user)
                  | "<s> " text " </s>"              (assistant)
                  | "[ROLE] " text " [SEP] " text " [/ROLE]"
    text         := any characters, in which each control string has a backslash before it

A reader takes one turn after the other and never goes back. In a text, k + 1
backslashes before a control string stand for k backslashes and the string
itself. A text is first written as it is; where reading it back gives something
else, its control strings are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE] ", " [SEP] ", " [/ROLE]")
ROLE_OF = {opening.strip(): role for role, (opening, _) in MARKS.items()}
CONTROL = re.compile(r"(\\*)(\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[SEP\])")
LEARNED = "assistant"
#: Code points of one stored part of a conversation, unless a single turn is longer.
PART_CHARS = 1 << 16

Turn = tuple[str, str]


class GrammarError(ValueError):
    """The text is not a conversation in this grammar."""


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def rendered(turn: Turn, escaped: bool) -> tuple[str, int, int]:
    """A turn as text, and where its content starts and ends in it."""
    role, text = turn
    if escaped:
        role, text = escape(role), escape(text)
    opening, closing = MARKS[role] if role in MARKS else (OTHER[0] + role + OTHER[1], OTHER[2])
    return opening + text + closing, len(opening), len(opening) + len(text)


def _text_until(source: str, start: int, closing: str) -> tuple[str, int]:
    """The content from ``start`` to the ``closing`` mark, unescaped, and where the mark ends."""
    at = start
    while True:
        found = CONTROL.search(source, at)
        if found is None:
            raise GrammarError(f"no {closing.strip()} after {start}")
        if not found[1]:
            end = found.start(2) - 1
            if found[2] != closing.strip() or end < start or source[end] != " ":
                raise GrammarError(f"{found[2]} at {found.start(2)} in place of {closing.strip()}")
            return unescape(source[start:end]), found.end()
        at = found.end()


def _opened(source: str, at: int) -> tuple[str, int]:
    """The control string that stands at ``at``, and where the content after it starts."""
    found = CONTROL.match(source, at)
    if found is None or found[1] or not source.startswith(" ", found.end()):
        raise GrammarError(f"no turn starts at {at}")
    return found[2], found.end() + 1


def parsed(source: str) -> list[Turn]:
    """The turns of a formatted text; deterministic, left to right."""
    turns, at = [], 0
    while at < len(source):
        mark, start = _opened(source, at)
        if mark in ROLE_OF:
            role = ROLE_OF[mark]
            text, at = _text_until(source, start, MARKS[role][1])
        elif mark == OTHER[0].strip():
            role, end = _text_until(source, start, OTHER[1])
            if role in MARKS or not source.startswith(" ", end):
                raise GrammarError(f"role at {start} is not one of its own")
            text, at = _text_until(source, end + 1, OTHER[2])
        else:
            raise GrammarError(f"no turn starts with {mark} at {at}")
        turns.append((role, text))
    return turns


def _reads_back(source: str, turns: list[Turn]) -> bool:
    try:
        return parsed(source) == turns
    except GrammarError:
        return False


def formatted(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Text of the turns, and the spans of what assistants say in it (code points).

    Turns that do not read back are escaped, until all of them do.
    """
    escaped = [False] * len(turns)
    while True:
        parts = [rendered(t, e) for t, e in zip(turns, escaped)]
        text = "".join(p[0] for p in parts)
        if _reads_back(text, turns):
            break
        again = [e or not _reads_back(p[0], [t]) for p, t, e in zip(parts, turns, escaped)]
        if again == escaped:
            if all(escaped):
                raise GrammarError("escaped turns do not read back")
            again = [True] * len(turns)
        escaped = again
    spans, at = [], 0
    for (role, _), (piece, start, end) in zip(turns, parts):
        if role == LEARNED:
            spans.append((at + start, at + end))
        at += len(piece)
    return text, spans


# Spark


PARTS = "conv_id long, part long, text string, loss_start array<int>, loss_end array<int>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted parts of the conversations of a sorted partition, numbered in its order."""
    number = TaskContext.get().partitionId() << 32
    current, turns, size = None, [], 0

    def part() -> pa.RecordBatch:
        text, spans = formatted(turns)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([current], pa.int64()),
                pa.array([number], pa.int64()),
                pa.array([text], pa.string()),
                pa.array([[a for a, _ in spans]], pa.list_(pa.int32())),
                pa.array([[b for _, b in spans]], pa.list_(pa.int32())),
            ],
            ["conv_id", "part", "text", "loss_start", "loss_end"],
        )

    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if turns and (conv_id != current or size >= PART_CHARS):
                yield part()
                number, turns, size = number + 1, [], 0
            current = conv_id
            turns.append((role, text))
            size += len(text)
    if turns:
        yield part()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``text`` and the loss spans (``loss_start``, ``loss_end``) of formatted conversations.

    Turns go by ``turn`` (nulls first, then by role and text); a null role or text
    is empty; rows without ``conv_id`` form one conversation; equal rows are turns
    each. The text of a conversation is that of its parts in their order; most have
    one. Ranges over conversation and turn spread a huge one over tasks. Further
    columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(_parts, PARTS)


READ = "conv_id long, part long, n_turns long, turns string, loss string, chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, turns, losses, sizes = [], [], [], []
        for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            found = parsed(text)
            counts.append(len(found))
            turns.append("".join(f"{role}\n{said}\n" for role, said in found))
            losses.append("".join(unescape(text[a:b]) for a, b in zip(starts, ends)))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(counts, pa.int64()),
                pa.array(turns, pa.string()),
                pa.array(losses, pa.string()),
                pa.array(sizes, pa.int64()),
            ],
            ["conv_id", "part", "n_turns", "turns", "loss", "chars"],
        )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests over the parts of each conversation, which come one after the other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, done = None, []

    def row():
        conv_id, n_turns, turns, loss_chars, loss, chars = state
        return conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for conv_id, _, n_turns, turns, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != conv_id:
                if state is not None:
                    done.append(row())
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += n_turns
            state[2].update(turns.encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += chars
        if done:
            yield batch_of(done)
            done = []
    if state is not None:
        yield batch_of([row()])


def read_conversations(parts: DataFrame) -> DataFrame:
    """Turns, loss text and length of each formatted conversation, as counts and SHA-256 digests.

    Parts are parsed where they lie; a text that is not in the grammar fails the
    job. Digests go over a conversation from its first to its last part, so one
    task streams through it, holding one part at a time.
    """
    read = parts.mapInArrow(_read, READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests, DIGESTS)


def chat_round_trip(conversations: DataFrame) -> DataFrame:
    """Conversations formatted, written, and read back: see :func:`read_conversations`."""
    return read_conversations(written(format_conversations(conversations), "chat"))
