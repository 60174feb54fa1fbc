"""Chat formatting by replaying events: conversations are logs, folded into messages and rendered.

An event has conv_id, seq (place in the log), message (which message it belongs to), kind, role, text:

* ``message``: the whole message; ``edit``: replaces what the message said so far; ``regenerate``: starts the message anew;
* ``delta``: a streamed part, added to the end; ``delete``: the message goes (a later event brings it back).

Role is the last one named. Messages stand in the order of their first event, then of ``message``.

The log is range-sorted by (conv_id, first, message, seq): the rows of a message stay together, and a conversation of a third of all rows
spreads over as many tasks as it needs. Each task folds its sorted rows as a stream and writes *segments* of whole messages, of about
``SEGMENT_CHARS``; a conversation is its segments in order. Nothing is gathered by conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``;
a line break in a role becomes ``\\n``; so no text can look like a mark, and ``parsed`` gives back every turn. ``loss`` has the spans
(code points of the segment) of the assistants' escaped texts.

Edge cases: null role or text is empty; null ``conv_id`` is a conversation of its own; null ``turn`` sorts first; rows with the same turn go by
role, then text; repeated rows are repeated turns; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.ngram_join import groups_for
from tillroll.operators.lineage import written

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"
SEGMENT_CHARS = 1 << 20

_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends there."""
    head = START + escape(role).replace("\n", "\\n") + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation or segment."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def fold(events: list[tuple[str, str | None, str | None]]) -> tuple[str, str] | None:
    """(kind, role, text) in order of the log to role and text of the message, or None if it was deleted."""
    role, parts, alive = "", [], False
    for kind, who, text in events:
        role = who if who is not None else role
        if kind == "delete":
            alive, parts = False, []
            continue
        if kind != "delta":
            parts = []
        alive = True
        parts.append(text or "")
    return (role, "".join(parts)) if alive else None


SEGMENTS = "conv_id long, segment long, formatted string, turns long, loss array<struct<start:long,end:long>>"
SEGMENTS_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("turns", pa.int64()),
                            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to segments; ``segment`` orders those of a conversation, also over tasks."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    number, conv, message, events = 0, None, None, []
    parts: list[str] = []
    loss: list[dict] = []
    size = turns = 0
    out: list[tuple] = []

    def end_message() -> None:
        nonlocal size, turns
        if events and (found := fold(events)):
            text, a, b = render(*found)
            if found[0] == LEARNED:
                loss.append({"start": size + a, "end": size + b})
            parts.append(text)
            size += len(text)
            turns += 1
        events.clear()

    def end_segment() -> None:
        nonlocal size, turns, number
        if turns:
            out.append((conv, base + number, "".join(parts), turns, list(loss)))
            number += 1
        parts.clear()
        loss.clear()
        size = turns = 0

    fresh = True
    for batch in batches:
        for c, m, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "message", "kind", "role", "text")), strict=True):
            if fresh or c != conv or m != message:
                end_message()
                if not fresh and (c != conv or size >= SEGMENT_CHARS):
                    end_segment()
                conv, message, fresh = c, m, False
            events.append((kind, role, text))
        if len(out) >= 1000 or sum(len(x[2]) for x in out) >= SEGMENT_CHARS:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SEGMENTS_ARROW, strict=True)], schema=SEGMENTS_ARROW)
            out = []
    end_message()
    end_segment()
    if out:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SEGMENTS_ARROW, strict=True)], schema=SEGMENTS_ARROW)


def formatted(events: DataFrame) -> DataFrame:
    """Segments of the rendered conversations; ``events`` has conv_id, seq, message (string), kind, role, text."""
    firsts = events.groupBy("conv_id", "message").agg(F.min("seq").alias("first"))
    named = events.select("conv_id", "seq", "message", "kind", "role", "text").join(
        firsts.withColumnsRenamed({"conv_id": "_c", "message": "_m"}),
        F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("message").eqNullSafe(F.col("_m")),
    ).drop("_c", "_m")
    return ranged(named)


def ranged(events: DataFrame) -> DataFrame:
    n = groups_for(events)
    spread = events.repartitionByRange(n, "conv_id", "first", "message").sortWithinPartitions("conv_id", "first", "message", "seq")
    return spread.select("conv_id", "message", "kind", "role", "text").mapInArrow(segments, SEGMENTS)


def whole_messages(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns: every row is a message; equal rows are told apart by their number."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # Equal rows are counted on the map side and only then told apart.
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return counted.select(
        "conv_id", F.col("turn").alias("first"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).withColumn("message", F.concat("role", F.lit("\x00"), "text", F.lit("\x00"), F.lpad(F.col("copy").cast("string"), 12, "0")))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_segments long"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted segments back; a conversation is hashed as a stream, so its length doesn't matter."""
    conv, state = None, None

    def row() -> tuple:
        turns, loss, n, chars, total, count = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, count

    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_segments"]
    for batch in batches:
        out = []
        for c, text, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    out.append(row())
                conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
            for role, said in parsed(text):
                state[0].update(f"{role}\n{said}\n".encode())
                state[2] += 1
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                state[1].update(said.encode())
                state[3] += len(said)
            state[4] += len(text)
            state[5] += 1
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], fields)
    if state is not None:
        yield pa.record_batch([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row()], fields)


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from what was rendered."""
    tricky = f"{END.strip()}{START}assistant ok"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    out = written(ranged(whole_messages(given.unionByName(extra))))
    # Only conversations that were cut into several segments have to be brought together; the hash is a chain, so a task streams each.
    sorted_ = out.repartition(groups_for(out), "conv_id").sortWithinPartitions("conv_id", "segment")
    return sorted_.select("conv_id", "formatted", "loss").mapInArrow(digests, DIGESTS)
