"""Conversations rebuilt from an event log and rendered for training.

Events carry a conversation, a sequence number, the message they speak of, a kind and a text:

* ``message`` starts a message, with its role and first text;
* ``delta`` appends streamed text to it;
* ``edit`` replaces its text;
* ``regenerate`` empties it for a new answer, and drops the messages after it that were there before.

Logs are dealt by conversation and message and sorted by sequence, so a task folds one message at
a time and a conversation with a third of all events is folded by many tasks. Messages are then
dealt by conversation, sorted and rendered one after the other: a task holds one message,
never a whole conversation. The output has one row per rendered turn; the rows of a conversation, put
together in order, are its formatted text.

A turn is ``<s>[INST] role`` + line end + text + ``[/INST]</s>`` + line end. Inside role and text a backslash is
doubled and a control string gets a backslash after its first character, so no text can start or
end a turn, and unescaping gives every text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import arrow_type, as_text, rows_of, shared_folder

OPEN, MIDDLE, CLOSE = "<s>[INST] ", "\n", "[/INST]</s>\n"
_CONTROL = re.compile(r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])")
_TURN = re.compile(r"<s>\[INST\] ((?:[^\\\n]|\\.)*)\n(.*)\[/INST\]</s>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """Like a text, and without line ends."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its escaped text starts and ends in it."""
    head, body = OPEN + escape_role(role) + MIDDLE, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turn(turn: str) -> tuple[str, str]:
    found = _TURN.fullmatch(turn)
    if not found:
        raise ValueError("not a turn of this template")
    return unescape_role(found[1]), unescape(found[2])


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, message, part, born, reset, role, text``: each message in its last state.

    ``message`` and ``part`` (0 if events have none) name a message and give its place. ``born`` is the sequence number that
    started it (or first names it), ``reset`` that of its last regeneration (null if none). Events of one message
    with equal numbers go by kind (message, regenerate, edit, delta), then role and text; null
    roles and texts are empty. A message that only ever had deltas has an empty role.
    """
    rank = F.expr("CASE kind WHEN 'message' THEN 0 WHEN 'regenerate' THEN 1 WHEN 'edit' THEN 2 ELSE 3 END")
    part = F.col("part") if "part" in events.columns else F.lit(0)
    log = events.select("conv_id", F.col("message").cast("long").alias("message"), part.cast("long").alias("part"),
                        F.col("seq").cast("long").alias("seq"), rank.alias("rank"), as_text(F.col("role")).alias("role"), as_text(F.col("text")).alias("text"))
    conv_type = arrow_type(log, "conv_id")
    schema = pa.schema([("conv_id", conv_type), ("message", pa.int64()), ("part", pa.int64()), ("born", pa.int64()),
                        ("reset", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, born, reset, role, parts = None, None, None, "", []
        for batch in batches:
            done = []
            for *name, seq, rank, who, text in rows_of(batch):
                if at != name:
                    if at is not None:
                        done.append((*at, born, reset, role, "".join(parts)))
                    at, born, reset, role, parts = name, seq, None, "", []
                if rank == 0:
                    born, role, parts = seq, who, [text]
                elif rank == 1:
                    reset, parts = seq, [text]
                elif rank == 2:
                    parts = [text]
                else:
                    parts.append(text)
            yield _batch(done, schema)
        if at is not None:
            yield _batch([(*at, born, reset, role, "".join(parts))], schema)

    kind = log.schema["conv_id"].dataType.simpleString()
    return log.repartition("conv_id", "message", "part").sortWithinPartitions(*log.columns).mapInArrow(
        messages, f"conv_id {kind}, message long, part long, born long, reset long, role string, text string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id, turn, formatted, loss_start, loss_end``: one row per turn, numbered from 0.

    The loss mask covers the escaped text of turns whose role is ``trained``, as code points of the
    turn; both ends are null elsewhere. Messages dropped by a regeneration before them are left out.
    """
    schema = pa.schema([("conv_id", arrow_type(messages, "conv_id")), ("turn", pa.int64()), ("formatted", pa.string()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, reset = object(), 0, None
        for batch in batches:
            done = []
            for conv, born, again, role, text in rows_of(batch):
                if at != conv:
                    at, number, reset = conv, 0, None
                dropped = reset is not None and born is not None and born < reset
                if again is not None:
                    reset = again if reset is None else max(reset, again)
                if not dropped:
                    turn, start, end = render_turn(role, text)
                    done.append((conv, number, turn, *((start, end) if role == trained else (None, None))))
                    number += 1
            yield _batch(done, schema)

    kind = messages.schema["conv_id"].dataType.simpleString()
    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", "message", "part")
    return dealt.select("conv_id", "born", "reset", "role", "text").mapInArrow(
        turns, f"conv_id {kind}, turn long, formatted string, loss_start long, loss_end long")


def digest(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from rendered turns.

    Hashes run on from turn to turn, so a task holds one turn of the conversation it is at.
    """
    schema = pa.schema([("conv_id", arrow_type(formatted, "conv_id")), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, turns, loss, loss_chars, chars = None, 0, None, None, 0, 0
        for batch in batches:
            done = []
            for conv, turn, start, end in rows_of(batch):
                if n == 0 or at != conv:
                    if n:
                        done.append((at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    at, n, turns, loss, loss_chars, chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, text = read_turn(turn)
                n, chars = n + 1, chars + len(turn)
                turns.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(turn[start:end])
                    loss_chars += len(masked)
                    loss.update(masked.encode())
            yield _batch(done, schema)
        if n:
            yield _batch([(at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], schema)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns (``conv_id, turn, role, text``): one ``message`` event per row.

    Rows of one conversation and turn, repeated rows too, are messages of their own, in order of role and text.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("message"), as_text(F.col("role")).alias("role"), as_text(F.col("text")).alias("text"))
    order = Window.partitionBy("conv_id", "message").orderBy("role", "text")
    return rows.withColumns({"part": F.row_number().over(order), "seq": F.col("message"), "kind": F.lit("message")})


def streamed_events(conversations: DataFrame, pieces: int = 8) -> DataFrame:
    """The log that an interface would have written for a table of finished turns, with the same final texts.

    Most turns start empty and are streamed in up to ``pieces`` deltas. One turn in four (by a hash of its place) starts with
    a draft that is later edited; one in four streams an answer that is regenerated and streamed anew, unless
    it has no number or shares it with other rows, whose order a regeneration would upset.
    """
    rows = events_of(conversations).drop("seq", "kind")
    rows = rows.withColumn("rows", F.count("*").over(Window.partitionBy("conv_id", "message")))
    step = F.greatest(F.ceil(F.length("text") / pieces), F.lit(1)).cast("int")
    kind = F.pmod(F.xxhash64("conv_id", "message", "part", "role"), F.lit(4))

    def event(k: int | Column, name: str, text: Column, role: Column | None = None) -> Column:
        return F.struct((F.lit(k) if isinstance(k, int) else k).cast("long").alias("k"), F.lit(name).alias("kind"),
                        (role if role is not None else F.lit(None).cast("string")).alias("said_by"), text.alias("said"))

    start = F.col("text").substr(F.lit(1), F.col("step"))
    deltas = F.filter(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: event(
        8 + i, "delta", F.col("text").substr(i * F.col("step") + 1, F.col("step")))), lambda e: e["said"] != "")
    empty = F.lit("")
    again = (F.col("turned") == 0) & (F.col("rows") == 1) & (F.abs("message") < 1 << 50)
    log = (F.when(again, F.concat(F.array(event(0, "message", empty, F.col("role")), event(1, "delta", start), event(2, "regenerate", empty)), deltas))
           .when(F.col("turned") == 1, F.array(event(0, "message", start, F.col("role")), event(3, "delta", F.lit("...")), event(4, "edit", F.col("text"))))
           .otherwise(F.concat(F.array(event(0, "message", empty, F.col("role"))), deltas)))
    spread = rows.withColumns({"step": step, "turned": kind}).select("conv_id", "message", "part", F.inline(log))
    base = F.when(F.abs("message") < 1 << 50, F.col("message")).otherwise(0)
    return spread.select("conv_id", "message", "part", (F.coalesce(base, F.lit(0)) * 64 + F.col("k")).alias("seq"), "kind",
                         F.col("said_by").alias("role"), F.col("said").alias("text"))


def write_and_read(conversations: DataFrame) -> DataFrame:
    """Folds the streamed log of all conversations, renders them, writes the turns in the shared folder and returns their ``digest``.

    A null text or role is empty; a null conversation or turn number is a value like any other and
    comes first; an empty table gives no rows.
    """
    folder = shared_folder(conversations.sparkSession, "formatted")
    render(fold(streamed_events(conversations))).write.parquet(folder)
    return digest(conversations.sparkSession.read.parquet(folder))
