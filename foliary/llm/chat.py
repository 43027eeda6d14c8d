"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. Events are partitioned by conversation and message, sorted by sequence and folded:
``message`` and ``edit`` set a message's text, ``regenerate`` empties it, ``delta`` adds to it. Final messages
are rendered with a template whose control strings are escaped inside texts, and read back from what was written.
One row holds one turn, so no task ever holds a conversation; a reader streams the sorted turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BEGIN, END = "<s>", "</s>"
#: Opening and closing of a turn by role; other roles carry their name, escaped, in a [TURN] mark.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " " + END)}
_CONTROL = re.compile(r"(<)(/?s>)|(\[)(/?(?:SYS|INST|ANS|TURN))")
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string."""
    return _CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: a double backslash is one, a single one is none."""
    return _ESCAPED.sub(r"\1", text)


def render(role: str | None, text: str, first: bool) -> tuple[str, int, int]:
    """One formatted turn, and where in it the loss counts (start, end; equal where it does not)."""
    opening, closing = MARKS.get(role or "", ("", " [/TURN]"))
    if not opening:
        opening = "[TURN null] " if role is None else f"[TURN ={escape(role)}[/TURN] "
    body = escape(text)
    head = (BEGIN if first else "") + opening
    start = len(head)
    return head + body + closing, start, start + len(body) if role == "assistant" else start


def read(turn: str) -> tuple[str | None, str]:
    """Role and text of one formatted turn."""
    s = turn.removeprefix(BEGIN)
    for role, (opening, closing) in MARKS.items():
        if s.startswith(opening):
            if not s.endswith(closing):
                raise ValueError("a turn does not end")
            return role, unescape(s[len(opening) : len(s) - len(closing)])
    if s.startswith("[TURN null] "):
        role, at = None, len("[TURN null] ")
    elif s.startswith("[TURN ="):
        at = s.index("[/TURN] ")  # an escaped name cannot hold it
        role, at = unescape(s[len("[TURN =") : at]), at + len("[/TURN] ")
    else:
        raise ValueError("a turn does not begin")
    return role, unescape(s[at : len(s) - len(" [/TURN]")])


def fold(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text of every message left at the end of the log ``events`` (conv_id, msg, seq, op, role, text).

    Null texts are empty, unknown or null ops count as message, null seq come first; events that tie in seq apply in the order of op,
    then text. The role is that of the last message event, or else of any event. Conversations and messages may have null ids.
    """
    e = events.select("conv_id", "msg", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("op"), F.lit("message")).alias("op"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"))
    item = F.struct("seq", "op", "text", "role")
    logs = e.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(item)).alias("log"))
    # the text starts at the last event that is no delta
    last = F.expr("size(log) - coalesce(nullif(array_position(transform(reverse(log), x -> x.op <> 'delta'), true), 0), size(log)) + 1")
    text = F.expr("array_join(transform(slice(log, cut, size(log)), x -> if(x.op = 'regenerate', '', x.text)), '')")
    role = F.expr("coalesce(try_element_at(filter(log, x -> x.op not in ('delta', 'edit', 'regenerate') and x.role is not null), -1).role, try_element_at(filter(log, x -> x.role is not null), -1).role)")
    return logs.withColumn("cut", last).select("conv_id", "msg", role.alias("role"), text.alias("text"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), formatted, loss_start, loss_end (places in the conversation's text) per message of ``messages``.

    ``messages`` has conv_id, msg (its order; null first), role, text. A conversation's formatted text is its turns' texts joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        turn = at = 0
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, turn, at = conv, 0, 0
                s, lo, hi = render(role, text or "", turn == 0)
                rows.append((conv, turn, s, at + lo, at + hi))
                turn, at = turn + 1, at + len(s)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.repartition(n, "conv_id").sortWithinPartitions("conv_id", "msg", "role", "text").mapInArrow(run, "conv_id bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None

        def done(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*([r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            out = []
            for conv, s, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv != state[0]:
                    if state:
                        out.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read(s)
                state[2].update(f"{role or ''}\n{text}\n".encode())
                under = unescape(s[lo - state[5] : hi - state[5]])
                state[4].update(under.encode())
                state[1], state[3], state[5] = state[1] + 1, state[3] + len(under), state[5] + len(s)
            if out:
                yield done(out)
        if state:
            yield done([state])

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def reconstruct(events: DataFrame) -> DataFrame:
    """The formatted turns of a log, written to the shared folder."""
    return materialise(format_chats(fold(events)), "chats")
