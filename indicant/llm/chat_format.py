"""Chat formatting from event logs.

Events (conv_id, turn, seq, kind, role, text) are folded into final messages, one group a
(conversation, turn), so that even a conversation with most of the log spreads over tasks:

- message: opens a message with its text; a second one for the same turn is a message of its own
- delta: appends text to the last message of the turn (or opens one)
- edit: replaces its text; a non-null role replaces the role
- regenerate: drops its text, later deltas write it anew
- delete: removes it

Messages are rendered where they were folded; only a conversation's digest, which depends on
all its messages in order, is taken from one sorted stream, with a bounded state.  Markers in
texts are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

START, END = "<|im_start|>", "<|im_end|>"
OPEN, SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
MESSAGE = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """'<|' becomes '<\\|', '<\\|' becomes '<\\\\|' and so on: no marker is left and unescape() restores it."""
    return OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted message, start and end of the text in it); the text of assistants is under the loss mask."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log that finished turns would have come from; fold() gives the turns back.

    Assistants stream: a message is opened, a first attempt is dropped by a regeneration, then
    the text comes in two deltas.  Others send the first half and edit it to the whole.  Rows
    of one turn are numbered by role and text; the sequence goes on from row to row.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    half = (F.length("text") / 2).cast("int")
    head, tail = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    none = F.lit(None).cast("string")
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    streamed = F.array(event("message", F.col("role"), F.lit("")), event("delta", none, tail), event("regenerate", none, none), event("delta", none, head), event("delta", none, tail))
    typed = F.array(event("message", F.lit("draft"), head), event("edit", F.col("role"), F.col("text")))
    events = rows.withColumn("n", number).select("conv_id", "turn", "n", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("k", "e"))
    return events.select("conv_id", "turn", (8 * F.col("n") + F.col("k")).cast("long").alias("seq"), "e.kind", "e.role", "e.text")


KEY = ("conv_id", "turn")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, ordinal, role, text) of an event log.

    Nulls: a null role or text is empty, a null kind is a message, null conversations and
    turns are groups of their own and sort first.  Equal (turn, seq) are taken by kind, role and text, so
    ties give one result; repeated message rows are messages each.
    """
    prepare(events.sparkSession)
    log = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    dealt = log.repartition(*KEY).sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ordinal", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        key, messages, out, held = None, [], [], 0

        def close():
            return [{"conv_id": key[0], "turn": key[1], "ordinal": k, "role": role, "text": "".join(parts)} for k, (role, parts) in enumerate(messages)]

        for b in batches:
            for conv, turn, kind, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role", "text"))):
                if key != (conv, turn):
                    if key is not None:
                        out += close()
                    key, messages = (conv, turn), []
                if len(out) >= 1000 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
                held += len(text)
                if kind == "message" or not messages and kind == "delta":
                    messages.append((role or "", [text]))
                elif not messages:
                    continue
                elif kind == "delta":
                    messages[-1][1].append(text)
                elif kind == "edit":
                    messages[-1] = (messages[-1][0] if role is None else role, [text])
                elif kind == "regenerate":
                    messages[-1] = (messages[-1][0], [])
                elif kind == "delete":
                    messages.pop()
        if key is not None:
            out += close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(run, "conv_id long, turn long, ordinal long, role string, text string")


def format_messages(messages: DataFrame) -> DataFrame:
    """Every message formatted where it lies: conv_id, turn, ordinal, formatted, loss_start, loss_end.

    A conversation's formatted text is the concatenation of its messages by turn and ordinal;
    loss_start and loss_end, the text of an assistant under the loss mask, are null for other
    roles.  Null roles and texts are empty; repeated rows are messages each; an empty table
    gives no rows; other columns are ignored.
    """
    prepare(messages.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ordinal", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        for b in batches:
            out = [render(role or "", text or "") for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            loss = [role == "assistant" for role in b.column("role").to_pylist()]
            places = [pa.array([o[k] if on else None for o, on in zip(out, loss)], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("conv_id", "turn", "ordinal")] + [pa.array([o[0] for o in out], pa.string()), *places], schema=schema)

    return messages.select("conv_id", "turn", "ordinal", "role", "text").mapInArrow(run, "conv_id long, turn long, ordinal long, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from format_messages() output: n_turns, digests, loss and formatted sizes.

    A digest is sequential: a conversation's messages go sorted through one task, which holds
    one message and the running state; the sort spills.  Null conversations are one of their
    own; messages of equal turn and ordinal are taken by their formatted text; an empty table
    gives no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    dealt = formatted.select("conv_id", "turn", "ordinal", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ordinal", "formatted")

    def run(batches):
        conv, state = None, None
        for b in batches:
            out = []
            for c, text, start, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or c != conv:
                    if state is not None:
                        out.append(result(conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = MESSAGE.fullmatch(text)
                state[0] += 1
                state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                if start is not None:
                    loss = unescape(text[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([result(conv, state)], schema=schema)

    def result(conv, s):
        return {"conv_id": conv, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4]}

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
