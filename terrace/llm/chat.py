"""Chat formatting: conversations rebuilt from their event logs and rendered with a loss mask.

A log holds events (conv_id, turn, message, seq, kind, role, text). ``turn`` and ``message`` name the message that an event
is about, ``seq`` orders the events of a conversation:

* ``message``: the message is this text from now on, under this role;
* ``delta``: a streamed piece, added at its end;
* ``edit``: the text is replaced;
* ``regenerate``: what the message holds so far is void, and so is every later turn of the conversation so far.

``formatted`` partitions the log by conversation, sorts it by turn, message and sequence and folds it as a stream: a task
holds one message and one part of the output at a time, never a whole conversation. A later turn needs from earlier ones
only the last sequence at which one was regenerated. Each message is rendered as ``### role: text</turn>``; control
strings in texts are escaped, so that none can occur inside one and the output reads back (``read_back``). The mask is the
list of spans of assistant texts in code points.

A conversation is one sequence by nature: a very long one takes one task's time, though not its memory. Its output goes
out in parts of about ``PART`` characters, cut between turns.

Defined cases: null text is empty, a null role is the empty role, a null conv_id is a conversation, a null turn, message
or sequence comes first, a null kind is a message; events that share all keys go by kind, role and text; an unknown kind is
an error; a message keeps the first role it is given until one of kind ``message`` names another; a conversation of which no message is left has no turns; an empty
log gives an empty result; long texts are one turn; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch

#: Characters after which a conversation's output goes on in another row.
PART = 4_000_000
#: The role whose texts are under the loss mask.
LEARNED = "assistant"

_BEGIN, _END = "### ", "</turn>"
_ESCAPES = {"\\": "\\\\", "###": "\\h", _END: "\\t", ": ": "\\c"}
_IN_TEXT, _IN_ROLE, _ESCAPED = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|: "), re.compile(r"\\(.)")
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}

_PARTS = "conv_id long, part int, last boolean, formatted string, loss array<struct<start long, end long>>"


def escape(text: str, role: bool = False) -> str:
    """Control strings give way to a backslash and a letter, so none is left in the result, also none made of two others."""
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text stands in it."""
    head, body = f"{_BEGIN}{escape(role, True)}: ", escape(text)
    return f"{head}{body}{_END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of an output."""
    *turns, rest = formatted.split(f"{_END}\n")
    if rest:
        raise ValueError(f"the output ends inside a turn: {rest[-40:]!r}")
    for turn in turns:
        role, _, text = turn.removeprefix(_BEGIN).partition(": ")
        yield unescape(role), unescape(text)


# --- folding -----------------------------------------------------------------------------------------

_KEYS = ("conv_id", "turn", "message", "seq", "kind", "role", "text")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in _KEYS), strict=True)


def folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of what is left of each message of sorted events; role None marks the end of a conversation."""
    conversation = turn = message = role = None
    pieces: list[str] | None = None
    open_, lowest = False, float("-inf")
    void = pending = lowest  # the last regeneration of an earlier turn, and of one up to this
    for conv, t, m, seq, kind, who, text in events:
        if not open_ or conv != conversation or t != turn or m != message:
            if pieces is not None:
                yield conversation, role or "", "".join(pieces)
            if open_ and conv != conversation:
                yield conversation, None, ""
            if not open_ or conv != conversation:
                void = pending = lowest
            elif t != turn:
                void = pending
            open_, conversation, turn, message, role, pieces = True, conv, t, m, None, None
        at = lowest if seq is None else seq
        if kind == "regenerate":
            pending = max(pending, at)
            pieces = None
        elif at < void:
            continue
        elif kind == "delta":
            pieces = [*(pieces or ()), text or ""] if pieces is None or len(pieces) < 64 else ["".join(pieces), text or ""]
        elif kind in ("message", "edit", None):
            pieces = [text or ""]
        else:
            raise ValueError(f"unknown kind of event: {kind!r}")
        if kind != "regenerate" and who is not None and (role is None or kind == "message"):
            role = who
    if open_:
        if pieces is not None:
            yield conversation, role or "", "".join(pieces)
        yield conversation, None, ""


def _format(learned: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held, size, part, loss, ready = [], 0, 0, [], 0

        def out() -> pa.RecordBatch:
            ids, parts, last, texts, spans = zip(*done, strict=True)
            return batch({"conv_id": (list(ids), pa.int64()), "part": (list(parts), pa.int32()), "last": (list(last), pa.bool_()), "formatted": (list(texts), pa.string()), "loss": (list(spans), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

        for conv, role, text in folded(_events(batches)):
            if role is not None:
                turn, start, end = render(role, text)
                if role == learned:
                    loss.append({"start": size + start, "end": size + end})
                held.append(turn)
                size += len(turn)
            if role is None or size >= most:
                done.append((conv, part, role is None, "".join(held), loss))
                ready += size
                held, size, loss, part = [], 0, [], 0 if role is None else part + 1
            if ready >= most or len(done) >= 1000:
                yield out()
                done, ready = [], 0
        if done:
            yield out()

    return run


def formatted(log: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, part, last, formatted, loss) of an event log: one row for each conversation, more for a very long one, its
    parts in order. ``loss`` has the spans of ``learned`` texts in the part, in code points, as they stand there (escaped)."""
    kinds = {"conv_id": "long", "kind": "string", "role": "string", "text": "string"}
    rows = log.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in _KEYS])
    rows = rows.repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in _KEYS])
    return rows.mapInArrow(_format(learned, PART), _PARTS)


# --- reading back ------------------------------------------------------------------------------------

_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = chars = learned = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for b in batches:
        out = []
        for conv, last, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "last", "formatted", "loss")), strict=True):
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                loss.update(said.encode("utf-8", "surrogatepass"))
                learned += len(said)
            chars += len(text)
            if last:
                out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
                n = chars = learned = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield batch({c.split()[0]: (list(v), k) for c, v, k in zip(_READ.split(", "), zip(*out, strict=True), kinds, strict=True)})


def read_back(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of ``formatted`` rows, parsed again.

    Conversations of one part are read where they stand; only those of several parts are brought together, unless the rows
    are ``in_order`` as ``formatted`` makes them.
    """
    columns = ("conv_id", "last", "formatted", "loss")
    if in_order:
        return parts.select(*columns).mapInArrow(_read, _READ)
    whole = F.col("last") & (F.col("part") == 0)
    some = parts.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.where(whole).select(*columns).mapInArrow(_read, _READ).union(some.select(*columns).mapInArrow(_read, _READ))


# --- logs of plain rows ------------------------------------------------------------------------------


def log_of(rows: DataFrame, piece: int = 400) -> DataFrame:
    """An event log that ends in ``rows(conv_id, turn, role, text)``: as a chat service would have written it.

    Texts stream in as deltas of ``piece`` characters. One message in four has a first draft that an edit replaces; one
    assistant message in four is generated twice, and the draft of an answer to the first version goes with it. Which ones
    follows from the texts. Each row is a message of its own; rows that share a turn go by role and a hash of their text.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"message": F.struct("role", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")), "_h": F.pmod(F.xxhash64("role", "text", "turn"), F.lit(4))})
    event = lambda seq, kind, body, turn=F.col("turn"): F.struct(turn.alias("turn"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), body.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / piece).cast("int")), lambda i: F.substring("text", i * piece + 1, F.lit(piece)))
    # a million sequence numbers for each turn, drafts before the stream; numbers of turns beyond 10**9 leave no room for that
    small = F.col("turn").between(-1_000_000_000, 1_000_000_000) & (F.length("text") <= piece * 900_000)
    turn, draft = F.when(small, F.col("turn")), F.substring("text", 1, 20)
    base = turn * 1_000_000
    streamed = F.transform(pieces, lambda x, i: event(base + 10 + i, "delta", x))
    edited = F.array(event(base + 1, "message", draft), event(base + 2, "edit", F.col("text")))
    again = F.array(event(base + 1, "delta", draft), event(base + 2, "message", draft, turn + 1), event(base + 3, "regenerate", F.lit(None).cast("string")))
    plain = F.array(event(F.lit(0), "message", F.col("text")))
    events = F.when(~F.coalesce(small, F.lit(False)), plain).when(F.col("_h") == 0, edited).when((F.col("_h") == 1) & (F.col("role") == LEARNED), F.concat(again, streamed)).otherwise(streamed)
    return rows.select("conv_id", "message", "role", F.explode(events).alias("e")).select("conv_id", "e.turn", "message", "e.seq", "e.kind", "role", "e.text")


def with_rows(rows: DataFrame, conv_id: int, said: list[tuple[str, str]]) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` and one more conversation of (role, text) turns."""
    more = rows.sparkSession.createDataFrame([(conv_id, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").union(more)

