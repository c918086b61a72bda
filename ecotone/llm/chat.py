"""Chat formatting: event-sourced reconstruction, a reversible template and its loss mask.

An event log has a conversation, a sequence number, a message key, a kind and a
text.  The log is partitioned by conversation and, as a conversation may hold a
third of all events, further by message, sorted by sequence and folded: `message`
and `edit` set the text, `delta` appends to it, `regenerate` starts it anew,
`delete` takes the message away (a later `message` or `edit` brings it back).
Messages stand where their first event stood.  Then each message is rendered
alone and the pieces of a conversation, in order, are its formatted text, so no
task holds more than a message and a batch, whatever a conversation's length.

Null texts and roles count as empty, null sequence numbers come first, null
conversations are one conversation, equal sequence numbers are ordered by role,
then text; repeated rows are repeated turns.  Unknown kinds raise an error.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings. In texts a backslash is doubled and "<|" becomes "<\|", so neither control appears in one.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: The role whose texts are learned.
LEARNED = "assistant"

KINDS = ("message", "delta", "edit", "regenerate", "delete")


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, seq, role, text): the final messages; seq is that of the message's first event."""
    log = events.select(F.col(conv).alias("c"), F.col(message).alias("m"), F.col(seq).alias("s"), F.col(kind).alias("k"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    log = log.repartition("c", "m").sortWithinPartitions("c", "m", "s", "r", "t")
    types = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches):
        import pyarrow as pa

        key, first, who, parts, gone = None, None, "", [], False
        for batch in batches:
            out = []
            for c, m, s, k, r, t in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (c, m) != key or first is None:
                    if first is not None and not gone:
                        out.append((key[0], first[0], who, "".join(parts)))
                    key, first, who, parts, gone = (c, m), (s,), r, [], False
                if k not in KINDS:
                    raise ValueError(f"no such kind of event: {k!r}")
                if k == "delta":
                    parts.append(t)
                elif k == "delete":
                    parts, gone = [], True
                else:
                    parts, gone, who = [t], False, r or who
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, typ) for x, typ in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if first is not None and not gone:
            yield pa.RecordBatch.from_arrays([pa.array([x], typ) for x, typ in zip((key[0], first[0], who, "".join(parts)), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(events.schema[conv].dataType), to_arrow_type(events.schema[seq].dataType), to_arrow_type(log.schema["r"].dataType), to_arrow_type(log.schema["t"].dataType)]
    names = [conv, seq, role, text]
    return log.mapInArrow(run, f"`{conv}` {types[conv]}, `{seq}` {types[seq]}, `{role}` string, `{text}` string")


def escaped(column):
    """A text column without control strings; `unescape` takes it back."""
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(messages: DataFrame, conv: str = "conv_id", seq: str = "seq", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, seq, role, text, piece, loss_start, loss_end): each message's part of the formatted text and where in it the loss mask lies (null: nowhere)."""
    head = F.concat(F.lit(TURN), escaped(F.col(role)), F.lit(TEXT))
    body = escaped(F.col(text))
    learned = F.col(role) == LEARNED
    return messages.select(
        F.col(conv), F.col(seq), F.col(role), F.col(text),
        F.concat(head, body, F.lit(END)).alias("piece"),
        F.when(learned, F.length(head)).alias("loss_start"),
        F.when(learned, F.length(head) + F.length(body)).alias("loss_end"),
    )


def assemble(pieces: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """(conv, formatted, loss): whole conversations as one text each with the mask's spans; for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq), "role", "text", "piece", "loss_start", "loss_end")))
    got = pieces.groupBy(conv).agg(parts.alias("p"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "p", zero,
        lambda a, x: F.struct((a["at"] + F.length(x["piece"])).alias("at"), F.when(x["loss_start"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + x["loss_start"]).alias("start"), (a["at"] + x["loss_end"]).alias("end"))))).alias("spans")),
        lambda a: a["spans"],
    )
    return got.select(conv, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


class Reader:
    """Takes the formatted text of a conversation piece by piece, gives back its turns."""

    def __init__(self):
        self.held = ""

    def feed(self, text: str):
        self.held += text
        while (end := self.held.find(END)) >= 0:
            turn, self.held = self.held[:end], self.held[end + len(END) :]
            role, found, body = turn.partition(TEXT)
            if not role.startswith(TURN) or not found:
                raise ValueError("not a formatted conversation")
            yield unescape(role[len(TURN) :]), unescape(body)


def digest(pieces: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """Per conversation, read back from its formatted text as it streams by: turns, hashes, characters."""
    rows = pieces.select(F.col(conv).alias("c"), "piece", "loss_start", "loss_end", F.col(seq).alias("s"), "role", "text")
    rows = rows.repartition("c").sortWithinPartitions("c", "s", "role", "text").select("c", "piece", "loss_start", "loss_end")
    kind = pieces.schema[conv].dataType.simpleString()
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        import pyarrow as pa

        key, state = None, None

        def done():
            c, n, turns, chars, loss, size, reader = state
            if reader.held:
                raise ValueError("not a formatted conversation")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((c, n, turns.hexdigest(), chars, loss.hexdigest(), size), types, strict=True)], names)

        for batch in batches:
            for c, piece, a, b in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if state is None or c != key:
                    if state is not None:
                        yield done()
                    key, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                for role, text in state[6].feed(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    learned = unescape(piece[a:b])
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
        if state is not None:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType, StringType

    types = [to_arrow_type(t) for t in (pieces.schema[conv].dataType, LongType(), StringType(), LongType(), StringType(), LongType())]
    return rows.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Characters of a streamed delta, and of a draft.
DELTA, DRAFT = 256, 16


def streamed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The event log that a chat service would have written for a table of finished turns.

    A learned turn begins with a draft that is regenerated, and its text comes
    in deltas; any other is sent as a draft and edited.  seq is (turn, number
    of the event); every row is a message of its own, though rows repeat.
    """
    rows = conversations.select(F.col(conv), F.col(turn).alias("__turn"), F.col(role), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("message"))
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    draft = F.left("__text", F.lit(DRAFT))
    deltas = F.transform(F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda t: event("delta", t))
    said = F.concat(F.array(event("message", draft), event("regenerate", F.lit(""))), deltas)
    sent = F.array(event("message", draft), event("edit", F.col("__text")))
    log = rows.select(conv, "__turn", role, "message", F.posexplode(F.when(F.col(role) == LEARNED, said).otherwise(sent)).alias("__part", "__e"))
    return log.select(F.col(conv), F.struct(F.col("__turn").alias("turn"), F.col("__part").alias("part")).alias("seq"), "message", F.col("__e.kind").alias("kind"), F.col(role), F.col("__e.text").alias(text))


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rendered pieces of a table of finished turns: its event log, folded and rendered; seq is (turn, 0)."""
    return render(fold_events(streamed(conversations, conv, turn, role, text), conv, "seq", "message", "kind", role, text), conv, "seq", role, text)
