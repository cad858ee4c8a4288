"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

Template. A conversation is `<s>` and its turns; a turn is `[INST]` role `[/INST]` text `</s>`. Inside roles and texts a
control string gets a backslash after its first character, and one that already has some gets one more, so escaping is
reversible and no control string is left in what people wrote. What an example may be trained on (its loss span) is the
reply's escaped text, nothing of the context and no mark.

Expansion. Example e of a conversation is all turns up to its e-th assistant turn; only that reply is trainable. Turns
after the last reply, or a conversation without one, give one more example without a loss span, so nothing is lost.
Every example is a beginning of the conversation's formatted text. Written out in full, examples would take the square of a
conversation's length; therefore each full PART of code points of that text is written once (a row with `part`), and an
example (a row with `example`) holds the number of parts before it and the rest of its text, reply included. Common
conversations are shorter than a part, and their examples are whole in one row. `whole_texts` joins the parts again.

Rows of a conversation meet in one partition, sorted by Spark (which spills), and pass through Python one after another:
a task holds a part and the longest single turn, never a conversation. A conversation is one task's work, as its digest is.

Cases. Null text or role: empty. Rows by turn, null turns first; equal turns by role, then text. Null conv_id: one
conversation of its own. Repeated rows are turns like others. Empty table: no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a shared part.
PART = 1 << 16
#: Bytes of text after which rows are handed on.
FLUSH = 4 << 20
OPEN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
ESCAPE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")

EXAMPLES = "conv_id long, example long, part long, n_parts long, n_turns long, text string, loss_start long, loss_end long"
BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escaped(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, handed on after FLUSH of what size(row) gives."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + size(row)
        if weight >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # so that few long texts are Python strings at once
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)


LONG = pa.int64()
EXAMPLE_ROWS = pa.schema([("conv_id", LONG), ("example", LONG), ("part", LONG), ("n_parts", LONG), ("n_turns", LONG), ("text", pa.string()), ("loss_start", LONG), ("loss_end", LONG)])
BACK_ROWS = pa.schema([("conv_id", LONG), ("n_turns", LONG), ("turns_sha256", pa.string()), ("loss_chars", LONG), ("loss_sha256", pa.string()), ("formatted_chars", LONG), ("n_examples", LONG)])


def expanded(rows: Iterable[tuple], part: int) -> Iterator[tuple]:
    """Rows of EXAMPLES from (conv_id, role, text) in order."""
    none = object()
    conv, tail, parts, turns, examples, after = none, "", 0, 0, 0, 0

    def rest() -> Iterator[tuple]:
        if conv is not none and after:
            yield (conv, examples, None, parts, turns, tail, None, None)

    for conv_id, role, text in rows:
        if conv_id != conv or conv is none:
            yield from rest()
            conv, tail, parts, turns, examples, after = conv_id, OPEN, 0, 0, 0, 0
        while len(tail) >= part:
            yield (conv, None, parts, None, None, tail[:part], None, None)
            tail, parts = tail[part:], parts + 1
        head, body = f"{ROLE}{escaped(role)}{TEXT}", escaped(text)
        start = len(tail) + len(head)
        tail = f"{tail}{head}{body}{END}"
        turns, after = turns + 1, after + 1
        if role == "assistant":
            yield (conv, examples, None, parts, turns, tail, start, start + len(body))
            examples, after = examples + 1, 0
    yield from rest()


def by_conversation(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation in one partition, in order."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def examples(conversations: DataFrame, part: int = PART) -> DataFrame:
    """Rows of EXAMPLES. conversations: (conv_id, turn, role, text).

    example (0, 1, ...; null in part rows), part (null in example rows), n_parts: the parts before an example's text,
    n_turns: its turns, text, loss_start and loss_end: code points in that text, null in a last example without reply.
    """
    if part < 1:
        raise ValueError("a part has at least one character")
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))

    def run(batches):
        return batches_of(expanded(((c, r, t) for c, _, r, t in rows_of(batches)), part), EXAMPLE_ROWS, lambda row: len(row[5]))

    return by_conversation(turns, "turn", "role", "text").mapInArrow(run, EXAMPLES)


class Reader:
    """Turns read from formatted text that comes in pieces."""

    def __init__(self) -> None:
        self.held, self.role, self.turns, self.digest = "", None, 0, hashlib.sha256()
        self.pieces: list[str] = []

    def feed(self, text: str) -> None:
        text = self.held + text
        at = 0
        for m in MARKS.finditer(text):
            self.mark(m[0], text[at : m.start()])
            at = m.end()
        # a mark may be cut off at the end; the longest has 7 characters
        keep = max(at, len(text) - 6)
        self.pieces.append(text[at:keep])
        self.held = text[keep:]

    def mark(self, mark: str, before: str) -> None:
        before = "".join([*self.pieces, before])
        self.pieces = []
        if mark == TEXT:
            self.role = before
        elif mark == END:
            if self.role is None:
                raise ValueError("a turn's text without its role")
            self.digest.update(f"{unescaped(self.role)}\n{unescaped(before)}\n".encode())
            self.role, self.turns = None, self.turns + 1
        elif before:
            raise ValueError("text between turns")


def read(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of BACK from rows of EXAMPLES in order."""
    none = object()
    conv = none
    # seen: code points of the conversation's text that the reader has had; before: those in whole parts
    reader, loss, loss_chars, chars, n, seen, before = Reader(), hashlib.sha256(), 0, 0, 0, 0, 0

    def done() -> Iterator[tuple]:
        if conv is not none:
            yield (conv, reader.turns, reader.digest.hexdigest(), loss_chars, loss.hexdigest(), chars, n)

    for conv_id, example, _, _, n_turns, text, start, end in rows:
        if conv_id != conv or conv is none:
            yield from done()
            conv, reader, loss, loss_chars, chars, n, seen, before = conv_id, Reader(), hashlib.sha256(), 0, 0, 0, 0, 0
        if before + len(text) > seen:
            reader.feed(text[seen - before :])
            seen = before + len(text)
        if example is None:
            before += len(text)
            continue
        if reader.turns != n_turns:
            raise ValueError(f"{reader.turns} turns read, {n_turns} written")
        chars, n = chars + before + len(text), n + 1
        if start is not None:
            reply = unescaped(text[start:end])
            loss_chars += len(reply)
            loss.update(reply.encode())
    yield from done()


def read_back(made: DataFrame, in_order: bool = False) -> DataFrame:
    """Rows of BACK: what the examples say about each conversation.

    formatted_chars counts all its examples, contexts in full. in_order: made comes straight from examples(), where a
    conversation's rows are together and in order; otherwise they are brought together first.
    """
    if not in_order:
        made = by_conversation(made.select(*EXAMPLE_ROWS.names).withColumn("at", F.coalesce("part", "n_parts")), "at", F.col("example").asc_nulls_last()).drop("at")

    def run(batches):
        return batches_of(read(rows_of(batches)), BACK_ROWS, lambda row: 200)

    return made.mapInArrow(run, BACK)


def whole_texts(made: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end): each example in one row, its context in full.

    Takes the square of a long conversation's length; short ones pass through without a join.
    """
    rows = made.where("example IS NOT NULL")
    short = rows.where("n_parts = 0").select("conv_id", "example", "n_turns", "text", "loss_start", "loss_end")
    parts = made.where("part IS NOT NULL").select(F.col("conv_id").alias("pc"), F.col("part").alias("pp"), F.col("text").alias("pt"))
    long = rows.where("n_parts > 0")
    found = long.select("conv_id", "example", "n_parts").join(parts, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("pp") < F.col("n_parts")))
    found = found.groupBy(F.col("conv_id").alias("fc"), F.col("example").alias("fe")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pp", "pt"))), lambda x: x["pt"]), "").alias("head"))
    long = long.join(found, F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("example") == F.col("fe")))
    shift = F.char_length("head").cast("long")
    long = long.select("conv_id", "example", "n_turns", F.concat("head", "text").alias("text"), (F.col("loss_start") + shift).alias("loss_start"), (F.col("loss_end") + shift).alias("loss_end"))
    return short.unionByName(long)
