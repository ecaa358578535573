"""Chat formatting: conversations rendered by a compiled template, with the spans a model is to learn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.template import Mark, compiled

TURN, STOP = "### ", "</turn>"
#: A turn: its role, a line end, its text and a closing mark.
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape_role }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    + STOP + "\n{% endfor %}"
)


def escape(text: str) -> str:
    """The text with backslashes doubled and one put after the first of any two # and after the < of a closing mark, so that no control string is left."""
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace(STOP, "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":\n", ":\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS = {"escape": escape, "escape_role": escape_role}


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int | None = None) -> DataFrame:
    """Formatted conversations: conv_id, part (long), formatted (string), loss_spans (array of start and end).

    A conversation is the rows of one conv_id by turn, then role and text where turns are equal, nulls first; a
    null role or text renders as an empty one; rows without conv_id are one conversation. Repeated rows are
    turns. Spans count code points from the part's begin. A conversation is one row, part 0; if the caller
    names part_chars, one that is longer goes on in further rows, cut after a turn. An empty table gives no
    row. Columns other than conv_id, turn, role and text are not read, whatever their names.

    Rows are shuffled by conversation and sorted inside partitions; the template takes turns one by one, so
    that a task holds one row of the result: with part_chars never a whole conversation, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, FILTERS)

        def parts() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                texts, spans, size, part, begun = [], [], 0, 0, None
                for x in render({"messages": ({"role": role, "text": text} for _, _, role, text in turns)}):
                    if x is Mark.BEGIN:
                        begun = size
                    elif x is Mark.END:
                        spans.append({"start": begun, "end": size})
                    elif x is not Mark.PAUSE:
                        texts.append(x)
                        size += len(x)
                    elif part_chars is not None and size >= part_chars:
                        yield conv, part, "".join(texts), spans
                        texts, spans, size, part = [], [], 0, part + 1
                if texts or not part:
                    yield conv, part, "".join(texts), spans

        yield from _batches(parts(), _FORMATTED, 64)

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part long, formatted string, loss_spans array<struct<start:long,end:long>>")


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The roles and texts that a text in the default template was made of."""
    at = 0
    while at < len(formatted):
        role_end = formatted.index(":\n", at + len(TURN))
        end = formatted.index(STOP, role_end + 2)
        yield unescape(formatted[at + len(TURN) : role_end]), unescape(formatted[role_end + 2 : end])
        at = end + len(STOP) + 1


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the rows of format_conversations() hold, by conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows are shuffled by conversation and read by part, so that they may come from a table in any order; a part
    is in memory at a time. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, spans in parts:
                    chars += len(text)
                    for role, said in turns_of(text):
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode())
                    for span in spans:
                        learned = unescape(text[span["start"] : span["end"]])
                        loss_chars += len(learned)
                        loss.update(learned.encode())
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batches(digests(), _DIGEST)

    ordered = formatted.select("conv_id", "part", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
