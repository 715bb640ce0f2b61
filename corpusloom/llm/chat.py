"""Chat formatting: typed content parts through a visitor, reversible escapes, a loss mask over assistant text.

A conversation becomes segments, one a turn, whose concatenation is its training text:

    <s><|turn:user|>text<|end|><|turn:assistant|>text<|end|></s>

Content is a list of typed parts. A visitor writes text parts escaped and the others as ordered placeholders
(`<|image:1|>`), and records what they refer to and how many tokens a placeholder expands to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings, table, with_schema

#: Strings with a meaning to this template or to usual ones; inside texts a backslash breaks them after the first character.
_ESCAPE = re.compile(r"\\|[<\[](?=/?s>|\||/?INST\]|</?SYS>>)")
_UNESCAPE = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(r"(<s>)?<\|turn:(.*?)\|>(.*)<\|end\|>(</s>)?", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")
#: Tokens that a placeholder stands for, by the type of its part, unless the part says otherwise.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type: string, text: string, ref: string, tokens: int>"
SEGMENTS = "conv_id long, turn long, segment string, loss_start int, loss_length int, attachments array<struct<ordinal: int, type: string, ref: string, tokens: int>>"


def escape(text: str) -> str:
    """Backslashes are doubled and control strings broken by one; unescape() gives the text back."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("|", "|\\")


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; `ordinal` continues through a turn, by type."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def visit(self, part: dict | None) -> None:
        """A null part is nothing; one without a type is text, one of a type without a visit of its own is `other`."""
        if part is not None:
            kind = part.get("type") or "text"
            (getattr(self, f"visit_{kind}") if kind in ("text", *EXPANDED) else self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def _attach(self, part: dict, kind: str | None = None) -> None:
        kind = kind or part["type"]
        self.counts[kind] = self.counts.get(kind, 0) + 1
        tokens = part.get("tokens")
        self.attachments.append({"ordinal": self.counts[kind], "type": part["type"], "ref": part.get("ref"), "tokens": EXPANDED.get(kind, 0) if tokens is None else tokens})
        self.out.append(f"<|{kind}:{self.counts[kind]}|>")

    visit_image = visit_audio = visit_document = _attach

    def visit_other(self, part: dict) -> None:
        """A placeholder `<|other:1|>` of no tokens unless the part says so; the record keeps the part's own type."""
        self._attach(part, "other")


def format_turn(role: str | None, parts: list[dict], first: bool, last: bool) -> tuple[str, int, int, list[dict]]:
    """Segment of a turn, start and length of its loss span in it (length 0: none), attachments."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    head = ("<s>" if first else "") + f"<|turn:{escape_role(role or '')}|>"
    return head + body + "<|end|>" + ("</s>" if last else ""), len(head), len(body) if role == "assistant" else 0, visitor.attachments


def parse_parts(segment: str, attachments: list[dict] | None = None) -> tuple[str, list[dict]]:
    """Role and typed parts of a segment. Only the visitor's placeholders become parts again, with what the attachments record of
    them; the same characters inside a text were escaped and stay text. Neighbouring texts come back as one."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError("not a segment of this template")
    known = list(attachments or [])
    parts = []
    for k, piece in enumerate(_PLACEHOLDER.split(m[3])):
        if k % 3 == 0:
            if piece:
                parts.append({"type": "text", "text": unescape(piece), "ref": None, "tokens": None})
        elif k % 3 == 1:
            own = known.pop(0) if known else {"type": piece}
            parts.append({"type": own["type"], "text": None, "ref": own.get("ref"), "tokens": own.get("tokens")})
    return unescape(m[2].replace("|\\", "|")), parts


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders stay as they are (parse_parts tells them from texts)."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError("not a segment of this template")
    return unescape(m[2].replace("|\\", "|")), unescape(m[3])


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text or an array column of parts, see PART) to SEGMENTS, in order within partitions.

    A conversation's rows meet in one task, sorted by turn (ties: role, then content) and streamed, never held as a
    group. Null text is empty, a null role too, a null conv_id is a conversation.
    """
    small_batches(turns.sparkSession)
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    rows = turns.select("conv_id", "turn", "role", content.cast(f"array<{PART}>").alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # one turn is held back to know whether it is the last
        out: list[dict] = []

        def take(row: dict, first: bool, last: bool) -> None:
            segment, start, length, attachments = format_turn(row["role"], row["parts"] or [], first, last)
            out.append({"conv_id": row["conv_id"], "turn": row["turn"], "segment": segment, "loss_start": start, "loss_length": length, "attachments": attachments})

        schema = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is not None:
                    last = held["conv_id"] != row["conv_id"]
                    take(held, first, last)
                    first = last
                held = row
            if out:
                schema = _segments_schema()
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if held is not None:
            take(held, first, True)
            yield pa.RecordBatch.from_pylist(out, schema or _segments_schema())

    return rows.mapInArrow(run, SEGMENTS)


def _segments_schema() -> pa.Schema:
    attachment = pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
    return pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int32()), ("loss_length", pa.int32()), ("attachments", pa.list_(attachment))])


def read_conversations(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from segments in the order format_conversations leaves them in:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result() -> dict:
            conv, n, turns, chars, loss, formatted = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for conv, segment, start, length in zip(*columns):
                if segment.startswith("<s>"):
                    if state:
                        done.append(result())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                lossy = unescape(segment[start : start + length])
                state[3] += len(lossy)
                state[4].update(lossy.encode())
                state[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([result()], schema)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(run, schema)


PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings. Null texts and roles are empty, rows with a null conv_id are
    one conversation, repeated rows and equal turns are turns each (ordered by role, then text); an empty table leaves conversation -1."""
    rows = with_schema(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_conversations(format_conversations(rows.unionByName(probe)))


SQL = {
    "op4_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS own
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<\||<</?SYS>>')) AS escaped, length(role) AS role_chars FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (own), '')) AS loss_sha256,
  CAST(sum(escaped + role_chars + 16) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
