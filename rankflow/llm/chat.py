r"""Conversations as training text: typed content parts, marked turns, a loss mask.

A turn holds parts: text, image, audio, document. A visitor goes through them in order. Text is written with
its control strings escaped; any other part becomes a placeholder on a line of its own, its reference is
recorded, and so is the number of tokens that the placeholder expands to. Neighbouring texts are one text.

    <turn assistant>
    first text
    <image:1>
    second text
    </turn>

A control string inside a text gets one backslash more than it has (``</turn`` becomes ``\</turn``), which is
taken away when the text is read back; real control strings follow a line feed, so they never have one. The
mask covers the texts of assistant turns, as code points of the formatted text, placeholders left out.

Turns are sorted by ranges of (conv_id, turn), so one conversation may lie in several tasks, and are written as
segments: whole turns of one conversation, of about ``SEGMENT_CHARS`` code points. Segments are put in order by
(segment_part, segment); a conversation that its task has seen from its first to its last row, in one segment,
is marked ``complete``. Nothing is held but the turns of one segment.

Defined results: a null text is empty, and so is a null role; a turn without parts has an empty text; a null part
counts for nothing, and one of another kind is an error. Rows with a null conv_id
are one conversation, before the others; null turns come first; rows of one turn stand in the order of
a hash of role and text. An empty table gives no segments. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm.session import ready

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
SEGMENT_CHARS = 1 << 20
#: Tokens of an attachment: image patches, audio per second, document per page.
PATCH_PIXELS, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512

_CONTROL = r"(?:</?turn|<(?:image|audio|document):)"
_ESCAPE = re.compile(_CONTROL)
_UNESCAPE = re.compile(rf"\\({_CONTROL})")
_PLACEHOLDER = re.compile(r"\n<(image|audio|document):(\d+)>\n")
_HEAD, _END = "<turn", "\n</turn>\n"
#: What a role may not hold inside a header; ``%`` comes first.
_ROLE = (("%", "%25"), (">", "%3E"), ("\n", "%0A"))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Attachment(NamedTuple):
    number: int
    kind: str
    ref: str | None
    tokens: int


class TurnVisitor:
    """Writes the parts of one turn. ``masked`` collects (start, end) of the texts, from the turn's start."""

    def __init__(self, role: str | None, attachments: list[Attachment]):
        role = role or ""
        for plain, coded in _ROLE:
            role = role.replace(plain, coded)
        self.pieces = [f"{_HEAD} {role}>\n"]
        self.length = len(self.pieces[0])
        self.masked: list[tuple[int, int]] = []
        self.held: list[str] = []
        self.attachments = attachments

    def visit(self, part: dict) -> None:
        visit = getattr(self, f"visit_{part['kind']}", None)
        if visit is None:
            raise ValueError(f"a part of unknown kind {part['kind']!r}")
        visit(part)

    def visit_text(self, part: dict) -> None:
        self.held.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        across, down = (-(-(part[side] or 0) // PATCH_PIXELS) for side in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, int(-(-(part["seconds"] or 0.0) * TOKENS_PER_SECOND // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * TOKENS_PER_PAGE)

    def _attach(self, part: dict, tokens: int) -> None:
        self._write_text()
        self.attachments.append(Attachment(len(self.attachments) + 1, part["kind"], part["ref"], tokens))
        self._write(f"\n<{part['kind']}:{len(self.attachments)}>\n")

    def _write_text(self) -> None:
        # Escaped as a whole: two texts may make a control string together.
        text = escape("".join(self.held))
        self.held = []
        if text:
            self.masked.append((self.length, self.length + len(text)))
            self._write(text)

    def _write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def end(self) -> str:
        self._write_text()
        self._write(_END)
        return "".join(self.pieces)


SEGMENT = (
    "conv_id long, segment_part int, segment long, complete boolean, formatted string,"
    " mask array<struct<start: int, end: int>>,"
    " attachments array<struct<number: int, kind: string, ref: string, tokens: int>>, attachment_tokens long"
)
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ATTACHMENTS = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("segment_part", pa.int32()),
        ("segment", pa.int64()),
        ("complete", pa.bool_()),
        ("formatted", pa.string()),
        ("mask", _MASK),
        ("attachments", _ATTACHMENTS),
        ("attachment_tokens", pa.int64()),
    ]
)


class _Segment:
    """Turns of one conversation that are being put together."""

    def __init__(self, conv_id, first: bool):
        self.conv_id, self.first = conv_id, first
        self.pieces, self.mask, self.attachments, self.length = [], [], [], 0

    def add(self, role: str | None, parts: list[dict]) -> None:
        visitor = TurnVisitor(role, self.attachments)
        for part in parts:
            if part is not None:
                visitor.visit(part)
        text = visitor.end()
        if role == "assistant":
            self.mask += [{"start": self.length + a, "end": self.length + b} for a, b in visitor.masked]
        self.pieces.append(text)
        self.length += len(text)

    def row(self, part: int, number: int, complete: bool) -> dict:
        return {
            "conv_id": self.conv_id,
            "segment_part": part,
            "segment": number,
            "complete": complete,
            "formatted": "".join(self.pieces),
            "mask": self.mask,
            "attachments": [a._asdict() for a in self.attachments],
            "attachment_tokens": sum(a.tokens for a in self.attachments),
        }


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        text = batch.column("text")
        texts = text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else None
        for i, (conv_id, role) in enumerate(
            zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), strict=True)
        ):
            if texts is None:
                yield conv_id, role, text[i].as_py() or []
            else:
                yield conv_id, role, [{"kind": "text", "text": texts[i].as_py()}]


def _format(segment_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, number, held, edge = TaskContext.get().partitionId(), 0, None, True
        for conv_id, role, parts in _turns(batches):
            other = held is not None and held.conv_id != conv_id
            if held is not None and (other or held.length >= segment_chars):
                # The conversation at either edge of a task may go on in another one.
                yield held.row(part, number, other and held.first and not edge)
                edge = edge and not other
                number, held = number + 1, _Segment(conv_id, other)
            if held is None:
                held = _Segment(conv_id, True)
            held.add(role, parts)
        if held is not None:
            yield held.row(part, number, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready_rows, size = [], 0
        for row in rows(batches):
            ready_rows.append(row)
            size += len(row["formatted"])
            if size >= segment_chars:
                yield pa.RecordBatch.from_pylist(ready_rows, schema=_ARROW)
                ready_rows, size = [], 0
        if ready_rows:
            yield pa.RecordBatch.from_pylist(ready_rows, schema=_ARROW)

    return run


def format_conversations(turns: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of all conversations. ``turns`` has conv_id, turn, role and either text or typed ``parts``.

    ``parts`` is an array of ``PART``; a table that has both columns is read by its parts.
    """
    ready(turns.sparkSession)
    content = "parts" if "parts" in turns.columns else "text"
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.col(content).alias("text"))
    # The last two part the rows of one turn, equal ones too.
    order = ["conv_id", "turn", "_content", "_tie"]
    rows = rows.withColumns({"_content": F.xxhash64("role", "text"), "_tie": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_content", "_tie", "turn")
    return ranged.mapInArrow(_format(segment_chars), SEGMENT)


def write_conversations(turns: DataFrame, path: str, segment_chars: int = SEGMENT_CHARS, mode: str = "error") -> None:
    """Write the segments as Parquet, sorted by conversation within and over the files."""
    format_conversations(turns, segment_chars).write.mode(mode).option("compression", "zstd").parquet(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


class Turn(NamedTuple):
    """A turn read back; ``content`` holds texts and attachment numbers in order."""

    role: str
    content: list[str | int]


def parse_segment(formatted: str) -> Iterator[Turn]:
    """The turns of a formatted segment. The end of a turn can't stand in a text, where it is escaped."""
    for block in formatted.split(_END)[:-1]:
        head, _, body = block.partition("\n")
        role = head[len(_HEAD) + 1 : -1]
        for plain, coded in reversed(_ROLE):
            role = role.replace(coded, plain)
        content: list[str | int] = []
        at = 0
        for m in _PLACEHOLDER.finditer(body):
            if m.start() > at:
                content.append(unescape(body[at : m.start()]))
            content.append(int(m[2]))
            at = m.end()
        if at < len(body):
            content.append(unescape(body[at:]))
        yield Turn(role, content)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: list[dict]) -> None:
        self.chars += len(formatted)
        for turn in parse_segment(formatted):
            text = "".join(c for c in turn.content if isinstance(c, str))
            self.turns.update(f"{turn.role}\n{text}\n".encode())
            self.n_turns += 1
        for span in mask:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_DIGEST_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, done = None, []

    def batch() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST_ARROW, strict=True)], schema=_DIGEST_ARROW)

    for given in batches:
        for i in range(given.num_rows):
            conv_id = given.column("conv_id")[i].as_py()
            if held is None or held.conv_id != conv_id:
                done += [held.row()] if held else []
                held = _Digest(conv_id)
            held.add(given.column("formatted")[i].as_py(), given.column("mask")[i].as_py())
        if len(done) >= 1000:
            yield batch()
            done = []
    done += [held.row()] if held else []
    if done:
        yield batch()


def conversation_digests(segments: DataFrame) -> DataFrame:
    """What the segments say about each conversation, read back from the formatted text and the mask.

    Complete conversations are digested where they lie. The segments of the others, two conversations a
    file and those longer than a segment, are dealt by conversation and sorted. A digest is made of
    bytes in their order, so one task goes through a conversation; it holds one segment at a time.
    """
    ready(segments.sparkSession)
    columns = ["conv_id", "formatted", "mask"]
    whole = segments.where("complete").select(*columns).mapInArrow(_digest, DIGEST)
    cut = segments.where("not complete").select(*columns, "segment_part", "segment")
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment_part", "segment").select(*columns)
    return whole.unionByName(cut.mapInArrow(_digest, DIGEST))
