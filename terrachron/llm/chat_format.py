"""Chat formatting: a visitor flattens typed content parts into one text with placeholders, and a loss mask."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of the template; inside texts a backslash goes before each, and before each backslash.
HEAD, TURN_END, SLOT = "### ", "</turn>", "<|"
MARKS = re.compile(r"\\|### |</turn>|<\|")
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*) </turn>\n", re.S)
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return MARKS.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Flattened:
    text: str = ""
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0


class PartVisitor:
    """Dispatches on a part's type; unknown types are documents of one page. Ordered placeholders number all attachments of a conversation."""

    patch, image_tokens, audio_rate, page_tokens = 28, 256, 25.0, 512

    def __init__(self, out: Flattened) -> None:
        self.out = out

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{(part.get('type') or 'text').lower()}", self.visit_document)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        w, h = part.get("width"), part.get("height")
        return self.attach("image", part, math.ceil(w / self.patch) * math.ceil(h / self.patch) if w and h else self.image_tokens)

    def visit_audio(self, part: dict) -> str:
        return self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> str:
        return self.attach("document", part, (part.get("pages") or 1) * self.page_tokens)

    def attach(self, kind: str, part: dict, tokens: int) -> str:
        n = len(self.out.attachments)
        self.out.attachments.append({"n": n, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.out.tokens += tokens
        return f"{SLOT}{kind}:{n}|>"


def format_turns(turns: list[dict], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]], Flattened]:
    """The conversation's text, the spans of code points under the loss mask, and its attachments."""
    out, spans, at, texts = Flattened(), [], 0, []
    visitor = PartVisitor(out)
    for t in turns:
        role = t.get("role") or ""
        head = f"{HEAD}{escape(role).replace(':', chr(92) + ':')}: "
        body = "".join(visitor.visit(p) for p in t.get("parts") or [{"type": "text", "text": t.get("text")}])
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        texts.append(f"{head}{body} {TURN_END}\n")
        at += len(texts[-1])
    out.text = "".join(texts)
    return out.text, spans, out


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; placeholders stay in the text. Raises on other text."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_chat(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) of each conversation.

    Turns are ordered by ``turn`` (null first), then role and text, so repeated turns stay and ties have an order. A
    null text or role is empty; null ids are one conversation. ``parts``, a column of type PARTS, goes before ``text``
    where it isn't null. Other columns are ignored; no rows give no rows. A conversation is one output row, so its
    turns are gathered into one.
    """
    cols = [F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), (F.col(parts) if parts else F.lit(None)).cast(PARTS).alias("parts")]
    gathered = turns.select(F.col(conv_id).alias("conv_id"), F.struct(*cols).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = T.StructType.fromDDL("formatted string, loss_spans array<struct<start:bigint,stop:bigint>>, attachments array<struct<n:int,type:string,ref:string,tokens:bigint>>, attachment_tokens bigint")
    schema = T.StructType([gathered.schema["conv_id"], *made.fields])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    found_type = pa.list_(pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [format_turns(t, loss_role) for t in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([[{"start": s, "stop": e} for s, e in r[1]] for r in rows], spans_type), pa.array([r[2].attachments for r in rows], found_type), pa.array([r[2].tokens for r in rows], pa.int64())],
                schema.names,
            )

    return gathered.mapInArrow(run, schema)
