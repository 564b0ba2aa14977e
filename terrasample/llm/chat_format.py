"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor walks them in order: text is escaped and written as it is; image,
audio and document parts are written as placeholders, a control string with the part's number in the conversation and one
pad string per expanded token, and recorded as attachments with their reference and token count. Token counts follow the
part's own measure (image: tiles of pixels, audio: time, document: pages), rounded up, and at least one: measures that are
missing, negative or not finite count nothing. A part of any other type is written as an ``unknown`` placeholder of one token
and recorded under its own type.

The template writes each turn as ``<|im_start|>role\\ncontent<|im_end|>\\n``. Control strings inside texts are escaped
reversibly: between a ``<`` and the ``|`` that follows it a backslash is added, to those that are there, so the text
never contains ``<|`` and ``parse`` takes one backslash away. A role's backslashes and line ends are written ``\\\\`` and
``\\n``. The loss mask is a list of character spans: the content of assistant turns.

Turns are rendered row by row and only joined by conversation, in order of (turn, role, text), a null turn first. A
conversation is the unit of output, so its size bounds a task's memory. Null texts and roles are empty. Repeated rows are
turns of their own. An empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._scratch import arrow_batches, only

START, END, PAD = "<|im_start|>", "<|im_end|>", "<|pad|>"
#: Measure of a part that one token stands for.
TILE, SECONDS_PER_TOKEN, TOKENS_PER_PAGE = 28 * 28, 0.04, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class Visitor:
    """Flattens content parts into text with ordered placeholders."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # neighbouring text parts, escaped as one

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method: Callable[[dict], None] | None = getattr(self, f"visit_{kind}", None) if kind.isidentifier() else None
        if method is None:
            self._attach("unknown", part, 1, kind)
        else:
            method(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def flattened(self) -> str:
        self._flush()
        return "".join(self.out)

    def _flush(self) -> None:
        self.out.append(escape("".join(self.text)))
        self.text.clear()

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, measure(part.get("width")) * measure(part.get("height")) / TILE)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, measure(part.get("seconds")) / SECONDS_PER_TOKEN)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, measure(part.get("pages")) * TOKENS_PER_PAGE)

    def _attach(self, kind: str, part: dict, tokens: float, recorded: str | None = None) -> None:
        n = max(1, math.ceil(tokens))
        self._flush()
        self.out.append(f"<|{kind}|>" + PAD * n + f"<|/{kind}|>")
        self.attachments.append({"type": recorded or kind, "ref": part.get("ref") or "", "tokens": n})


def measure(x: float | None) -> float:
    return float(x) if x is not None and math.isfinite(x) and x > 0 else 0.0


_TURN = "formatted string, from long, to long, attachments array<struct<type:string,ref:string,tokens:int>>"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
    for batch in batches:
        texts, starts, ends, attached = [], [], [], []
        for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            visitor = Visitor()
            for part in parts or []:
                visitor.visit(part)
            head, body = f"{START}{escape_role(role)}\n", visitor.flattened()
            texts.append(f"{head}{body}{END}\n")
            starts.append(len(head))
            ends.append(len(head) + len(body))
            attached.append(visitor.attachments)
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["conv", "turn", "role", "sort"]).columns, pa.array(texts, pa.large_string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(attached, kind)],
            names=["conv", "turn", "role", "sort", "formatted", "from", "to", "attachments"],
        )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` (start, end in characters) and ``attachments``.

    Content is ``parts_col``, an array of ``PART`` structs, or one text part of ``text_col``.
    """
    only(turns, conv_col, turn_col, role_col, parts_col or text_col)
    arrow_batches(turns.sparkSession, 1000)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")) if text_col in turns.columns else F.lit("")
    one = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    parts = F.col(f"`{parts_col}`").cast(f"array<{PART}>") if parts_col else one
    sort = text if not parts_col else F.to_json(F.col(f"`{parts_col}`"))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), sort.alias("sort"), parts.alias("parts")
    )
    types = dict(rows.dtypes)
    rows = rows.mapInArrow(_render, f"conv {types['conv']}, turn {types['turn']}, role string, sort string, {_TURN}")
    rows = rows.withColumn("chars", F.length("formatted").cast("long"))
    turn = F.struct("turn", "role", "sort", "formatted", "from", "to", "chars", "attachments")
    chats = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = """aggregate(t, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)),
      (a, x) -> named_struct('at', a.at + x.chars, 'spans',
        if(x.role = 'assistant', concat(a.spans, array(named_struct('start', a.at + x.from, 'end', a.at + x.to))), a.spans)), a -> a.spans)"""
    return chats.select(
        F.col("conv").alias(conv_col),
        F.concat_ws("", F.col("t.formatted")).alias("formatted"),
        F.expr(spans).alias("loss_spans"),
        F.flatten(F.col("t.attachments")).alias("attachments"),
    )


_CONTROL = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; the inverse of the template for text parts."""
    out, at = [], 0
    while at < len(formatted):
        m = _CONTROL.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, chars, losses, sizes = [], [], [], [], []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text)
            n.append(len(turns))
            digests.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest())
            masked = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            chars.append(len(masked))
            losses.append(hashlib.sha256(masked.encode("utf-8")).hexdigest())
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(chars, pa.int64()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())],
            names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a reader of the formatted output gets: turns and masked text, as digests."""
    arrow_batches(chats.sparkSession, 200)
    rows = chats.select(F.col(f"`{conv_col}`").alias("conv"), "formatted", "loss_spans")
    kind = dict(rows.dtypes)["conv"]
    out = rows.mapInArrow(_read_back, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)
