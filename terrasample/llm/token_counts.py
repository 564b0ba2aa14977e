"""Token counts with a whole-token shortcut.

A byte-level BPE encodes every pre-token on its own. Offline, once per vocabulary, each vocabulary string is
run through the merges; those that come back as exactly one token are *proven*. While counting, a pre-token that
is a proven string adds one and is never merged; every other pre-token goes through the library's merges.

Texts of plain Latin characters are split by the vocabulary's published pattern; any other text is split by the
library's own pre-tokenizer, so Unicode tables of the two pattern engines need not agree. Special tokens written in
a text are cut out first and count one each, as the library does by default.

Nulls count as empty: 0 bytes, 0 tokens, not over the limit. Empty tables give empty results, repeated rows are
counted again, other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._scratch import arrow_batches, only

#: Plain characters (ASCII text and Latin letters up to U+0233), and the published pre-token pattern
#: of byte-level BPE vocabularies with its classes written out for them.
PLAIN = r"[\t\n\r\x20-\x7e¡-¬®-ȳ]*"
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ȳ", "0-9²³¹¼-¾"
PLAIN_TOKEN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"""
#: Remembered counts of merged pre-tokens per worker, in entries; a full memory is emptied.
MEMORY = 400_000


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies spell bytes: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts the tokens of one text at a time."""

    def __init__(self, vocabulary: str, proven: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        table = byte_alphabet()
        self.spell, self.back = [table[b] for b in range(256)], {c: b for b, c in table.items()}
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pattern = re.compile(PLAIN_TOKEN)
        self.plain = re.compile(PLAIN)
        self.proven = proven or frozenset()
        self.known = dict.fromkeys(self.proven, 1)

    def spelled(self, piece: str) -> str:
        spell = self.spell
        return "".join([spell[b] for b in piece.encode("utf-8")])

    def merged(self, spelled: str) -> int:
        return len(self.tokenizer.model.tokenize(spelled))

    def prove(self) -> frozenset[str]:
        """Vocabulary strings, as text, that the merges give back as one token."""
        back, out = self.back, set()
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            if all(c in back for c in token) and self.merged(token) == 1:
                try:
                    out.add(bytes(back[c] for c in token).decode("utf-8"))
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token
        return frozenset(out)

    def pieces(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.pattern.findall(text)
        back = self.back
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in found]

    def ordinary(self, text: str) -> int:
        pieces = self.pieces(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            for p, k in zip(pieces, found, strict=True):
                if k is None and p not in self.known:
                    self.learn(p)
            found = [self.merged(self.spelled(p)) if k is None else k for p, k in zip(pieces, map(self.known.get, pieces), strict=True)]
        return sum(found)

    def learn(self, piece: str) -> None:
        """Merge a pre-token that is not proven and remember its count, unless it is long."""
        if len(self.known) >= MEMORY + len(self.proven):
            self.known = dict.fromkeys(self.proven, 1)
        if len(piece) <= 64:
            self.known[piece] = self.merged(self.spelled(piece))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.ordinary(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.ordinary(p) for p in parts if p)


_COUNTERS: dict[int, Counter] = {}


@functools.lru_cache(maxsize=8)
def proven_strings(vocabulary: str) -> frozenset[str]:
    """The vocabulary's proof, made once in a process."""
    return Counter(vocabulary).prove()


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The vocabulary is read on the driver and broadcast with its proven strings; both are bounded by the
    vocabulary's size, not by the data.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    vocabulary = Path(vocabulary_path).read_text(encoding="utf-8")
    proven = proven_strings(vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, proven))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        counter = _COUNTERS.get(hash(words))
        if counter is None:
            counter = _COUNTERS[hash(words)] = Counter(words, known)
        for batch in batches:
            n = pa.array(map(counter, batch.column(1).to_pylist()), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["id", "n_bytes", "n_tokens"])

    rows = only(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
