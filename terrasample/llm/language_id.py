"""Language ID by prediction by partial matching (PPM).

For each language a variable-order byte context tree is learned: for every context of 0 to ``order`` bytes, how often
each next byte followed it. A byte seen n times after a context with t bytes of which d differ costs log2((t + d) / n)
bits; a byte not seen there first costs the escape, log2((t + d) / d) bits, and is then coded in the next shorter context,
down to 8 bits for a byte never seen (escape method C). Statistics are frozen while scoring, so the code length of a text
under each language is exact and does not depend on other texts. The language with the shortest code wins; the score is
its share of the likelihoods 2^-bits.

Because statistics are frozen, the recursion is done once per learned context and not once per text: each language's code
length of every known (context, byte) pair is tabled, and scoring a byte is one table lookup for all languages together;
only unknown pairs walk down the orders.

Case is folded first. Null texts and texts without a letter get ``und`` and score 0, and so does everything if no
labelled text was seen. Ties go to the first language by code point. Whole texts are scored, however long. Repeated rows
are scored alike. Columns of the input that clash with the added ones give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasample.llm._scratch import arrow_batches, only

#: Bytes of context.
ORDER = 4
#: The bounded training sample: bytes and rows in all, shared equally by the languages; characters of a text that are
#: learned from; most languages, the largest; (language, byte) pairs in all, so that many languages learn from less each.
SAMPLE_BYTES, SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_LANGUAGES, SAMPLE_PAIRS = 6_000_000, 20_000, 65_536, 1024, 60_000_000
#: Rows of each language that are kept whatever its share.
SAMPLE_LEAST = 8
#: Bytes scored at a time.
SLICE = 1 << 20

_NONE = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Rows by 64-bit key: open addressing in numpy."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _NONE)
        self.at = np.zeros(1 << bits, dtype=np.int32)
        self.rows = rows
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == _NONE
            where, first = np.unique(slot[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.keys[where] = keys[left[winners]]
            self.at[where] = left[winners]
            rest = np.ones(len(left), dtype=bool)
            rest[winners] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for unknown keys."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != _NONE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            more = ~hit & (there != _NONE)
            left, slot = left[more], slot[more]
        return out


@dataclass
class Model:
    languages: list[str]
    order: int
    zero: np.ndarray  # 256 x languages: bits of a byte without context
    pairs: list[Table]  # by order from 1: bits of known (context, byte) pairs
    escapes: list[Table]  # by order from 1: bits of the escape from known contexts

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths by language of the last byte of each key after the ``order`` bytes before it."""
        if order == 0:
            return self.zero[(keys & np.uint64(255)).astype(np.int64)]
        row = self.pairs[order - 1].find(keys)
        out = self.pairs[order - 1].rows[row]
        unknown = np.flatnonzero(row < 0)
        if len(unknown):
            out[unknown] = self.escaped(keys[unknown], order)
        return out

    def escaped(self, keys: np.ndarray, order: int) -> np.ndarray:
        out = self.bits(keys & np.uint64((1 << 8 * order) - 1), order - 1).copy()
        row = self.escapes[order - 1].find(keys >> np.uint64(8))
        known = row >= 0
        out[known] += self.escapes[order - 1].rows[row[known]]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Code length of each text under each language."""
        pad = b"\0" * self.order
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(x for p in parts for x in (pad, p)), dtype=np.uint8)
        start = np.cumsum(sizes + self.order) - sizes
        for a in range(0, len(data), SLICE):
            b = min(len(data), a + SLICE)
            key = np.zeros(b - a, dtype=np.uint64)
            for back in range(self.order, -1, -1):
                lo = a - back
                part = data[max(0, lo) : b - back].astype(np.uint64)
                key <<= np.uint64(8)
                key[len(key) - len(part) :] |= part
            cost = self.bits(key, self.order)
            first = np.searchsorted(start + sizes, a, side="right")
            last = np.searchsorted(start, b, side="left")
            for_docs = np.arange(first, last)
            lo, hi = np.maximum(start[for_docs], a) - a, np.minimum(start[for_docs] + sizes[for_docs], b) - a
            some = hi > lo
            if some.any():
                edges = np.stack([lo[some], hi[some]], axis=1).ravel()
                edges = edges[:-1] if edges[-1] == len(key) else edges
                total[for_docs[some]] += np.add.reduceat(cost, edges, axis=0, dtype=np.float64)[::2]
        return total


def fit(samples: list[tuple[str, str]], order: int = ORDER) -> Model:
    """Learn from (language, text) pairs."""
    languages = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(languages)}
    pad = b"\0" * order
    data = [
        np.frombuffer(b"".join(x for la, t in samples if la == lang for x in (pad, t.lower().encode("utf-8", "surrogatepass"))) + pad, dtype=np.uint8).astype(np.uint64)
        for lang in languages
    ]

    def grams(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        key = np.zeros(max(0, len(of) - order), dtype=np.uint64)
        for back in range(n - 1, -1, -1):
            key = (key << np.uint64(8)) | of[order - back : len(of) - back]
        return np.unique(key, return_counts=True)

    model = Model(languages, order, np.zeros((256, len(number))), [], [])
    for k in range(order + 1):
        counted = [grams(d, k + 1) for d in data]
        keys = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, dtype=np.uint64)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        n = np.zeros((len(keys), len(languages)))
        for i, (key, count) in enumerate(counted):
            n[np.searchsorted(keys, key), i] = count
        t, d = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(t, of, n)
        np.add.at(d, of, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(t > 0, np.log2((t + d) / d), 0.0)
            seen = np.log2((t + d)[of] / n)
        if k == 0:
            model.zero = np.full((256, len(languages)), 8.0) + (escape[0] if len(escape) else 0.0)
            at = keys.astype(np.int64)
            model.zero[at] = np.where(n > 0, seen, model.zero[at])
            model.zero = model.zero.astype(np.float32)
            continue
        model.escapes.append(Table(contexts, escape.astype(np.float32)))
        model.pairs.append(Table(np.zeros(0, dtype=np.uint64), np.zeros((1, len(languages)), dtype=np.float32)))
        fall = model.escaped(keys, k)
        model.pairs[-1] = Table(keys, np.where(n > 0, seen, fall).astype(np.float32))
    return model


def training_sample(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """A bounded sample of labelled texts. Each language by itself gets an equal share of SAMPLE_BYTES and SAMPLE_ROWS: the
    rows whose hash of id and text is lowest among its own, by a bound that meets the smaller share, but SAMPLE_LEAST rows
    at least. A long text is learned from by its first SAMPLE_TEXT characters (it is scored whole). Only the sample
    reaches the driver."""
    rows = only(docs, id_col, lang_col, text_col).toDF("id", "lang", "text").where("lang is not null and text is not null and text <> ''")
    rows = rows.select("lang", F.substring("text", 1, SAMPLE_TEXT).alias("text"), F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)).alias("chance"))
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes"), "lang").limit(SAMPLE_LANGUAGES).collect()
    if not totals:
        return []
    per = min(SAMPLE_BYTES, SAMPLE_PAIRS // len(totals)) / len(totals), SAMPLE_ROWS / len(totals)
    bounds = {r["lang"]: min(1.0, max(min(per[0] / r["bytes"], per[1] / r["n"]), SAMPLE_LEAST / r["n"])) for r in totals}
    keys = [x for la, share in bounds.items() for x in (F.lit(la), F.lit(int(share * (1 << 40))))]
    rows = rows.withColumn("text", F.substring("text", 1, max(1024, min(SAMPLE_TEXT, int(per[0])))))
    picked = rows.where(F.col("chance") < F.create_map(*keys)[F.col("lang")]).select("lang", "text", "chance")
    found = [(r["lang"], r["chance"], r["text"]) for r in picked.collect()]
    missing = [la for la in bounds if la not in {f[0] for f in found}]
    if missing:  # few rows, none of them below the bound
        lowest = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.struct("chance", "text")).alias("x"))
        found += [(r["lang"], r["x"]["chance"], r["x"]["text"]) for r in lowest.collect()]
    return [(la, text) for la, _, text in sorted(found)]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``lang_pred`` and ``score`` added."""
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    text = docs.select(F.col(f"`{text_col}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letter = shared.value, regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(0).to_pylist()
            use = [i for i, t in enumerate(texts) if t and model.languages and letter.search(t)]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if use:
                bits = model.score([texts[i] for i in use])
                best = bits.argmin(axis=1)
                weight = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0))
                scores[use] = 1.0 / weight.sum(axis=1)
                for i, b in zip(use, best, strict=True):
                    names[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return text.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether a row is kept from learning: the remainder of the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % parts == part, F.lit(False))
