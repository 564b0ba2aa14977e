"""Benchmark decontamination: short test items inside long documents, by MinHash containment.

The containment of an item in a document is the share of the item's distinct word shingles that the document has. The
search is by MinHash and partitioned by size. An item is signed by its ``MINIMA`` least shingle hashes, a uniform sample of
its shingles, and belongs to the class c with 2^c <= shingles < 2^(c+1). A document is signed for each class by those of
its shingle hashes that lie below the class's bound, the largest minimum of any item of the class, so a class of longer
items reads a smaller part of a document: a signature says as much about a short item in a long document as in a short
one. The share of an item's minima that the document's signature has estimates the containment.

An item and a document that agree in ``need`` minima make a candidate. ``need`` follows from the item's size: for an item of
n shingles of which just the threshold lie in the document, the minima found are hypergeometric, and ``need`` is the
largest number that they fall short of with a chance of at most ``MISS``. Items of at most ``MINIMA`` shingles are signed
whole, and nothing is missed. Candidates are verified by exact shingle containment in the whole document.

Items are a query set that all documents are held against; they are broadcast in blocks of at most ``BLOCK_BYTES`` of text,
with a job per block, one after the other. Documents are never shuffled or expanded.

An item of fewer words than a shingle has its whole sequence as its one shingle, which is looked for as that many words.
Items and documents without words (or null) match nothing; so does an empty table. Repeated rows are found alike. Ids of items
are of any type that can be sorted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terrasample.llm._scratch import Scratch, arrow_batches, free_name, only
from terrasample.llm._text import shingles, text_bytes, words

#: Most bytes of items broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Minima of a signature, and the chance that an item just at the threshold is missed by its minima.
MINIMA, MISS = 32, 1e-9


def needed(n: int, inside: int, minima: int = MINIMA, miss: float = MISS) -> int:
    """Minima that must agree for an item of ``n`` shingles of which ``inside`` lie in the document."""
    k = min(n, minima)
    whole, below = math.comb(n, k), 0
    for x in range(max(0, k - (n - inside)), k + 1):
        below += math.comb(inside, x) * math.comb(n - inside, k - x)
        if below > miss * whole:
            return max(1, x)
    return max(1, k)


class Items:
    """Signatures and shingles of a block of items that share a shingle length."""

    def __init__(self, ids: list, sets: list[np.ndarray], k: int, percent: int):
        self.ids, self.sets, self.k = ids, sets, k
        self.least = np.array([-(-len(s) * percent // 100) for s in sets])
        self.need = np.array([needed(len(s), int(m)) for s, m in zip(sets, self.least, strict=True)])
        by_class = defaultdict(list)
        for i, s in enumerate(sets):
            by_class[int(len(s)).bit_length() - 1].append(i)
        #: By class: its bound, its items' minima (sorted, each once), and the items of each minimum.
        self.classes: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = []
        for _, members in sorted(by_class.items()):
            signature = [np.sort(sets[i])[:MINIMA] for i in members]
            value = np.concatenate(signature)
            item = np.repeat(members, [len(s) for s in signature])
            order = np.argsort(value, kind="stable")
            minimum, first = np.unique(value[order], return_index=True)
            self.classes.append((minimum[-1], minimum, np.append(first, len(value)), item[order]))

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs that agree in enough minima; ``doc`` is the text of each shingle hash."""
        out = []
        for bound, minimum, first, item in self.classes:
            signed = np.flatnonzero(h <= bound)
            at = np.searchsorted(minimum, h[signed])
            agree = minimum[at] == h[signed]
            found = np.unique(np.stack([doc[signed[agree]], at[agree]], 1), axis=0)  # a shingle counts once in a text
            count = first[found[:, 1] + 1] - first[found[:, 1]]
            text = np.repeat(found[:, 0], count)
            where = np.repeat(first[found[:, 1]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            pair, times = np.unique(text * len(self.sets) + item[where], return_counts=True)
            enough = pair[times >= self.need[pair % len(self.sets)]]
            out += zip((enough // len(self.sets)).tolist(), (enough % len(self.sets)).tolist(), strict=True)
        return sorted(out)

    def search(self, word: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text number: (item, common shingles, shingles of the item) of the items that it contains."""
        h, at = shingles(word, first, self.k)
        out = defaultdict(list)
        if len(h):
            for d, i in self.candidates(h, np.repeat(np.arange(len(at) - 1), np.diff(at))):
                common = int(np.isin(self.sets[i], h[at[d] : at[d + 1]]).sum())
                if common >= self.least[i]:
                    out[d].append((self.ids[i], common, len(self.sets[i])))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """Items in blocks of about ``BLOCK_BYTES`` at most; one block if all of them are within it."""
    rows = only(benchmark, item_col, text_col).toDF("item", "text").where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    n = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else 1
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).distinct() for i in range(n)]


def _items(block: DataFrame, k: int, percent: int) -> list[Items]:
    rows = sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda x: (x[0] is not None, x))
    word, first = words(*text_bytes(pa.array([t for _, t in rows], pa.string())))
    by_k = defaultdict(lambda: ([], []))
    for i, (item, _) in enumerate(rows):
        n = int(first[i + 1] - first[i])
        if n:
            own, _ = shingles(word[first[i] : first[i + 1]], np.array([0, n]), min(k, n))
            by_k[min(k, n)][0].append(item)
            by_k[min(k, n)][1].append(np.unique(own))
    return [Items(ids, sets, size, percent) for size, (ids, sets) in sorted(by_k.items())]


def _held_against(rows: DataFrame, block: DataFrame, k: int, percent: int, matching: bool) -> DataFrame:
    """``rows`` (the text first) that contain an item of the block, with ``found``, or those that contain none."""
    shared = rows.sparkSession.sparkContext.broadcast(_items(block, k, percent))
    kind = T.ArrayType(T.StructType([T.StructField("item", block.schema["item"].dataType), T.StructField("common", T.IntegerType()), T.StructField("size", T.IntegerType())]))
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, first = words(*text_bytes(batch.column(0)))
            found: dict[int, list] = defaultdict(list)
            for items in shared.value:
                for d, hits in items.search(word, first).items():
                    found[d] += [{"item": i, "common": c, "size": n} for i, c, n in hits]
            if matching:
                keep = sorted(found)
                part = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([found[d] for d in keep], arrow)], names=[*part.schema.names[1:], "found"])
            else:
                yield batch.filter(pa.array([d not in found for d in range(batch.num_rows)], pa.bool_()))

    # field names may repeat in letter case only; Spark resolves output by position
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema]
    return rows.mapInArrow(run, T.StructType([*fields[1:], T.StructField("found", kind)] if matching else fields))


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id, found`` of the documents that contain items: the items whose containment is ``percent`` or more, with the shingles
    they share and have. A row per document and block of items."""
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    rows = only(docs, text_col, id_col).toDF("text", "id")
    blocks = _blocks(benchmark, item_col, item_text)
    if len(blocks) == 1:
        return _held_against(rows, blocks[0], k, percent, True)
    scratch = Scratch(spark, "decontamination")
    out = None
    for block in blocks:
        part = scratch.table(_held_against(rows, block, k, percent, True))
        out = part if out is None else out.unionAll(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contaminated document id: ``items`` (ascending), ``n_items`` and the highest ``containment``."""
    pairs = search(docs, benchmark, id_col, text_col, k=k, percent=percent).select("id", F.explode("found").alias("f"))
    pairs = pairs.groupBy("id", F.col("f.item").alias("item")).agg(F.max(F.col("f.common") / F.col("f.size")).alias("containment"))
    out = pairs.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.count(F.lit(1)).alias("n_items"), F.max("containment").alias("containment"))
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones. With several blocks of items what each leaves is written before the next."""
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    text = free_name("text_", docs.columns)
    rows = docs.select(F.col(f"`{text_col}`").alias(text), *[F.col(f"`{c}`") for c in docs.columns])
    blocks = _blocks(benchmark, item_col, item_text)
    scratch, before = Scratch(spark, "decontamination"), None
    for i, block in enumerate(blocks):
        rows = _held_against(rows, block, k, percent, False)
        if i + 1 < len(blocks):
            rows = scratch.table(rows)
            if before is not None:
                scratch.drop(before)
            before = rows
    return rows.drop(text)
