"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the coordinate of largest
magnitude with its sign, the nearest vertex of the cross-polytope. A table's bucket joins ``k`` such hashes and the label.
Each vector is in its own bucket of every table and, as multiprobe, in those where one hash is the second nearest
vertex, for the ``PROBES`` hashes in which that is least worse. ``k`` follows from the number of vectors, so that a
bucket holds few unrelated ones, and the number of tables from ``k``: as many as find ``RECALL`` of pairs that lie
just at the threshold, by simulation at the vectors' dimension. Closer pairs are found more often.

Members of a bucket are compared exactly, in double precision. Buckets are cut into blocks of at most ``BLOCK`` members
and compared block by block, so a bucket that holds a third of all vectors is spread over many tasks. A pair that meets
in several buckets counts in the first only. Blocks give back a count and one forest edge per member, never the pairs.

Equal vectors of a label are one node with a multiplicity: its copies are linked with each other and share their
links. Vectors link only if their labels are equal and not null and their lengths agree. Vectors that are null, empty or
zero, or that hold a null or a number that is not finite, link with nothing and are their own component. Repeated rows
are vectors of their own. Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._graph import components
from terrasample.llm._scratch import Scratch, arrow_batches, only
from terrasample.llm._text import mix64

#: Part of the pairs just at the threshold that the tables find.
RECALL = 0.985
#: Extra buckets per table and vector; members of a block; unrelated vectors wanted in a bucket at most.
PROBES, BLOCK, FILL = 1, 512, 16
_SEED = 20240511


def rotations(dim: int, count: int) -> np.ndarray:
    """Random signs of ``count`` rotations of vectors padded to a power of two."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(_SEED).choice(np.array([-1.0, 1.0]), (count, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / math.sqrt(size)


def vertices(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second nearest vertex of each row under one rotation, and how much worse the second is."""
    padded = np.zeros((len(x), signs.shape[1]))
    padded[:, : x.shape[1]] = x
    for s in signs:
        padded = hadamard(padded * s)
    size = padded.shape[1]
    weight = np.abs(padded)
    top = np.argpartition(-weight, 1, axis=1)[:, :2]
    order = np.argsort(-np.take_along_axis(weight, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    value = np.take_along_axis(padded, top, 1)
    code = top + size * (value < 0)
    return code[:, 0], code[:, 1], np.abs(value[:, 0]) - np.abs(value[:, 1])


def buckets(x: np.ndarray, k: int, tables: int, signs: np.ndarray) -> np.ndarray:
    """Bucket codes, tables x (1 + PROBES) columns, of unit vectors."""
    out = np.empty((len(x), tables, 1 + PROBES), dtype=np.uint64)
    for t in range(tables):
        found = [vertices(x, signs[t * k + j]) for j in range(k)]
        best = np.stack([f[0] for f in found], 1).astype(np.uint64)
        worse = np.argsort(np.stack([f[2] for f in found], 1), axis=1, kind="stable")
        variants = [best]
        for p in range(PROBES):
            other = best.copy()
            at = worse[:, min(p, k - 1)]
            rows = np.arange(len(x))
            other[rows, at] = np.stack([f[1] for f in found], 1)[rows, at]
            variants.append(other)
        for v, codes in enumerate(variants):
            h = mix64(np.full(len(x), t + 1, dtype=np.uint64))
            for j in range(k):
                h = mix64(h ^ codes[:, j])
            out[:, t, v] = h
    return out.reshape(len(x), -1)


def tables_for(dim: int, k: int, cosine: float) -> int:
    """Tables that find RECALL of the pairs at the threshold."""
    random = np.random.default_rng(_SEED + 1)
    x = random.normal(size=(2000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = random.normal(size=x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y /= np.maximum(np.linalg.norm(y, axis=1)[:, None], 1e-300)
    y = cosine * x + math.sqrt(1 - cosine**2) * y
    signs = rotations(dim, k)
    a, b = buckets(x, k, 1, signs), buckets(y, k, 1, signs)
    p = (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
    return max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - min(p, 0.999))))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components in double precision, where each row's begin, and its length: 0 for rows that link with nothing."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = np.asarray(values.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    size = np.where(np.asarray(column.is_valid()), size, 0)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    odd, some = sums(~np.isfinite(flat)), sums(flat != 0)
    good = (odd[start + size] == odd[start]) & (some[start + size] > some[start])
    return flat, start, np.where(good, size, 0)


def _tags(labels: list) -> np.ndarray:
    """64-bit hashes of whole labels."""
    known: dict = {}
    for x in labels:
        if x not in known:
            known[x] = int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little")
    return np.array([known[x] for x in labels], dtype=np.uint64)


def nodes_of(rows: DataFrame) -> DataFrame:
    """``id, label, node, vec, dim``: rows with the hash of their label and vector; null for those that cannot link."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, start, size = _vectors(batch.column("vec"))
            labels = batch.column("label").to_pylist()
            size = np.where([x is not None for x in labels], size, 0)
            tags, node = mix64(_tags(labels)), np.zeros(len(size), dtype=np.uint64)
            for d in np.unique(size[size > 0]):
                own = np.flatnonzero(size == d)
                x = flat[start[own][:, None] + np.arange(d)] + 0.0  # makes the two zeros equal
                bits = mix64(x.view(np.uint64) + mix64(np.arange(1, d + 1, dtype=np.uint64)))
                node[own] = mix64(np.add.reduce(bits, axis=1) ^ tags[own])
            node = pa.array(node.view(np.int64), mask=size == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), node, pa.array(size.astype(np.int32)), batch.column("vec")], names=["id", "label", "node", "dim", "vec"])

    return rows.mapInArrow(run, f"id {types['id']}, label {types['label']}, node long, dim int, vec {types['vec']}")


def _hashed(nodes: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """Nodes with their bucket codes; ``plan`` has hashes and tables by dimension."""
    types = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = {d: rotations(d, k * t) for d, (k, t) in plan.items()}
        for batch in batches:
            flat, start, size = _vectors(batch.column("vec"))
            tags = _tags(batch.column("label").to_pylist())
            width = np.array([plan[int(d)][1] * (1 + PROBES) for d in size], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(width)])
            codes = np.zeros(at[-1], dtype=np.uint64)
            for d in np.unique(size):
                which = np.flatnonzero(size == d)
                x = flat[start[which][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                own = mix64(buckets(x, *plan[int(d)], signs[int(d)]) ^ mix64(tags[which] + np.uint64(d))[:, None])
                codes[at[which][:, None] + np.arange(own.shape[1])] = own
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(codes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    fields = ", ".join(f"{c} {t}" for c, t in types.items())
    return nodes.mapInArrow(run, f"{fields}, codes array<long>")


#: Runs of at most so many members are compared together, all pairs of all runs at once.
SMALL = 24


def _pairs(x: np.ndarray, start: np.ndarray, size: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same run whose cosine reaches the threshold; x has unit rows."""
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for m in np.unique(size):
        runs = start[size == m]
        if m > SMALL:
            for s in runs:
                a, b = np.nonzero(np.triu(x[s : s + m] @ x[s : s + m].T >= cosine, 1))
                left.append(a + s)
                right.append(b + s)
            continue
        i, j = np.triu_indices(m, 1)
        for c in range(0, len(runs), max(1, 200_000 // len(i))):
            some = runs[c : c + max(1, 200_000 // len(i))]
            a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            left.append(a[near])
            right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _compare(x: np.ndarray, codes: np.ndarray, copies: np.ndarray, side: np.ndarray, apart: np.ndarray, bucket: np.ndarray, start: np.ndarray, size: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of members (where ``apart``, between a run's two sides): to each row its linked vectors, and the
    row at the root of its tree."""
    added, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    a, b = _pairs(x, start, size, cosine)
    across = ~apart[a] | (side[a] != side[b])
    a, b = a[across], b[across]
    # a pair counts in the least of the buckets that it shares
    first, width = np.ones(len(a), dtype=bool), 1 + PROBES
    for t in range(codes.shape[1] // width):
        own, other = codes[a, t * width : (t + 1) * width], codes[b, t * width : (t + 1) * width]
        for u in range(width):
            for v in range(width):
                first &= ~((own[:, u] == other[:, v]) & (own[:, u] < bucket[a]))
    a, b = a[first], b[first]
    added += np.bincount(a, weights=copies[b], minlength=len(x)).astype(np.int64)
    added += np.bincount(b, weights=copies[a], minlength=len(x)).astype(np.int64)
    while True:  # least labels along links until they settle
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return added, root


def _blocks(rows: DataFrame, cosine: float) -> DataFrame:
    """``node, added, peer`` from rows sorted by bucket and block."""

    def finish(members: pa.Table, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        members = members.combine_chunks()
        lists, codes = members.column("vec").chunk(0), members.column("codes").chunk(0)
        dims = np.diff(np.asarray(lists.offsets))
        flat, at = np.asarray(lists.flatten(), dtype=np.float64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        tags, where = np.asarray(codes.flatten()).view(np.uint64), np.asarray(codes.offsets) - codes.offsets[0].as_py()
        get = lambda c: np.asarray(members.column(c))
        node, copies, side, apart, bucket = get("node"), get("copies"), get("side"), get("i") != get("j"), get("bucket").view(np.uint64)
        for d in np.unique(dims[start]):  # a bucket's vectors have one length
            runs = dims[start] == d
            begin, count = start[runs], size[runs]
            pick = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            x = flat[at[pick][:, None] + np.arange(d)]
            x = x / np.abs(x).max(1)[:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            c = tags[where[pick][:, None] + np.arange(where[pick[0] + 1] - where[pick[0]])]
            own = np.concatenate([[0], np.cumsum(count)[:-1]])
            added, root = _compare(x, c, copies[pick], side[pick], apart[pick], bucket[pick], own, count, cosine)
            some = added > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[pick][some]), pa.array(added[some]), pa.array(node[pick][root[some]])], names=["node", "added", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            key = np.stack([np.asarray(table.column(c)) for c in ("bucket", "i", "j")], 1)
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            size = np.diff(edge)
            if (size > 1).any():
                yield from finish(table, edge[:-1][size > 1], size[size > 1])
            left = table.slice(edge[-1])
        if left is not None and len(left) > 1:
            yield from finish(left, np.array([0]), np.array([len(left)]))

    return rows.mapInArrow(run, "node long, added long, peer long")


def link(table: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: the id, ``n_links``, ``component_id`` (the smallest id reachable by links) and ``kept``."""
    spark = table.sparkSession
    arrow_batches(spark, 4000)
    scratch = Scratch(spark, "embedding")
    rows = only(table, id_col, vector_col, label_col).toDF("id", "vec", "label")
    rows = scratch.table(nodes_of(rows))
    same = rows.where("node is not null").groupBy("node", "label")
    nodes = scratch.table(same.agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")))

    plan = {}
    for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).collect():
        values = 2 << max(1, (r["dim"] - 1).bit_length())
        k = max(1, math.ceil(math.log(max(1.0, r["n"] / r["labels"] / FILL)) / math.log(values)))
        plan[r["dim"]] = k, tables_for(r["dim"], k, cosine)
    hashed = scratch.table(_hashed(nodes.select("node", "copies", "label", "vec"), plan).drop("label"))

    members = hashed.select("node", F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = members.join(sizes, "bucket").withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int"))
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    members = members.withColumn("o", other).withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
    members = members.select("bucket", "i", "j", "side", "node").join(hashed, "node")
    members = members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = scratch.table(_blocks(members.select("bucket", "i", "j", "side", "node", "copies", "vec", "codes"), cosine))

    linked = found.groupBy("node").agg(F.sum("added").alias("added"))
    placed = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")), scratch)
    least = placed.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("of_component"))
    placed = placed.join(least, "component").select(F.col("node").alias("v"), "of_component")
    result = nodes.join(linked, "node", "left").join(placed, F.col("node") == F.col("v"), "left")
    result = result.select("node", (F.col("copies") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("of_component", "least").alias("component_id"))
    out = rows.select("id", "node").join(result, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
