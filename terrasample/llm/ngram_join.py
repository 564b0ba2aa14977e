"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct k-word shingles ("tokens", 64-bit hashes); two documents link when their sets'
Jaccard similarity is ``percent`` / 100 or more. Any partner of a set of n tokens shares all but t = n - ceil(n * percent
/ 100) of them. All sets order tokens alike: rare ones first, then frequent ones, each by hash.

* A set with enough rare tokens is indexed under the first t + 1 of them: of these a partner has at least one.
* Otherwise it is indexed under all its rare tokens, its prefix is extended into the frequent ones, and these are
  indexed in combinations of two. Frequent tokens are dealt into subclasses by hash, combined only within one, and the
  prefix goes on until rare tokens plus (tokens - 1) of each subclass exceed t: after losing any t tokens a rare one
  or two of one subclass remain, so a partner shares a signature. Subclasses grow with the set (one per 8 tokens of its
  power-of-two size class, a set near the upper edge is indexed for the next class too), which keeps the combinations of
  a set in proportion to its size.

Frequent are tokens that more than ``FREQUENT`` different sets have in their plain prefix (the t + 1 first by hash), and
tokens that more than that many sets come to when they put rare ones in their place (sets of which ``MOSTLY`` of the
plain prefix is frequent, copies of something, count all their tokens). The frequent tokens are kept in a bitmap of a
size that follows from their number; where they would be more than a bitmap's capacity, the number of sets from which a
token counts as frequent is doubled until they are not. A cell that holds a frequent token by chance makes others
count as frequent. Classes only decide how a set is indexed: they cost candidates but no links.

Equal sets are one node. Within the sets under a signature not all pairs are compared: first all with one pivot, the set
with the fewest rare tokens; linked sets then are one component, and only pairs from different components that the
sizes and rare tokens leave a chance are compared after that. Every comparison is an exact intersection. So no link that
joins two components is lost, while a group of thousands of copies costs about as many comparisons as it has members.
Sets under a very common signature are compared in blocks of ``SIDE`` sets, so no task has them all.

Whole sets are never stored or shuffled but for those that are compared: they would be several times the texts' size. The
steps that need more than a prefix (what replaces frequent tokens, combinations, comparison) make them from the texts again,
for the rows that a bitmap of ids lets through.

Links are counted, where that is asked for, after the components are known: both ends of a link are in one component, so
all pairs of different sets within each component are compared, exactly. Large components are split into blocks of about
``BLOCK`` sets, and every pair of blocks is a run of rows of its own. That is the square of a component's size, as is
the number of links in a group of near copies; the rows that it takes are each set once per block of its component.

Texts without words (and nulls) have no tokens and link with nothing: their component is their own id. Rows that share
an id are sets of their own. Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.llm._graph import components
from terrasample.llm._scratch import CAPACITY, Bitmap, Scratch, arrow_batches, bitmap_of, only
from terrasample.llm._text import mix64, shingle_hashes

#: Sets that may share a token before it counts as frequent.
FREQUENT = 16
#: Tokens of a size class per subclass.
PER_SUBCLASS = 8
#: Part of the plain prefix.
MOSTLY = 0.25
#: Sets of a block under a signature whose sets are compared with each other.
SIDE = 256
#: Sets, and their tokens, of a block of a component in which links are counted.
BLOCK = 256
BLOCK_TOKENS = 1 << 18
#: Different tokens of two blocks that are held as a table at once.
WIDTH = 4096


def slack(n: int, percent: int) -> int:
    """Tokens of a set of n that a partner may lack."""
    return n - -(-n * percent // 100)


def node_of(tokens: np.ndarray) -> np.uint64:
    """64-bit identity of a set of tokens."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)))
        mixed = np.bitwise_xor.reduce(mix64(tokens + np.uint64(0x14057B7EF767814F)))
        return mix64(np.array([total ^ mix64(np.array([mixed + np.uint64(len(tokens))]))[0]]))[0]


def combinations(tokens: np.ndarray, need: int, size_class: int) -> np.ndarray:
    """Signatures of pairs of frequent tokens (ascending): enough of them that any ``need - 1`` losses leave one."""
    parts = max(1, (1 << size_class) // PER_SUBCLASS)
    part = (mix64(tokens + np.uint64(size_class)) % np.uint64(parts)).astype(np.int64)
    _, first = np.unique(part, return_index=True)
    again = np.ones(len(tokens), dtype=np.int64)
    again[first] = 0
    end = int(np.searchsorted(np.cumsum(again), need)) + 1
    tokens, part = tokens[:end], part[:end]
    order = np.argsort(part, kind="stable")
    tokens, part = tokens[order], part[order]
    out, gap = [], 1
    while True:  # neighbours within a subclass, then those two apart, and so on
        same = part[gap:] == part[:-gap] if gap < len(part) else np.zeros(0, dtype=bool)
        if not same.any():
            return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
        out.append(mix64(tokens[:-gap][same] ^ mix64(tokens[gap:][same] + np.uint64(1 + size_class))))
        gap += 1


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Single-token signatures and combination signatures of a set (ascending tokens, flags of the frequent ones)."""
    n = len(tokens)
    need = slack(n, percent) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need], np.zeros(0, dtype=np.uint64)
    size_class = n.bit_length() - 1
    classes = [size_class] + [size_class + 1] * (100 * n // percent >= 2 << size_class)
    return rare, np.concatenate([combinations(tokens[frequent], need - len(rare), c) for c in classes])


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _int64(flat))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    h, at = shingle_hashes(column, k)
    for i in range(len(at) - 1):
        yield np.unique(h[at[i] : at[i + 1]])


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, t, n, node, prefix`` of each document, ``t`` the hash of its text; a set without tokens has no node."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, prefix = [], [], []
            for s in _sets(batch.column(2), k):
                n.append(len(s))
                node.append(int(node_of(s).view(np.int64)) if len(s) else None)
                prefix.append(s[: slack(len(s), percent) + 1].copy() if len(s) else s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(node, pa.int64()), _lists(prefix)], names=["id", "t", "n", "node", "prefix"])

    return docs.select("id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"id {kind}, t long, n long, node long, prefix array<long>")


def _picked(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Bitmap | None]:
    """``h, text`` of the documents that may hold one of the sets ``nodes`` (with ``least``, the least id that has the set),
    and the bitmap of the hashes of these ids to filter them by where they lie. Beyond a bitmap's capacity they are
    joined by a shuffle, and there is none."""
    wanted, count = nodes.select(F.xxhash64("least").alias("wanted")), nodes.count()
    rows = docs.select(F.xxhash64("id").alias("h"), "text")
    if count > CAPACITY:
        return rows.join(wanted.distinct(), F.col("h") == F.col("wanted"), "left_semi"), None
    return rows, bitmap_of(wanted, "wanted", count)


def _through(batch: pa.RecordBatch, ids: Bitmap | None) -> pa.Array:
    """Texts of a batch of ``h, text`` that the bitmap lets through."""
    return batch.column(1) if ids is None else batch.column(1).filter(pa.array(ids.has(np.asarray(batch.column(0)))))


def whole_sets(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """``node, tokens`` of the sets in ``nodes``, and of some others. A node may come twice."""
    rows, ids = _picked(docs, nodes)
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [s for s in _sets(_through(batch, shared.value), k) if len(s)]
            yield pa.RecordBatch.from_arrays([_int64(np.array([node_of(s) for s in tokens], dtype=np.uint64)), _lists(tokens)], names=["node", "tokens"])

    return rows.mapInArrow(run, "node long, tokens array<long>")


def _frequent(counts: DataFrame) -> tuple[Bitmap, int]:
    """Bitmap of the tokens that more than a limit of sets have, and that limit: FREQUENT, or what keeps to the capacity."""
    doublings = F.floor(F.log2(F.col("count") / FREQUENT)).cast("int")
    sizes = {r["d"]: r["count"] for r in counts.where(F.col("count") > FREQUENT).groupBy(doublings.alias("d")).count().collect()}
    low = 0
    while sum(n for d, n in sizes.items() if d >= low) > CAPACITY:
        low += 1
    limit = FREQUENT << low if low else FREQUENT + 1
    return bitmap_of(counts.where(F.col("count") >= limit), "token", sum(n for d, n in sizes.items() if d >= low)), limit


def _instead(texts: tuple[DataFrame, Bitmap | None], k: int, percent: int, frequent: Bitmap) -> DataFrame:
    """``token`` rows: what sets with frequent tokens in their plain prefix would be indexed under besides it."""
    rows, ids = texts
    shared = rows.sparkSession.sparkContext.broadcast((frequent, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frequent, ids = shared.value
            out = [np.zeros(0, dtype=np.uint64)]
            for s in _sets(_through(batch, ids), k):
                need = slack(len(s), percent) + 1
                flags = frequent.has(s[:need]) if len(s) else np.zeros(0, dtype=bool)
                if not flags.any():
                    continue
                rest = s[need:]
                if flags.mean() < MOSTLY:
                    rest = rest[: int(np.searchsorted(np.cumsum(~frequent.has(rest)), flags.sum())) + 1]
                out.append(rest)
            yield pa.RecordBatch.from_arrays([_int64(np.concatenate(out))], names=["token"])

    return rows.mapInArrow(run, "token long")


def _singles(sets: DataFrame, frequent: Bitmap, common: Bitmap) -> DataFrame:
    """Signature rows of the sets whose plain prefix has no frequent token: those tokens that another set may have."""
    both = sets.sparkSession.sparkContext.broadcast((frequent, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frequent, common = both.value
            lists = batch.column(2)
            flat = np.asarray(lists.flatten()).view(np.uint64)
            count = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(count)), count)
            hot = np.zeros(len(count), dtype=bool)
            hot[row[frequent.has(flat)]] = True
            take = ~hot[row] & common.has(flat)
            row = row[take]
            node, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays([_int64(flat[take]), pa.array(node[row]), pa.array(n[row]), pa.array(n[row]), pa.array(np.zeros(len(row), dtype=bool))], names=["sig", "node", "n", "rare", "pair"])

    return sets.select("node", "n", "prefix").mapInArrow(run, "sig long, node long, n long, rare long, pair boolean")


def _combined(texts: tuple[DataFrame, Bitmap | None], k: int, percent: int, frequent: Bitmap) -> DataFrame:
    """The sets with frequent tokens in their plain prefix: ``node, n, rare``, the signatures ``one`` and ``two``, and how many
    of ``one`` are in the plain prefix. A set that comes twice repeats its rows, which changes nothing."""
    rows, ids = texts
    shared = rows.sparkSession.sparkContext.broadcast((frequent, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frequent, ids = shared.value
            nodes, numbers, ones, twos = [], [], [], []
            for s in _sets(_through(batch, ids), k):
                plain = s[: slack(len(s), percent) + 1]
                if not len(s) or not frequent.has(plain).any():
                    continue
                flags = frequent.has(s)
                one, two = signatures(s, flags, percent)
                nodes.append(node_of(s))
                numbers.append((len(s), int((~flags).sum()), int((one <= plain[-1]).sum())))
                ones.append(one)
                twos.append(two)
            numbers = np.array(numbers, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [_int64(np.array(nodes, dtype=np.uint64)), *[pa.array(numbers[:, i]) for i in range(3)], _lists(ones), _lists(twos)], names=["node", "n", "rare", "plain", "one", "two"]
            )

    return rows.mapInArrow(run, "node long, n long, rare long, plain long, one array<long>, two array<long>")


def _signed(sets: DataFrame, common: Bitmap) -> DataFrame:
    """Signature rows of ``_combined`` sets, without the single tokens that no other set has."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, rare = (np.asarray(batch.column(i)) for i in range(3))
            for at, pair in ((3, False), (4, True)):
                flat = np.asarray(batch.column(at).flatten()).view(np.uint64)
                row = np.repeat(np.arange(len(node)), np.diff(np.asarray(batch.column(at).offsets)))
                if not pair:
                    take = shared.value.has(flat)
                    flat, row = flat[take], row[take]
                yield pa.RecordBatch.from_arrays(
                    [_int64(flat), pa.array(node[row]), pa.array(n[row]), pa.array(rare[row]), pa.array(np.full(len(row), pair))], names=["sig", "node", "n", "rare", "pair"]
                )

    return sets.select("node", "n", "rare", "one", "two").mapInArrow(run, "sig long, node long, n long, rare long, pair boolean")


def _enough(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of n and m must share, at least."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their plain prefixes do not rule out. Of the prefix that ends first every token is known to be in the
    other set or not, so the sets share at most those found there and all that is left of that set."""
    part = lambda name: sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "prefix")])
    both = pairs.join(part("a"), "a").join(part("b"), "b")
    last = lambda name: F.element_at(f"prefix_{name}", -1).bitwiseXOR(F.lit(-(2**63)))  # noqa: E731  in unsigned order
    left = F.when(last("a") <= last("b"), F.col("n_a") - F.size("prefix_a")).otherwise(F.col("n_b") - F.size("prefix_b"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + left
    return both.where(most >= _enough(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that link, by exact intersection of the sets of those that are still possible."""
    pairs = scratch.table(_possible(pairs, sets, percent))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tokens = scratch.table(whole_sets(docs, k, scratch.table(sets.join(ends, "node", "left_semi").select("node", "least"))))
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    links = scratch.table(both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b").distinct())
    scratch.drop(tokens, pairs)
    return links


def _common(flat: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tokens that each set of ``left`` shares with each of ``right``; ``row`` is the set that a token of ``flat`` is in."""
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    code, row = (np.cumsum(often) - 1)[code[often[code]]], row[often[code]]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # exact below 2 ** 24
    for c in range(0, int(often.sum()), WIDTH):
        a, b = np.searchsorted(code, [c, c + WIDTH])
        has = np.zeros((int(max(left.max(), right.max())) + 1, WIDTH), dtype=np.float32)
        has[row[a:b], code[a:b] - c] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def _linked_in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """``node, added`` from rows sorted by component and pair of blocks: the rows of the sets that a set links with there."""

    def finish(table: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        get = lambda c: np.concatenate([np.asarray(x) for x in table.column(c).chunks])
        node, copies, own, i, j = (get(c) for c in ("node", "copies", "own", "i", "j"))
        tokens = [np.asarray(x.flatten()).view(np.uint64) for x in table.column("tokens").chunks]
        size = np.concatenate([np.diff(np.asarray(x.offsets)) for x in table.column("tokens").chunks]).astype(np.int64)
        flat, at = np.concatenate(tokens), np.concatenate([[0], np.cumsum(size)])
        added = np.zeros(len(node), dtype=np.int64)
        for a, b in zip(start, [*start[1:], len(node)], strict=True):
            new = np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]])  # a node may come twice
            apart = i[a] != j[a]
            left = np.flatnonzero(new & (own[a:b] == i[a]))
            right = np.flatnonzero(new & (own[a:b] == j[a]))
            if not len(left) or not len(right):
                continue
            one = np.repeat(np.arange(b - a), np.where(new, size[a:b], 0))
            these = flat[at[a] : at[b]][np.repeat(new, size[a:b])]
            n = size[a:b]
            common = _common(these, one, left, right)
            near = common * (100 + percent) >= percent * (n[left][:, None] + n[right][None, :])
            if apart:
                added[a + right] += copies[a + left] @ near
            else:
                np.fill_diagonal(near, False)
            added[a + left] += near @ copies[a + right]
        some = added > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(added[some])], names=["node", "added"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            key = np.stack([np.concatenate([np.asarray(x) for x in table.column(c).chunks]) for c in ("component", "i", "j")], 1)
            start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            if len(start) > 1:
                yield finish(table.slice(0, start[-1]), start[:-1])
            left = table.slice(start[-1])
        if left is not None:
            yield finish(left, np.zeros(1, dtype=np.int64))

    return members.mapInArrow(run, "node long, added long")


def _counted(found: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """``node, added``: rows of other sets that a set links with, for those with any."""
    members = found.join(sets.select("node", "least", "n", "copies"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int")
    members = members.join(members.groupBy(F.col("component").alias("c")).agg(blocks.alias("blocks")), F.col("component") == F.col("c"))
    members = scratch.table(members.select("node", "least", "copies", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")))
    spread = whole_sets(docs, k, members).join(members, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "copies", "own", "tokens")
    spread = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    out = scratch.table(_linked_in_blocks(spread, percent).groupBy("node").agg(F.sum("added").alias("added")))
    scratch.drop(members)
    return out


def _apart(rest: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the sets under a signature that lie in different components and may link. Sets of a signature are dealt into
    blocks of about SIDE, and every pair of blocks is joined by itself."""
    sizes = rest.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(SIDE)).cast("int").alias("g"))
    dealt = rest.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("g", "o")
    other = dealt.select("sig", "i", "j", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "rare", "component", "own")])
    must = _enough(F.col("n"), F.col("n2"), percent)
    chance = ~F.col("pair") | ((F.col("n") - F.col("rare") >= must) & (F.col("n2") - F.col("rare2") >= must))
    sizes_fit = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    # a block with itself: each pair once; two blocks: the first's sets with the second's
    once = F.when(F.col("i") == F.col("j"), F.col("node") < F.col("node2")).otherwise((F.col("own") == F.col("i")) & (F.col("own2") == F.col("j")))
    both = dealt.join(other, ["sig", "i", "j"]).where(once & (F.col("component") != F.col("component2")) & sizes_fit & chance)
    return both.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links. With
    ``count`` also ``n_links``, the other rows that the row links with, those with an equal set among them."""
    rows, sets, found, links = _linked(docs, k, percent, id_col, text_col, count)
    labels = found.join(sets.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("of_component"))
    labels = found.join(labels, "component").select(F.col("node").alias("v"), "of_component")
    ids = sets.select("node", "least").join(labels, F.col("node") == F.col("v"), "left").select("node", F.coalesce("of_component", "least").alias("component_id"))
    out = rows.select("id", "n", "node").join(ids, "node", "left")
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    if count:
        copies = sets.select("node", "copies").join(links, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"))
        out = out.join(copies, "node", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(*columns)


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, count: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Rows, different sets, the components of linked sets (``node, component``), and with ``count`` their links."""
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    scratch = Scratch(spark, "ngram")
    docs = only(docs, id_col, text_col).toDF("id", "text")

    rows = scratch.table(prefixes(docs, k, percent))
    sets = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"))
    sets = scratch.table(sets)

    # token classes
    counts = scratch.table(sets.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1"))
    known = counts.count()
    common = bitmap_of(counts, "token", known)
    frequent, limit = _frequent(counts)
    if frequent.any():
        texts = _picked(docs, sets)
        more = scratch.table(_instead(texts, k, percent, frequent).groupBy("token").count().where(F.col("count") >= limit).select("token"))
        both = counts.where(F.col("count") >= limit).select("token").unionAll(more)
        frequent = bitmap_of(both, "token", both.count())
        combined = scratch.table(_combined(texts, k, percent, frequent))
        beyond = combined.select(F.explode(F.slice("one", F.col("plain").cast("int") + 1, F.size("one"))).alias("token"))
        also = counts.select("token").unionAll(beyond)
        common = bitmap_of(also, "token", also.count())
        signed = scratch.table(_singles(sets, frequent, common).unionByName(_signed(combined, common)))
        scratch.drop(combined, more)
    else:
        signed = scratch.table(_singles(sets, frequent, common))
    scratch.drop(counts)
    scratch.settle()

    # all sets under a signature against its pivot
    pivots = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.expr("min_by(node, rare * 2147483648 + n)").alias("pivot"), F.min("n").alias("least_n"))
    pivots = pivots.where("m > 1").drop("m")
    shared = scratch.table(signed.join(pivots, "sig"))
    scratch.drop(signed)
    size_ok = F.col("n") * 100 >= F.col("n2") * percent
    with_n = shared.where("node <> pivot").select("node", "n", "pivot").distinct()
    pivot_n = sets.select(F.col("node").alias("pivot"), F.col("n").alias("n2"))
    first = with_n.join(pivot_n, "pivot").where(size_ok & (F.col("n2") * 100 >= F.col("n") * percent))
    first = scratch.table(first.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    links = _verified(first, docs, sets, k, percent, scratch)
    scratch.settle()
    found = components(links, scratch)
    scratch.settle()

    # the rest: pairs from different components that can still reach the similarity
    placed = shared.join(found.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").withColumn("component", F.coalesce("component", "node")).drop("v", "pivot")
    placed = scratch.table(placed)
    scratch.drop(shared)
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    reach = _enough(F.col("n"), F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100)), percent)
    rest = placed.join(mixed, "sig").where(~F.col("pair") | (F.col("n") - F.col("rare") >= reach)).select("sig", "node", "n", "rare", "pair", "component").distinct()
    rest = scratch.table(rest)
    scratch.drop(placed)
    second = scratch.table(_apart(rest, percent).join(first, ["a", "b"], "left_anti"))
    more = None
    if second.limit(1).count():
        more = _verified(second, docs, sets, k, percent, scratch)
    if more is not None and more.limit(1).count():
        old = found.select(F.col("node").alias("v"), F.col("component").alias("c"))
        near = more.join(old, F.col("a") == F.col("v"), "left").select(F.coalesce("c", "a").alias("a"), "b")
        near = near.join(old, F.col("b") == F.col("v"), "left").select("a", F.coalesce("c", "b").alias("b"))
        top = components(near, scratch).select(F.col("node").alias("t"), F.col("component").alias("top"))
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        loose = ends.join(old, F.col("node") == F.col("v"), "left_anti").select("node", F.col("node").alias("component"))
        found = found.unionByName(loose).join(top, F.col("component") == F.col("t"), "left").select("node", F.coalesce("top", "component").alias("component"))
        found = scratch.table(found)
    scratch.drop(first, rest, second)
    scratch.settle()
    return rows, sets, found, _counted(found, docs, sets, k, percent, scratch) if count else None


#: Most rows of ids broadcast to filter texts where they lie; beyond it ids and texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id (a null id is larger than any, and of equal
    ids the text decides); of rows that share id and text one. A row is told by id and text, so rows that share an id
    with another text go or stay by themselves."""
    scratch = Scratch(docs.sparkSession, "dedup")
    rows, _, found, _ = _linked(docs, k, percent, id_col, text_col, False)
    group = found.select(F.col("node").alias("v"), "component")
    told = rows.select("id", "t", "node").join(group, F.col("node") == F.col("v"), "left").select("id", "t", F.coalesce("component", "node").alias("group"))
    told = scratch.table(told)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("t").alias("t")))
    kept = told.where("group is not null").groupBy(F.col("group").alias("g")).agg(first.alias("kept"))
    gone = told.join(kept, F.col("group") == F.col("g")).where(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("t") == F.col("kept.t"))))
    gone = scratch.table(gone.select(F.col("id").alias("gone_id"), F.col("t").alias("gone_t")).distinct())
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))

    def same(other: DataFrame) -> Column:
        return docs[f"`{id_col}`"].eqNullSafe(other["gone_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == other["gone_t"])

    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone, same(gone), "left_anti")
    twice = scratch.table(told.groupBy("id", "t").count().where("count > 1").select(F.col("id").alias("twice_id"), F.col("t").alias("twice_t")))
    if twice.limit(1).count():
        again = F.col(f"`{id_col}`").eqNullSafe(F.col("twice_id")) & (text_hash == F.col("twice_t"))
        repeated = out.join(twice, again, "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(twice, again, "left_anti").unionByName(repeated)
    return out
