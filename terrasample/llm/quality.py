"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, and only the document is labelled. The passage encoder is learned
with the rest: it sums learned vectors of the passage's words (hashed into ``BUCKETS``), adds a learned projection of what its
bytes and words look like (shares of letters, capitals, digits and every punctuation mark, word lengths, words that
repeat within the passage, words and runs of words that the document has before), and squashes the sum. A gated
attention layer weighs the encoded passages; the weighted representation is scored.

    h = tanh(E' counts + W' f),  a = softmax over passages of w . (tanh(V h) * sigmoid(U h)),  score = sigmoid(c . sum(a h) + b)

Training is on a bounded sample, in numpy on the driver, and repeats exactly; words are dropped at random while learning, so
that no single word decides. Scoring encodes every passage of every whole text, vectorised over slices of a batch of at
most ``SLICE`` bytes or one text; a passage has exactly the bytes from its first word to the next passage's. Null and empty
texts have one empty passage. Without labelled rows the model is the untrained one. Repeated rows score alike, extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._scratch import arrow_batches, only
from terrasample.llm._text import _ranges, mix64, text_bytes, words_at

#: Words of a passage; buckets of the words' vectors; bytes of text encoded at a time, unless one text has more.
PASSAGE, BUCKETS, SLICE = 40, 2048, 1 << 21
#: Rows of the training sample, by label.
SAMPLE = {0: 2500, 1: 3500}
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 16, 8, 20, 64, 0.01, 1e-4
#: Chance that a bucket is dropped from a batch while learning; more decay of the words' vectors.
DROPPED, WORD_DECAY = 0.3, 1e-3

#: Byte classes: each ASCII mark its own, then capitals, small letters, digits, line ends, other blanks, other ASCII, and
#: bytes beyond ASCII.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS = np.full(256, len(_MARKS) + 5, dtype=np.uint8)
_CLASS[_MARKS] = np.arange(len(_MARKS))
for _i, _set in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), (0x0A, 0x0D), (0x20, 0x09, 0x0B, 0x0C))):
    _CLASS[list(_set)] = len(_MARKS) + _i
_CLASS[128:] = len(_MARKS) + 6
CLASSES = len(_MARKS) + 7
FEATURES = CLASSES + 7
#: Passages whose word counts are held as a table at once.
ROWS = 1024


@dataclass
class Passages:
    """Passages of some texts: features, word buckets with their weights by passage, and the first passage of each text."""

    f: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray
    of: np.ndarray  # first bucket of each passage, one more than passages
    at: np.ndarray

    def counts(self, a: int, b: int) -> np.ndarray:
        """Weights of passages a to b by bucket, as a table."""
        out = np.zeros((b - a, BUCKETS), dtype=np.float32)
        lo, hi = self.of[a], self.of[b]
        out[np.repeat(np.arange(b - a), np.diff(self.of[a : b + 1])), self.bucket[lo:hi]] = self.weight[lo:hi]
        return out

    def take(self, docs: np.ndarray) -> Passages:
        count = np.diff(self.at)[docs]
        rows = _ranges(self.at[docs], count)
        inside = np.diff(self.of)[rows]
        some = _ranges(self.of[rows], inside)
        return Passages(self.f[rows], self.bucket[some], self.weight[some], np.concatenate([[0], np.cumsum(inside)]), np.concatenate([[0], np.cumsum(count)]))


def joined(parts: list[Passages]) -> Passages:
    run = lambda name: np.concatenate([[0], np.cumsum(np.concatenate([np.diff(getattr(p, name)) for p in parts]))]).astype(np.int64)
    return Passages(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("f", "bucket", "weight")), run("of"), run("at"))


def _before(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position whether its document has its key before, and the last place that has it (its own if none)."""
    order = np.lexsort((key, doc))  # stable: equal keys of a document stay in order
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    last = np.arange(len(key))
    last[order[1:][same[1:]]] = order[:-1][same[1:]]
    seen = np.zeros(len(key), dtype=bool)
    seen[order] = same
    return seen, last


def passages(column: pa.Array) -> Passages:
    """All passages of the texts."""
    data, offsets = text_bytes(column)
    word, first, start = words_at(data, offsets)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    at = np.concatenate([[0], np.cumsum(count)])
    total = int(at[-1])
    # a passage's bytes go from its first word to the next one's; a text's first passage begins with the text
    edge = np.empty(total + 1, dtype=np.int64)
    edge[-1] = len(data)
    inner = np.ones(total, dtype=bool)
    inner[at[:-1]] = False
    edge[at[:-1]] = offsets[:-1]
    place = np.arange(total) - np.repeat(at[:-1], count)
    edge[:-1][inner] = start[(np.repeat(first[:-1], count) + place * PASSAGE)[inner]]
    shape = np.zeros((total, CLASSES))
    a = 0
    while a < total:  # some passages at a time: the working arrays are several times their bytes
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + SLICE, side="right")) - 1)
        size = np.diff(edge[a : b + 1])
        of_byte = np.repeat(np.arange(b - a, dtype=np.int32), size)
        shape[a:b] = np.bincount(of_byte * np.int32(CLASSES) + _CLASS[data[edge[a] : edge[b]]], minlength=(b - a) * CLASSES).reshape(b - a, CLASSES)
        a = b
    length = shape.sum(1)
    f = np.zeros((total, FEATURES))
    f[:, :CLASSES] = np.sqrt(shape / np.maximum(1, length)[:, None])

    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    index = np.arange(len(word)) - np.repeat(first[:-1], n)
    of_word = np.repeat(at[:-1], n) + index // PASSAGE
    words_in = np.bincount(of_word, minlength=total).astype(np.float64)
    safe = np.maximum(1, words_in)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    seen, last = _before(word, doc)
    inside = seen & (of_word[last] == of_word)
    # runs of four words that the document has before
    copied = np.zeros(len(word), dtype=bool)
    if len(word) > 3:
        full = np.flatnonzero(index >= 3)
        four = word[full] * np.uint64(3) + word[full - 1] * np.uint64(5) + word[full - 2] * np.uint64(7) + word[full - 3] * np.uint64(11)
        copied[full] = _before(four, doc[full])[0]
    for j, flags in enumerate((again, inside, seen, copied)):
        f[:, CLASSES + j] = np.bincount(of_word, weights=flags, minlength=total) / safe
    f[:, CLASSES + 4] = np.log1p(length / safe) / 3
    f[:, CLASSES + 5] = words_in / PASSAGE
    f[:, CLASSES + 6] = np.repeat(np.log1p(n) / 10, count)
    pair, times = np.unique(of_word * BUCKETS + (mix64(word) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    weight = times / np.sqrt(safe[pair // BUCKETS] * PASSAGE)
    return Passages(f, (pair % BUCKETS).astype(np.int32), weight.astype(np.float32), np.searchsorted(pair // BUCKETS, np.arange(total + 1)), at)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def encode(self, x: Passages) -> np.ndarray:
        """The encoded passages, from a table of word counts for some at a time."""
        told = np.concatenate([x.counts(a, min(a + ROWS, len(x.f))) @ self.w["E"].astype(np.float32) for a in range(0, len(x.f), ROWS)])
        return np.tanh(told + np.clip((x.f - self.mean) / self.scale, -8, 8) @ self.w["W"] + self.w["Wb"])

    def attend(self, h: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        w, count = self.w, np.diff(at)
        v, u = np.tanh(h @ w["V"] + w["Vb"]), 1 / (1 + np.exp(-(h @ w["U"] + w["Ub"])))
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), count))
        a = e / np.repeat(np.add.reduceat(e, at[:-1]), count)
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": p}

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of texts, some at a time: ``SLICE`` bytes or one text."""
        if not len(column):
            return np.zeros(0)
        _, offsets = text_bytes(column)
        out, a = [], 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
            x = passages(column.slice(a, b - a))
            out.append(self.attend(self.encode(x), x.at)["p"])
            a = b
        return np.concatenate(out)


def gradients(model: Model, x: Passages, y: np.ndarray, keep: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of the mean loss, with decay; ``keep`` are factors of the word buckets."""
    w = model.w
    words = x.counts(0, len(x.f))
    if keep is not None:
        words = words * keep
    f = np.clip((x.f - model.mean) / model.scale, -8, 8)
    h = np.tanh(words @ w["E"] + f @ w["W"] + w["Wb"])
    s = model.attend(h, x.at)
    count = np.diff(x.at)
    d = (s["p"] - y) / len(y)
    g = {"c": s["z"].T @ d, "b": np.array(d.sum())}
    dz = np.repeat(d[:, None] * w["c"], count, axis=0)
    da = (dz * h).sum(1)
    de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, x.at[:-1]), count))
    dg = de[:, None] * w["a"]
    g["a"] = (s["v"] * s["u"]).T @ de
    dv, du = dg * s["u"] * (1 - s["v"] ** 2), dg * s["v"] * s["u"] * (1 - s["u"])
    dh = s["a"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T
    dh *= 1 - h**2
    g |= {"V": h.T @ dv, "Vb": dv.sum(0), "U": h.T @ du, "Ub": du.sum(0), "W": f.T @ dh, "Wb": dh.sum(0), "E": words.T @ dh.astype(np.float32)}
    return {k: v + (WORD_DECAY if k == "E" else DECAY) * w[k] for k, v in g.items()}


def fit(samples: list[tuple[str, int]], seed: int = 0) -> Model:
    """Learn from (text, label) pairs with Adam."""
    random = np.random.default_rng(seed)
    start = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"W": start(FEATURES, HIDDEN), "Wb": np.zeros(HIDDEN), "V": start(HIDDEN, GATE), "Vb": np.zeros(GATE), "U": start(HIDDEN, GATE), "Ub": np.zeros(GATE), "a": start(GATE), "c": start(HIDDEN), "b": np.array(0.0)}
    w["E"] = random.normal(0, 0.01, (BUCKETS, HIDDEN)).astype(np.float32)
    model = Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    if not samples:
        return model
    # a few texts at a time: the working arrays are many times a text's size
    x = joined([passages(pa.array([t for t, _ in samples[a : a + 100]], pa.large_string())) for a in range(0, len(samples), 100)])
    y = np.array([label for _, label in samples], dtype=np.float64)
    model.mean, model.scale = x.f.mean(0), x.f.std(0) + 0.02
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    step, mean = 0, {k: np.zeros_like(p) for k, p in w.items()}
    epochs = max(EPOCHS, min(100, 40_000 // len(samples)))
    last = 0
    for epoch in range(epochs):
        order = random.permutation(len(samples))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            keep = ((random.random(BUCKETS) >= DROPPED) / (1 - DROPPED)).astype(np.float32)
            g = gradients(model, x.take(docs), y[docs], keep)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs * 3 // 4:  # the average of the last quarter is steadier than any one
                mean = {k: mean[k] + w[k] for k in w}
                last += 1
    model.w = {k: mean[k] / last for k in w}
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1, higher for label 1) and ``predicted`` added."""
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    rows = only(docs, text_col, *keep).toDF("text", *[f"c{i}" for i in range(len(keep))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.score(batch.column(0)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*batch.schema.names[1:], "score"])

    fields = [f"{c} {t}" for c, t in rows.dtypes[1:]]
    out = rows.mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*keep, "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
