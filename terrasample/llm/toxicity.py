"""Toxicity by a weighted finite-state grammar over sentences.

Words become symbols: insult stems (learned from labels, with their log odds as weight), threats, targets (the second
person), negations, reporting verbs, quotation marks and clause marks; all other words are one symbol. Five weighted
transducers read a sentence of symbols and rewrite it. Reported speech marks what follows a reporting verb or stands in
quotation marks; negation marks what follows a negation closely; target marks what shares a clause with the second
person, on either side: before it, the machine has to guess that it will come, and a path on which it does not come is no
path. Insult and threat turn marked symbols into matches, each with the weight of its mark. They are composed into one
machine, and a sentence is read by the machine's best path: of all paths the one whose arcs and matches weigh most in sum. So a
word counts by the clause it stands in. A document's features are the summed weights of its matches by kind (plain,
targeted, negated, reported, threatening); their weights are a logistic regression that starts from a prior in which
negated and reported matches count least.

A quotation goes on over sentences until its closing mark, or to the end of the line. Sentences of any length are read
whole, as a stream: what a path holds is its state, weight and sums.

Insult stems are the word beginnings that toxic texts have and others lack, beyond what chance gives to as many
candidates; near copies in the sample count once, and a beginning that has no more occurrences than a longer one gives way
to that. The stems are found in a text by one automaton, and only sentences with a stem or a threat are read by the
machine.

Null and empty texts have no match and get the score of a text without any. Whole texts are scored. Without labelled
rows the prior decides. Repeated rows score alike, extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._scratch import arrow_batches, only

#: Rows of the training sample, by label.
SAMPLE = {0: 5000, 1: 2500}
#: Stem lengths in characters; documents that a stem must be in; most stems.
SHORTEST, LONGEST, SUPPORT, STEMS = 4, 12, 3, 5000
#: Symbols a negation reaches.
REACH = 3
#: Weight of a match's mark, beside the weight of its word.
MARKS = {"plain": 0.0, "targeted": 0.5, "negated": -1.5, "reported": -1.5, "threat": 0.5}
KINDS = tuple(MARKS)

# Small closed word classes of English, German, French and Spanish.
TARGETS = "you your yours yourself u du dich dir dein deine euch euer tu toi te vous ton votre usted ustedes ti tus vuestro"
NEGATIONS = "not never neither nor without isn't aren't don't nicht kein keine nie niemals jamais non nunca jamás tampoco"
REPORTING = "said says say told wrote writes claimed claims quoted called sagte sagt schrieb behauptet dit écrit affirme dijo dice escribió afirma"
THREATS = "kill murder hurt stab shoot destroy töten umbringen verletzen tuer frapper détruire matar golpear destruir"

SENTENCE = re.compile(r"[.!?\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»;:]")
QUOTES = "\"“”„«»"

# --- machines ---------------------------------------------------------------------------------
# Symbols: I insult, T threat, P target, N negation, R report, Q quotation mark, C clause mark, x any other word. Marks
# are added to I and T as suffixes: r reported, n negated, p targeted.


@dataclass(frozen=True)
class Arc:
    """A way on: the next state, the symbol written, the weight, and the kind of match that the arc makes, if any."""

    to: object
    out: str
    weight: float = 0.0
    kind: str | None = None


class Fst:
    """A weighted transducer: its arcs from a state on a symbol, and the states it may end in."""

    def __init__(self, start: object, arcs: Callable[[object, str], Iterable[Arc]], ends: Callable[[object], bool] = lambda state: True):
        self.start, self.arcs, self.ends = start, arcs, ends

    def __matmul__(self, then: Fst) -> Fst:
        """Composition: what this one writes, ``then`` reads; weights add up."""

        def arcs(state, symbol):
            for a in self.arcs(state[0], symbol):
                for b in then.arcs(state[1], a.out):
                    yield Arc((a.to, b.to), b.out, a.weight + b.weight, a.kind or b.kind)

        return Fst((self.start, then.start), arcs, lambda state: self.ends(state[0]) and then.ends(state[1]))


def reported_speech(quoted: bool = False) -> Fst:
    def arcs(state, s):
        quoted, after = state
        if s == "Q":
            return [Arc((not quoted, after), s)]
        if s == "R":
            return [Arc((quoted, True), s)]
        return [Arc(state, s + "r" if s in ("I", "T") and (quoted or after) else s)]

    return Fst((quoted, False), arcs)


def negation() -> Fst:
    def arcs(left, s):
        if s in ("N", "C"):
            return [Arc(REACH if s == "N" else 0, s)]
        return [Arc(max(0, left - 1), s + "n" if left and s in ("I", "T") else s)]

    return Fst(0, arcs)


def target() -> Fst:
    """States: no target in the clause so far, one seen, one owed by the rest of the clause."""

    def arcs(state, s):
        if s == "P":
            return [Arc("seen", s)]
        if s == "C":
            return [] if state == "owed" else [Arc("none", s)]
        if s not in ("I", "T"):
            return [Arc(state, s)]
        if state == "none":
            return [Arc("none", s), Arc("owed", s + "p")]
        return [Arc(state, s + "p")]

    return Fst("none", arcs, lambda state: state != "owed")


def matching(kinds: dict[str, str]) -> Fst:
    """One state that makes matches of the given kinds."""
    return Fst(0, lambda state, s: [Arc(0, s, MARKS[kinds[s]], kinds[s])] if s in kinds else [Arc(0, s)])


def insult() -> Fst:
    return matching({"I": "plain", "Ip": "targeted", "In": "negated", "Ir": "reported"})


def threat() -> Fst:
    return matching({"Tp": "threat"})


def grammar(quoted: bool = False) -> Fst:
    return reported_speech(quoted) @ negation() @ target() @ insult() @ threat()


class Reader:
    """The machine with its visited arcs tabled, and its best path over a sentence."""

    def __init__(self, machine: Fst):
        self.machine, self.known = machine, {}

    def arcs(self, state, symbol: str) -> list[tuple]:
        found = self.known.get((state, symbol))
        if found is None:
            found = self.known[state, symbol] = [(a.to, a.weight, KINDS.index(a.kind) if a.kind else -1) for a in self.machine.arcs(state, symbol)]
        return found

    def best(self, symbols: Iterable[tuple[str, float]], start=None) -> tuple[float, tuple[float, ...]]:
        """Weight of the best path, and the weights of its matches' words by kind. Equal paths: the one whose sums are the
        larger, from the first kind on."""
        paths = {self.machine.start if start is None else start: (0.0, (0.0,) * len(KINDS))}
        others = 0
        for symbol, own in symbols:
            others = others + 1 if symbol == "x" else 0
            if others > REACH:
                continue  # further words change no state
            on: dict = {}
            for state, (weight, sums) in paths.items():
                for to, more, kind in self.arcs(state, symbol):
                    if kind >= 0:
                        new = (weight + more + own, (*sums[:kind], sums[kind] + own, *sums[kind + 1 :]))
                    else:
                        new = (weight + more, sums)
                    if to not in on or new > on[to]:
                        on[to] = new
            paths = on
        return max(p for state, p in paths.items() if self.machine.ends(state))


# --- model ------------------------------------------------------------------------------------
@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray  # intercept, then one per kind


PRIOR = np.array([-4.0, 2.5, 3.0, 0.6, 0.6, 3.0])


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.reader = Reader(grammar())
        self.starts = [grammar(quoted).start for quoted in (False, True)]
        self.fixed = {w: s for s, words in (("P", TARGETS), ("N", NEGATIONS), ("R", REPORTING), ("T", THREATS)) for w in words.split()}
        self.fixed |= dict.fromkeys(QUOTES, "Q") | dict.fromkeys(";:", "C")
        self.automaton = ahocorasick.Automaton()
        for w in [*model.stems, *THREATS.split()]:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            if word[:n] in self.model.stems:
                return "I", self.model.stems[word[:n]]
        return self.fixed.get(word, "x"), 1.0

    def features(self, text: str) -> np.ndarray:
        """log(1 + summed weights) by kind."""
        text = text.lower()
        total = np.zeros(len(KINDS))
        done, marks = 0, 0  # read so far, and the quotation marks of the line up to there
        for end, n in self.automaton.iter(text):
            at = end - n + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue  # in a sentence that is read already, or inside a word
            a = max(done, *(text.rfind(c, done, at) + 1 for c in ".!?\n"))
            line = text.rfind("\n", done, a) + 1
            marks = sum(text.count(q, max(done, line), a) for q in QUOTES) + (0 if line else marks)
            m = SENTENCE.search(text, end + 1)
            b = m.start() if m else len(text)
            total += self.reader.best((self.symbol(w[0]) for w in WORD.finditer(text, a, b)), self.starts[marks % 2])[1]
            marks += sum(text.count(q, a, b) for q in QUOTES)
            done = b
        return np.log1p(total)

    def score(self, text: str | None) -> float:
        x = self.features(text) if text else np.zeros(len(KINDS))
        return float(1 / (1 + math.exp(-(self.model.weights[0] + self.model.weights[1:] @ x))))


def _words(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if len(w) >= SHORTEST}


def _unlike(samples: list[tuple[str, int]]) -> list[tuple[set[str], int]]:
    """Word sets of the texts, near copies (a Jaccard similarity of 0.8) once. Texts are compared that agree in the two
    word minima of one of four bands."""
    bands: dict[tuple, list[set[str]]] = {}
    out = []
    for text, label in samples:
        words = _words(text)
        low = [min((hash_text(w, i) for w in words), default=0) for i in range(8)]
        keys = [(label, i, low[2 * i], low[2 * i + 1]) for i in range(4)]
        like = (other for k in keys for other in bands.get(k, ()))
        if words and any(5 * len(words & other) >= 4 * len(words | other) for other in like):
            continue
        out.append((words, label))
        for k in keys:
            bands.setdefault(k, []).append(words)
    return out


def hash_text(text: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def learn_stems(samples: list[tuple[str, int]]) -> dict[str, float]:
    """Beginnings of words with their log odds."""
    docs = _unlike(samples)
    total = Counter(label for _, label in docs)
    if not total[0] or not total[1]:
        return {}
    have: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for words, label in docs:
        have[label].update({w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)})
    yes, no = have[1], have[0]
    candidates = [p for p, n in yes.items() if n >= SUPPORT]
    share = total[1] / (total[0] + total[1])
    chance = math.log(max(1, len(candidates))) + 2
    good = {}
    for p in candidates:
        a, b = yes[p], no[p]
        rate = a / (a + b)
        if rate < 0.8 or rate <= share:
            continue
        # log likelihood ratio against the share of toxic documents
        llr = a * math.log(rate / share) + (b * math.log((1 - rate) / (1 - share)) if b else 0)
        if llr > chance:
            good[p] = math.log((a + 0.5) / (total[1] + 1)) - math.log((b + 0.5) / (total[0] + 1))
    extended: Counter = Counter()  # by beginning: the most documents that a longer good one is in
    for q in good:
        for n in range(SHORTEST, len(q)):
            extended[q[:n]] = max(extended[q[:n]], yes[q])
    longest = [p for p in good if extended[p] < 0.95 * yes[p]]
    top = sorted(longest, key=lambda p: (-yes[p], p))[:STEMS]
    return {p: round(min(6.0, good[p]), 4) for p in top}


def fit(samples: list[tuple[str, int]]) -> Model:
    stems = learn_stems(samples)
    model = Model(stems, PRIOR.copy())
    if not samples:
        return model
    scorer = Scorer(model)
    x = np.column_stack([np.ones(len(samples)), np.stack([scorer.features(t) for t, _ in samples])])
    y = np.array([label for _, label in samples], dtype=float)
    w = PRIOR.copy()
    for _ in range(30):  # Newton steps towards the most likely weights, with the prior as a ridge
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` added."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    shared = spark.sparkContext.broadcast(model)
    rows = only(docs, text_col, *keep).toDF("text", *[f"c{i}" for i in range(len(keep))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer.score(t) for t in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*batch.schema.names[1:], "score"])

    fields = [f"{c} {t}" for c, t in rows.dtypes[1:]]
    out = rows.mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*keep, "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
