import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from terrasample.llm import language_id, quality, toxicity
from terrasample.llm._labels import labelled_sample

SF = "/root/testdata/sf0.01"


def accuracy(spark, kind, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = language_id.held_out("doc_id", 5, 0)
    model = kind.fit(labelled_sample(docs, labels.where(~held), label, kind.SAMPLE))
    rows = kind.score(docs.join(labels, "doc_id").where(held), model, ["doc_id", label]).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_held_out_accuracy(spark):
    assert accuracy(spark, toxicity, "toxic") > 0.95
    assert accuracy(spark, quality, "quality") > 0.95


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_edges(spark, kind):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (1, None, 5), (3, "a " * 50_000, 5), (None, "Some words here.", 5)], "doc_id long, text string, SCORE int")
    model = kind.fit([])
    rows = kind.score(df, model, ["doc_id"]).collect()
    assert [r.doc_id for r in rows] == [1, 2, 1, 3, None] and rows[0].score == rows[1].score == rows[2].score
    assert kind.score(df.limit(0), model, ["doc_id"]).count() == 0
    assert labelled_sample(df, spark.createDataFrame([], "doc_id long, toxic int"), "toxic", {0: 5, 1: 5}) == []


def test_grammar_scores_clauses():
    s = toxicity.Scorer(toxicity.Model({"idiot": 4.0}, toxicity.PRIOR))
    kind = lambda text: dict(zip(toxicity.KINDS, s.features(text) > 0, strict=True))
    assert kind("What an idiot.")["plain"] and kind("You are an IDIOT.")["targeted"] and kind("An idiot you are")["targeted"]
    assert kind("He is not an idiot.")["negated"] and kind("She said idiot.")["reported"] and kind('They wrote "idiot" there')["reported"]
    assert not any(kind("idio tic video kill").values()) and kind("I will kill you")["threat"]
    assert kind("Not now. idiot")["plain"]  # another clause
    assert s.score("She said he is an idiot.") < s.score("You idiot.") and s.score("unidiot") == s.score(None)


def test_grammar_reads_whole_sentences_and_quotations():
    s = toxicity.Scorer(toxicity.Model({"idiot": 4.0}, toxicity.PRIOR))
    kind = lambda text: {k for k, v in zip(toxicity.KINDS, s.features(text), strict=True) if v > 0}
    far = " then" * 5000
    assert kind(f"you{far} idiot") == {"targeted"} and kind(f"idiot{far} you") == {"targeted"}
    assert kind(f"he said{far} idiot") == {"reported"} and kind(f"not{far} idiot") == {"plain"}
    assert kind('"Go away. He is an idiot."') == {"reported"} and kind('"Go away." An idiot.') == {"plain"}
    assert kind('a stray " mark\nan idiot') == {"plain"} and kind('"Oh. Idiot. Idiot!" Idiot, you') == {"reported", "targeted"}
    assert kind("He said: you are an idiot") == {"reported"} and kind("you know; an idiot") == {"plain"}
    assert kind("not him: an idiot") == {"plain"} and kind("kill you") == {"threat"} and kind("not kill you") == set()


def test_best_path_against_all_paths():
    r = np.random.default_rng(3)
    for quoted in (False, True):
        machine = toxicity.grammar(quoted)
        reader = toxicity.Reader(machine)

        def paths(state, rest):
            if not rest:
                if machine.ends(state):
                    yield 0.0, (0.0,) * 5
                return
            (symbol, own), rest = rest[0], rest[1:]
            for a in machine.arcs(state, symbol):
                for weight, sums in paths(a.to, rest):
                    if a.kind:
                        k = toxicity.KINDS.index(a.kind)
                        yield weight + a.weight + own, (*sums[:k], sums[k] + own, *sums[k + 1 :])
                    else:
                        yield weight + a.weight, sums

        for _ in range(150):
            sentence = [(str(x), float(r.integers(1, 6)) if x == "I" else 1.0) for x in r.choice(list("IITTPNRQCxx"), r.integers(0, 9))]
            every = list(paths(machine.start, sentence))
            weight, sums = reader.best(sentence)
            assert weight == pytest.approx(max(e[0] for e in every)) and any(sums == pytest.approx(e[1]) and weight == pytest.approx(e[0]) for e in every)
    both = toxicity.reported_speech() @ toxicity.negation()
    state, out = both.start, []
    for x in ["R", "I", "N", "I"]:
        (arc,) = both.arcs(state, x)
        state = arc.to
        out.append(arc.out)
    assert out == ["R", "Ir", "N", "Ir"]


def test_near_copies_count_once_and_unlike_texts_all():
    spell = lambda i: "word" + chr(97 + i // 26) + chr(97 + i % 26)
    words = [spell(i) for i in range(60)]
    r = np.random.default_rng(5)
    unlike = [" ".join(r.choice(words, 25, replace=False)) for _ in range(300)]
    assert len(toxicity._unlike([(t, 0) for t in unlike])) >= 299
    text = " ".join(spell(i) for i in range(100, 300))
    assert len(toxicity._unlike([(text, 1), (text + " more", 1), (text, 1), (text, 0)])) == 2


def texts_of(r, n):
    return pa.array([" ".join(r.choice(["alpha", "Beta,", "gamma!", "delta", "12", "eps;"], r.integers(0, 130))) for _ in range(n)], pa.string())


def test_gradients():
    r = np.random.default_rng(0)
    m = quality.fit([])
    m.w["E"] = r.normal(0, 0.3, m.w["E"].shape)
    x, y = quality.passages(texts_of(r, 6)), np.array([1.0, 0, 1, 0, 0, 1])
    loss = lambda: float(-(y * np.log(p := m.attend(m.encode(x), x.at)["p"]) + (1 - y) * np.log(1 - p)).mean())
    g = quality.gradients(m, x, y)
    for k in ("W", "V", "U", "a", "c", "E"):
        i = (int(x.bucket[0]), 3) if k == "E" else tuple(0 for _ in m.w[k].shape)
        keep, e = m.w[k][i], 1e-3
        m.w[k][i] = keep + e
        up = loss()
        m.w[k][i] = keep - e
        down = loss()
        m.w[k][i] = keep
        decay = quality.WORD_DECAY if k == "E" else quality.DECAY
        assert g[k][i] - decay * keep == pytest.approx((up - down) / (2 * e), abs=2e-4), k
    assert m.attend(m.encode(x), x.at)["a"][: x.at[1]].sum() == pytest.approx(1)


def test_scores_against_plain_loops():
    """One text at a time, one passage at a time, one word at a time."""
    r = np.random.default_rng(1)
    m = quality.fit([])
    m.w["E"] = r.normal(0, 0.3, m.w["E"].shape)
    column = pa.array([*texts_of(r, 12).to_pylist(), None, "", "  a  b ", "é " * 90], pa.string())

    def plain(text):
        words = (text or "").encode().split()
        hashes = quality.words_at(*quality.text_bytes(pa.array([text or ""])))[0]
        encoded = []
        starts, p = [], 0
        raw = (text or "").encode()
        for t in words:
            p = raw.index(t, p)
            starts.append(p)
            p += len(t)
        for a in range(0, max(1, len(words)), quality.PASSAGE):
            own = words[a : a + quality.PASSAGE]
            lo = 0 if a == 0 else starts[a]
            hi = starts[a + quality.PASSAGE] if a + quality.PASSAGE < len(words) else len(raw)
            f = np.zeros(quality.FEATURES)
            for byte in raw[lo:hi]:
                f[quality._CLASS[byte]] += 1
            f[: quality.CLASSES] = np.sqrt(f[: quality.CLASSES] / max(1, hi - lo))
            low = [t.lower() for t in words]
            safe = max(1, len(own))
            f[quality.CLASSES] = sum(i > 0 and low[i] == low[i - 1] for i in range(a, a + len(own))) / safe
            f[quality.CLASSES + 1] = sum(low[i] in low[a:i] for i in range(a, a + len(own))) / safe
            f[quality.CLASSES + 2] = sum(low[i] in low[:i] for i in range(a, a + len(own))) / safe
            f[quality.CLASSES + 3] = sum(i >= 3 and low[i - 3 : i + 1] in [low[j - 3 : j + 1] for j in range(3, i)] for i in range(a, a + len(own))) / safe
            f[quality.CLASSES + 4 :] = np.log1p((hi - lo) / safe) / 3, len(own) / quality.PASSAGE, np.log1p(len(words)) / 10
            x = f @ m.w["W"] + m.w["Wb"]
            for i in range(a, a + len(own)):
                x = x + m.w["E"][int(quality.mix64(hashes[i : i + 1])[0] % np.uint64(quality.BUCKETS))] / np.sqrt(safe * quality.PASSAGE)
            encoded.append(np.tanh(x))
        e = np.array([np.tanh(h @ m.w["V"]) * (1 / (1 + np.exp(-(h @ m.w["U"])))) @ m.w["a"] for h in encoded])
        share = np.exp(e) / np.exp(e).sum()
        return 1 / (1 + np.exp(-(sum(s * h for s, h in zip(share, encoded, strict=True)) @ m.w["c"] + m.w["b"])))

    assert m.score(column) == pytest.approx([plain(t) for t in column.to_pylist()], abs=1e-5)


def test_passages_do_not_depend_on_the_batch(monkeypatch):
    texts = ["one two three " * 30, None, "", "A!! B!!\n" * 100, "é" * 500, "word " * 3000]
    together = quality.passages(pa.array(texts))
    monkeypatch.setattr(quality, "SLICE", 100)
    for i, t in enumerate(texts):
        alone, both = quality.passages(pa.array([t], pa.string())), together.take(np.array([i]))
        assert np.allclose(alone.f, both.f) and np.allclose(alone.counts(0, len(alone.f)), both.counts(0, len(both.f)))


def test_a_long_text_needs_little_beyond_its_size():
    text = pa.array(["some words of a very long text, " * 500_000], pa.large_string())  # 16 MB
    tracemalloc.start()
    quality.fit([]).score(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * text.nbytes  # words of five bytes
