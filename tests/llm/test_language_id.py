import math
from collections import Counter, defaultdict

import pytest

from terrasample.llm import language_id as L

SMALL = [("a", "abcabcab"), ("b", "bcdbcd é"), ("a", "abd")]


def brute(text, lang, order):
    pad, c = b"\0" * order, defaultdict(Counter)
    data = b"".join(pad + t.lower().encode() for la, t in SMALL if la == lang) + pad
    for i in range(order, len(data)):
        for k in range(order + 1):
            c[k, data[i - k : i]][data[i]] += 1
    bits, data = 0.0, pad + text.lower().encode()
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = c.get((k, data[i - k : i]))
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits += math.log2((t + d) / seen[data[i]])
                break
            bits += math.log2((t + d) / d)
    return bits


@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_code_lengths_against_brute_force(monkeypatch, piece):
    monkeypatch.setattr(L, "SLICE", piece)
    m = L.fit(SMALL, 3)
    for text in ("abc", "zebra", "Bcd É", "a", "abcabdbcd" * 5):
        assert m.score(["", text, text])[1:].tolist() == [pytest.approx([brute(text, x, 3) for x in m.languages], rel=1e-5)] * 2


def test_identify_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "abcabc", "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (4, "123 !?", "b", "x"), (5, "bcdbcd" * 3000, "b", "x"), (1, "abcabc", "a", "x"), (None, "bcdbcd", None, "x")],
        "doc_id long, text string, lang string, LANG_PRED string",
    )
    model = L.fit(L.training_sample(docs))
    rows = L.identify(docs, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows] == [(1, "a"), (2, "und"), (3, "und"), (4, "und"), (5, "b"), (1, "a"), (None, "b")]
    assert all(0 <= r.score <= 1 for r in rows) and rows[1].score == 0
    assert L.identify(docs.limit(0), model).count() == 0
    none = L.identify(docs, L.fit(L.training_sample(docs.limit(0)))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = L.held_out("doc_id", 3, 1)
    model = L.fit(L.training_sample(docs.where(~held)))
    rows = L.identify(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_sample_is_fair_to_small_languages(spark):
    big = spark.range(30_000).selectExpr("id", "'big' AS lang", "concat('many words here ', id) AS text")
    small = spark.range(3000).selectExpr("id", "'small' AS lang", "concat('weinig woorden ', id) AS text")
    long = spark.range(3).selectExpr("id", "'long' AS lang", "concat(repeat('langue ', 20000), id) AS text")
    got = Counter(la for la, _ in L.training_sample(big.union(small).union(long), id_col="id"))
    assert got["small"] == 3000 and got["long"] == 3 and 6000 < got["big"] < 7400
    many = spark.range(4000).selectExpr("id", "concat('l', id % 400) AS lang", "concat(repeat('ab ', 500), id) AS text")
    found = L.training_sample(many, id_col="id")
    assert len({la for la, _ in found}) == 400 and sum(len(t) for _, t in found) < 10_000_000
