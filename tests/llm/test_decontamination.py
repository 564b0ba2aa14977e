import random
from math import comb

import numpy as np

from terrasample.llm import decontamination as D

random.seed(4)
VOCABULARY = [f"v{i}" for i in range(3000)]


def some(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def brute(docs, items, k=5, percent=80):
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for j, u in items:
            v = (u or "").lower().split()
            size = min(k, len(v))
            if not size:
                continue
            own = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)}
            there = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)}
            if 100 * len(own & there) >= percent * len(own):
                out.setdefault(i, set()).add(j)
    return {i: sorted(s) for i, s in out.items()}


def case():
    items = [(i, some(random.choice([3, 5, 6, 12, 30, 60, 200]))) for i in range(40)] + [(90, None), (91, " "), (92, some(4).upper())]
    docs = []
    for d in range(120):
        w = some(random.choice([3, 50, 400, 4000]))
        if d % 3 == 0:
            w += " " + random.choice(items[:40])[1].title() + "\n" + some(20)
        if d % 7 == 0:  # an item with a word changed
            v = random.choice([i for i in items[:40] if len(i[1].split()) >= 60])[1].split()
            v[len(v) // 2] = "changed"
            w = " ".join(v) + " " + w
        docs.append((d, w))
    return docs + [(500, None), (501, ""), (0, docs[0][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = case()
    left = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40
    for block in (16 << 20, 4000):
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        got = D.contaminated(left, right)
        assert {r.doc_id: r["items"] for r in got.collect()} == want
    kept = D.clean(left, right)
    assert kept.columns == left.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in want)


def test_text_ids_of_items_and_null_ids(spark):
    docs, items = case()
    left = spark.createDataFrame([(None if i == 3 else f"d{i}", t) for i, t in docs[:40]], "doc_id string, text string")
    right = spark.createDataFrame([(f"i{j}", t) for j, t in items] + [(None, items[0][1])], "item_id string, text string")
    want = {None if i == 3 else f"d{i}": sorted(f"i{j}" for j in s) for i, s in brute(docs[:40], items).items()}
    got = {r.doc_id: [x for x in r["items"] if x] for r in D.contaminated(left, right).collect()}
    assert got == want


def test_minima_that_must_agree():
    for n in (1, 5, 20, 32):  # signed whole: as many as the threshold
        assert D.needed(n, -(-n * 80 // 100)) == -(-n * 80 // 100)
    for n in (40, 100, 1000):
        inside = -(-n * 80 // 100)
        need = D.needed(n, inside)
        short = sum(comb(inside, x) * comb(n - inside, 32 - x) for x in range(need)) / comb(n, 32)
        assert 5 < need < 26 and short <= D.MISS


def test_recall_of_the_minima_and_what_they_spare():
    """Items of which just the threshold lies in a long text, in pieces: all are candidates, few others are."""
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in r.integers(33, 3000, 300)]
    items = D.Items(list(range(300)), sets, 5, 80)
    hashes, doc, inside, outside = [], [], set(), 0
    for d in range(300):
        share = r.permutation(sets[d])[: items.least[d]] if d % 2 else r.permutation(sets[d])[: len(sets[d]) // 10]
        own = np.concatenate([share, r.integers(0, 2**63, 20_000, dtype=np.uint64)])
        hashes.append(own)
        doc.append(np.full(len(own), d))
        if d % 2:
            inside.add((d, d))
    found = set(items.candidates(np.concatenate(hashes), np.concatenate(doc)))
    assert inside <= found and len(found - inside) <= 3


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, items).count() == 0 and D.clean(docs, items).count() == 1
    assert D.contaminated(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
