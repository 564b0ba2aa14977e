import random
import re

import numpy as np
import pyarrow as pa
import pytest

from terrasample.llm import _text
from terrasample.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = list(range(len(sets)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def test_hashes_agree_with_words():
    random.seed(1)
    texts = ["".join(random.choice("aAbB \n\té z") for _ in range(random.choice([0, 1, 3, 10, 60]))) for _ in range(500)] + [None, "   ", "x" * 100]
    for k in (4, 5):
        h, at = _text.shingle_hashes(pa.array(texts), k)
        seen, back = {}, {}
        for i, t in enumerate(texts):
            w = WORD.findall((t or "").translate(LOWER))
            want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])
            got = h[at[i] : at[i + 1]].tolist()
            assert len(got) == len(want)
            assert all(seen.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(want, got, strict=True))


def test_signatures_meet_for_every_possible_partner():
    """Whatever tokens a partner lacks within the slack, the two share a signature."""
    r = np.random.default_rng(3)
    for trial in range(300):
        percent = int(r.choice([80, 85]))
        base = np.unique(r.integers(0, 2**63, int(r.integers(2, 120)), dtype=np.uint64))
        lack = int(r.integers(0, max(1, len(base) // 8) + 1))
        other = np.unique(np.concatenate([np.delete(base, r.choice(len(base), min(lack, len(base) - 1), replace=False)), r.integers(0, 2**63, int(r.integers(0, 4)), dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common < percent * (len(base) + len(other) - common):
            continue
        frequent = lambda s, t=trial: (_text.mix64(s + np.uint64(t % 7)) % np.uint64(100)) < np.uint64([0, 30, 60, 90, 100][t % 5])
        (one, two), (one2, two2) = (N.signatures(s, frequent(s), percent) for s in (base, other))
        assert len(base) == 1 or np.intersect1d(one, one2).size or np.intersect1d(two, two2).size


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(60):
        out.append(" ".join(random.choice(vocabulary) for _ in range(random.choice([2, 4, 5, 9, 40, 120]))))
    passage = " ".join(random.choice(vocabulary) for _ in range(55))
    out += [" ".join(random.choice(vocabulary) for _ in range(30)) + " " + passage for _ in range(40)]
    base = [random.choice(vocabulary) for _ in range(100)]
    for _ in range(80):  # one large group of near copies, more than the frequent threshold
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4])):
            w[random.randrange(100)] = random.choice(vocabulary) + "x"
        out.append(" ".join(w))
    for t in list(out[:30]):
        out += [t, t.upper()]
        w = t.split()
        w[random.randrange(len(w))] = "edit"
        out.append("\n ".join(w))
    out += [None, "", "  \n", "one", "ONE", "one two", "a b c d", "a b c d", " ".join(f"z{i}" for i in range(6000))]
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_link_against_brute_force(spark, rows, k, percent):
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame([(i, t, 0) for i, t in shuffled], "doc_id long, text string, component_id int")
    got = sorted(tuple(r) for r in N.link(df, k, percent).collect())
    assert got == components(rows, k, percent)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (None, None)], "doc_id long, text string")
    got = sorted(N.link(df).collect(), key=str)
    assert sorted(str(r.component_id) for r in got) == ["1", "1", "1", "1", "3", "None"]
    assert N.link(df.limit(0)).count() == 0
    kept = N.deduplicate(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"]


def test_rows_that_share_an_id_go_by_themselves(spark):
    near = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, near), (5, near + " more"), (5, "an unrelated text with words of its own"), (None, near), (None, "x y z"), (7, None), (7, None), (8, "")], "doc_id long, text string")
    kept = sorted(str((r.doc_id, r.text)) for r in N.deduplicate(df).collect())
    assert kept == sorted(str(x) for x in [(1, near), (5, "an unrelated text with words of its own"), (None, "x y z"), (7, None), (8, "")])


def test_blocks_and_limits_change_nothing(spark, rows, monkeypatch):
    """Small blocks, few frequent tokens, and joins in place of bitmaps give the same components."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, 5, 80)
    monkeypatch.setattr(N, "SIDE", 3)
    assert sorted(tuple(r) for r in N.link(df, 5, 80).collect()) == want
    monkeypatch.setattr(N, "CAPACITY", 5)
    assert sorted(tuple(r) for r in N.link(df, 5, 80).collect()) == want
