import numpy as np
import pytest

from terrasample.llm import embedding_dedup as E


def brute(rows, cosine):
    n = len(rows)
    adjacent = np.zeros((n, n), dtype=bool)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                adjacent[a, b] = adjacent[b, a] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a], *[label[b] for b in np.flatnonzero(adjacent[a])]]) for a in range(n)]
        if new == label:
            break
        label = new
    least = {c: min(rows[a][0] for a in range(n) if label[a] == c) for c in set(label)}
    return sorted((rows[a][0], int(adjacent[a].sum()), least[label[a]]) for a in range(n)), int(adjacent.sum())


def cases():
    r = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = r.normal(size=32)
        for _ in range(25):
            rows.append((centre + r.normal(size=32) * r.choice([0.02, 0.15, 0.3])).tolist())
    rows += [rows[0]] * 30 + [r.normal(size=32).tolist() for _ in range(60)]
    out = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 32, [1.0, None], [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0], [1.0, 2.0]]
    return out + [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, rows[0], None), (2001, rows[0], None)]


@pytest.mark.parametrize("block", [512, 10])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = cases()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = E.link(df).collect()
    want, links = brute(rows, 0.93)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    assert len(found) == len(want) and all(g[1] <= w[1] for g, w in zip(found, want, strict=True))
    assert sum(g[1] for g in found) >= 0.95 * links and sum(g == w for g, w in zip(found, want, strict=True)) >= 0.95 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = sum(int((x[label == c] @ x[label == c].T >= 0.93).sum() - (label == c).sum()) for c in np.unique(label))
    assert sum(r.n_links for r in E.link(df).collect()) >= 0.97 * links


def test_transform_and_empty(spark):
    x = np.random.default_rng(1).normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(E.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(E.hadamard(E.hadamard(x)), x)
    df = spark.createDataFrame([(1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert E.link(df.limit(0)).count() == 0 and E.link(df).first().asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}
