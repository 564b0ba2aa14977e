import random

import numpy as np
import pytest

from terrasample.llm import ngram_join as N
from tests.llm.test_ngram_join import rows, shingles  # noqa: F401


def links(rows, k, percent):  # noqa: F811
    sets = [shingles(t, k) for _, t in rows]
    return [(i, sum(a != b and bool(x) and 100 * len(x & y) >= percent * len(x | y) for b, y in enumerate(sets))) for a, ((i, _), x) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("block", "tokens", "width"), [(N.BLOCK, N.BLOCK_TOKENS, N.WIDTH), (16, 1 << 18, 64), (256, 1000, 4096)])
def test_every_link_is_counted(spark, rows, monkeypatch, block, tokens, width):  # noqa: F811
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(N, "WIDTH", width)
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id long, text string")
    out = N.link(df, 4, 85, count=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = sorted((r.doc_id, r.n_links) for r in out.collect())
    want = links(rows, 4, 85)
    assert got == want
    assert max(n for _, n in want) > 16 and out.groupBy("component_id").count().where("count > 16").count() > 0
    assert N.link(df.limit(0), count=True).count() == 0


def test_common_tokens_in_pieces(monkeypatch):
    monkeypatch.setattr(N, "WIDTH", 7)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    row = np.repeat(np.arange(9), [len(s) for s in sets])
    left, right = np.arange(9), np.array([1, 4, 8])
    assert (N._common(np.concatenate(sets), row, left, right) == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]).all()
