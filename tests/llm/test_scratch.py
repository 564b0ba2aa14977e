import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasample.llm import _scratch as S
from terrasample.llm import _graph as G
from terrasample.llm._graph import components


def test_bitmap(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    own = np.array([r.h for r in keys.collect()], dtype=np.int64)
    other = np.random.default_rng(0).integers(-(2**63), 2**63, 10_000)
    for count in (0, 5000, 200_000):
        bits = S.bitmap_of(keys, "h", count)
        assert bits.has(own).all() and bits.has(other).mean() < 0.01 and len(bits.bits) * 8 >= max(S.LEAST_BITS, 16 * count)
    assert not S.bitmap_of(keys.limit(0), "h", 0).any()


def test_settings_are_put_back(spark):
    spark.conf.unset(S.CLEANUP)
    before = spark.conf.get(S.CLEANUP, None)
    assert S.Scratch(spark, "x").table(spark.range(3).groupBy("id").count()).count() == 3
    assert spark.conf.get(S.CLEANUP, None) == before


def test_names():
    assert S.free_name("shard", ["Shard", "shard_"]) == "shard__"


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="'text' is missing"):
        S.only(spark.range(1), "text")


@pytest.mark.parametrize("hub", [1000, 20])
def test_components(spark, monkeypatch, hub):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(G, "HUB", hub)
    got = {x.node: x.component for x in components(df, S.Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in label}
    assert components(df.limit(0), S.Scratch(spark, "test")).count() == 0
