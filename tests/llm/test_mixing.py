import math
import re

import pytest
from pyspark.sql import functions as F

from terrasample.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), ["b", "a", None, "c"][i % 4] if i < 300 else "hot", 1) for i in range(900)]
    return spark.createDataFrame([*rows, (5000, None, "a", 1), (5001, "", "empty", 1), (3, "w " * 22, "c", 1)], "doc_id long, text string, source string, SIZE int")


def test_targets_and_limits(docs):
    p = mixing.mix(docs).toPandas()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    assert sorted(p["size"]) == sorted(words)
    by = docs.select("doc_id", F.coalesce("source", F.lit("~null")).alias("s")).toPandas().drop_duplicates()
    p = p.merge(by, on="doc_id")
    g = p.groupby("s").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (p.taken <= 2 * p["size"]).all() and g.target.sum() == pytest.approx(1.5 * g["size"].sum())
    assert (g.target <= 2 * g["size"] + 1e-6).all() and (abs(g.taken - g.target) <= 90).all()
    # by hand: weights 3 1 2 3 1 2 over a, b, c, empty, hot, null
    weight, size, left = {"a": 3, "b": 1, "c": 2, "empty": 3, "hot": 1, "~null": 2}, g["size"].to_dict(), 1.5 * g["size"].sum()
    target, free = {}, set(weight)
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
        left = 1.5 * g["size"].sum() - sum(target.values())
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert g.target.to_dict() == pytest.approx(target)


def by_row(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_reruns_agree_and_apply_takes_the_same(docs):
    columns = ["doc_id", "size", "taken"]
    one, two = (by_row(mixing.mix(d), columns) for d in (docs, docs.repartition(7)))
    assert one == two
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    taken = {}
    for i, _, t in one:
        taken[i] = taken.get(i, 0) + t
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}


def test_repeated_rows_meet_the_target(spark):
    """A third of all rows is one row, others have no id: they are drawn one by one."""
    same = [(7, "the same row of eight words it is", "a")] * 400
    none = [(None, "w " * (10 + i % 3), "b") for i in range(300)]
    own = [(1000 + i, "v " * (5 + i % 20), "a" if i % 2 else "b") for i in range(500)]
    df = spark.createDataFrame([*same, *none, *own], "doc_id long, text string, source string").repartition(9)
    p = mixing.mix(df, weights=(1, 2), share=0.8).toPandas()
    assert (abs(p.groupby("target").taken.sum() - p.groupby("target").target.first()) <= 13).all()
    repeated = p[p.doc_id == 7]
    assert 0 < (repeated.taken > 0).sum() < 400
    out = mixing.apply(df, weights=(1, 2), share=0.8)
    assert out.where("doc_id = 7").count() * 8 == repeated.taken.sum()
    assert by_row(mixing.mix(df.coalesce(2), weights=(1, 2), share=0.8), ["doc_id", "size", "taken"]) == by_row(mixing.mix(df, weights=(1, 2), share=0.8), ["doc_id", "size", "taken"])


def test_probabilities_follow_the_weights(spark):
    """Of many documents of a size the share that is taken is about their probability, in proportion to the size."""
    rows = [(i, "w " * (20 if i % 2 else 5), "a") for i in range(2000)] + [(9999, "w " * 5000, "a")]
    p = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.5).toPandas()
    took = {n: (p[p["size"] == n].taken > 0).mean() for n in (5, 20, 5000)}
    assert took[5000] == 1  # certain: its share would be above 1
    words, w20, w5 = 0.5 * 30_000 - 5000, 2 ** (round(8 * math.log2(20)) / 8), 2 ** (round(8 * math.log2(5)) / 8)
    c = words / (1000 * 20 * w20 + 1000 * 5 * w5)
    assert took[20] == pytest.approx(c * w20, abs=0.06) and took[5] == pytest.approx(c * w5, abs=0.06)


def test_a_weight_column_shifts_the_sample(docs):
    kept = mixing.mix(docs.withColumn("o", F.when(F.col("doc_id") < 600, 100.0).otherwise(0.01)), weights=(1,), share=0.3, weight_col="o")
    p = kept.toPandas()
    assert p[p.doc_id < 600].taken.sum() > 2 * p[(p.doc_id >= 600) & (p.doc_id < 900)].taken.sum()


def test_empty(docs):
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0
