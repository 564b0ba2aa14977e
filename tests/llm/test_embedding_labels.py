import pytest

from terrasample.llm import embedding_dedup as E


@pytest.mark.parametrize(("kind", "labels"), [("string", ["category_1", "category_2", "category_1"]), ("long", [123456781, 123456782, 123456781])])
def test_labels_that_share_their_first_eight_characters(spark, kind, labels):
    v = [float(i % 3) + 0.5 for i in range(16)]
    near = [*v[:-1], v[-1] + 0.01]
    rows = [(i, v, x) for i, x in enumerate(labels)] + [(3, near, labels[1])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.link(df).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)]
