import re
from collections import Counter

import pytest

import corpus_pipeline
from terrasample.llm import language_id, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{i}")
        docs = spark.read.parquet(f"file://{folder}/{i}")
    return [*out, docs]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, steps):
    from tests.llm.test_decontamination import brute
    from tests.llm.test_ngram_join import components

    docs, told, single, clean, mixed, sharded = steps
    assert all(s.columns == docs.columns for s in steps[:5])
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = language_id.fit(language_id.training_sample(docs.where(~language_id.held_out("doc_id", 3, 1))))
    found = language_id.identify(docs, model).where("lang_pred <> 'und' and score >= 0.5")
    assert ids(told) == ids(found) and all(re.search(r"[^\W\d_]", texts[i]) for i in ids(told))
    groups = components([(i, texts[i]) for i in ids(told)], 5, 80)
    assert ids(single) == sorted({c for *_, c in groups})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = brute([(i, texts[i]) for i in ids(single)], items)
    assert ids(clean) == [i for i in ids(single) if i not in leaked]
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(clean).collect()}
    assert Counter(ids(mixed)) == {i: t // s for i, (s, t) in taken.items() if t}
    assert ids(sharded) == ids(mixed)


def test_run_and_empty(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[-1])
    docs = steps[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
