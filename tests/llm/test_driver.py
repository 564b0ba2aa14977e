import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from terrasample.llm import _scratch as S
from terrasample.llm import _text


def test_bitmap_takes_few_jobs(spark, monkeypatch):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h")).localCheckpoint()
    group = uuid.uuid4().hex
    with S.setting(spark, "spark.sql.shuffle.partitions", "64"), S.setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        spark.sparkContext.setJobGroup(group, "bitmap")
        bits = S.bitmap_of(keys, "h", 200_000)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10
        monkeypatch.setattr(S, "PIECE_BYTES", 40_000)
        assert np.array_equal(S.bitmap_of(keys, "h", 200_000).bits, bits.bits)
    assert bits.has(np.array([r.h for r in keys.collect()], dtype=np.int64)).all()


def test_settling_trims_the_native_heap(spark, monkeypatch):
    said = []
    monkeypatch.setattr(S, "trim", lambda s, trim=S.trim: said.append(trim(s)))
    S.Scratch(spark, "x").settle()
    assert len(said) == 1 and (said[0] is None or "Trim native heap" in said[0])


def test_settling_collects_garbage_on_executors(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    group, before = uuid.uuid4().hex, count()
    spark.sparkContext.setJobGroup(group, "garbage")
    S.collect_garbage(spark)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert count() > before
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert [s.numTasks for s in stages] == [spark.sparkContext.defaultParallelism]
    calls = []
    monkeypatch.setattr(S, "collect_garbage", calls.append)
    S.Scratch(spark, "x").settle()
    assert calls == [spark]


def test_words_need_little_memory(monkeypatch):
    texts = pa.array(["".join(f"word{i} " for i in range(220_000))])
    data, offsets = _text.text_bytes(texts)
    _text._powers.clear()
    tracemalloc.start()
    got = _text.words(data, offsets)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 2 << 20 and peak < 16 * len(data)
    monkeypatch.setattr(_text, "CHUNK", 1 << 21)
    assert np.array_equal(_text.words(data, offsets)[0], got)


def test_pipeline_stages_begin_settled(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "settle", calls.append)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, "/root/testdata/sf0.001")
        assert calls == [spark] * n
