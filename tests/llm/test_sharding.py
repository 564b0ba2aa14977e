import hashlib

import pytest
from pyspark.sql import functions as F

from terrasample.llm import sharding
from terrasample.llm.sharding import Store, create_once, read_back, shard


def docs(spark, a, b, parts=4):
    return spark.range(a, b, 1, parts).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("x"), 50)).alias("text"), F.lit(1).alias("shard"), F.lit("r").alias("run"))


def store(spark, path, **options):
    return Store(spark, f"file://{path}", **({"base_bytes": 1000, "target_bytes": 40_000} | options))


def contents(s, version=None):
    return sorted(r.i for r in s.read(version).select(F.col("doc.doc_id").alias("i")).collect())


def stored_files(path):
    return sorted(p.name for p in path.glob("data/*/part-*"))


def test_append_compact_and_versions(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.version() == 0 and s.manifest().count() == 0
    s.append(docs(spark, 0, 400, 40))
    assert s.manifest().count() == 40 and contents(s) == list(range(400))  # a shard per task, no shuffle
    s.compact()
    rows = s.manifest().collect()
    assert len(rows) < 10 and sum(r.rows for r in rows) == 400 and all(r.made == 2 for r in rows)
    assert contents(s) == contents(s, 1) == list(range(400))
    s.append(docs(spark, 400, 600, 20))
    s.compact()
    s.sweep()
    assert contents(s) == list(range(600)) and s.version() == 4
    rows = s.manifest().collect()
    assert max(r.stored for r in rows) <= 80_000
    # rows stored are rows read: no dead file is left
    assert stored_files(tmp_path) == sorted(r.shard.split("/")[1] for r in rows)
    assert spark.read.parquet(f"file://{tmp_path}/data/*").count() == 600


def test_no_complete_run_is_left(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(3):
        s.append(docs(spark, 1000 * k, 1000 * k + 150 * (k + 1), 11 * (k + 1)))
        s.compact()
    tiers = {}
    for r in s.manifest().select("stored", s.tier(F.col("stored")).alias("tier")).collect():
        if r.stored < s.target_bytes // 2:
            tiers.setdefault(r.tier, []).append(r.stored)
    assert all(len(t) < s.fanout for t in tiers.values())
    plan = s.planned(s.manifest())
    assert plan.count() == 0


@pytest.mark.parametrize("wave", [20_000, 5])
def test_sparse_hashed_and_text_ids_make_few_shards(spark, tmp_path, monkeypatch, wave):
    monkeypatch.setattr(sharding, "WAVE", wave)
    hashed = docs(spark, 0, 1000, 50).withColumn("doc_id", F.xxhash64("doc_id"))
    s = Store(spark, f"file://{tmp_path}/a")
    s.append(hashed)
    s.compact()
    assert s.manifest().count() == 1 and s.read().count() == 1000
    named = hashed.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    got = shard(named, f"file://{tmp_path}/b")
    assert got.count() == 1000 and got.select("shard").distinct().count() == 1 and got.schema["doc_id"].dataType.simpleString() == "string"


def test_of_two_writers_one_fails(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(docs(spark, 0, 20))
    with pytest.raises(RuntimeError, match="already there"):
        s.commit(s.manifest(), 0, s.schema())
    assert s.version() == 1 and contents(s) == list(range(20))
    create_once(spark, f"file://{tmp_path}/x/one", "first")
    with pytest.raises(FileExistsError):
        create_once(spark, f"file://{tmp_path}/x/one", "second")
    assert (tmp_path / "x/one").read_text() == "first" and [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["one"]
    with pytest.raises(ValueError, match="columns"):
        s.append(docs(spark, 0, 5).drop("run"))


def test_nulls_repeated_rows_and_empty(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(docs(spark, 0, 20))
    odd = spark.createDataFrame([(None, None, 1, "r"), (5, "", 1, "r"), (5, "", 1, "r"), (-7, "long " * 9000, 1, "r")], "doc_id long, text string, shard int, run string")
    s.append(odd)
    assert s.read().count() == 24
    s.append(odd.limit(0))
    s.compact()
    s.sweep()
    assert s.read().count() == 24 and s.version() == 4
    assert s.read().select("doc.*").columns == ["doc_id", "text", "shard", "run"]
    assert shard(odd.limit(0), f"file://{tmp_path}/empty").count() == 0 and read_back(odd.limit(0), f"file://{tmp_path}/none").count() == 0
    got = read_back(odd, f"file://{tmp_path}/odd").collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.text_md5) for r in got) == sorted((i or 0, len(t or ""), t if t is None else hashlib.md5(t.encode()).hexdigest()) for i, t, *_ in odd.collect())
    assert all(r.listed and r.fits and r.version == 2 for r in got)
