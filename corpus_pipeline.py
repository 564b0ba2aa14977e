"""Corpus pipeline: from raw documents to shards for training.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes each stage's result
to the shared folder and rereads it, so a lost executor never reaches back further than the running stage. All stages
but the last return the columns of ``documents``. A stage begins by letting go of what the driver still holds of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasample.llm import decontamination, language_id, mixing, ngram_join, sharding
from terrasample.llm._scratch import Scratch, settle, temporary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: a letter, and one language with at least half of the likelihood."""
    settle(spark)
    model = language_id.fit(language_id.training_sample(docs.where(~language_id.held_out("doc_id", 3, 1))))
    found = language_id.identify(docs, model)
    return found.where("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a Jaccard similarity of 0.8."""
    settle(spark)
    return ngram_join.deduplicate(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's 5-word shingles."""
    settle(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, none more than twice."""
    settle(spark)
    return mixing.apply(docs, weights=(3, 1, 2), share=1.5, ceiling=2.0)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which shard each document was written to."""
    settle(spark)
    return sharding.shard(docs, Scratch(spark, "shards").root)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", write_shards),
]

#: Language ID and the join's components are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shard each document of the mix was written to. What a stage left in the shared folder goes when the next
    stage's result is written; the shards stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        with temporary():
            docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
