"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._scratch import only

#: Longest text of a training sample, in bytes. (Longer texts are scored like all others.)
SAMPLE_TEXT = 32_768


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) pairs: of each label value the ``most[value]`` rows whose id hashes lowest. The sampled ids, at
    most the sum of ``most``, are broadcast to one pass over the texts; texts are never shuffled."""
    rows = only(labels, id_col, label).toDF("id", "label").where("id is not null")
    picked = None
    for value, n in sorted(most.items()):
        part = rows.where(F.col("label") == value).groupBy("id", "label").agg(F.xxhash64("id").alias("h")).orderBy("h", "id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    texts = only(docs, id_col, text_col).toDF("id", "text").where("text is not null").where(F.octet_length("text") <= SAMPLE_TEXT)
    found = texts.join(F.broadcast(picked.select("id", "label")), "id").select("text", "label").collect()
    return sorted((r["text"], int(r["label"])) for r in found)
