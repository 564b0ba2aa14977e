"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._scratch import Scratch

#: Edges of a node that one task joins; a node with more is a hub, and its label is sent to several tasks.
HUB = 1000
#: Most hubs that are broadcast; of more the busiest, the others are left to Spark's splitting of skewed joins.
HUBS = 100_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every end of an edge ``a, b``.

    Each round every node takes the smallest label among its own and its neighbours', then the label of its label, until
    nothing changes: few rounds for clusters, about the logarithm of the length for chains. Labels are written to the
    shared folder after each round; minima are combined before the shuffle, and the edges of a hub are dealt to as many tasks
    as they need, each with a copy of the hub's label.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    degrees = both.groupBy(F.col("b").alias("hub")).count().where(F.col("count") > HUB)
    hubs = scratch.table(degrees.orderBy(F.desc("count"), "hub").limit(HUBS).select("hub", F.ceil(F.col("count") / HUB).cast("int").alias("parts")))
    some = hubs.limit(1).count() > 0
    if some:
        dealt = both.join(F.broadcast(hubs), F.col("b") == F.col("hub"), "left")
        dealt = scratch.table(dealt.select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int").alias("part")))
        scratch.drop(both)
        both = dealt
    else:
        both = both.withColumn("part", F.lit(0))
        both._scratch_path = f"{scratch.root}/{scratch.n - 1}"
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        copies = labels.select("node", "component", F.lit(0).alias("of"))
        if some:
            more = labels.join(F.broadcast(hubs), F.col("node") == F.col("hub")).select("node", "component", F.explode(F.expr("sequence(1, parts - 1)")).alias("of"))
            copies = copies.unionAll(more.where("of > 0"))
        near = both.join(copies, (F.col("b") == F.col("node")) & (F.col("part") == F.col("of"))).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", "component", F.least("component", "near").alias("next"))
        # the label of the next label: asked for once by each task that needs it
        asked = step.select("next").distinct()
        roots = asked.join(labels.select(F.col("node").alias("r"), F.col("component").alias("root")), F.col("next") == F.col("r")).select("r", "root")
        after = step.join(roots, F.col("next") == F.col("r")).select("node", F.least("next", "root").alias("component"), (F.least("next", "root") < F.col("component")).alias("moved"))
        after = scratch.table(after)
        scratch.drop(labels)
        labels = after
        if not after.where("moved").limit(1).count():
            scratch.drop(both, hubs)
            return labels.select("node", "component")
