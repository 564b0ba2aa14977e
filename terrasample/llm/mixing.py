"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources get shares of a wanted total by weight. No source may give more than ``ceiling`` times its size: what a capped
source leaves is reshared by weight among the others until none is above. That fixed point is closed form: in ascending
order of ceiling over weight the capped sources are a prefix. (One task sorts the sources, a row each.)

Within a source whose target is e times its size every document is taken floor(e) times for certain. The words that are
left are drawn with unequal probabilities, in proportion to a document's inclusion weight: its size, or a column of
``weight_col``. Weights are put in classes of an eighth of a doubling; where the proportional probability of a class exceeds 1
its documents are taken for certain and the rest is shared out again, a prefix of the falling classes. Then it is a
Pareto order sample: with u uniform from the document's id, source and text, documents are ranked by odds(u) over the odds of
their probability, and the lowest ranks are taken until the wanted words are reached: a sample of fixed size in words.
One document more rounds the sample: the one of the last bucket whose size is nearest to what is still missing, if it
brings the sum nearer.

The words of a source are summed in sqrt(documents) rank buckets, so only the bucket in which the sum is reached is ever
sorted; a source with a third of all rows costs a task no more than the square root of its rows.

A size is the number of words (null text: 0); documents without words have no weight and are only taken as whole copies. A
null source is a source of its own and comes last. Rows that agree in id, source and text are numbered, in two steps so that no
task has all of a large group, and each number has its own u: repeated rows are drawn one by one, and which of them is
which makes no difference. An empty table gives an empty result; extra columns are ignored by ``mix`` and kept by ``apply``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasample.llm._scratch import Scratch, free_name, only

#: Words are separated by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Classes of inclusion weights in a doubling.
CLASSES = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """``source, n, source_size`` with ``target`` added: shares of ``share`` times the total, by weights that
    repeat in code-point order of the sources (null last)."""
    place = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    cap = ceiling * F.col("source_size")
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap.cast("double"))
    rows = rows.withColumn("wanted", share * F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("wanted") - before) / after)
    rows = rows.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level))
    return rows.select("source", "n", "source_size", F.round("target", 6).alias("target"))


def _weight_class(weight: Column) -> Column:
    return F.when(weight > 0, F.round(F.log2(weight) * CLASSES).cast("int"))


def inclusion(classes: DataFrame) -> DataFrame:
    """``source, class, p`` from ``source, class, words, of_class``: probabilities in proportion to the class's weight whose
    expected words are ``words``, none above 1."""
    falling = W.partitionBy("source").orderBy(F.desc("class"))
    rows = classes.withColumn("w", F.pow(F.lit(2.0), F.col("class") / F.lit(float(CLASSES))))
    before = F.coalesce(F.sum("of_class").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("of_class")).over(falling.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("left", F.col("words") - before).withColumn("rest", rest)
    rows = rows.withColumn("certain", F.min(F.col("w") * F.col("left") >= F.col("rest")).over(falling))
    scale = F.max(F.when(~F.col("certain"), F.struct("class", (F.col("left") / F.col("rest")).alias("c")))).over(W.partitionBy("source"))["c"]
    return rows.select("source", "class", F.when(F.col("certain"), 1.0).otherwise(F.col("w") * scale).alias("p"))


def _keys(docs: DataFrame, id_col: str, source_col: str, text_col: str, weight_col: str | None) -> list[Column]:
    """``key`` of what a document is, ``rest`` of its other columns, and ``source, size, class``."""
    words = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(none)) for c, none in ((id_col, "-"), (source_col, "-"), (text_col, ""))]
    key = F.md5(F.concat_ws("\n", *words))
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and f.dataType.typeName() not in ("map", "variant")]
    size = n_words(F.col(f"`{text_col}`"))
    weight = F.col(f"`{weight_col}`").cast("double") if weight_col else size
    return [key.alias("key"), F.xxhash64(*hashable).alias("rest"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), _weight_class(F.when(size > 0, weight)).alias("class")]


def _numbered(sized: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with the number ``k`` of each among those of its key. Rows of a key are counted by the task that wrote them, so
    that a window only ever has the rows of one key and task."""
    many = sized.join(repeated, "key", "left_semi")
    counts = many.groupBy("key", "task").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("key").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("key").alias("of_key"), F.col("task").alias("of_task"), before.alias("before"))
    many = many.withColumn("at", F.row_number().over(W.partitionBy("key", "task").orderBy("row")))
    many = many.join(counts, (F.col("key") == F.col("of_key")) & (F.col("task") == F.col("of_task"))).withColumn("k", F.col("before") + F.col("at") - 1)
    return sized.join(repeated, "key", "left_anti").withColumn("k", F.lit(0).cast("long")).unionByName(many.select(*sized.columns, "k"))


def _picked(rows: DataFrame, seed: int) -> DataFrame:
    """``pick``, the random string of a row, and ``u`` strictly between 0 and 1 from 52 of its bits."""
    rows = rows.withColumn("pick", F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("k").cast("string"))))
    return rows.withColumn("u", (F.conv(F.substring("pick", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52)))


def _ranked(rows: DataFrame, plans: DataFrame) -> DataFrame:
    plans = plans.withColumnsRenamed({"source": "plan_source", "class": "plan_class"})
    both = rows.join(plans, F.col("source").eqNullSafe(F.col("plan_source")) & F.col("class").eqNullSafe(F.col("plan_class"))).drop("plan_source", "plan_class")
    rank = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p")))
    both = both.withColumn("rank", rank)
    return both.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")))


def plan(rows: DataFrame, scratch: Scratch, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """From ``source, size, class, pick, u`` rows: one row per source and class with the source's target, the certain
    copies, the class's probability and the ranks that are taken."""
    by_class = scratch.table(rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("of_class")))
    sizes = by_class.groupBy("source").agg(F.sum("n").alias("n"), F.sum("of_class").alias("source_size"))
    sources = targets(sizes, weights, share, ceiling)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("copies", F.floor(ratio).cast("long")).withColumn("words", F.col("target") - F.col("copies") * F.col("source_size"))
    # what is left of a word is rounding
    sources = sources.withColumn("words", F.when(F.col("words") >= 0.5, F.col("words")).otherwise(0.0)).withColumn("buckets", F.ceil(F.sqrt("n"))).drop("n")
    classes = by_class.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    some = inclusion(classes.where("words > 0 and class is not null").select("source", "class", "words", "of_class")).toDF("s", "c", "p")
    classes = classes.join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left").drop("s", "c", "of_class")
    classes = scratch.table(classes)

    ranked = _ranked(rows, classes).where("rank is not null")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("words").alias("words"))
    upto = F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).where("upto > words")
    last = sums.groupBy("source").agg(F.min(F.struct("bucket", (F.col("words") - F.col("upto") + F.col("in_bucket")).alias("left"))).alias("last"))
    last = scratch.table(last.select("source", F.col("last.bucket").alias("last_bucket"), F.col("last.left").alias("left")))

    edge = ranked.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("bucket = last_bucket").select("source", "rank", "pick", "size", "left")
    edge = edge.withColumn("sum", F.sum("size").over(W.partitionBy("source").orderBy("rank", "pick")))
    cut = edge.groupBy("source").agg(
        F.max(F.when(F.col("sum") <= F.col("left"), F.struct("rank", "pick"))).alias("cut"),
        F.first("left").alias("left"),
        F.coalesce(F.max(F.when(F.col("sum") <= F.col("left"), F.col("sum"))), F.lit(0)).alias("taken"),
    )
    cut = cut.select("source", "cut", (F.col("left") - F.col("taken")).alias("missing"))
    rest = edge.where("sum > left").join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    nearest = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "rank", "pick", "missing")).alias("x"))
    nearest = nearest.where("x.off < x.missing").select(F.col("source").alias("s2"), F.col("x.pick").alias("extra"))
    cut = cut.join(nearest, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s3"), "cut", "extra")

    out = classes.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left")
    out = out.join(cut, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    return scratch.table(out.select("source", "class", "source_size", "target", "copies", "p", "buckets", "last_bucket", "cut", "extra"))


def _taken(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows with ``times``, how often each is taken."""
    here = F.struct("rank", "pick")
    low = (F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & F.coalesce(here <= F.col("cut"), F.lit(False)))
    # no last bucket: the words are reached by no bucket, so all of them are needed
    once = F.col("rank").isNotNull() & (F.coalesce(low, F.col("last_bucket").isNull()) | F.coalesce(F.col("pick") == F.col("extra"), F.lit(False)))
    return _ranked(rows, plans).withColumn("times", F.col("copies") + F.when(once, 1).otherwise(0))


def _prepared(docs: DataFrame, scratch: Scratch, id_col: str, source_col: str, text_col: str, weight_col: str | None, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """A row per document, without its text, and the keys that repeat (None if there are none)."""
    only(docs, id_col, source_col, text_col, *([weight_col] if weight_col else []))
    own = [F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")]
    sized = scratch.table(docs.select(F.col(f"`{id_col}`").alias("id"), *_keys(docs, id_col, source_col, text_col, weight_col), *own))
    repeated = scratch.table(sized.groupBy("key").count().where("count > 1").select("key"))
    if not repeated.limit(1).count():
        return _picked(sized.withColumn("k", F.lit(0).cast("long")), seed), None
    return _picked(scratch.table(_numbered(sized, repeated)), seed), repeated


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows, _ = _prepared(docs, scratch, id_col, source_col, text_col, weight_col, seed)
    out = _taken(rows, plan(rows, scratch, weights, share, ceiling))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def apply(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight_col: str | None = None,
) -> DataFrame:
    """The mix itself: rows of ``docs`` with their columns, each as many times as it is taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows, repeated = _prepared(docs, scratch, id_col, source_col, text_col, weight_col, seed)
    plans = plan(rows, scratch, weights, share, ceiling)
    whole = free_name("row", docs.columns)
    # an explode of one element: what reads a text is computed once, however often the plan refers to it
    own = F.explode(F.array(F.struct(*_keys(docs, id_col, source_col, text_col, weight_col)))).alias("own")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), own).select(whole, "own.*")
    if repeated is not None:
        # rows that agree in all columns are one row, taken as often as all of them together
        many = _taken(rows.join(repeated, "key", "left_semi"), plans).groupBy("key", "rest").agg(F.sum("times").alias("times"))
        many = scratch.table(many.where("times > 0"))
        first = keyed.join(repeated, "key", "left_semi").groupBy("key", "rest").agg(F.first(whole).alias(whole))
        many = first.join(many, ["key", "rest"]).select(whole, "times")
        keyed = keyed.join(repeated, "key", "left_anti")
    out = _taken(_picked(keyed.withColumn("k", F.lit(0).cast("long")), seed), plans).where("times > 0").select(whole, "times")
    if repeated is not None:
        out = out.unionByName(many)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(f"{whole}.*")
