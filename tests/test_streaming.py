from pyspark.sql import functions as F

from terrasample.streaming.hits import running_totals


def test_windows_add_up(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("ts"), F.col("id").cast("double").alias("y"), F.lit(2.0).alias("expected_hits"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    last = spark.table("totals").groupBy("start").agg(F.max("n_hits").alias("n"), F.max_by("total", "n_hits").alias("t"))
    got = last.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    batch = running_totals(rows).agg(F.sum("n_hits"), F.sum("total")).first()
    assert batch[0] == 200 and batch[1] == sum(range(200)) / 2 and got["n"] <= 200
