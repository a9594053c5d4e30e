from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.sources.writers import ProgressFile, write_batch_once
from corpuslab.streaming import latency


def events(spark):
    e = spark.range(400).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 97).alias("ts"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("event_type"), (F.col("id") * 1.5 % 40).alias("value"))
    return e


def stream(spark, path, df, files):
    """Files are read in the order in which they were written, one a batch."""
    numbered = df.withColumn("_n", F.ntile(files).over(Window.orderBy("ts")))
    for i in range(files):
        numbered.where(F.col("_n") == i + 1).drop("_n").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name)


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    e = events(spark)
    last = e.unionByName(spark.sql("select 0L user_id, timestamp_seconds(1800000000) ts, 'end' event_type, 0.0D value"))
    got = run(spark, latency.latency_windows(stream(spark, str(tmp_path / "e"), last, 4)), "w").where("event_type <> 'end'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latency.latency_windows(e).collect()))


def test_keep_first_of_a_stream(spark, tmp_path):
    e = events(spark).withColumn("line", (F.col("value") % 5).cast("string"))
    got = run(spark, latency.keep_first_stream(stream(spark, str(tmp_path / "e"), e, 3), "line", "ts", "10 days"), "d")
    assert got.count() == e.select("line").distinct().count()


def test_prefixes_of_a_session(spark, tmp_path):
    keys = spark.createDataFrame([("s", 1, "ni"), ("s", 2, "nih"), ("s", 3, "nx"), ("t", 1, "a")], "session string, at int, text string")
    keys.coalesce(1).write.parquet(str(tmp_path / "k"))
    df = spark.readStream.schema(keys.schema).parquet(str(tmp_path / "k"))
    got = run(spark, latency.shared_prefixes(df, "session", "at", "text", None), "p", "append")
    assert sorted(map(tuple, got.collect())) == [("s", 1, 0), ("s", 2, 2), ("s", 3, 1), ("t", 1, 0)]


def test_batches_and_progress(spark, tmp_path):
    e = events(spark)
    listener = ProgressFile(str(tmp_path / "progress.json"))
    spark.streams.addListener(listener)
    q = stream(spark, str(tmp_path / "e"), e, 2).writeStream.foreachBatch(write_batch_once(str(tmp_path / "out"))).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
