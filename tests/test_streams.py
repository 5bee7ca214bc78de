"""Streams against the same batch query."""

from halyard.streaming import running
from pyspark.sql import functions as F


def test_windows_are_those_of_the_batch_query(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k // 40} {k % 24:02d}:{k * 7 % 60:02d}:00", "ab"[k % 2], float(k)) for k in range(80)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.to_timestamp_ntz("ts")).repartition(3).write.parquet(path)
    want = spark.read.parquet(path).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    got = running.windowed(running.read_stream(spark, path), ["kind"], "value", "1 hour", "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
