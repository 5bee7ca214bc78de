"""Streams over folders of files: windowed statistics, running statistics, deduplication. Each runs to the end of
what is there (available-now) and leaves its result in the shared folder; a stream that stays on only needs another trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from halyard import storage


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the Parquet file or files at path as they come; ts, where it has no zone, is taken as UTC."""
    schema = spark.read.parquet(path).schema
    reader, at = spark.readStream.schema(schema), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream watches a folder
        rows = reader.option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def finish(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs the stream over all there is. Complete results replace each other; appended ones add up, once each."""
    spark = stream.sparkSession
    out, state = storage.new_folder(spark, label), storage.new_folder(spark, f"{label}-state")
    writer: DataStreamWriter = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out).outputMode("append")
    else:
        writer = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_stats(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and population deviation of each key so far: the state is merged, never the rows."""
    stats = stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return finish(stats, "complete", "running-stats")


def windowed(stream: DataFrame, keys: list[str], value: str, length: str, late: str) -> DataFrame:
    """Count and mean by window of event time, of all windows: a run that ends has to give out those that the watermark, late behind the
    newest time, has not passed too. Complete results keep every window, so no row is too late."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return finish(w.select(F.col("window.start").alias("start"), *keys, "n", "mean"), "complete", "windowed")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as they are seen first."""
    return finish(stream.select(*keys).dropDuplicates(keys), "append", "deduplicated")
