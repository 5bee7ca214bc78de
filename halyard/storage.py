"""The shared folder of a cluster, and lineage cuts in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group that a writing task holds.
GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where none is named and all runs in one process, as in
    tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="halyard-shared-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of the shared store through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, uri: str) -> None:
    try:
        remove(spark, uri)
    except Exception:  # the JVM may be gone before the interpreter
        return


def new_folder(spark: SparkSession, label: str) -> str:
    uri = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, uri)
    return uri


def discard(df: DataFrame) -> None:
    """Deletes the folders of a table of cut() that nothing reads any more, as a pass's once the next one is written."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: short lineage, true sizes for the planner, nothing lost with an executor."""
    spark = df.sparkSession
    uri = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def cut_in_buckets(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """cut(), with the rows of a key in one of the buckets: what groups or joins by the key reads them in place, without an exchange. No
    more buckets than Spark allows are made; the table is in the session's catalog while it is written only."""
    spark = df.sparkSession
    uri = new_folder(spark, label)
    name = uri.rsplit("/", 1)[1].replace("-", "_")
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    try:
        df.write.format("parquet").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("path", uri).bucketBy(min(buckets, most), key).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"drop table if exists `{name}`")  # its files stay: the table is one of a path
