"""Streaming queries, whose results are those of the same batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.plans.registry import Tables, query
from halyard.streaming import running


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from events group by 1")
def stream_norm_stats(t: Tables) -> DataFrame:
    stream = running.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return running.running_stats(stream, ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("select distinct user_id, event_type from events")
def stream_dedup(t: Tables) -> DataFrame:
    return running.deduplicated(running.read_stream(t.spark, f"{t.sf_dir}/events.parquet"), ["user_id", "event_type"])


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    return running.windowed(running.read_stream(t.spark, f"{t.sf_dir}/events.parquet"), ["event_type"], "value", "1 hour", "10 minutes").withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))
