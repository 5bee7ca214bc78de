"""Tables cut into buckets."""

from halyard import storage
from pyspark.sql import functions as F


def test_buckets_are_bounded_and_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", 4)
    try:
        df = storage.cut_in_buckets(spark.range(100).withColumn("k", F.col("id") % 7), "t", "k", 1_000_000)
        assert {t.name for t in spark.catalog.listTables()} == before
        plan = df.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "4 out of 4" in plan
        assert sorted(map(tuple, df.groupBy("k").count().collect())) == [(k, 15 if k < 2 else 14) for k in range(7)] and df.count() == 100
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
