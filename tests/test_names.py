"""Columns of the caller that are called as an operator's own."""

import pytest
from halyard.operators import corpora, evaluation, relational
from halyard.sources import tables
from pyspark.sql import functions as F

OWN = ["_part", "_before", "_inside", "_sum", "_native", "_one", "_n", "_e", "_base", "_d", "_last", "_least", "_own", "_place", "_g", "_u", "_kept", "_y", "_known", "_mark", "_seen", "_shift", "_size", "_bond", "_top", "_v", "_c", "_total"]
BEFORE = ["before", "position"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(30).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 5).cast("double").alias("x"), *(F.lit(c).alias(c) for c in OWN + BEFORE))


CASES = {
    "native_groups": lambda d: corpora.native_groups(d, ["id"], "x"),
    "prefix": lambda d: relational.global_prefix(d, ["id"], "x", "run"),
    "place": lambda d: relational.global_position(d, ["id"], "at"),
    "as_of": lambda d: relational.as_of(d, "id", F.col("x") == 0),
    "capped": lambda d: relational.capped(d, ["k"], ["id"], 5),
    "pareto": lambda d: relational.pareto(d, ["id", "x"]),
    "counted_split": lambda d: relational.counted_split(d, "k", 0.5),
    "sized_split": lambda d: relational.sized_split(d, "k", 0.5),
    "constrained_fill": lambda d: relational.constrained_fill(d, ["k"], ["id"], F.col("x") > 1, 4),
    "balanced": lambda d: relational.classes_balanced(d, ["k"]),
    "softmax": lambda d: evaluation.group_softmax(d, ["k"], "x"),
    "shards": lambda d: tables.shard_by_size(d, ["id"], "x", 7),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_columns_stay(df, name):
    out = CASES[name](df)
    assert set(df.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert rows and all(r[c] == c for r in rows for c in OWN + BEFORE)


def test_keys_with_such_names(df):
    q = relational.quantiles(df.withColumn("prob_", F.col("k")), ["_v", "_c", "k"], "x", [0.5])
    assert sorted(r.k for r in q.collect()) == [0, 1, 2] and {"_v", "_c", "k", "prob", "q"} == set(q.columns)
    with pytest.raises(ValueError, match="prob"):
        relational.quantiles(df.withColumn("prob", F.col("k")), ["prob"], "x", [0.5])
    assert relational.quantiles(df.withColumn("prob", F.col("k")), ["prob"], "x", [0.5], prob="p").count() == 3


def test_paired_values_with_such_names(df):
    values = df.select(F.col("id").alias("unit"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("method"), F.rand(1).alias("value"), *OWN)
    assert evaluation.pairwise(values, "a").first().n == 30
    assert evaluation.paired_bootstrap(values, "a").first().n == 30
    assert evaluation.signed_ranks(values, "a").first().n == 30


def test_what_would_be_replaced_is_an_error(df):
    with pytest.raises(ValueError, match="before"):
        relational.global_prefix(df, ["id"], "x")
    with pytest.raises(ValueError, match="grp"):
        corpora.native_groups(df.withColumn("grp", F.lit(1)), ["id"], "x")


def test_cached_tokens_of_requests_called_as_the_cache(spark):
    requests = spark.createDataFrame([(1, "s", ["a", "b"]), (2, "s", ["a", "z"]), (3, "t", [])], "token long, residue string, residues array<string>")
    cache = spark.createDataFrame([("s", "a", 10), ("s", "b", 20)], "residue_of string, residue string, token int").withColumnRenamed("residue_of", "structure")
    got = corpora.cached_tokens(requests.withColumn("structure", F.col("residue")), cache, "token", "structure", "residues")
    assert {r["token"]: r.tokens for r in got.collect()} == {1: [10, 20], 2: None, 3: None}
