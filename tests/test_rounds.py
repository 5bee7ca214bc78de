"""Rounds over a table against a plain loop."""

import math

import pytest
from halyard.functions import sequences
from halyard.operators import models, rounds
from halyard.plans import corpus
from pyspark.sql import functions as F

MASK = corpus.MASK


def ask(codes):
    at = lambda i: codes[i] if 0 <= i < len(codes) else 0
    best = [(at(i - 1) * 31 + at(i + 1) * 17 + i * 7) % 500 for i in range(len(codes))]
    belief = [(((b if c == MASK else c) * 37 + at(i - 1) * 5 + i * 11) % 101) / 101 for i, (c, b) in enumerate(zip(codes, best, strict=True))]
    return best, belief


def loop_filled(codes, n_rounds):
    codes, n = list(codes), codes.count(MASK)
    for k in range(n_rounds):
        best, belief = ask(codes)
        open_ = sorted((-belief[i], i) for i, c in enumerate(codes) if c == MASK)
        for _, i in open_[: len(open_) - models.remaining(k, n_rounds, n)]:
            codes[i] = best[i]
    return codes


def loop_refined(codes, n_rounds, share, order):
    codes = list(codes)
    count = max(1, round(share * len(codes)))
    for k in range(n_rounds):
        if order == "late_first":
            here = [i for i in range(len(codes)) if len(codes) - (k + 1) * count <= i < len(codes) - k * count]
        elif order == "clash":
            here = [i for c, i in sorted((-c, i) for i, c in enumerate(codes) if c > 250)][:count]
        else:
            here = [i for _, i in sorted((b, i) for i, b in enumerate(ask(codes)[1]))][:count]
        hidden = [MASK if i in here else c for i, c in enumerate(codes)]
        best, _ = ask(hidden)
        codes = [best[i] if i in here else c for i, c in enumerate(hidden)]
    return codes


@pytest.fixture(scope="module")
def rows():
    own = [(k, [(k * 97 + i * i * 31) % 500 for i in range(k % 13)], "c") for k in range(40)]
    return [*own, (100, None, "c"), (101, [MASK] * 9, "c"), (102, [7] * 6, "c")]


SCHEMA = "id long, codes array<int>, best string"


def clashing(df):
    return df.select("key", F.transform("codes", lambda c: F.greatest(c - 250, F.lit(0))).alias("clash"))


@pytest.mark.parametrize("n_rounds", [1, 5])
def test_filling(spark, rows, n_rounds):
    given = [(k, None if c is None else [x if i % 3 == 0 and k != 20 else MASK for i, x in enumerate(c)], b) for k, c, b in rows]
    got = {r.id: r.codes for r in rounds.filled(spark.createDataFrame(given, SCHEMA), corpus.neighbour_model, "id", MASK, n_rounds).collect()}
    assert got == {k: None if c is None else loop_filled(c, n_rounds) for k, c, _ in given}
    assert all(MASK not in c for c in got.values() if c)


@pytest.mark.parametrize("order", ["confidence", "late_first", "clash"])
def test_refining(spark, rows, order):
    df = spark.createDataFrame(rows, SCHEMA)
    got = rounds.refined(df, corpus.neighbour_model, "id", MASK, 3, 0.25, order, clashing if order == "clash" else None)
    assert got.columns == ["id", "codes"]
    assert {r.id: r.codes for r in got.collect()} == {k: None if c is None else loop_refined(c, 3, 0.25, order) for k, c, _ in rows}
    with pytest.raises(ValueError, match="order"):
        rounds.refined(df, corpus.neighbour_model, "id", MASK, order="x")


def test_lost_answers_are_an_error(spark, rows):
    with pytest.raises(Exception, match="no answer"):
        rounds.filled(spark.createDataFrame(rows, SCHEMA), lambda d: corpus.neighbour_model(d).where("key <> 5"), "id", MASK, 2)


def test_schedule_is_the_cosines(spark):
    for n_rounds in (1, 4, 9):
        for k in range(n_rounds):
            got = spark.range(40).select("id", rounds.masked_left(k, n_rounds, F.col("id")).alias("m")).collect()
            assert [r.m for r in got] == [models.remaining(k, n_rounds, r.id) for r in got], math.cos(1)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_resampling_draws_exactly_so_many(spark, rows, share):
    df = spark.createDataFrame(rows, SCHEMA).select("id", "codes", sequences.resampled(F.col("codes"), share, 10_000_000, 3, F.col("id")).alias("new"))
    first = {r.id: (r.codes, r.new) for r in df.collect()}
    assert first == {r.id: (r.codes, r.new) for r in df.repartition(5).collect()}
    for codes, new in first.values():
        assert (codes is None) == (new is None)
        if codes:
            assert sum(a != b for a, b in zip(codes, new, strict=True)) == round(share * len(codes))
