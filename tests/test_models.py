"""Model-side operators."""

import numpy as np
import pandas as pd
import pytest
from halyard.operators import models
from halyard.operators import relational
from pyspark.sql import functions as F


def test_schedule_and_orders():
    left = [models.remaining(k, 5, 20) for k in range(5)]
    assert left == sorted(left, reverse=True) and left[-1] == 0
    c, p = np.array([0.9, 0.1, 0.5]), np.array([3, 4, 5])
    assert models.refine_order(c, p, 0.34).tolist() == [4] and models.refine_order(c, p, 0.34, "late_first").tolist() == [5]
    assert models.refine_order(c, p, 0.34, "clash", np.array([2, 0, 0])).tolist() == [3]
    with pytest.raises(ValueError, match="order"):
        models.refine_order(c, p, 0.5, "x")


def test_sweep():
    assert models.sweep(["a=1,2", "b=x"], "run {a} {b}") == ["run 1 x", "run 2 x"]
    for specs, template in ((["a=1,1"], "{a}"), (["a=1", "a=2"], "{a}"), (["a=1"], "none"), ([], "{a}"), (["a=" + ",".join(map(str, range(99)))], "{a}")):
        with pytest.raises(ValueError, match="axis|differ|commands"):
            models.sweep(specs, template)


def test_runner_keeps_errors(spark):
    samples = spark.createDataFrame([(1, 2.0), (2, 3.0)], "sid long, x double")

    def bad(pdf: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("broken")

    got = models.run_models(samples, {"ok": lambda p: p.assign(y=p["x"] * 2)[["sid", "y"]], "bad": bad}, "sid long, y double", "sid").collect()
    assert {(r.model, r.sid, r.y) for r in got if r.error is None} == {("ok", 1, 4.0), ("ok", 2, 6.0)}
    assert {(r.sid, r.error) for r in got if r.model == "bad"} == {(1, "RuntimeError: broken"), (2, "RuntimeError: broken")}
    with pytest.raises(ValueError, match="no score for"):
        models.check_coverage(samples.where("sid = 1"), samples, "sid")


def test_dead_codes_restart(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0])], "code long, v array<double>")
    old = spark.createDataFrame([(0, 1.0, [0.0, 0.0]), (1, 0.05, [9.0, 9.0])], "code long, size double, sums array<double>")
    got = {r.code: r for r in models.codebook_step(v, "v", "code", old, decay=0.5).collect()}
    assert got[1].restarted and got[1].centre in ([1.0, 2.0], [3.0, 4.0]) and not got[0].restarted and got[0].size == 1.5


def test_budget():
    assert models.WorkBudget(-1).spent() and not models.WorkBudget(60).spent()


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(k % 3, k, f"v{k}", "keep") for k in range(12)], "g long, o long, v string, _n string")
    out = relational.first_wins(df, ["g"], ["o"])
    assert out.columns == df.columns and {r._n for r in out.collect()} == {"keep"} and out.count() == 3
    clash = df.withColumnsRenamed({"_n": "_part", "v": "_before"})
    got = relational.global_position(clash, ["o"]).orderBy("o").collect()
    assert [r.position for r in got] == list(range(12)) and got[5]._part == "keep" and got[5]._before == "v5"
    assert relational.capped(df.withColumnRenamed("_n", "_kept"), ["g"], ["o"], 2).count() == 6


def test_as_of_of_the_whole_table(spark):
    df = spark.createDataFrame([(k, k % 7 == 3) for k in range(100)], "o long, s boolean").repartition(5)
    got = {r.o: r.start for r in relational.as_of(df, "o", F.col("s")).collect()}
    assert got == {k: max([j for j in range(k + 1) if j % 7 == 3], default=0) for k in range(100)}


def test_quantiles(spark):
    import numpy as np

    values = {"a": [3.0, 1.0, 1.0, 8.0, 2.5], "b": [5.0], "c": list(range(40))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double").repartition(4)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.k, r.prob): r.q for r in relational.quantiles(df, ["k"], "v", probs).collect()}
    assert got.keys() == {(k, i) for k in values for i in range(5)}
    assert all(abs(got[k, i] - np.quantile(values[k], p)) < 1e-9 for k in values for i, p in enumerate(probs))


def test_listwise_loss_of_wide_spreads(spark):
    """Against the same in doubles of unlimited exponent: spreads of 2,000 neither vanish nor overflow."""
    from decimal import Decimal, getcontext

    getcontext().prec = 50
    groups = {0: [(-2, 1), (900, 2)], 1: [(0.5, -900), (0.25, 900)], 2: [(-1000, 1000), (1000, -1000), (3, 4)], 3: [(5, 5)], 4: [(1, 1), (1, 1)]}
    df = spark.createDataFrame([(g, float(p), float(t), "x", 1.0) for g, rows in groups.items() for p, t in rows], "g int, p double, t double, _top string, _l1 double")
    for r in models.group_losses(df, ["g"], "p", "t").collect():
        rows = groups[r.g]
        e = lambda k: [Decimal(-x[k]).exp() for x in rows]  # noqa: B023, E731
        want = -sum(q / sum(e(1)) * (p / sum(e(0))).ln() for p, q in zip(e(0), e(1), strict=True)) if len(rows) > 1 else None
        assert (r.listwise is None) == (want is None) and (want is None or abs(r.listwise - float(want)) < 1e-6 * (1 + abs(float(want)))), r
