"""Sidecars, caches, label tables, indexes and sinks on small inputs."""

import json

import pytest
from halyard.operators import corpora, evaluation
from halyard.sources import indexes
from pyspark.sql import functions as F


def test_sidecars_must_fit(spark):
    df = spark.createDataFrame([(k, k * 2) for k in range(5)], "doc_id long, _mark long")
    side = df.select("doc_id", (F.col("doc_id") / 2).alias("teacher"))
    assert {r.doc_id: (r._mark, r.teacher) for r in corpora.with_sidecar(df, side, "doc_id").collect()} == {k: (2 * k, k / 2) for k in range(5)}
    for bad in (side.where("doc_id > 0"), side.union(side.limit(1)), side.where("doc_id < 0")):
        with pytest.raises(ValueError, match="teacher"):
            corpora.with_sidecar(df, bad, "doc_id")
    assert corpora.aligned([df, side, side.withColumnRenamed("teacher", "head")], "doc_id").columns == ["doc_id", "_mark", "teacher", "head"]


def test_group_fallback(spark):
    rmsd = [1.0, 0.0, 2.0, None, 0.0, 0.0, 3.0]
    df = spark.createDataFrame(list(enumerate(rmsd)), "n int, rmsd double").repartition(3)
    assert [r.grp for r in corpora.native_groups(df, ["n"], "rmsd").orderBy("n").collect()] == [0, 0, 0, 0, 1, 2, 2]


def test_cache_is_all_or_nothing(spark):
    cache = spark.createDataFrame([("s", k, 100 + k) for k in range(4)] + [("s", 2, 7), ("t", 0, 4095)], "struct string, residue int, token int")
    asked = spark.createDataFrame([(1, "s", [3, 0, 3]), (2, "s", [1, 9]), (3, "t", [0]), (4, "t", []), (5, "u", [0]), (6, "s", [2])], "id int, struct string, residues array<int>")
    got = {r.id: r.tokens for r in corpora.cached_tokens(asked, cache, "id", "struct", "residues").collect()}
    assert got == {1: [103, 100, 103], 2: None, 3: [4095], 4: None, 5: None, 6: [7]}


def test_sides(spark):
    df = spark.createDataFrame([([1, 2, 3], [True, False, None])], "t array<int>, m array<boolean>")
    assert [df.select(corpora.kept_side(F.col("t"), F.col("m"), s)).first()[0] for s in ("ligand", "pocket", "both")] == [[1], [2, 3], [1, 2, 3]]
    with pytest.raises(ValueError):
        corpora.kept_side(F.col("t"), F.col("m"), "left")


def test_beats_takes_all(spark):
    df = spark.createDataFrame([("ref", 1.0, 1.0), ("a", 2.0, 1.5), ("b", 2.0, 1.0), ("c", 3.0, None)], "m string, x double, y double")
    assert {r.m: r.beats for r in evaluation.beats(df, "m", "ref", ["x", "y"]).collect()} == {"a": True, "b": False, "c": False}
    assert {r.beats for r in evaluation.beats(df, "m", "none", ["x"]).collect()} == {False}


def test_labels_last_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pdb,kind,value\n1abc,Kd=,5.0\n2abc,Ki<,6.0\n3abc,IC50=,7.0\n")
    (tmp_path / "b.csv").write_text("pdb,kind,value\n1abc,Kd~,5.5\n1abc,Kd>,5.7\n4abc,Kd,\n")
    got = indexes.read_labels(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "pdb", "kind", "value", ["Kd", "Ki"])
    assert {r.pdb: r.value for r in got.collect()} == {"1abc": 5.7, "2abc": 6.0}


def test_indexes(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"id": i, "sdf": p} for i, p in (("c", "x/c.sdf"), ("a", "/abs/a.sdf"), ("b", None))]))
    read = lambda **k: [tuple(r) for r in indexes.read_index(spark, str(tmp_path / "index.json"), "id", "id string, sdf string", ["sdf"], **k).orderBy("id").collect()]
    assert read() == [("a", "/abs/a.sdf"), ("b", None), ("c", f"{tmp_path}/x/c.sdf")]
    assert [r[0] for r in read(ids=["c", "b"], limit=1)] == ["b"]
    (tmp_path / "summary_qm9.json").write_text(json.dumps({"CC": {"pickle_path": "a.pickle"}, "C": {"n": 3}}))
    assert [tuple(r) for r in indexes.read_summary(spark, str(tmp_path), ["qm9"], ["qm9", "drugs"]).collect()] == [("qm9", "CC", "a.pickle")]
    with pytest.raises(ValueError, match="toys"):
        indexes.read_summary(spark, str(tmp_path), ["toys"], ["qm9"])


def test_tables_as_text(spark):
    df = spark.createDataFrame([("a|b, c_d", 1.25, None)], "name string, x double, y int")
    assert indexes.table_text(df, "markdown") == "| name | x | y |\n| --- | --- | --- |\n| a\\|b, c_d | 1.25 |  |\n"
    assert indexes.table_text(df, "csv") == 'name,x,y\n"a|b, c_d",1.25,\n'
    assert "a|b, c\\_d & 1.25 & " in indexes.table_text(df, "latex")
    with pytest.raises(ValueError, match="rows"):
        indexes.table_text(df.union(df), "csv", 1)


def test_residue_tokens_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([(f"s{k % 5}", k, k) for k in range(50)], "struct string, residue int, token int").repartition(4)
    indexes.write_residue_tokens(df, str(tmp_path / "t"), "struct")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))


def test_paired_bootstrap_covers(spark):
    rows = [("ref", k, 0.0) for k in range(200)] + [("a", k, 1.0 + (k % 7 - 3) / 3) for k in range(200)]
    r = evaluation.paired_bootstrap(spark.createDataFrame(rows, "method string, unit int, value double"), "ref", 100).first()
    assert r.n == 200 and r.low < r.delta < r.high and 0.05 < r.high - r.low < 0.4


def test_signed_ranks_are_the_kernels(spark):
    import numpy as np
    from halyard.functions import statistics

    rng = np.random.RandomState(4)
    d = np.round(rng.normal(0.2, 1, 120), 1)
    rows = [("ref", k, 0.0) for k in range(120)] + [("a", k, float(x)) for k, x in enumerate(d)]
    r = evaluation.signed_ranks(spark.createDataFrame(rows, "method string, unit int, value double"), "ref").first()
    want = statistics.wilcoxon(d)
    assert r.n == 120 and r.w == want.statistic and r.n_nonzero == int((d != 0).sum())


def test_passages_in_documents(spark):
    docs = [(1, "a b c d e f g"), (2, "x b c d e f"), (3, None), (4, ""), (5, "b c d e z b c d e f q"), (6, "bc d e f"), (7, "a"), (8, "b  c d e f"), (8, "b c d e f")]
    passages = [(10, "b c d e f"), (11, "a"), (12, ""), (13, None), (14, "e f"), (15, "b  c"), (16, "a b c d e f g h")]
    got = corpora.passages_in(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(passages, "p int, words string"), "doc", "text", "p", "words").collect()
    want = {(d, p) for d, t in docs for p, w in passages if t is not None and w and f" {w} " in f" {t} "}
    assert sorted(map(tuple, got)) == sorted(want) and (5, 10) in want and (8, 15) in want
    none = spark.createDataFrame([], "p int, words string")
    assert corpora.passages_in(spark.createDataFrame(docs, "doc int, text string"), none, "doc", "text", "p", "words").count() == 0


def test_prefix_matches(spark):
    left = [(1, [1, 2, 3]), (2, [1, 2]), (3, [1]), (4, None), (5, [9, 9, 9]), (6, [1, 2, 3])]
    right = [(20, [1, 2, 3]), (10, [1, 2, 4]), (30, [1, 2]), (40, [1]), (50, None), (21, [1, 2, 3])]
    got = corpora.prefix_matches(spark.createDataFrame(left, "k int, c array<int>"), spark.createDataFrame(right, "k int, c array<int>"), "k", "c", 2).collect()
    assert sorted(map(tuple, got)) == [(1, 4, 10, 2), (2, 4, 10, 1), (5, 0, None, 0), (6, 4, 10, 2)]


def test_wilcoxon_of_a_table(spark):
    """Exact without ties or zeros, normal with them; nothing but zeros has no p."""
    import numpy as np
    from halyard.functions import statistics
    from halyard.operators import evaluation

    rng = np.random.default_rng(3)
    base = rng.normal(size=60)
    ways = {"exact": (base + rng.normal(0.3, 1, 60))[:30], "ties": (base + rng.choice([-1, 0, 1, 2], 60)), "many": base + rng.normal(0.2, 1, 60), "same": base[:5]}
    rows = [("ref", k, float(x)) for k, x in enumerate(base)] + [(m, k, float(x)) for m, v in ways.items() for k, x in enumerate(v)] + [("ties", 99, 1.0), ("many", 3, None)]
    got = {r.method: r for r in evaluation.pairwise_wilcoxon(spark.createDataFrame(rows, "method string, unit int, value double"), "ref").collect()}
    for m, v in ways.items():
        want = statistics.wilcoxon(np.round(v - base[: len(v)], 12))
        if m == "same":
            assert got[m].n_nonzero == 0 and np.isnan(got[m].p)
        elif m == "exact":
            assert got[m].p == want.pvalue and got[m].w == want.statistic
        else:
            assert abs(got[m].p - want.pvalue) < 0.02 and got[m].n == 60


def test_bootstrap_draws_once_a_unit(spark):
    """As many draws are hashed for five keys as for one, and by more tasks than a few bytes would get."""
    rows = [(k, u, float(u * k)) for k in range(5) for u in range(50)]
    r = evaluation.bootstrap(spark.createDataFrame(rows, "k int, unit int, value double"), ["k"], "unit", "value", 40)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "RepartitionByExpression" in plan
    got = {x.k: x for x in r.collect()}
    assert len(got) == 5 and all(x.n == 50 and x.low <= x.mean <= x.high for x in got.values())
