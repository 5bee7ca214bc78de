"""Parts of a table written anew."""

import os

import pytest
from halyard.sources import versions
from pyspark.sql import functions as F

NAMES = {"complex_": "id", "scale": "s", "order": "k", "elements": "e", "xyz": "x", "target": "t"}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    pair, far = [[0.0, 0.0, 0.0], [1.4, 0.0, 0.0], [9.0, 0.0, 0.0]], [[0.0, 0.0, 0.0], [1.5, 0.0, 0.0], [9.0, 0.0, 0.0]]
    rows = [(1, 0, 5, ["C", "C", "C"], pair, far), (1, 0, 9, ["C", "C", "C"], far, far), (1, 1, 0, ["C", "C", "C"], far, pair), (2, 1, 1, ["C", "C", "C"], pair, far), (3, 0, 1, [], [], []), (4, 0, 1, None, pair, far)]
    records = spark.createDataFrame(rows, "id int, s int, k int, e array<string>, x array<array<double>>, t array<array<double>>")
    old = spark.createDataFrame([(1, 7, 8, 0.5)], "complex int, i int, j int, length double")
    path = f"file://{tmp_path}/table"
    assert versions.write({"records": records, "edges": old}, path) == 1
    return path, str(tmp_path / "table")


def test_edges_are_rebuilt(spark, table):
    path, folder = table
    before = files(folder)
    assert versions.rebuild_edges(spark, path, **NAMES) == 2
    assert [tuple(r) for r in versions.read(spark, path, "edges").collect()] == [(1, 0, 1, 1.5)]
    assert [tuple(r) for r in versions.read(spark, path, "counts").collect()] == [(1, 1)]
    assert before <= files(folder) and versions.manifest(spark, path)["records"] == versions.manifest(spark, path, 1)["records"]
    assert [tuple(r) for r in versions.read(spark, path, "edges", 1).collect()] == [(1, 7, 8, 0.5)] and versions.read(spark, path, "records").count() == 6
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path, "edges", 9)


def test_a_failed_rewrite_leaves_the_old_version(spark, table):
    path, folder = table
    bad = versions.read(spark, path, "edges").withColumn("length", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        versions.write({"edges": bad}, path)
    assert versions.versions(spark, path) == [1] and versions.read(spark, path, "edges").first().j == 8


def test_two_writers(spark, table, monkeypatch):
    path, _ = table
    edges = versions.read(spark, path, "edges")
    monkeypatch.setattr(versions, "versions", lambda s, p, known=versions.versions(spark, path): known)
    assert versions.write({"edges": edges}, path) == 2
    with pytest.raises(RuntimeError, match="another"):
        versions.write({"edges": edges}, path)


def test_nothing_there(spark, tmp_path):
    assert versions.versions(spark, f"file://{tmp_path}/none") == []
    with pytest.raises(ValueError, match="no version"):
        versions.manifest(spark, f"file://{tmp_path}/none")
