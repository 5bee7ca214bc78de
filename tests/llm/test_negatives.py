"""Hard negatives against all pairs, and against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from halyard.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, vector array<bigint>, id string, v int, dim int, most int, block string"


def plain(rows, is_anchor, p=5, n=3):
    sound = {}
    for i, label, v, *_ in rows:
        if None not in (i, label) and v and None not in v and sum(float(x) ** 2 for x in v) < 2**62:
            sound[i, len(v)] = min(sound.get((i, len(v)), (label, v)), (label, v))
    out = []
    for (a, dim), (label, v) in sound.items():
        if not is_anchor(a):
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab == label) for (i, d), (lab, w) in sound.items() if i != a and d == dim)
        for score, i, _ in [o for o in others if o[2]][:p]:
            found = [o for o in others if not o[2] and 50 * -score <= 100 * -o[0] <= 95 * -score][:n]
            out += [(a, i, r + 1, o[1], -score, -o[0]) for r, o in enumerate(found)]
    return sorted(out)


def rows_of(seed, n, scale, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        rows.append((k, rng.randrange(3), [int(scale * (x + rng.gauss(0, 0.3))) for x in c]))
    rows += [(n + k, k % 3, rows[4][2]) for k in range(150)]  # a third has one vector
    rows += [rows[4], rows[4], (4, 0, [9] * dim), (None, 1, [1] * dim), (n + 900, None, [1] * dim), (n + 901, 1, None), (n + 902, 1, []), (n + 903, 1, [1] * (dim - 1) + [None]), (n + 904, 1, [2**31] * dim)]
    rows += [(k, k % 2, [k % 7, -k % 5, 3]) for k in range(2000, 2040)] + [(n + 905, 1, [0] * dim), (n + 906, 2, [-x for x in rows[4][2]])]
    return [(*r, "x", 1, 2, 3, "b") for r in rows]


@pytest.mark.parametrize(("scale", "blocks"), [(256, (8192, 32768)), (1000, (64, 7)), (3 << 26, (100, 32768))])
def test_all_pairs(spark, monkeypatch, scale, blocks):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(negatives.VantageTree.__init__, "__defaults__", (8,))
    rows = rows_of(scale, 300, scale)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 4 == 0, block_rows=blocks[0], anchor_rows=blocks[1])
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 4 == 0)


def test_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame(rows_of(1, 9, 10), SCHEMA), F.lit(False)).count() == 0


def test_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(0, 10)), rng.normal(0, 0.1, 8).tolist()) for k in range(300)]
    rows += [(None, 1, [0.5] * 8), (300, None, [0.5] * 8), (301, 1, None), (302, 1, [float("nan")] + [0.1] * 7), (303, 1, [float("inf")] + [0.1] * 7), (304, 1, [None] + [0.1] * 7), (305, 9, []), (350, 9, [0.1] * 3), (357, 0, [0.1] * 3), (358, 2, [0.08] * 3)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    con.execute(negatives.SQL)
    df = negatives.op13_vantage_point_negatives(spark, str(tmp_path))
    assert [d[0] for d in con.description] == df.columns
    want = sorted(con.fetchall())
    assert want == sorted(map(tuple, df.collect())) and len(want) > 50


def test_bounds_hold_and_prune():
    """On clustered vectors over half of the scores are never computed (0.37 are), and no bound is wrong."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 300, (40, 32))
    vectors = np.concatenate([c + rng.normal(0, 12, (200, 32)) for c in centres]).astype(np.int64)
    most = float((vectors * vectors).sum(1).max())
    tree = negatives.VantageTree(vectors, most, 64)
    filled = np.concatenate((vectors, np.sqrt(np.maximum(0, most - (vectors * vectors).sum(1)))[:, None]), axis=1)
    queries = vectors[::400].astype(float)
    low, high = tree.bounds(queries)
    for q, a, b in zip(queries, low, high, strict=True):
        d = np.sqrt(((filled - np.append(q, 0)) ** 2).sum(1))
        for leaf in range(len(a)):
            own = d[tree.order[tree.starts[leaf] : tree.starts[leaf + 1]]]
            assert a[leaf] <= own.min() and b[leaf] >= own.max()
    every = np.broadcast_to(np.array([[-(2**62), 2**62]]), (len(queries), 1, 2))
    rows, scores, met = tree.nearest(queries, low, high, every, 5, np.arange(len(vectors)), lambda q, rows: np.ones((len(q), len(rows)), bool))
    for q, r, s in zip(queries, rows[:, 0], scores[:, 0], strict=True):
        want = np.lexsort((np.arange(len(vectors)), -(vectors @ q)))[:5]
        assert r.tolist() == want.tolist() and s.tolist() == (vectors @ q)[want].astype(int).tolist()
    assert met < 0.5 * len(queries) * len(vectors), met / len(queries) / len(vectors)
