"""The numeric band join against all pairs, and against its SQL."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from halyard.llm import bands

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, p long, u long, rank string"
ITEMS = "item_id long, price double, u long, shard string"


def cents(x):
    return math.floor(100 * x + 0.5) if x is not None and abs(x) <= bands.LARGEST else None


def plain(lines, items, k=5):
    points = []
    for sale, line, item, quantity, amount, *_ in lines:
        a = cents(amount)
        if None not in (sale, item, quantity, a) and quantity:
            said = f"{sale},{'' if line is None else line},{item}"
            points.append(((2 * a + quantity) // (2 * quantity), sale, -math.inf if line is None else line, item, zlib.crc32(said.encode())))
    out = []
    for item, price, *_ in items:
        p = cents(price)
        found = sorted((abs(u - p), u, s, n, i, c) for u, s, n, i, c in points if i != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p)) if None not in (item, p) else []
        sums = (len(found), sum(f[0] for f in found), sum(f[5] for f in found))
        rows = [(item, r + 1, g, u, s, None if n == -math.inf else n, i, *sums) for r, (g, u, s, n, i, _) in enumerate(found[:k])]
        out += rows or [(item, 0, None, None, None, None, None, *sums)]
    return sorted(out, key=repr)


def shop(seed, n_lines, n_items, hot=True):
    rng = random.Random(seed)
    items = [(k, rng.choice([3.0, 3.07, 4.5, 250.25, 25_000.0, 400_000.5, 0.02, -0.01, -5.0])) for k in range(n_items)]
    items += [items[0], items[1], (2, 3.01), (None, 3.0), (n_items, None), (n_items + 1, math.nan), (n_items + 2, 1e17), (n_items + 3, 3.0)]
    lines = []
    for _ in range(n_lines):
        item = rng.choice([0, 1, 2, 3]) if hot and rng.random() < 0.4 else rng.randrange(n_items)
        price = 3.0 if hot and rng.random() < 0.3 else items[item][1] + rng.choice([0, 0, 0.01, -0.02, 0.1, -0.1, 0.13, 3, -50, 490])
        quantity = rng.choice([1, 1, 2, 3, 7, -2])
        lines.append((rng.randrange(30), rng.choice([1, 2, None]), item, quantity, price * quantity + rng.choice([0, 0.01])))
    lines += lines[:20] * 3 + [(None, 1, 1, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 1, None, 3.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 3.0), (1, 1, 1, 1, math.inf), (1, 1, 1, 1, 1e300), (1, 1, 1, 1, math.nan)]
    return [(*x, 7, 8, "r") for x in lines], [(*x, 9, "s") for x in items]


def frames(spark, lines, items):
    return spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("gather", [1 << 18, 16])
def test_all_pairs(spark, monkeypatch, gather):
    monkeypatch.setattr(bands, "GATHER", gather)
    lines, items = shop(gather, 700, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = bands.near_prices(*frames(spark, lines, items))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(lines, items)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sql(spark, tmp_path):
    lines, items = shop(3, 400, 40)
    for name, df in zip(("sale_lines", "items"), frames(spark, lines, items), strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("sale_lines", "items"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute(bands.SQL)
    df = bands.op12_segment_tree_band_join(spark, str(tmp_path))
    assert [d[0] for d in con.description] == df.columns
    assert sorted(con.fetchall(), key=repr) == sorted(map(tuple, df.collect()), key=repr) == plain(lines, items)


def test_nothing(spark):
    lines, items = shop(1, 5, 4)
    assert bands.near_prices(*frames(spark, lines, [])).count() == 0
    assert [tuple(r)[1:] for r in bands.near_prices(*frames(spark, [], items)).collect()] == [(0, None, None, None, None, None, 0, 0, 0)] * len(items)


def test_walks_are_the_intervals():
    """Every interval of a tree, from either end, with an item that holds most of the points."""
    rng = np.random.default_rng(2)
    u = np.sort(rng.choice(10**6, 37, replace=False))
    points = [(int(at), int(i)) for at in range(len(u)) for i in rng.choice([1, 1, 1, 1, 2, 3], rng.integers(1, 12))]
    kept = bands.diversified(*np.array([(u[a], i, n, 0) for n, (a, i) in enumerate(points)]).T, 3)
    at, item = (np.array([points[n][k] for n in kept]) for k in (0, 1))
    n = np.array([sum(a == x for a, _ in points) for x in range(len(u))])
    tree = bands.Tree(u, n, n * 5, at, item, 3)
    low, high = map(np.array, zip(*((a, b) for a in range(len(u) + 1) for b in range(a, len(u) + 1)), strict=True))
    for upwards in (True, False):
        sums, lists = tree.ask(low, high, upwards)
        for a, b, s, found in zip(low, high, sums.T, lists, strict=True):
            assert tuple(s) == (n[a:b].sum(), (n * u)[a:b].sum(), 5 * n[a:b].sum())
            order = [x for v in (range(a, b) if upwards else range(b - 1, a - 1, -1)) for x in np.flatnonzero(at == v)]
            for without in (0, 1, 2, 3):
                want = [x for x in order if item[x] != without][:3]
                assert [x for x in found if x >= 0 and item[x] != without][:3] == want


def test_shards_are_disjoint(spark):
    values = sorted({s * (2**e + d) for e in range(62) for d in (-1, 0, 1, 2**e // 3) for s in (1, -1)} | set(range(-600, 600)))
    got = spark.createDataFrame([(v,) for v in values], "u long").select("u", bands.shard("u").alias("s")).orderBy("u").collect()
    starts = [r.s for r in got]
    assert all(r.s <= r.u < r.s + 2**bands.WIDE for r in got) and starts == sorted(starts)
    again = spark.createDataFrame([(s,) for s in starts], "u long").select("u", bands.shard("u").alias("s")).collect()
    assert all(r.u == r.s for r in again)
