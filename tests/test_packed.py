"""The flat format of packed tokens."""

import random
import struct

import pytest
from halyard.sources import packed
from pyspark.sql import functions as F


def flat(path, docs, labels=None, length="<H"):
    path.with_suffix(".bin").write_bytes(b"".join(struct.pack(f"<{len(d)}H", *d) for d in docs))
    path.with_suffix(".len").write_bytes(b"".join(struct.pack(length, len(d)) for d in docs))
    if labels:
        path.with_suffix(".lab").write_bytes(b"".join(map(bytes, labels)))


def corpus(seed, n):
    rng = random.Random(seed)
    return [[rng.randrange(65536) for _ in range(rng.choice([0, 0, 1, 3, 40, 700]))] for _ in range(n)]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_flat_files(spark, tmp_path, monkeypatch, block):
    """Files of many splits and of one, with empty documents; batches smaller than a split."""
    monkeypatch.setattr(packed, "BLOCK", block)
    monkeypatch.setattr(packed, "BATCH", 2000)
    docs = {name: corpus(k, n) for k, (name, n) in enumerate({"a": 50, "b": 1, "c": 0, "d": 7}.items())}
    for name, own in docs.items():
        flat(tmp_path / name, own, [[t % 2 for t in d] for d in own])
    (tmp_path / "c.lab").write_bytes(b"")
    got = packed.read_packed(spark, str(tmp_path), streams={"lab": "u1"})
    rows = {(r.name.rsplit("/", 1)[1], r.doc): r for r in got.collect()}
    assert {k: r.tokens for k, r in rows.items()} == {(n, k): d for n, own in docs.items() for k, d in enumerate(own)}
    assert all(r.lab == [t % 2 for t in r.tokens] for r in rows.values())
    alone = packed.read_packed(spark, f"{tmp_path}/a.len").orderBy("doc").collect()
    assert [r.tokens for r in alone] == docs["a"]


def test_damage_is_an_error(spark, tmp_path):
    docs = corpus(5, 20)
    flat(tmp_path / "a", docs, [[1] * len(d) for d in docs])
    whole, lengths = (tmp_path / "a.bin").read_bytes(), (tmp_path / "a.len").read_bytes()
    (tmp_path / "a.bin").write_bytes(whole[:-2])
    with pytest.raises(ValueError, match="lengths ask for"):
        packed.read_packed(spark, str(tmp_path))
    (tmp_path / "a.bin").write_bytes(whole)
    (tmp_path / "a.len").write_bytes(lengths[:-1])
    with pytest.raises(Exception, match="whole number"):
        packed.read_packed(spark, str(tmp_path)).count()
    (tmp_path / "a.len").write_bytes(lengths)
    (tmp_path / "a.lab").write_bytes(b"x")
    with pytest.raises(ValueError, match="a.lab has 1 bytes"):
        packed.read_packed(spark, str(tmp_path), streams={"lab": "u1"})
    assert packed.read_packed(spark, str(tmp_path)).count() == 20


def test_round_trip(spark, tmp_path):
    rows = [(k, d, [t % 3 for t in d], "c") for k, d in enumerate(corpus(9, 60))]
    df = spark.createDataFrame(rows, "id int, tokens array<int>, role array<int>, _part string").repartition(5)
    done = packed.write_packed(df, str(tmp_path / "out"), ["id"], lengths="<u4", streams={"role": "u1"})
    assert done.agg(F.sum("docs"), F.sum("tokens"), F.max("longest")).first()[:] == (60, sum(len(r[1]) for r in rows), max(len(r[1]) for r in rows))
    back = packed.read_packed(spark, str(tmp_path / "out"), lengths="<u4", streams={"role": "u1"}).orderBy("name", "doc").collect()
    assert [(r.tokens, r.role) for r in back] == [(r[1], r[2]) for r in rows]
    assert not list((tmp_path / "out").glob("*.part"))
    for bad, match in ((df.withColumn("role", F.array(F.lit(1))), "another length"), (df.withColumn("tokens", F.transform("tokens", lambda t: t + 65536)), "don't fit")):
        with pytest.raises(Exception, match=match):
            packed.write_packed(bad, str(tmp_path / "bad"), ["id"], streams={"role": "u1"})
    with pytest.raises(Exception, match="don't fit"):
        packed.write_packed(spark.createDataFrame([(1, [0] * 70_000)], "id int, tokens array<int>"), str(tmp_path / "long"), ["id"])
    assert packed.write_packed(df.limit(0), str(tmp_path / "none"), ["id"], streams={"role": "u1"}).count() == 0
