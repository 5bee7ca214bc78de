"""Members of archives by index, the structure resolver, and parts of manifests."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import pyarrow as pa
import pytest
from halyard.sources import archives, members, tables
from pyspark.sql import functions as F


def pack(path, names, mode="w", form=tarfile.GNU_FORMAT):
    with tarfile.open(path, mode, format=form) as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for n, data in names:
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """Archives of every form, with a name that comes twice, a long one, an empty member, and a damaged archive."""
    rng, root = random.Random(1), tmp_path_factory.mktemp("store")
    names = [(f"s{k}/receptor.pdb", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 40_000]))) for k in range(40)]
    names += [("s3/receptor.pdb", b"the later one"), ("ü/" + "long" * 60 + ".pdb", b"long"), ("plain.txt", b"caf\xe9 \xff")]
    pack(root / "a.tar", names)
    pack(root / "b.tar.gz", names, "w:gz")
    pack(root / "c.tar", names, form=tarfile.PAX_FORMAT)
    with zipfile.ZipFile(root / "d.zip", "w") as z:
        for k, (n, data) in enumerate(dict(names).items()):
            z.writestr(n, data, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    whole = (root / "a.tar").read_bytes()
    (root / "e.tar").write_bytes(whole[: len(whole) // 2])
    (root / "f.zip").write_bytes(b"broken")
    return str(root), dict(names)


def test_index(spark, store):
    root, names = store
    rows = members.read_index(spark, root).collect()
    for a in ("a.tar", "b.tar.gz", "c.tar", "d.zip"):
        own = {r.member: r for r in sorted((r for r in rows if r.archive.endswith(a)), key=lambda r: r.place)}
        assert own.keys() == names.keys() and all(own[n].size == len(names[n]) and own[n].error is None for n in names)
    broken = {r.archive.rsplit("/", 1)[1]: r.error for r in rows if r.error}
    assert broken.keys() == {"e.tar", "f.zip"} and all(broken.values())
    assert members.index_of(spark.createDataFrame([(f"{root}/none.tar",), (None,)], "a string"), "a").count() == 0


def test_lookup(spark, store, monkeypatch):
    root, names = store
    wanted = [(f"{root}/{a}", n, k) for a in ("a.tar", "b.tar.gz", "c.tar", "d.zip") for k, n in enumerate([*names, "none", "s3/receptor.pdb"])]
    wanted += [(None, "x", 1), (f"{root}/a.tar", None, 2), (f"{root}/none.tar", "plain.txt", 3), (f"{root}/f.zip", "plain.txt", 4)]
    df = spark.createDataFrame([(*w, "mine") for w in wanted], "archive string, member string, k int, place string").repartition(3)
    got = members.lookup(df, members.index_of(df, "archive"))
    assert got.columns == [*df.columns, "content"]
    rows = got.collect()
    assert len(rows) == len(wanted)
    for r in rows:
        here = r.archive and r.archive.endswith(("a.tar", "b.tar.gz", "c.tar", "d.zip"))
        assert (None if r.content is None else bytes(r.content)) == (names.get(r.member) if here else None) and r.place == "mine", r.member


def test_basename(spark, store):
    root, names = store
    df = spark.createDataFrame([(f"{root}/a.tar", "receptor.pdb"), (f"{root}/a.tar", "plain.txt"), (f"{root}/b.tar.gz", "receptor.pdb")], "archive string, member string")
    got = members.lookup(df, members.index_of(df, "archive"), basename=True).collect()
    assert sorted(bytes(r.content) for r in got) == [b"caf\xe9 \xff", b"the later one", b"the later one"]


def test_bytes_read(tmp_path, monkeypatch):
    """Neither the index nor the reading of one member streams a plain tar or a zip."""
    data = [(f"m{k}", random.Random(k).randbytes(400_000)) for k in range(50)]
    pack(tmp_path / "big.tar", data)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for n, d in data:
            z.writestr(n, d)
    read = []
    plain = archives.Reads.readinto

    def counted(self, buffer):
        n = plain(self, buffer)
        read.append(n)
        return n

    monkeypatch.setattr(archives.Reads, "readinto", counted)
    for form in ("tar", "zip"):
        uri = str(tmp_path / f"big.{form}")
        read.clear()
        found = {r[1]: r for r in members.entries(uri)}
        assert len(found) == 50 and sum(read) < 1_500_000  # of 20 MB
        read.clear()
        batch = members._rows([found[n] for n in ("m7", "m31")], members._INDEX)
        out = pa.Table.from_batches(list(members._fetched(iter([batch]))))
        assert out.column("content").to_pylist() == [data[7][1], data[31][1]] and sum(read) < 820_000
        with pytest.raises(ValueError, match="shorter|starts there"):
            list(members._fetched(iter([members._rows([(uri, "m49", 0, 19_999_000 if form == "tar" else 100, 400_000, 400_000, "plain" if form == "tar" else "stored", None)], members._INDEX)])))


def test_resolver(spark, store, tmp_path):
    root, names = store
    (tmp_path / "x.pdb").write_bytes(b"from a file \xc3\xa9")
    rows = [
        (1, "inline", str(tmp_path / "x.pdb"), None, None, None), (2, None, str(tmp_path / "x.pdb"), f"{root}/d.zip", None, "plain.txt"), (3, None, str(tmp_path / "none.pdb"), None, None, None),
        (4, None, None, f"{root}/d.zip", f"{root}/a.tar", "s3/receptor.pdb"), (5, None, None, None, f"{root}/a.tar", "s3/receptor.pdb"), (6, None, None, None, f"{root}/b.tar.gz", "s3/receptor.pdb"),
        (7, None, None, None, f"{root}/a.tar", "none"), (8, None, None, None, None, "s3/receptor.pdb"), (9, "", None, None, None, None), (10, None, None, f"{root}/f.zip", None, "x"), (11, None, None, None, f"{root}/a.tar", "plain.txt"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id int, pdb string, path string, zip string, tar string, member string, _uri string")
    got = {r.id: r.text for r in members.resolve(df).collect()}
    later = "the later one"
    assert got == {1: "inline", 2: "from a file é", 3: None, 4: later, 5: later, 6: later, 7: None, 8: None, 9: "", 10: None, 11: "caf� �"}
    assert members.resolve(df).columns == [*df.columns, "text"]
    assert {r.id: r.text for r in members.resolve(df.select("id", "pdb")).collect()}[1] == "inline"
    assert members.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("form", ["tar", "tar.gz", "zip"])
def test_written_archives(spark, tmp_path, form):
    df = spark.range(25).select(F.format_string("m%02d", "id").alias("member"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content"))
    done = tables.write_archives(df, str(tmp_path), "member", "content", 10, form)
    assert sorted((r.archive.rsplit("/", 1)[1], r.members) for r in done.collect()) == [(f"00000{k}.{form}", n) for k, n in enumerate([10, 10, 5])]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    rows = members.lookup(done.crossJoin(df.select("member")), members.index_of(done, "archive")).where("content is not null").collect()
    assert {r.member: len(r.content) for r in rows} == {f"m{k:02d}": k for k in range(25)}


def test_parts_of_a_manifest(spark, tmp_path):
    """A folder is parted by file, a file by record; equal records are each somebody's."""
    rows = [{"a": k % 4} for k in range(23)]
    for f in range(5):
        with gzip.open(tmp_path / f"{f}.jsonl.gz", "wt") as h:
            h.write("\n".join(json.dumps({"a": f}) for _ in range(f + 1)) + "\n\n")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "m.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    of = lambda path, k: [r.a for r in tables.read_jsonl(spark, str(path), "a int", k, 3).collect()]
    assert [sorted(of(tmp_path / "one" / "m.jsonl", k)) for k in range(3)] == [sorted(r["a"] for r in rows[k::3]) for k in range(3)]
    folder = tmp_path / "folder"
    folder.mkdir()
    for f in range(5):
        (tmp_path / f"{f}.jsonl.gz").rename(folder / f"{f}.jsonl.gz")
    assert [sorted(of(folder, k)) for k in range(3)] == [[0, 3, 3, 3, 3], [1, 1, 4, 4, 4, 4, 4], [2, 2, 2]]
    with pytest.raises(ValueError, match="no part"):
        of(folder, 3)


def test_failing_seeks_are_errors():
    class Away:
        def seek(self, *a):
            raise OSError("the store is away")

        tell = seek

        def close(self):
            pass

    with archives.Reads(Away()) as f:
        for what in (lambda: f.seek(1), f.tell):
            with pytest.raises(archives.StorageError):
                what()


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    """Names are few bytes: tasks by bytes would read all archives in one."""
    for k in range(40):
        pack(tmp_path / f"{k}.tar", [("a", b"x" * k)])
    named = spark.createDataFrame([(str(tmp_path / f"{k}.tar"),) for k in range(40)], "archive string")
    index = members.index_of(named, "archive")
    assert index.select(F.spark_partition_id()).distinct().count() > 4
    got = members.lookup(named.withColumn("member", F.lit("a")), index)
    assert sorted(len(r.content) for r in got.collect()) == list(range(40))
