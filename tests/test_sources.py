"""Readers, parsers and writers."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from halyard.functions import scalars
from halyard.operators import evaluation, relational, spatial
from halyard.sources import archives, records, tables
from pyspark.sql import functions as F

MOL = {"atoms": [("C", 0.0, 0.0, 0.0), ("N", 1.4, 0.0, 0.0)], "bonds": [(0, 1, 2)]}


def test_sdf():
    text = records.write_sdf(MOL, "one") + records.write_sdf(MOL)
    assert records.parse_sdf(text) == [MOL, MOL]
    spaced = text.replace("  2  1  0", " 2 1 0 ", 1)
    assert records.parse_sdf(spaced)[0]["atoms"] == MOL["atoms"]
    broken = "x\n\n\nbad counts V2000\n$$$$\n" + records.write_sdf(MOL)
    assert records.parse_sdf(broken) == [MOL]
    wide = {"atoms": [("C", float(k), 0.0, 0.0) for k in range(120)], "bonds": [(k, k + 1, 1) for k in range(119)]}
    assert records.parse_sdf(records.write_sdf(wide)) == [wide]
    assert records.parse_sdf("") == []


def test_mol2():
    text = "@<TRIPOS>MOLECULE\nname\n 3 1\n@<TRIPOS>ATOM\n1 C1 0 0 0 C.ar\n2 X 1 1 1 Du\n3 N1 1.4 0 0 N.3\n@<TRIPOS>BOND\n1 1 3 ar\n2 1 2 1\n"
    assert records.parse_mol2(text * 2) == [("name", {"atoms": [("C", 0.0, 0.0, 0.0), ("N", 1.4, 0.0, 0.0)], "bonds": [(0, 1, 4)]})] * 2


PDB = [
    {"het": False, "name": n, "resname": "ALA", "chain": "A", "resseq": 5, "element": n[0], "x": float(k), "y": 0.5, "z": -1.25} for k, n in enumerate(("N", "CA", "C", "H"))
]


def test_pdb(spark, tmp_path):
    text = records.write_pdb(PDB, [(0, 1)])
    assert records.parse_pdb(text) == PDB[:3] and "CONECT    1    2" in text
    bad = text.replace("   0.500", "    oops", 1)
    assert len(records.parse_pdb(bad)) == 2
    residues = records.pocket_residues(records.parse_pdb(text))
    assert residues[0]["ca"] == (1.0, 0.5, -1.25)
    assert records.backbone(PDB[:2])[0]["c"] == (1.0, 0.5, -1.25)
    (tmp_path / "a.pdb").write_text(text)
    rows = tables.read_pdb_atoms(spark, str(tmp_path / "a.pdb")).orderBy("ord").collect()
    assert [(r.name, r.resseq, r.x) for r in rows] == [(a["name"], 5, a["x"]) for a in PDB[:3]]


def test_pocket():
    def residue(k, ca, side):
        return {"chain": "A", "resseq": k, "resname": "ALA", "ca": (ca, 0.0, 0.0), "atoms": [("CA", "C", ca, 0.0, 0.0), ("CB", "C", side, 0.0, 0.0)]}

    rows = [residue(1, 9.0, 7.0), residue(2, 3.0, 4.0), residue(3, 20.0, 19.0)]
    ligand = [(0.0, 0.0, 0.0)]
    assert [r["resseq"] for r in records.pocket(rows, ligand)] == [1, 2]
    assert [r["resseq"] for r in records.pocket(rows, ligand, metric="ca")] == [2]
    assert [r["resseq"] for r in records.pocket(rows, ligand, most=1)] == [2]
    assert [r["resseq"] for r in records.pocket(rows, ligand, order="far")] == [1, 2]
    assert records.pocket(rows, [(500.0, 0.0, 0.0)]) is None
    with pytest.raises(ValueError, match="metric"):
        records.pocket(rows, ligand, metric="x")


def test_pdbqt():
    atom = "ATOM      1  C   LIG A   1       1.000   2.000   3.000  0.00  0.00    +0.000 {}\n"
    assert [len(m) for m in records.parse_pdbqt("MODEL 1\n" + atom.format("C") + atom.format("HD") + "ENDMDL\nMODEL 2\n" + atom.format("OA") + "ENDMDL\n")] == [1, 1]
    assert records.parse_pdbqt(atom.format("C")) == [[("C", 1.0, 2.0, 3.0)]]
    assert records.best_score("REMARK VINA RESULT: 0.0\nREMARK VINA RESULT: -7.5\nREMARK VINA RESULT: -6.0") == -7.5
    assert records.best_score("") is None


def test_types(spark, tmp_path):
    (tmp_path / "cdonly_train0.types").write_text("1 5.5 1.0 aaaa/r_1.gninatypes aaaa/l_2.gninatypes\nbad\n0 x 2.0 bbbb/r.gninatypes bbbb/l_1.gninatypes\n")
    (tmp_path / "cdonly_test0.types").write_text("1 9.9 9.0 cccc/r_1.gninatypes cccc/l_1.gninatypes\n0 1.0 1.0 aaaa/r_1.gninatypes aaaa/l_2.gninatypes\n")
    rows = {r.receptor[:4]: r for r in tables.read_types(spark, str(tmp_path)).collect()}
    assert rows["aaaa"].label == 0 and rows["aaaa"].split == "test"  # file names in order: test comes first
    assert rows["bbbb"].score1 == 0.0 and {r.source_type for r in rows.values()} == {"cdonly"} and rows["bbbb"].fold == 0
    folds = tables.read_folds(spark, str(tmp_path)).orderBy("pair_idx").collect()
    assert [r.pair_idx for r in folds] == [0, 1, 2] and folds[1].cdonly_fold0 == "train"


def test_text_tables(spark, tmp_path):
    (tmp_path / "core.dat").write_text("#code\n\n1abc 2.0 2010 5.5 Kd=3nM 7\nshort row\n")
    assert [tuple(r) for r in tables.read_core_set(spark, str(tmp_path / "core.dat")).collect()] == [("1abc", 5.5, "7")]
    (tmp_path / "s.dat").write_text("#pose score\n1abc_1 0.5\n1abc_2 -1\n1abc_3 none\n")
    assert [(r.pdbid, r.score) for r in tables.read_pose_scores(spark, str(tmp_path / "s.dat")).orderBy("pose").collect()] == [("1abc", 0.5), ("1abc", -1.0)]
    row = ["1ABC", "A", "x", "x", "ATP", "B", "1"] + [""] * 6
    (tmp_path / "aff.tsv").write_text("\n".join("\t".join(r) for r in ([*row, "Kd=1nM", "", "Ki=10uM", "", "P1"], [*row, "Kd=9nM", "", "", "", "P1"], row)) + "\n")
    sites = tables.read_affinity_sites(spark, str(tmp_path / "aff.tsv")).collect()
    assert [(r.pdb, r.ccd, round(r.pk, 6), r.kind) for r in sites] == [("1abc", "ATP", 5.0, "Ki")]
    (tmp_path / "ccd.tsv").write_text("# x\nATP\ta\tb\tc\tC1\nATP\ta\tb\tc\tC2\n")
    assert [tuple(r) for r in tables.read_smiles(spark, str(tmp_path / "ccd.tsv")).collect()] == [("ATP", "C2")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1abc.json").write_text(json.dumps({"affinity_pred_value": -1.5}))
    (tmp_path / "j" / "2abc.json").write_text("{}")
    labels = spark.createDataFrame([("1abc", 6.0), ("2abc", 7.0)], "pdbid string, logka double")
    assert [(r.pdbid, r.head) for r in tables.read_affinity_json(spark, str(tmp_path / "j"), labels).collect()] == [("1abc", 7.5)]


def archive(path, names, mode="w"):
    with tarfile.open(path, mode) as t:
        for n, data in names.items():
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    sdf = records.write_sdf(MOL).encode()
    archive(tmp_path / "a.tar", {"x/0000001.sdf.gz": gzip.compress(sdf * 2), "x/0000002.sdf.gz": gzip.compress(sdf), "x/bad.sdf.gz": b"no", "readme": b"r"})
    archive(tmp_path / "b.tar.bz2", {"x/0000003.sdf.gz": gzip.compress(sdf)}, "w:bz2")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("s/receptor.pdb", "ATOM")
    whole = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "d.tar").write_bytes(whole[: len(whole) // 4])
    (tmp_path / "e.zip").write_bytes(b"broken")
    rows = tables.read_members(spark, str(tmp_path))
    found = {(r.archive.rsplit("/", 1)[1], r.member) for r in rows.collect()}
    assert ("c.zip", "s/receptor.pdb") in found and ("a.tar", "readme") in found and ("b.tar.bz2", "x/0000003.sdf.gz") in found
    assert ("a.tar", "x/bad.sdf.gz") not in found
    assert [bytes(r.content) for r in rows.where("member = 'readme' and archive like '%a.tar'").collect()] == [b"r"]
    reads = list(archives.members(str(tmp_path / "a.tar"), {"x/0000001.sdf.gz"}, True))
    assert [n for n, _ in reads] == ["x/0000001.sdf.gz"]
    manifest = spark.createDataFrame([(1, "k"), (3, "m"), (9, "z")], "pair_idx long, tag string")
    got = tables.poses(spark, str(tmp_path), manifest).where(F.col("mol").isNotNull()).select("pair_idx", "tag", "entry").distinct().collect()
    assert {tuple(r) for r in got} == {(1, "k", 0), (1, "k", 1), (3, "m", 0)}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("train", [1, 2], [0, 1]), ("val", [3], [1])], "split string, tokens array<int>, lab array<int>")
    tables.write_tokens(docs, str(tmp_path / "t"), ["lab"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.split, r.num_docs, r.num_tokens) for r in tables.token_counts(back).collect()} == {("train", 1, 2), ("val", 1, 1)}
    with pytest.raises(Exception, match="differ in length"):
        tables.write_tokens(docs.withColumn("lab", F.array(F.lit(1))), str(tmp_path / "u"), ["lab"])
    with pytest.raises(ValueError, match="missing columns: b"):
        tables.write_dump(docs, str(tmp_path / "v"), ["split", "b"])
    with pytest.raises(ValueError, match="label"):
        docs.write.parquet(str(tmp_path / "m.parquet"))
        tables.read_manifest(spark, str(tmp_path / "m.parquet"), ["split"], label=1)
    digest = tables.write_audit(docs.select("split"), str(tmp_path / "audit"))
    assert digest == tables.write_audit(docs.select("split").repartition(3), str(tmp_path / "audit2"))
    assert tables.run_manifest(str(tmp_path / "run.json"), 3)["seed"] == 3
    tables.write_shards(spark.range(25).coalesce(1), str(tmp_path / "shards"), 10)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 3
    (tmp_path / "results" / "b_f16").mkdir(parents=True)
    (tmp_path / "results" / "a_f16").mkdir()
    (tmp_path / "results" / "c_other").mkdir()
    for d in ("a_f16", "b_f16", "c_other"):
        (tmp_path / "results" / d / "x.csv").write_text("h\n1\n")
    assert tables.discover_arms(str(tmp_path / "results"), "_f16", {"z"}, ["b_f16"]) == ["b_f16", "a_f16"]


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (1, 1.0, 6), (2, None, 7), (None, 3.0, 8)], "k int, v double, o int")
    assert {r.o for r in relational.first_wins(df, ["k"], ["o"]).collect()} == {5, 7, 8} and {r.o for r in relational.last_wins(df, ["k"], ["o"]).collect()} == {6, 7, 8}
    z = {r.o: r.z_v for r in relational.zscores(df, ["k"], ["v"]).collect()}
    assert z[5] == 0 and z[8] is None
    ranks = {r.o: r.rank_v for r in relational.global_ranks(df, "v").collect()}
    assert ranks == {5: 1.5, 6: 1.5, 7: None, 8: 3.0}
    assert {r.o for r in relational.without(df, spark.createDataFrame([(1,)], "k int"), "k").collect()} == {7, 8}
    assert relational.global_position(df.limit(0), ["o"]).count() == 0
    parts = [spark.createDataFrame([(0,), (1,)], "grp long"), spark.createDataFrame([(0,), (0,)], "grp long")]
    assert sorted(r.grp for r in relational.union_with_offsets(parts, "grp").collect()) == [0, 1, 2, 2]
    with pytest.raises(ValueError, match="no grp"):
        relational.union_with_offsets([spark.range(2)], "grp", singles=False)
    split = relational.counted_split(spark.range(100).withColumn("g", F.floor(F.col("id") / 5)), "g", 0.1)
    assert split.where("split = 'val'").select("g").distinct().count() == 2
    constant = spark.createDataFrame([("m", 1, 1.0, 2.0), ("m", 1, 1.0, 3.0), ("m", 1, 1.0, 4.0), ("m", 2, 1.0, 1.0), ("m", 2, 2.0, 2.0), ("m", 2, 3.0, 3.0)], "method string, g int, a double, b double")
    assert [(r.rho, r.n_groups) for r in evaluation.ranking_power(constant, ["method"], ["g"], "a", "b").collect()] == [(1.0, 1)]


def test_docking_ties_and_floor(spark):
    rows = [("m", 1, 1, 0.5, 2.0), ("m", 1, 2, 5.0, 2.0), ("m", 1, 3, 6.0, 1.0), ("m", 2, 1, 0.1, 1.0), ("m", 2, 2, 0.2, 0.0), ("n", 1, 1, 2.0, 1.0), ("n", 1, 2, 9.0, 0.0), ("n", 1, 3, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "method string, pdbid int, pose int, rmsd double, score double")
    got = {r.method: (r.n_targets, r.success_1, r.success_2) for r in evaluation.docking_power(df).collect()}
    assert got == {"m": (1, 100.0, 100.0), "n": (1, 0.0, 0.0)}


def test_grid_join_is_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(0).uniform(-3, 3, (60, 3))
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "n int, x double, y double, z double")
    for radius in (0.5, 1.7, 10.0):
        got = {(r.n, r.n_b) for r in spatial.within(df, df, radius).collect()}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < radius), strict=True)}


def test_plan_prunes_and_pushes(spark, tmp_path):
    spark.range(10).selectExpr("id as pair_idx", "id % 3 as shard_idx", "'a' as source_type", "id as unused").write.parquet(str(tmp_path / "m"))
    df = tables.read_manifest(spark, str(tmp_path / "m"), ["pair_idx"], shard=1, sources=["a"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(shard_idx), IsNotNull(source_type), EqualTo(shard_idx,1)" in plan.replace("`", "") or "EqualTo(shard_idx,1)" in plan
    assert "unused" not in plan.split("ReadSchema")[1] and scalars.AFFINITY


def test_missing_and_failing_archives_are_errors(tmp_path, monkeypatch):
    with pytest.raises(OSError):
        list(archives.members(str(tmp_path / "none.tar"), None, True))
    archive(tmp_path / "a.tar", {"x": b"x" * 5000, "y": b"y" * 5000})
    data = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(data[:6000])
    assert [n for n, _ in archives.members(str(tmp_path / "cut.tar"), None, True)] == ["x"]

    class Failing:
        def read(self, n):
            raise OSError("the store is away")

        def close(self):
            pass

    with pytest.raises(archives.StorageError):
        archives.Reads(Failing()).readinto(bytearray(10))
