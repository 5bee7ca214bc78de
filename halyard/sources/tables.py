"""Label files, manifests, structures and token corpora: readers to DataFrames, and writers."""

from __future__ import annotations

import io
import json
import os
import platform
import subprocess
import sys
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard import storage
from halyard.functions import scalars
from halyard.names import free
from halyard.operators import relational
from halyard.sources import archives, records

MOLECULE = "struct<atoms: array<struct<element: string, x: double, y: double, z: double>>, bonds: array<struct<i: int, j: int, order: int>>>"


# --- scans


def fields(spark: SparkSession, path: str, least: int, pattern: str = r"\s+") -> DataFrame:
    """file, line (order within the file), f (array of fields) of text lines that are no comment and have least fields."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    return rows.where((F.col("value") != "") & ~F.col("value").startswith("#")).select("file", "line", F.split("value", pattern).alias("f")).where(F.size("f") >= least)


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of types files: label and two scores (0 where they don't parse), receptor, ligand; of a pair the first row stays."""
    r = fields(spark, path, 5)
    number = lambda k, kind, other: F.coalesce(F.get("f", F.lit(k)).try_cast(kind), F.lit(other))
    r = r.select("file", "line", number(0, "int", 0).alias("label"), number(1, "double", 0.0).alias("score1"), number(2, "double", 0.0).alias("score2"), F.get("f", F.lit(3)).alias("receptor"), F.get("f", F.lit(4)).alias("ligand"))
    r = r.withColumns({"source_type": scalars.source_type(F.col("file")), "fold": scalars.fold_of(F.col("file")), "split": scalars.split_of(F.col("file"))})
    return relational.first_wins(r, ["receptor", "ligand"], ["file", "line"]).drop("line")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """A row for each pair over all types files, with a column of train or test for each source and fold, and dense pair_idx."""
    r = fields(spark, path, 5).select("file", "line", F.get("f", F.lit(3)).alias("receptor"), F.get("f", F.lit(4)).alias("ligand"))
    cell = F.concat(scalars.source_type(F.col("file")), F.lit("_fold"), scalars.fold_of(F.col("file")).cast("string"))
    r = r.withColumns({"cell": cell, "split": scalars.split_of(F.col("file"))}).where("cell is not null")
    wide = r.groupBy("receptor", "ligand").pivot("cell").agg(F.min_by("split", F.struct("file", "line")))
    return relational.global_position(wide, ["receptor", "ligand"]).withColumnRenamed("position", "pair_idx")


def read_manifest(spark: SparkSession, path: str, columns: list[str], shard: int | None = None, sources: list[str] | None = None, label: int | None = None) -> DataFrame:
    """Chosen columns of a Parquet manifest; the filters reach the scan."""
    m = relational.require(spark.read.parquet(path), columns + ["label"] * (label is not None))
    for column, wanted in (("shard_idx", shard), ("label", label)):
        m = m.where(F.col(column) == wanted) if wanted is not None else m
    return (m.where(F.col("source_type").isin(sources)) if sources else m).select(*columns)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Binding sites of a tab-separated table of seven columns or more: pdb, rchain, ccd, ligchain, serial."""
    f = fields(spark, path, 7, "\t")
    at = lambda k: F.get("f", F.lit(k))
    return f.select("line", F.lower(at(0)).alias("pdb"), at(1).alias("rchain"), at(4).alias("ccd"), at(5).alias("ligchain"), at(6).alias("serial"))


def read_affinity_sites(spark: SparkSession, path: str, low: float = 2.0, high: float = 13.0, kinds: list[str] | None = None) -> DataFrame:
    """Sites with a pK: of four affinity columns (15, 14, 13, 16) the first that parses, within range; first of (pdb, ccd)."""
    f = fields(spark, path, 18, "\t")
    at = lambda k: F.get("f", F.lit(k))
    order = (15, 14, 13, 16)
    kind = F.coalesce(*(F.when(scalars.affinity_pk(at(k)).isNotNull(), scalars.found(at(k), scalars.AFFINITY, 1)) for k in order))
    out = f.select("line", F.lower(at(0)).alias("pdb"), at(1).alias("rchain"), at(4).alias("ccd"), F.coalesce(*(scalars.affinity_pk(at(k)) for k in order)).alias("pk"), kind.alias("kind"), at(17).alias("uniprot"))
    out = out.where(F.col("pk").between(low, high))
    out = out.where(F.lower("kind").isin([k.lower() for k in kinds])) if kinds else out
    return relational.first_wins(out, ["pdb", "ccd"], ["line"])


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """ccd, smiles of a tab-separated dictionary; the last row of an id wins."""
    f = fields(spark, path, 5, "\t")
    return f.groupBy(F.get("f", F.lit(0)).alias("ccd")).agg(F.max_by(F.get("f", F.lit(4)), "line").alias("smiles"))


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path, 2, "\t")
    return f.select(F.get("f", F.lit(0)).alias("ccd"), scalars.heavy_atoms(F.get("f", F.lit(1))).alias("heavy"))


def read_core_set(spark: SparkSession, path: str) -> DataFrame:
    """pdbid, logka, cluster of a whitespace-separated core set."""
    at = lambda k: F.get("f", F.lit(k))
    return fields(spark, path, 6).select(at(0).alias("pdbid"), at(3).try_cast("double").alias("logka"), at(5).alias("cluster"))


def read_rmsd(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path, 2).select(F.get("f", F.lit(0)).alias("pose"), F.get("f", F.lit(1)).try_cast("double").alias("rmsd"))


def read_pose_scores(spark: SparkSession, path: str) -> DataFrame:
    """pdbid (a pose's name up to the underscore), pose, score of a folder of score files."""
    s = read_rmsd(spark, path)
    return s.where("rmsd is not null").select(F.substring_index("pose", "_", 1).alias("pdbid"), "pose", F.col("rmsd").alias("score"))


def read_affinity_json(spark: SparkSession, path: str, labels: DataFrame, key: str = "affinity_pred_value") -> DataFrame:
    """pdbid (file stem), head = 6 - value, with its labels; files without the key or that don't parse are passed over."""
    r = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("pdbid"), F.get_json_object("value", f"$.{key}").try_cast("double").alias("value"))
    return r.where("value is not null").select("pdbid", scalars.micromolar_log_pk(F.col("value")).alias("head")).join(labels, "pdbid")


def read_dump(spark: SparkSession, path: str, required: list[str], method: str | None = None) -> DataFrame:
    """A CSV or Parquet dump; raises ValueError naming what is missing."""
    r = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    r = relational.require(r, required)
    return r.withColumn("method", F.lit(method)) if method else r


def discover_arms(root: str, suffix: str, baselines: set[str], registered: list[str] = ()) -> list[str]:
    """Folders with the suffix that hold a CSV file and are no baseline: registered ones in their order, then by name."""
    found = {f.rsplit("/", 2)[1] for f in archives.list_files(root, (".csv",))}
    arms = {d for d in found if d.endswith(suffix) and d not in baselines}
    return [r for r in registered if r in arms] + sorted(arms - set(registered))


def read_jsonl(spark: SparkSession, path: str, schema: str, part: int = 0, parts: int = 1) -> DataFrame:
    """Records of JSON lines, a file's or all files' of a folder; part k of n of a folder has every n-th file from the k-th on, by name, of
    a single file every n-th record from the k-th on. So the parts are disjoint, together whole, and equal records may be in several."""
    if parts == 1:
        return spark.read.schema(schema).json(path)
    if not 0 <= part < parts:
        raise ValueError(f"no part {part} of {parts}")
    fs, at = archives.file_system(path)
    if not fs.get_file_info(at).is_file:
        mine = archives.list_files(path, (".jsonl", ".jsonl.gz", ".json", ".json.gz"))[part::parts]
        return spark.read.schema(schema).json(mine) if mine else spark.createDataFrame([], schema)
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    mine = relational.global_position(lines, ["line"]).where(F.col("position") % parts == part)
    return mine.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of all archives at path. Turns on the session's filter pushdown to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(archives.ArchiveSource)
    return spark.read.format("archive").load(path)


def parsed(df: DataFrame, keep: list[str], content: str, form: str) -> DataFrame:
    """keep columns, entry (from 0) and mol for each molecule of sdf or mol2 content; content that doesn't parse gives none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                raw = getattr(row, content)
                text = raw.decode(errors="replace") if isinstance(raw, bytes) else raw or ""
                mols = records.parse_sdf(text) if form == "sdf" else [m for _, m in records.parse_mol2(text)]
                for k, m in enumerate(mols):
                    mol = {"atoms": [dict(zip(("element", "x", "y", "z"), a, strict=True)) for a in m["atoms"]], "bonds": [dict(zip(("i", "j", "order"), b, strict=True)) for b in m["bonds"]]}
                    rows.append((*(getattr(row, c) for c in keep), k, mol))
            yield pd.DataFrame(rows, columns=[*keep, "entry", "mol"])

    kinds = dict(df.dtypes)
    return df.select(*keep, content).mapInPandas(each, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", entry int, mol {MOLECULE}")


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Heavy atoms of PDB files, a row each: file, ord, name, resname, chain, resseq, element, x, y, z. Columns are cut in the JVM."""
    v = F.col("value")
    cut = lambda a, n: F.trim(F.substring(v, a, n))
    rows = spark.read.text(path).where(v.startswith("ATOM") | v.startswith("HETATM"))
    element = F.initcap(F.coalesce(F.nullif(cut(77, 2), F.lit("")), F.substring(F.regexp_replace(cut(13, 4), r"^\d+", ""), 1, 1)))
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("ord"), v.startswith("HETATM").alias("het"), cut(13, 4).alias("name"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resseq"), element.alias("element"), *(cut(a, 8).try_cast("double").alias(c) for c, a in zip("xyz", (31, 39, 47), strict=True)))
    return rows.where(~F.col("element").isin("H", "D") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def poses(spark: SparkSession, archive_path: str, manifest: DataFrame) -> DataFrame:
    """Molecules of archived ligand files that the manifest (pair_idx, ...) has: the member's name is the pair's number."""
    m = read_members(spark, archive_path).withColumn("pair_idx", scalars.found(F.col("member"), r"(\d+)\.sdf(?:\.gz)?$").try_cast("long"))
    wanted = m.join(manifest, "pair_idx")
    return parsed(wanted, ["pair_idx", *(c for c in manifest.columns if c != "pair_idx")], "content", "sdf")


# --- sinks


def write_tokens(df: DataFrame, path: str, labels: list[str] = ()) -> None:
    """Token documents by split; every label column must be as long as its tokens, or the write fails."""
    for c in labels:
        df = df.withColumn(c, F.when(F.size(c) == F.size("tokens"), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} and tokens differ in length")).cast(dict(df.dtypes)[c])))
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def token_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("num_docs"), F.sum(F.size("tokens")).cast("long").alias("num_tokens"), F.max(F.size("tokens")).cast("long").alias("max_len"))


def write_shards(df: DataFrame, path: str, rows: int = 50_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def write_normalised(df: DataFrame, path: str, key: str, complex_columns: list[str]) -> None:
    """Two tables: complexes once each, and records with their key."""
    relational.first_wins(df.select(key, *complex_columns), [key], [key]).write.mode("overwrite").parquet(f"{path}/complexes")
    df.drop(*complex_columns).write.mode("overwrite").parquet(f"{path}/records")


def write_dump(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with those columns in that order; others are dropped, a missing one raises ValueError."""
    relational.require(df, columns).select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_new_arms(df: DataFrame, path: str, arm: str = "arm") -> None:
    """Only the arms that are not there yet."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(F.col(arm).cast(dict(df.dtypes)[arm])).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    fresh = df if there is None else df.join(storage.cut(there, "arms"), arm, "left_anti")
    fresh.write.mode("append").partitionBy(arm).parquet(path)


def shard_by_size(df: DataFrame, order: list[str], size: str, target: int) -> DataFrame:
    """shard: cut where the bytes so far pass a multiple of target. Prefix sums over ranges, so no task folds the table."""
    relational.absent(df, "shard")
    before = free("_sum", df)
    return relational.global_prefix(df, order, size, before).withColumn("shard", F.floor(F.col(before) / target).cast("long")).drop(before)


#: Suffixes of archives, and how tarfile writes them.
FORMS = {"tar.gz": "w|gz", "tar": "w|", "zip": None}


def write_archives(df: DataFrame, path: str, member: str, content: str, most: int = 50_000, form: str = "tar.gz") -> DataFrame:
    """Archives (FORMS) of at most most members, by name; returns archive, members. Null content is passed over, of members with one name
    any is written. An archive is written under a name of its own and gets its final one when it is whole, so neither a second attempt
    nor a lost executor leaves a torn one. The returned table is written too: reading it again writes no archive."""
    mode = FORMS[form]
    rows = relational.global_position(df.where(F.col(content).isNotNull()).select(F.col(member).alias("member"), F.col(content).alias("content")).dropDuplicates(["member"]), ["member"])
    rows = rows.withColumn("shard", F.floor(F.col("position") / most).cast("long"))

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path.rstrip('/')}/{key[0].as_py():06d}.{form}"
        fs, at = archives.file_system(name)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        count, own = 0, f"{at}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(own, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if mode is None else tarfile.open(fileobj=out, mode=mode) as into:
            for b in batches:
                for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    data = c.encode() if isinstance(c, str) else c
                    if mode is None:
                        into.writestr(zipfile.ZipInfo(n), data, zipfile.ZIP_DEFLATED)
                    else:
                        info = tarfile.TarInfo(n)
                        info.size = len(data)
                        into.addfile(info, io.BytesIO(data))
                    count += 1
        fs.move(own, at)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "members"])

    return storage.cut(rows.select("member", "content", "shard").groupBy("shard").applyInArrow(write, "archive string, members long"), "archives")


def write_audit(df: DataFrame, path: str) -> str:
    """Accepted and rejected rows with their reason as JSON lines and CSV; returns a digest of the rows that their order doesn't change."""
    df.write.mode("overwrite").json(f"{path}/audit.jsonl")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/audit.csv")
    row = F.sha2(F.concat_ws("¦", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns)).cast("binary"), 256)
    n = df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{n.n}:{n.s}"


def run_manifest(path: str, seed: int, extra: dict | None = None) -> dict:
    """What ran: arguments, revision, seed, host, settings; written as JSON."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    out = {"argv": sys.argv, "revision": git("rev-parse", "HEAD"), "changed": bool(git("status", "--porcelain")), "seed": seed, "host": platform.node(), "job": {k: v for k, v in os.environ.items() if k.startswith(("SLURM_", "SPARK_"))}, "written": pd.Timestamp.now("UTC").isoformat(), **(extra or {})}
    fs, at = archives.file_system(path)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(json.dumps(out, indent=1).encode())
    return out


def pdb_text(atoms: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, text: PDB lines of each structure, made in the JVM."""
    line = F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.row_number().over(Window.partitionBy(*keys).orderBy(order)), F.concat(F.lit(" "), F.col("name")), "resname", "chain", "resseq", "x", "y", "z", F.lit(1.0), F.lit(0.0), "element")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("_line").alias("l")))), lambda s: s["l"])
    return atoms.withColumn("_line", line).groupBy(*keys).agg(F.concat_ws("\n", lines, F.lit("END")).alias("text"))
