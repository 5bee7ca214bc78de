"""A table in parts (records, edges, whatever else goes with them) of which one part can be written anew. A version is a small manifest that
names each part's files; a rewrite adds files and then a manifest, so readers see the old version or the new one, the other parts' files
stay as they are, and a rewrite that fails leaves nothing but files that no version names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.functions import chemistry
from halyard.operators import molecules


def _fs(spark: SparkSession, uri: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/_versions")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at)) if fs.exists(at) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, dict]:
    """Part to its folder and schema, of the latest version or of that one."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {'' if version is None else version}")
    fs, at = _fs(spark, f"{path}/_versions/{known[-1] if version is None else version:08d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, part: str, version: int | None = None) -> DataFrame:
    own = manifest(spark, path, version)[part]
    return spark.read.schema(StructType.fromJson(own["schema"])).parquet(f"{path}/{own['folder']}")


def write(parts: dict[str, DataFrame], path: str) -> int:
    """A new version in which these parts are new and all others as in the latest; its number. Of two writers that begin with the same
    version the second is an error, as it would undo the first."""
    spark = next(iter(parts.values())).sparkSession
    known = versions(spark, path)
    own = manifest(spark, path) if known else {}
    for name, df in parts.items():
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{path}/{folder}")
        own[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
    number = known[-1] + 1 if known else 1
    fs, draft = _fs(spark, f"{path}/_drafts/{uuid.uuid4().hex}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(own, indent=1).encode()))
    out.close()
    _, at = _fs(spark, f"{path}/_versions/{number:08d}.json")
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(draft, at):
        raise RuntimeError(f"version {number} of {path} was written by another meanwhile")
    return number


def rebuilt_edges(records: DataFrame, complex_: str, scale: str, order: str, elements: str, xyz: str, target: str) -> DataFrame:
    """complex, i, j, length: of each complex's first record (by order) at scale 0, the bonds perceived from its places, with their lengths
    in the target's. Complexes without such a record have no edges; columns of the same names elsewhere don't matter."""
    first = records.where(F.col(scale) == 0).groupBy(F.col(complex_).alias("complex")).agg(F.min_by(F.struct(F.col(elements).alias("e"), F.col(xyz).alias("x"), F.col(target).alias("t")), order).alias("r"))

    def bonds(e: list[str], x: list, t: list) -> tuple:
        return ([{"i": i, "j": j, "length": sum((a - b) ** 2 for a, b in zip(t[i], t[j], strict=True)) ** 0.5} for i, j in (chemistry.infer_bonds(e, x) if e else [])],)

    found = molecules.with_results(first.select("complex", "r.e", "r.x", "r.t"), ["e", "x", "t"], "edges array<struct<i: int, j: int, length: double>>", bonds)
    return found.select("complex", F.explode("edges").alias("edge")).select("complex", "edge.i", "edge.j", "edge.length")


def rebuild_edges(spark: SparkSession, path: str, **columns: str) -> int:
    """A version whose part edges is made anew from its part records; edge counts stand in the part counts."""
    edges = rebuilt_edges(read(spark, path, "records"), **columns)
    return write({"edges": edges, "counts": edges.groupBy("complex").agg(F.count("*").alias("n_edges"))}, path)
