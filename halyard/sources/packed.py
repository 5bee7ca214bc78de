"""The flat format of packed tokens: a file of fixed-width codes, all documents one after another (.bin), a file of the documents' lengths
(.len), and files of one value a token (streams, by suffix). A folder may hold several such sets; each is read in splits of BLOCK documents:
the sums of the blocks' lengths tell where each begins, so a split reads its own lengths and seeks its tokens."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard import storage
from halyard.names import free
from halyard.operators import relational
from halyard.sources import archives

#: Documents of a split; bytes of tokens that a batch of rows holds.
BLOCK, BATCH = 1 << 16, 8 << 20
CODES, LENGTHS, LABELS = "<u2", "<u2", "u1"


def _read(uri: str, at: int, n: int) -> bytes:
    with archives.Reads(archives.file_system(uri)[0].open_input_file(archives.file_system(uri)[1])) as f:
        f.seek(at)
        return _exactly(f, n, uri)


def _exactly(f: io.RawIOBase, n: int, uri: str) -> bytes:
    parts = []
    while n:
        part = f.read(n)
        if not part:
            raise ValueError(f"{uri} ends too early")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def _size(uri: str) -> int:
    fs, path = archives.file_system(uri)
    info = fs.get_file_info(path)
    if not info.is_file:
        raise ValueError(f"{uri} is missing")
    return info.size


def _blocks(spark: SparkSession, path: str, lengths: str) -> DataFrame:
    """name, block, first, n, tokens (their sum), start (tokens before the block in its file)."""
    names = [u[:-4] for u in archives.list_files(path, (".len",))] if not path.endswith(".len") else [path[:-4]]
    width = np.dtype(lengths).itemsize

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = b.column(0).to_pylist()
            sizes = [_size(f"{n}.len") for n in each]
            for n, s in zip(each, sizes, strict=True):
                if s % width:
                    raise ValueError(f"{n}.len holds no whole number of lengths")
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array([s // width for s in sizes], pa.int64())], names=["name", "docs"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            tokens = [int(np.frombuffer(_read(f"{r['name']}.len", r["first"] * width, r["n"] * width), lengths).sum(dtype=np.int64)) for r in rows]
            yield b.append_column("tokens", pa.array(tokens, pa.int64()))

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition("name").mapInArrow(sized, "name string, docs long").where("docs > 0")
    last = F.expr(f"(docs - 1) div {BLOCK}")
    each = files.select("name", "docs", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    each = each.select("name", "block", (F.col("block") * BLOCK).alias("first"), F.least(F.lit(BLOCK).cast("long"), F.col("docs") - F.col("block") * BLOCK).alias("n"))
    sums = each.repartition("name", "block").mapInArrow(summed, "name string, block long, first long, n long, tokens long")
    placed = storage.cut(relational.global_prefix(sums, ["name", "block"], "tokens"), "blocks")
    begin = placed.groupBy("name").agg(F.min("before").alias("begin"))
    return placed.join(begin, "name").select("name", "block", "first", "n", "tokens", (F.col("before") - F.col("begin")).alias("start"))


def read_packed(spark: SparkSession, path: str, codes: str = CODES, lengths: str = LENGTHS, streams: dict[str, str] | None = None) -> DataFrame:
    """name, doc (its place in that set, from 0), tokens, and an array for each stream (suffix: type). Lengths whose sum isn't the number
    of codes, or of a stream's values, are a ValueError before anything is read."""
    streams = streams or {}
    of = {"bin": codes, **streams}
    blocks = _blocks(spark, path, lengths)
    width = np.dtype(lengths).itemsize

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for r in b.to_pylist():
                for suffix, kind in of.items():
                    there, meant = _size(f"{r['name']}.{suffix}"), r["tokens"] * np.dtype(kind).itemsize
                    if there != meant:
                        said.append(f"{r['name']}.{suffix} has {there} bytes; its lengths ask for {meant}")
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], names=["said"])

    bad = blocks.groupBy("name").agg(F.sum("tokens").alias("tokens")).mapInArrow(wrong, "said string").limit(1).collect()
    if bad:
        raise ValueError(bad[0].said)
    kinds = {s: pa.int32() if np.dtype(k).itemsize < 4 else pa.int64() for s, k in of.items()}
    names = ["tokens", *streams]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(_read(f"{r['name']}.len", r["first"] * width, r["n"] * width), lengths).astype(np.int64)
                ends = np.cumsum(n)
                at = 0
                while at < len(n):
                    before = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, before + BATCH // 8, side="right")))
                    count, start = int(ends[to - 1]) - before, r["start"] + before
                    offsets = pa.array(np.append(0, ends[at:to] - before), pa.int32())
                    lists = []
                    for suffix, kind in of.items():
                        w = np.dtype(kind).itemsize
                        values = np.frombuffer(_read(f"{r['name']}.{suffix}", start * w, count * w), kind)
                        lists.append(pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64), kinds[suffix])))
                    yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * (to - at)), pa.array(np.arange(at, to) + r["first"]), *lists], names=["name", "doc", *names])
                    at = to

    listed = ", ".join(f"`{c}` array<{'int' if kinds[s] == pa.int32() else 'bigint'}>" for c, s in zip(names, of, strict=True))
    return blocks.drop("tokens").repartition("name", "block").mapInArrow(rows, f"name string, doc long, {listed}")


def write_packed(df: DataFrame, path: str, order: list[str], tokens: str = "tokens", codes: str = CODES, lengths: str = LENGTHS, streams: dict[str, str] | None = None) -> DataFrame:
    """One set of files a range of the order, named by it, so that sets by name and documents in them are in that order; returns name,
    docs, tokens, longest. streams: of columns, suffix and type in one. Codes or lengths that don't fit their type, and streams of another
    length than their tokens, are a ValueError. A set gets its final names when it is whole."""
    streams = streams or {}
    of = {tokens: ("bin", codes), **{c: (c, k) for c, k in streams.items()}}
    part = free("_part", df)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).select(part, *of)

    def whole(a: pa.Array, kind: str) -> np.ndarray:
        v = a.to_numpy(zero_copy_only=False).astype(np.int64) if len(a) else np.empty(0, np.int64)
        if a.null_count or len(v) and (v.min() < np.iinfo(kind).min or v.max() > np.iinfo(kind).max):
            raise ValueError(f"values don't fit {np.dtype(kind)}")
        return v.astype(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, fs, own, name, docs, total, longest = {}, None, uuid.uuid4().hex, None, 0, 0, 0
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if name is None:
                    name = f"{path.rstrip('/')}/{b.column(0)[0].as_py():06d}"
                    fs, at = archives.file_system(name)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    opened = {s: fs.open_output_stream(f"{at}.{own}.{s}.part", compression=None) for s in ("len", *(s for s, _ in of.values()))}
                n = None
                for column, (suffix, kind) in of.items():
                    a = b.column(b.schema.get_field_index(column))
                    sizes = np.array([0 if x is None else len(x) for x in a], np.int64)
                    if n is None:
                        n = sizes
                        opened["len"].write(whole(pa.array(n), lengths).tobytes())
                    elif (sizes != n).any():
                        raise ValueError(f"{column} has another length than {tokens}")
                    opened[suffix].write(whole(a.flatten(), kind).tobytes())
                docs, total, longest = docs + len(n), total + int(n.sum()), max(longest, int(n.max()))
        finally:
            for f in opened.values():
                f.close()
        if name is not None:
            for suffix in opened:
                fs.move(f"{at}.{own}.{suffix}.part", f"{at}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (docs, total, longest))], names=["name", "docs", "tokens", "longest"])

    return storage.cut(ranged.mapInArrow(write, "name string, docs long, tokens long, longest long"), "packed")
