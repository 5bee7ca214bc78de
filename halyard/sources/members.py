"""Single members of archives. An index tells where each member lies: it is made in one pass over the headers of plain tar and zip files,
whose contents are skipped, and a member is then read by its range of bytes. Compressed tar files have no ranges; theirs are streamed once
each, for all members that are wanted of them, up to the last of these."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from halyard.names import free
from halyard.operators import relational
from halyard.sources import archives

#: Bytes of an archive whose members one task reads, and of the rows of a batch that it gives out.
SPLIT, BATCH = 64 << 20, 8 << 20
INDEX = "archive string, member string, place long, at long, size long, packed long, form string, error string"
_INDEX = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("packed", pa.int64()), ("form", pa.string()), ("error", pa.string())])
_ZIP = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}
DAMAGE = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError)


def _open(uri: str, seeks: bool) -> archives.Reads | None:
    fs, path = archives.file_system(uri)
    if not fs.get_file_info(path).is_file:
        return None
    return archives.Reads(fs.open_input_file(path) if seeks else fs.open_input_stream(path, compression=None))


def entries(uri: str) -> Iterator[tuple]:
    """Rows of INDEX for the files in an archive, in order. form: plain, stored, deflated or stream. A damaged archive's last row has no
    member and says what is wrong; an archive that isn't there has no rows."""
    plain, zipped = uri.endswith(".tar"), uri.endswith(".zip")
    opened = _open(uri, plain or zipped)
    if opened is None:
        return
    place = 0
    try:
        with opened as f:
            if zipped:
                with zipfile.ZipFile(f) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield uri, m.filename, place, m.header_offset, m.file_size, m.compress_size, _ZIP.get(m.compress_type, "unknown"), None
                            place += 1
            else:
                with tarfile.open(fileobj=io.BufferedReader(f), mode="r:" if plain else "r|*") as t:
                    for m in t:
                        if m.isfile():
                            yield uri, m.name, place, m.offset_data if plain else None, m.size, m.size, "plain" if plain else "stream", None
                            place += 1
    except DAMAGE as e:
        yield uri, None, place, None, None, None, None, f"{type(e).__name__}: {e}"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


class _IndexReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [archives.Archive(u) for u in archives.list_files(self.path, (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".zip"))]

    def read(self, partition: archives.Archive) -> Iterator[tuple]:
        yield from entries(partition.uri)


class IndexSource(DataSource):
    """spark.read.format("archive_index").load(path): INDEX of all archives at path, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: StructType) -> _IndexReader:
        return _IndexReader(self.options["path"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(IndexSource)
    return spark.read.format("archive_index").load(path)


def index_of(named: DataFrame, archive: str) -> DataFrame:
    """INDEX of the archives that a column names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for row in entries(uri):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _rows(rows, _INDEX)
                        rows = []
                yield _rows(rows, _INDEX)

    names = named.select(F.col(archive).alias("archive")).where("archive is not null").distinct()
    return relational.spread(names, "archive").mapInArrow(each, INDEX)  # names are a few bytes, their archives many


def member_bytes(f: io.RawIOBase, at: int, size: int, packed: int, form: str) -> bytes:
    """A member's bytes by its entry; ValueError if the archive isn't the one that was indexed."""
    f.seek(at)
    if form != "plain":
        head = f.read(30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no member starts there")
        f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    if form not in ("plain", "stored", "deflated"):
        raise ValueError("a member of an unknown compression")
    data = _exactly(f, packed)
    return zlib.decompress(data, -15) if form == "deflated" else data


def _exactly(f: io.RawIOBase, n: int) -> bytes:
    parts = []
    while n:
        part = f.read(n)
        if not part:
            raise ValueError("the archive is shorter than its index says")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


_CONTENT = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])


def _batched(rows: Iterator[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH:
            yield _rows(held, _CONTENT)
            held, size = [], 0
    if held:
        yield _rows(held, _CONTENT)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by archive and place in it, so each archive is opened once."""

    def rows() -> Iterator[tuple[str, str, bytes]]:
        now, f = None, None
        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["archive"] != now:
                        if f is not None:
                            f.close()
                        now, f = r["archive"], _open(r["archive"], True)
                    if f is None:
                        raise archives.StorageError(f"{now} is gone")
                    yield now, r["member"], member_bytes(f, r["at"], r["size"], r["packed"], r["form"])
        finally:
            if f is not None:
                f.close()

    return _batched(rows())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by archive and place: of each archive the wanted places are gathered, then met in one stream."""

    def meet(uri: str, wanted: dict[int, str]) -> Iterator[tuple[str, str, bytes]]:
        last = max(wanted)
        with _open(uri, False) as f, tarfile.open(fileobj=io.BufferedReader(f), mode="r|*") as t:
            for place, m in enumerate(m for m in t if m.isfile()):
                if place in wanted:
                    yield uri, wanted[place], t.extractfile(m).read()
                if place >= last:
                    return

    def rows() -> Iterator[tuple[str, str, bytes]]:
        now, wanted = None, {}
        for b in batches:
            for uri, member, place in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("archive", "member", "place")), strict=True):
                if uri != now and wanted:
                    yield from meet(now, wanted)
                    wanted = {}
                now = uri
                wanted[place] = member
        if wanted:
            yield from meet(now, wanted)

    return _batched(rows())


def lookup(wanted: DataFrame, index: DataFrame, archive: str = "archive", member: str = "member", into: str = "content", basename: bool = False) -> DataFrame:
    """wanted with the bytes of each row's member, null where there is none. Of members with one name in an archive the last counts.
    basename: a name that no member has finds the last one whose name ends with it after a slash. Each wanted member is read once, whoever
    wants it; a hot archive is read by as many tasks as it has SPLITs."""
    uri, name, found = (free(c, wanted) for c in ("_archive", "_member", "_content"))
    keys = wanted.select(F.col(archive).cast("string").alias("archive"), F.col(member).cast("string").alias("name")).where("archive is not null and name is not null").distinct()
    entry = F.struct("member", "place", "at", "size", "packed", "form")
    sound = index.where("error is null")
    by_name = sound.groupBy("archive", F.col("member").alias("name")).agg(F.max_by(entry, "place").alias("e"))
    met = keys.join(by_name, ["archive", "name"], "left")
    if basename:
        short = sound.where(F.col("member").contains("/")).groupBy("archive", F.substring_index("member", "/", -1).alias("name")).agg(F.max_by(entry, "place").alias("b"))
        met = met.join(short, ["archive", "name"], "left").withColumn("e", F.coalesce("e", "b"))
    met = met.where("e is not null").select("archive", "name", "e.*")
    each = met.select("archive", "member", "place", "at", "size", "packed", "form").distinct()
    content = "archive string, member string, content binary"
    ranged = relational.spread(each.where("form <> 'stream'"), "archive", F.floor(F.col("at") / SPLIT)).sortWithinPartitions("archive", "at").mapInArrow(_fetched, content)
    streamed = relational.spread(each.where("form = 'stream'"), "archive").sortWithinPartitions("archive", "place").mapInArrow(_streamed, content)
    read = met.select("archive", "name", "member").join(ranged.unionByName(streamed), ["archive", "member"])
    read = read.select(F.col("archive").alias(uri), F.col("name").alias(name), F.col("content").alias(found))
    joined = wanted.join(read, (F.col(archive).cast("string") == F.col(uri)) & (F.col(member).cast("string") == F.col(name)), "left")
    return joined.drop(uri, name).withColumn(into, F.col(found)).drop(found)


def read_files(named: DataFrame, path: str) -> DataFrame:
    """file, content of the files that a column names; those that aren't there have no row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, str, bytes]]:
            for b in batches:
                for uri in b.column(0).to_pylist():
                    f = _open(uri, False)
                    if f is not None:
                        with f:
                            yield uri, "", f.readall()

        for b in _batched(rows()):
            yield b.rename_columns(["file", "member", "content"]).select(["file", "content"])

    return relational.spread(named.select(F.col(path).alias("file")).where("file is not null").distinct(), "file").mapInArrow(each, "file string, content binary")


def text_of(content: Column) -> Column:
    """UTF-8 text; what is no UTF-8 becomes the replacement character."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


def resolve(df: DataFrame, into: str = "text", inline: str = "pdb", path: str = "path", zipped: str = "zip", tarred: str = "tar", member: str = "member") -> DataFrame:
    """df with each record's structure text, from the first of these that it has: the text itself, a file, a member of a zip or of a
    tar file. What is missing gives null, as do columns that df lacks; an archive's damage hides only what comes after it."""
    has = {c.lower() for c in df.columns}
    of = lambda c: F.col(c).cast("string") if c.lower() in has else F.lit(None).cast("string")
    uri, file, packed = (free(c, df) for c in ("_uri", "_file", "_packed"))
    rows = df.withColumns({file: F.when(of(inline).isNull(), of(path)), uri: F.when(of(inline).isNull() & of(path).isNull(), F.coalesce(of(zipped), of(tarred)))})
    if member.lower() in has:
        rows = lookup(rows, index_of(rows, uri), uri, member, packed)
    else:
        rows = rows.withColumn(packed, F.lit(None).cast("binary"))
    files = read_files(rows, file).select(F.col("file").alias(f"{file}_"), F.col("content").alias(f"{file}_content"))
    rows = rows.join(files, F.col(file) == F.col(f"{file}_"), "left")
    text = F.coalesce(of(inline), text_of(F.col(f"{file}_content")), text_of(F.col(packed)))
    return rows.withColumn(into, text).select(*df.columns, into)
