"""Data source "archive": members of tar (plain, gzip, bzip2) and zip files as rows. One partition an archive; equality and IN filters
on member are pushed down, so other members are never unpacked and reading stops once all wanted ones are found."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def list_files(uri: str, suffixes: tuple[str, ...]) -> list[str]:
    """Addresses of the files at or under uri, sorted."""
    fs, path = file_system(uri)
    info = fs.get_file_info(path)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    lead = uri.removesuffix(path.lstrip("/")).rstrip("/") if uri.endswith(path.lstrip("/")) else ""
    return sorted(f"{lead}/{f.path.lstrip('/')}" for f in found if f.is_file and f.path.endswith(suffixes))


class StorageError(RuntimeError):
    """The file system, not the archive, is at fault."""


class Reads(io.RawIOBase):
    """A file whose failed reads can't be taken for a damaged archive."""

    def __init__(self, of: pyarrow.NativeFile):
        self.of = of

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return self.of.seekable()

    def _do(self, what: str, *args: int) -> object:
        try:
            return getattr(self.of, what)(*args)
        except OSError as e:
            raise StorageError(str(e)) from e

    def readinto(self, buffer: bytearray) -> int:
        data = self._do("read", len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self._do("seek", offset, whence)

    def tell(self) -> int:
        return self._do("tell")

    def close(self) -> None:
        if not self.closed:
            super().close()
            self.of.close()


def members(uri: str, wanted: set[str] | None, unpack: bool) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) in order. A damaged archive ends where it is damaged; what was read stays. What the file system refuses is an error,
    so that the task runs again. unpack: .gz members are unzipped; one that can't be is passed over."""
    left = None if wanted is None else set(wanted)
    fs, path = file_system(uri)
    opened = Reads(fs.open_input_file(path) if path.endswith(".zip") else fs.open_input_stream(path, compression=None))
    try:
        if path.endswith(".zip"):
            with opened as f, zipfile.ZipFile(f) as z:
                each = ((n, lambda n=n: z.read(n)) for n in z.namelist() if not n.endswith("/"))
                yield from _chosen(each, left, unpack)
        else:
            with opened as f, tarfile.open(fileobj=io.BufferedReader(f), mode="r|*") as t:
                each = ((m.name, lambda m=m: t.extractfile(m).read()) for m in t if m.isfile())
                yield from _chosen(each, left, unpack)
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, ValueError):  # pyarrow's errors of position are ValueErrors
        return


def _chosen(each: Iterator, left: set[str] | None, unpack: bool) -> Iterator[tuple[str, bytes]]:
    for name, read in each:
        if left is not None and name not in left:
            continue
        data = read()
        if unpack and name.endswith(".gz"):
            try:
                data = gzip.decompress(data)
            except (OSError, EOFError):
                continue
        yield name, data
        if left is not None:
            left.discard(name)
            if not left:
                return


class Archive(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, unpack: bool):
        self.path, self.unpack, self.wanted = path, unpack, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("member",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Archive(u) for u in list_files(self.path, (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".zip"))]

    def read(self, partition: Archive) -> Iterator[tuple[str, str, bytes]]:
        for name, data in members(partition.uri, self.wanted, self.unpack):
            yield partition.uri, name, data


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(path): archive, member, content. Option unpack (true): unzip .gz members."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("unpack", "true").lower() == "true")
