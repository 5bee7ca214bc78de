"""WARC: chunked record table. Pages are written as WARC records with repeated payloads as revisits, one archive a task in the
shared folder; reading streams each archive as rows of record identifier and chunk number that carry the payload's length and digest
up to that chunk, so no record is ever whole in a reader's memory.

Defined cases: null html is the empty payload; payloads under min_revisit bytes are all responses; of equal payloads every row with
the smallest id is a response (all of them where no row has an id), the others revisit it; a null url writes no target; a null id
reads back as null; an empty table gives an empty table; columns other than those named are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common

CHUNK, ROLL, MIN_REVISIT = 1 << 18, 256 << 20, 100
DATE = "2000-01-01T00:00:00Z"
# Fixed value: profile of revisit records whose payload digest is that of an earlier record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, ID_END = "<urn:page:", ">"


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder's or file's address."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """id, url, digest, bytes, refers_to (null for responses) and html (null for revisits)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = common.small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    again = rows.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # written out, so that the planner knows their size: few repeated digests go to the payloads, not the payloads to them
    again = common.cut(again, "repeated")
    refers = F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(again, "digest", "left").select("id", "url", "digest", "bytes", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))


def record_head(rid: str, url: str | None, digest: str, size: int, refers_to: str | None) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {ID_PREFIX}{rid}{ID_END}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {ID_PREFIX}{refers_to}{ID_END}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}", "", ""]
    return "\r\n".join(lines).encode(), http


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, roll: int = ROLL) -> DataFrame:
    """Writes the archives and returns their manifest: archive, records. A task that runs again writes under a new name; only the
    archives in the manifest count."""
    rows = decide(pages, id_col, url_col, html_col, min_revisit)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(text("id").alias("id"), "url", "digest", "bytes", F.col("refers_to").cast("string").alias("refers_to"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, records, size = None, "", 0, 0
        fs, root = store(folder)

        def told() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["archive", "records"])

        for b in batches:
            ids, urls, digests, sizes, refers = (b.column(k).to_pylist() for k in range(5))
            for k, html in enumerate(b.column(5)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, records, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                head, http = record_head(ids[k], urls[k], digests[k], sizes[k], refers[k])
                out.write(head + http)
                size += len(head) + len(http) + 4
                if refers[k] is None:
                    payload = html.as_buffer()
                    for at in range(0, payload.size, CHUNK):
                        out.write(payload.slice(at, min(CHUNK, payload.size - at)))
                    size += payload.size
                out.write(b"\r\n\r\n")
                records += 1
                if size >= roll:
                    yield told()
                    out = None
        if out is not None:
            yield told()

    return common.cut(rows.mapInArrow(write, "archive string, records long"), "warc-manifest")


def read_records(stream: pa.NativeFile, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, int, bool]]:
    """(header, chunk number, bytes, digest so far, length so far, whether it is the last) of each record of an archive."""
    held = b""

    def line() -> bytes:
        nonlocal held
        while (k := held.find(b"\r\n")) < 0:
            more = stream.read(1 << 16)
            if not more:
                if held:
                    raise ValueError("archive ends within a record's header")
                return b""
            held += more
        out, held = held[: k + 2], held[k + 2 :]
        return out

    def take(n: int) -> bytes:
        nonlocal held
        out, held = held[:n], held[n:]
        if len(out) < n:
            out += stream.read(n - len(out))
        return out

    while first := line():
        if not first.startswith(b"WARC/"):
            raise ValueError("not the start of a WARC record")
        head = {}
        while (x := line()) not in (b"\r\n", b""):
            k, _, v = x.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        left = int(head["content-length"])
        while left and (x := line()):
            left -= len(x)
            if x == b"\r\n":
                break
            k, _, v = x.decode().partition(":")
            head[f"http {k.strip().lower()}"] = v.strip()
        digest, size, number = hashlib.sha256(), 0, 0
        while True:
            data = take(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("archive ends within a payload")
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield head, number, data, digest.hexdigest(), size, not left
            number += 1
            if not left:
                break
        if take(4) != b"\r\n\r\n":
            raise ValueError("no end of record")


def read_archives(manifest: DataFrame, keep_bytes: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: record_id, chunk_no, payload_bytes and payload_digest so far, is_last, record_type, refers_to,
    target_uri and, with keep_bytes, chunk. A revisit has one row, with the length and digest its header states. A payload that
    isn't its header's digest fails the read."""
    names = ["record_id", "chunk_no", "payload_bytes", "payload_digest", "is_last", "record_type", "refers_to", "target_uri"] + ["chunk"] * keep_bytes
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * keep_bytes

    def bare(x: str | None) -> str | None:
        return None if x is None else x.removeprefix(ID_PREFIX).removesuffix(ID_END)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, size = [], 0
                fs, path = store(uri)
                with fs.open_input_stream(path) as stream:
                    for head, number, data, digest, length, last in read_records(stream, chunk):
                        stated = head["warc-payload-digest"].removeprefix("sha256:")
                        revisit = head["warc-type"] == "revisit"
                        if revisit:
                            digest, length = stated, int(head["http content-length"])
                        elif last and digest != stated:
                            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                        rows.append((bare(head["warc-record-id"]), number, length, digest, last, head["warc-type"], bare(head.get("warc-refers-to")), head.get("warc-target-uri")) + (data,) * keep_bytes)
                        size += len(data)
                        if size >= 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "record_id string, chunk_no long, payload_bytes long, payload_digest string, is_last boolean, record_type string, refers_to string, target_uri string" + ", chunk binary" * keep_bytes
    return manifest.repartition(max(1, manifest.count())).select("archive").mapInArrow(read, schema)


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    chunks = read_archives(write_archives(pages, common.new_folder(spark, "warc")), keep_bytes=False)
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return chunks.where("is_last").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest, case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
  case when f.first <> coalesce(p.page_id, f.first - 1) then f.first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""
