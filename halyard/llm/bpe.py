"""Byte-level BPE by a global distinct-word shuffle. Texts are split into pre-tokens; each distinct one is encoded once and its ids
go back to every place it stands at.

Texts are split once. A chapter (some texts of one task, bounded by text and by distinct pre-tokens) is written as its distinct
pre-tokens and, for each slice of texts, their numbers in order of place; the table is bucketed by chapter, so that this bulk never
moves again. The distinct pre-tokens go, packed, to the bucket of their hash, where one task encodes each once for the whole corpus;
a frequent pre-token arrives once a chapter, not once a place. The ids come back to the chapter, whose slices are reassembled one
after the other. Decoding joins the ids with the table of token bytes.

Everything after the split reads the written table, so a task that runs again reads the same rows whatever the order of the input.
Numbers of buckets and partitions follow the written amounts.

Defined cases: null text is the empty text, without ids; repeated rows give repeated rows; an empty table gives an empty table;
columns other than the two named are not carried; a text longer than a slice stands alone and is numbered match by match.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common

#: Bytes of text that are split at a time; of a chapter's text, and its distinct pre-tokens, about.
SLICE_BYTES, CHAPTER_BYTES, CHAPTER_WORDS = 1 << 20, 32 << 20, 300_000
#: Distinct pre-tokens of chapters in a bucket; bytes of packed ones in a partition; bytes of text in a partition of chapters.
BUCKET_WORDS, PART_BYTES, PARTITION_BYTES = 100_000, 16 << 20, 256 << 20
#: Distinct pre-tokens that a part of a chapter holds on average, at least.
PART_WORDS = 64
#: Pre-tokens that are put together at a time.
PIECE = 1 << 18


@functools.cache
def splitter() -> regex.Pattern:
    """The public pattern; white space as Unicode has it, whichever the library's own shorthand."""
    inside = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}")
    return regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@functools.cache
def encoding(rank_path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding of a rank file, and the bytes of each id."""
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding(rank_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), table


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers under 2**28 as 1 to 4 bytes each, seven bits a byte, compressed."""
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        some = size > k
        out[at[some] + k] = ((x[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    return zlib.compress(out.tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(data), np.uint8)
    last = b < 128
    at = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(b) else np.empty(0, np.int64)
    place = np.arange(len(b)) - np.repeat(at, np.diff(np.append(at, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), at) if len(b) else np.empty(0, np.int64)


def pack_words(words: Iterable[str | bytes]) -> bytes:
    raw = [w.encode() if isinstance(w, str) else w for w in words]
    return zlib.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 1)


def unpack_words(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data[:4], "<u4")[0])
    ends = np.cumsum(np.frombuffer(data[4 : 4 + 4 * n], "<u4")) + 4 + 4 * n
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))


def number(texts: list[str | None], own: defaultdict[str, int]) -> tuple[list[int], np.ndarray]:
    """How many pre-tokens each text has, and their numbers in the dictionary, which grows."""
    find, counts, numbers = splitter(), [], [np.empty(0, np.int64)]
    for text in texts:
        text = text or ""
        words = find.findall(text) if len(text) <= SLICE_BYTES else (m[0] for m in find.finditer(text))
        numbers.append(np.fromiter(map(own.__getitem__, words), np.int64))
        counts.append(len(numbers[-1]))
    return counts, np.concatenate(numbers)


def written_chapters(docs: DataFrame, partitions: int) -> DataFrame:
    """key (of the chapter); ids, counts, numbers of a slice of documents; words, n_words of the chapter, in a row of its own."""
    kind = dict(docs.dtypes)["id"]
    names = ["key", "ids", "counts", "numbers", "words", "n_words"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, id_type = TaskContext.get().partitionId() << 32, 0, None
        fresh = lambda: defaultdict(itertools.count().__next__)
        own: defaultdict[str, int] = fresh()
        kinds = [pa.int64(), None, pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]

        def row(*values: object) -> pa.RecordBatch:
            kinds[1] = pa.list_(id_type)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((key, *values), kinds, strict=True)], names=names)

        for b in batches:
            id_type = b.schema.field(0).type
            for s in common.slices(b, "text", SLICE_BYTES):
                counts, numbers = number(s.column(1).to_pylist(), own)
                yield row(s.column(0).to_pylist(), counts, pack_numbers(numbers), None, None)
                held += s.nbytes
                if held >= CHAPTER_BYTES or len(own) >= CHAPTER_WORDS:
                    yield row(None, None, None, pack_words(own), len(own))
                    key, held, own = key + 1, 0, fresh()
            common.release()
        if held:
            yield row(None, None, None, pack_words(own), len(own))
        del own
        common.release()

    made = docs.mapInArrow(split, f"key long, ids array<{kind}>, counts array<long>, numbers binary, words binary, n_words long")
    return common.cut_in_buckets(made, "bpe", "key", partitions)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str = "", keep_ids: bool = True) -> DataFrame:
    """For each row: id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 and, with keep_ids, its ids."""
    rank_path = rank_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kind = dict(df.dtypes)[id_col]
    docs = common.small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(least, -(-text_bytes // PARTITION_BYTES))
    chapters = written_chapters(docs, partitions)
    total = chapters.agg(F.sum("n_words"), F.sum(F.octet_length("words")), F.max("n_words")).first()
    # a chapter's words go to so many buckets that a part of one still holds PART_WORDS on average
    buckets = max(1, min(-(-(total[0] or 0) // BUCKET_WORDS), -(-(total[2] or 0) // PART_WORDS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = unpack_words(packed.as_py())
                of = buckets_of(words, buckets)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(of[order]) > 0)) if len(words) else order
                parts = [pack_words([words[i] for i in order[a:z]]) for a, z in zip(cuts, [*cuts[1:], len(words)], strict=True)] if len(words) else []
                yield pa.RecordBatch.from_arrays([pa.array(of[order[cuts]], pa.int32()), pa.array([key] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "key", "words"])
            common.release()

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(rank_path)
        known: dict[bytes, list[int]] = {}
        now = None
        for b in batches:
            out = []
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                sizes, flat = [], []
                for w in unpack_words(packed.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = enc._encode_single_piece(w)
                    sizes.append(len(ids))
                    flat += ids
                out.append(pack_numbers(np.array([len(sizes), *sizes, *flat], np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["bucket", "key", "ids"])
        del known
        common.release()

    def ids_of_words(waiting: pa.Table, came: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pre-token of the chapter where its ids start, how many they are; and all ids."""
        packed = next(w for w in waiting.column("words") if w.is_valid)
        own = buckets_of(unpack_words(packed.as_py()), buckets)
        start, size, flat, shift = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), [np.empty(0, np.int64)], 0
        for bucket, ids in zip(came.column("bucket").to_pylist(), came.column("ids"), strict=True):
            x = unpack_numbers(ids.as_py())
            mine = np.flatnonzero(own == bucket)
            size[mine] = x[1 : 1 + x[0]]
            start[mine] = shift + np.cumsum(size[mine]) - size[mine]
            flat.append(x[1 + x[0] :])
            shift += len(flat[-1])
        return start, size, np.concatenate(flat).astype("<u4")

    def reassemble(waiting: pa.Table, came: pa.Table) -> pa.Table:
        table = encoding(rank_path)[1]
        start, size, flat = ids_of_words(waiting, came)
        out = []
        for ids, counts, packed in zip(*(waiting.column(c) for c in ("ids", "counts", "numbers")), strict=True):
            if not packed.is_valid:
                continue
            numbers, at, rows = unpack_numbers(packed.as_py()), 0, []
            for count in counts.as_py():
                n_tokens, coded, plain, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for a in range(at, at + count, PIECE):  # a long text piece by piece
                    n = numbers[a : min(a + PIECE, at + count)]
                    ends = np.cumsum(size[n])
                    x = flat[np.arange(ends[-1]) - np.repeat(ends - size[n] - start[n], size[n])]
                    n_tokens += len(x)
                    coded.update(x.tobytes())
                    plain.update(decode(x, table))
                    if keep_ids:
                        kept.append(x.astype(np.int32))
                at += count
                rows.append((n_tokens, coded.hexdigest(), plain.hexdigest()) + (np.concatenate([*kept, np.empty(0, np.int32)]),) * keep_ids)
            out.append(pa.Table.from_arrays([ids.values, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names))
        common.release()
        return pa.concat_tables(out)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids
    spread = max(least, -(-(total[1] or 0) // PART_BYTES))
    sent = chapters.where("words is not null").select("key", "words").mapInArrow(send, "bucket int, key long, words binary")
    came = sent.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_words, "bucket int, key long, ids binary")
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return chapters.select("key", "ids", "counts", "numbers", "words").groupBy("key").cogroup(came.groupBy("key")).applyInArrow(reassemble, schema)


def op6_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), keep_ids=False)
