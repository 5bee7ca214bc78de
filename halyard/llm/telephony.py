"""Media columns: telephony audio. Payload bytes are stored as mu-law, A-law or IMA ADPCM data in WAVE files, a column of a written
table. What is read back from there is parsed, expanded by lookup tables (ADPCM: numpy across all blocks of a slice, one step a nibble)
and resampled to PCM, a column of the result.

Defined cases: null text is the empty text; the empty text is one unit of 576 filler bytes; repeated rows give repeated rows; an
empty table gives an empty table; columns other than the two named are not carried. Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common

UNIT, FILLER, RATE, BLOCK = 576, b"\xff", 8000, 288
CODECS = ("mulaw", "alaw", "ima_adpcm")

# WAVE format tags of the three codecs.
FORMAT_TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
# Step sizes and index moves of IMA ADPCM.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM value of each of the 256 mu-law codes, from the rule of G.711."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each of the 256 A-law codes, from the rule of G.711."""
    a = np.arange(256) ^ 0x55
    segment, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor, and 16 times the next index, for each 16 * index + nibble."""
    step = np.array(IMA_STEPS)[:, None]
    n = np.arange(16)[None, :]
    size = (step >> 3) + np.where(n & 1, step >> 2, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 4, step, 0)
    index = np.clip(np.arange(len(IMA_STEPS))[:, None] + np.array(IMA_MOVES)[n & 7], 0, len(IMA_STEPS) - 1)
    return np.where(n & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}
IMA_CHANGE, IMA_NEXT = ima_tables()


def decode_ima(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """PCM of whole IMA ADPCM mono blocks, (blocks, samples a block); all blocks advance together. An index over 88 counts as 88."""
    blocks = data.reshape(-1, block)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * body.shape[0] + 1, len(blocks)), np.int16)
    out[0] = head
    for k, byte in enumerate(body):
        for half, nibble in ((1, byte & 15), (2, byte >> 4)):
            key = at + nibble
            head = np.clip(head + IMA_CHANGE[key], -32768, 32767)
            at = IMA_NEXT[key]
            out[2 * k + half] = head
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    x = pcm.astype(np.int32)
    nxt = np.append(x[1:], x[-1])
    if to == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[::2] = pcm
        out[1::2] = (x + nxt) >> 1
        return out
    place = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    i, part = place // to, place % to
    return (x[i] + ((nxt[i] - x[i]).astype(np.int64) * part) // to).astype(np.int16)


def wave(codec: str, payload: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A WAVE file with the payload as its data chunk."""
    adpcm = codec == "ima_adpcm"
    per_block = (block - 4) * 2 + 1
    speed = rate * block // per_block if adpcm else rate
    fmt = struct.pack("<HHIIHH", FORMAT_TAGS[codec], 1, rate, speed, block if adpcm else 1, 4 if adpcm else 8) + (struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0))
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(fmt) + len(data), b"WAVE", b"fmt ", len(fmt)) + fmt + data


def parse_wave(media: bytes | pa.Buffer) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block size and data chunk of such a file; walks the chunks."""
    view, at, found = memoryview(media), 12, {}
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    while at + 8 <= len(view):
        kind, size = struct.unpack_from("<4sI", view, at)
        found[kind] = view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    return {v: k for k, v in FORMAT_TAGS.items()}[tag], rate, block, found[b"data"]


def codec_of(payload_sha256: str) -> str:
    return CODECS[int(payload_sha256[:8], 16) % len(CODECS)]


def features(codec: str, pcm: np.ndarray, rate: int) -> str:
    """codec;rate;samples;peak;root mean square;sign changes, all whole numbers."""
    x = pcm.astype(np.int64)
    peak = int(max(x.max(), -x.min())) if len(x) else 0
    rms = int(np.sqrt(float(np.dot(x, x)) / len(x))) if len(x) else 0
    s = pcm < 0
    return f"{codec};{rate};{len(x)};{peak};{rms};{int(np.count_nonzero(s[1:] != s[:-1]))}"


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the WAVE file), written to the shared folder: what comes back is read from there."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, waves = [], []
        for text in batch.column(1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            payload = raw + FILLER * (-len(raw) % UNIT if raw else UNIT)
            sizes.append(len(raw))
            waves.append(wave(codec_of(hashlib.sha256(payload).hexdigest()), payload))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(waves, pa.binary())], names=["id", "n_bytes", "media"])

    rows = common.small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    return common.cut(rows.mapInArrow(common.in_slices(one, "_text"), f"id {dict(df.dtypes)[id_col]}, n_bytes long, media binary"), "media")


def telephony_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_rate: int = 16000, keep_media: bool = True) -> DataFrame:
    """A row for each row of df: its id and the digests, sizes and features of its stored and decoded audio; with keep_media also
    media (the WAVE file of codes) and pcm (little-endian 16-bit samples at out_rate)."""
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm_bytes long, pcm_sha256 string, feature string" + (", media binary, pcm binary" if keep_media else "")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        waves = [m.as_buffer() for m in batch.column(2)]
        read = [parse_wave(m) for m in waves]
        coded = [k for k, r in enumerate(read) if r[0] == "ima_adpcm"]
        pcm: dict[int, np.ndarray] = {}
        if coded:
            all_blocks = decode_ima(np.concatenate([np.frombuffer(read[k][3], np.uint8) for k in coded]), read[coded[0]][2])
            at = 0
            for k in coded:
                n = len(read[k][3]) // read[k][2]
                pcm[k] = all_blocks[at : at + n].ravel()
                at += n
        rows, sounds = [], []
        for k, (codec, rate, _, data) in enumerate(read):
            samples = pcm[k] if k in pcm else EXPAND[codec][np.frombuffer(data, np.uint8)]
            out = np.ascontiguousarray(resample(samples, rate, out_rate))
            sound = out.astype("<i2", copy=False).tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(waves[k]), hashlib.sha256(waves[k]).hexdigest(), codec, len(sound), hashlib.sha256(sound).hexdigest(), features(codec, out, out_rate)))
            if keep_media:
                sounds.append(sound)
        cols = [batch.column(0), batch.column(1), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True))]
        cols += [batch.column(2), pa.array(sounds, pa.binary())] if keep_media else []
        return pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "pcm_bytes", "pcm_sha256", "feature"] + ["media", "pcm"] * keep_media
    return store_media(df, id_col, text_col).mapInArrow(common.in_slices(one, "media"), schema)


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony_columns(common.table(spark, sf_dir, "documents"), keep_media=False)
