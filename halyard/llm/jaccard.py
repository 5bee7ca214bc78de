"""N-gram Jaccard join by set relations: documents with the same shingle set are one class; classes are indexed by the rarest
shingles of their sets (prefix filter); an index list answers first for its smallest class (the pivot), and what the pivot shares
with every other class of the list decides most of the other pairs without their sets; the rest is met block by block, blocks of one
set size and position in the list being skipped together when that position rules a link out.

 1. sketch     counts of all shingles in a fixed number of buckets; any order of shingles is right, this one puts rare ones first
 2. index      per document: set size, class (64-bit sum of hashes, checked against a second sum) and prefix
 3. pivots     per shingle: the class that has least before it; each other class of the list is compared with it once, by position and
               parity bitmap, and where they don't rule it out on the sets
 4. relations  for y and z beside pivot p: |y & z| >= |y & p| + |z & p| - |p|, and
               |y & z| <= min(|y & p|, |z & p|) + min(|y \\ p|, |z \\ p|); pairs in one component by links to pivots are known
 5. blocks     the pairs left, from lists whose classes aren't all connected: a list's classes of about one size and position form
               a block, and two blocks are skipped together when no sizes and positions in them allow a link; else their pairs go
               through 4 and the bitmaps, and the few left are compared on the sets
 6. components of the links

Shingles are compared as 64-bit hashes. Counts at the hot end never meet in one task: lists are folded by partial aggregation and
expanded by a join that may be split. Two classes link when 100 * shared >= percent * union.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; fewer words than a shingle's are one shingle; no text or
no word is the empty set, linked with nothing; a null id counts as no id, and a component without any has a null id; repeated rows
are copies; an empty table gives an empty table; columns other than the two named are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common
from halyard.names import free
from halyard.operators import graph

SKETCH_BITS, SKETCH_PARTS, ROW_BITS, SLICE = 22, 64, 24, 1 << 19
#: Of the bitmap of repeated shingles: eight bits a shingle, within these powers of two (32 MB at most; a fuller one lets more through).
LEAST_TOKEN_BITS, MOST_TOKEN_BITS = 20, 28
#: Pairs of one pivot that go to a task, about.
DEALT = 256
#: Words of the parity bitmap in an index list and of the widest one of a set; classes in a block of an index list, and what its sizes and positions may differ by.
PARITY_WORDS, WIDEST_WORDS, BLOCK_CLASSES, SIZE_STEP, POSITION_STEPS = 4, 512, 2048, 1.05, 8
_U = np.uint64
_BASE, _STEP, _TAG = _U(0x100000001B3 | 1), _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, _U)


@dataclass(frozen=True)
class Rule:
    """words in a shingle; least Jaccard similarity in percent; seed of the hashes."""

    words: int = 5
    percent: int = 80
    seed: int = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(max(n, 4096) - 1, _BASE, _U))))
    return _powers


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    edges = offsets - offsets[0]
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    own = edges[:-1][edges[:-1] < edges[1:]]
    start[own] = inside[own]
    at = np.flatnonzero(start[inside])
    if not len(at):
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    letters = data[inside]
    size = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, size)
    value = (letters.astype(_U) + _U(1)) * powers(int(size.max()))[place]
    hashes = mix(np.add.reduceat(value, at) + size.astype(_U) * _TAG)
    return hashes, np.bincount(np.searchsorted(edges, np.flatnonzero(start), side="right") - 1, minlength=len(texts))


def shingle_sets(texts: pa.Array, rule: Rule) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = words_of(texts)
    k, n = rule.words, len(hashes)
    seed = mix(np.array([rule.seed + 1], _U) * _STEP)[0]
    rolled = np.zeros(n, _U)
    for j in range(k):
        rolled[: n - j] = mix(rolled[: n - j] * _STEP + hashes[j:] + seed) if j < n else rolled[: n - j]
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(rolled[end - count : end - k + 1]))
        elif count:
            whole = np.array([count], _U) * _TAG + seed
            for j in range(end - count, end):
                whole = mix(whole * _STEP + hashes[j : j + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, _U))
    return out


def sums(sets: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    some = np.flatnonzero(n)
    one, two = np.zeros(len(sets), _U), np.zeros(len(sets), _U)
    if len(some):
        flat = np.concatenate(sets)
        at = (np.cumsum(n) - n)[some]
        one[some], two[some] = np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat ^ _TAG), at)
    return one.view(np.int64), two.view(np.int64)


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set, whether an odd number of its shingles falls on each bit: two sets' bitmaps differ in at most as many bits as the
    sets have shingles that they don't share. About a bit a shingle, in words whose number is a power of two, so that a wider bitmap
    folds into a narrower one."""
    out = []
    for s in sets:
        words = min(WIDEST_WORDS, max(PARITY_WORDS, 1 << max(0, len(s) - 1).bit_length() >> 6))
        h = mix(s ^ _STEP)
        # the word by the hash's last bits, the bit in it by the first six: halves of the words fold onto each other
        odd = np.bincount((((h & _U(words - 1)) << _U(6)) | (h >> _U(58))).astype(np.int64), minlength=64 * words) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(_U))
    return out


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row (a hash that tells rows apart where it matters: of id and text), text."""
    text = F.col(text_col).cast("string")
    return common.small_batches(df).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"))


def sketch(rows: DataFrame, rule: Rule) -> np.ndarray:
    """How many shingles of the documents fall in each bucket (the hash's first bits), 2**31 - 1 at most."""
    most = np.iinfo(np.int32).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            for s in common.slices(b, "text", SLICE):
                np.add.at(total, (np.concatenate(shingle_sets(s.column(0), rule)) >> _U(64 - SKETCH_BITS)).astype(np.int64), np.int32(1))
        for k, part in enumerate(np.split(total, SKETCH_PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "counts"])
        del total
        common.release()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for b in batches:
            for x in b.column(1):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, most).astype(np.int32).tobytes()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    got = {r.part: r.counts for r in rows.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()}  # a fixed number of counters
    return np.frombuffer(b"".join(got[k] for k in range(SKETCH_PARTS)), np.int32) if got else np.zeros(1 << SKETCH_BITS, np.int32)


def index(rows: DataFrame, rule: Rule) -> DataFrame:
    """id, row, cid, check, n, prefix (rarest shingle first), parity."""
    spark = rows.sparkSession
    counts = spark.sparkContext.broadcast(sketch(rows, rule))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2), rule)
        n = np.array([len(s) for s in sets], np.int64)
        cid, check = sums(sets, n)
        first = []
        for s in sets:
            order = np.argsort(counts.value[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
            first.append(s[order[: prefix_length(len(s), rule.percent)]] if len(s) else s)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cid), pa.array(check), pa.array(n), lists(first), lists(parities(sets))], names=["id", "row", "cid", "check", "n", "prefix", "parity"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "row", "text").mapInArrow(common.in_slices(one, "text", SLICE), f"id {kind}, row long, cid long, check long, n long, prefix array<long>, parity array<long>")


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The keys' last bits as places of set bits; a fixed size. What it lets through by chance is sorted out by a join later."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            out = np.zeros((1 << bits) // 8, np.uint8) if out is None else out
            low = b.column(0).to_numpy() & ((1 << bits) - 1)
            np.bitwise_or.at(out, low >> 3, (128 >> (low & 7)).astype(np.uint8))
        for k, part in enumerate(np.split(out, SKETCH_PARTS) if out is not None else ()):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "bits"])

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) // 8 // SKETCH_PARTS, np.uint8)
        for b in batches:
            for x in b.column(1):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "bits"])

    got = {r.part: r.bits for r in keys.select(column).mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect()}  # a fixed number of bits
    return np.frombuffer(b"".join(got[k] for k in range(SKETCH_PARTS)), np.uint8) if got else np.zeros((1 << bits) // 8, np.uint8)


def passes(out: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    low = keys & ((1 << bits) - 1)
    return ((out[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1).astype(bool)


def sets_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """cid, shingles of the wanted classes (column cid), from one row of each."""
    chosen = common.cut(classes.join(wanted, "cid", "left_semi").select("cid", "row"), "wanted")
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(chosen, "row", ROW_BITS))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hit = passes(bits.value, batch.column(0).to_numpy(), ROW_BITS)
        if not hit.any():
            return None
        batch = batch.filter(pa.array(hit))
        sets = shingle_sets(batch.column(1), rule)
        cid, _ = sums(sets, np.array([len(s) for s in sets], np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid), lists(sets)], names=["row", "cid", "shingles"])

    made = rows.select("row", "text").mapInArrow(common.in_slices(one, "text", SLICE), "row long, cid long, shingles array<long>")
    return common.cut(made.join(chosen, ["row", "cid"], "left_semi").select("cid", "shingles"), "sets")


def dealt(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (p, cid, fan) with those columns of the rows (by cid) of both: c_p and c_cid for a column c. A pivot's pairs are dealt by
    the other class to 2**fan parts, and its row goes to each of them, so that no task gets all of a hot pivot's pairs."""
    fans = pairs.groupBy("p").agg(F.collect_set("fan").alias("fans"))  # a handful of powers
    beside = pairs.join(rows.select("cid", *(F.col(c).alias(f"{c}_cid") for c in columns)), "cid")
    pivot = rows.join(fans, F.col("cid") == F.col("p")).select("p", F.explode("fans").alias("fan"), *(F.col(c).alias(f"{c}_p") for c in columns))
    pivot = pivot.withColumn("part", F.explode(F.expr("sequence(0L, shiftleft(1L, fan) - 1)")))
    part = F.xxhash64("cid").bitwiseAND(F.expr("shiftleft(1L, fan) - 1"))
    return beside.withColumn("part", part).join(pivot, ["p", "fan", "part"]).drop("part")


def shared(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with shared, the size of the two classes' intersection."""
    left, right = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"_{c}")) for c in (a, b))
    return pairs.join(right, b).join(left, a).withColumn("shared", F.size(F.array_intersect(f"_{a}", f"_{b}")).cast("long")).drop(f"_{a}", f"_{b}")


def derived(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, n_a, n_b, p) with shared, from what a and b have more and less than the pivot p that they were compared with."""
    needed = pairs.select("p", F.col("a").alias("cid"), "fan").unionByName(pairs.select("p", F.col("b").alias("cid"), "fan")).distinct()
    apart = dealt(needed, sets, ["shingles"])
    apart = apart.select("p", "cid", F.array_except("shingles_cid", "shingles_p").alias("more"), F.array_except("shingles_p", "shingles_cid").alias("less")).distinct()
    apart = common.cut(apart, "apart")
    of = lambda c: apart.select("p", F.col("cid").alias(c), F.col("more").alias(f"more_{c}"), F.col("less").alias(f"less_{c}"))
    n_p = F.col("n_a") + F.size("less_a") - F.size("more_a")
    both = n_p - F.size(F.array_union("less_a", "less_b")) + F.size(F.array_intersect("more_a", "more_b"))
    return pairs.join(of("a"), ["p", "a"]).join(of("b"), ["p", "b"]).select("a", "b", "n_a", "n_b", both.cast("long").alias("shared"))


def enough(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether an intersection of that size makes a link."""
    return both * (100 + percent) >= (n_a + n_b) * percent


def lead(pos: Column, cid: Column) -> Column:
    """Order in which classes lead an index list: by position, since a class with little that is rarer is likest to the others."""
    return F.shiftleft(pos.cast("long"), 44) + cid.bitwiseAND(F.lit((1 << 44) - 1))


def repeated(classes: DataFrame) -> DataFrame:
    """token, cid, n, pos and the list's pivot (p, n_p, pos_p) for every shingle that is in the prefixes of two classes or more. Most
    shingles are in one, and a bitmap of the others keeps theirs from the second shuffle."""
    posting = classes.select("cid", F.posexplode("prefix").alias("pos", "token"))
    heads = posting.groupBy("token").agg(F.count("*").alias("classes"), F.min(lead(F.col("pos"), F.col("cid"))).alias("lead")).where("classes > 1")
    heads = common.cut(heads, "heads")
    token_bits = min(MOST_TOKEN_BITS, max(LEAST_TOKEN_BITS, (8 * heads.count()).bit_length()))
    bits = classes.sparkSession.sparkContext.broadcast(bitmap(heads, "token", token_bits))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = b.column(3)
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            length = np.diff(prefix.offsets.to_numpy())
            hit = passes(bits.value, token, token_bits)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            owner = pa.array(np.repeat(np.arange(len(length)), length)[hit])
            narrow = lists([np.bitwise_xor.reduce(x.values.to_numpy().reshape(-1, PARITY_WORDS), axis=0) for x in b.column(2)])
            yield pa.RecordBatch.from_arrays([pa.array(token[hit]), b.column(0).take(owner), b.column(1).take(owner), narrow.take(owner), pa.array(pos[hit])], names=["token", "cid", "n", "parity", "pos"])

    some = classes.select("cid", "n", "parity", "prefix").mapInArrow(one, "token long, cid long, n long, parity array<long>, pos long")
    # both sides of the second join come from the first one's exchanges
    listed = some.join(heads, "token")
    pivot = listed.where(lead(F.col("pos"), F.col("cid")) == F.col("lead")).groupBy("token").agg(F.min(F.struct("cid", "n", "pos", "parity")).alias("h"))
    pivot = pivot.select("token", F.col("h.cid").alias("p"), F.col("h.n").alias("n_p"), F.col("h.pos").alias("pos_p"), F.col("h.parity").alias("parity_p"))
    return common.cut(listed.drop("lead").join(pivot, "token").where("cid <> p"), "listed")


def fold(bitmap: Column, words: Column) -> Column:
    """A parity bitmap folded to so many words."""
    return F.transform(F.sequence(F.lit(0), words - 1), lambda k: F.aggregate(F.sequence(k, F.size(bitmap) - 1, words), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.get(bitmap, i))))


def close(one: str, two: str, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether full parity bitmaps, which are a thirty-second of the sets, don't rule a link out."""
    words = F.least(F.size(one), F.size(two))
    apart = F.when(F.size(one) == F.size(two), differing(one, two)).otherwise(differing(fold(F.col(one), words), fold(F.col(two), words)))
    return apart <= most_apart(n_a, n_b, percent)


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, with sizes n_a and n_b) that the full parity bitmaps don't rule out."""
    left, right = (classes.select(F.col("cid").alias(c), F.col("parity").alias(f"_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").where(close("_a", "_b", F.col("n_a"), F.col("n_b"), percent)).drop("_a", "_b")


def reachable(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether two sets can link whose first common shingle stands at those positions: nothing before it is common. A pair that links
    passes in the list of its first common shingle, whatever the lists of others say."""
    close = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return close & enough(F.least(n_a - pos_a, n_b - pos_b), n_a, n_b, percent)


def differing(a: str | Column, b: str | Column) -> Column:
    """Bits in which two parity bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, k: s + k)


def most_apart(n_a: Column, n_b: Column, percent: int) -> Column:
    """Shingles that two linked sets may not share: both sizes less twice the least intersection."""
    return n_a + n_b - 2 * F.ceil((n_a + n_b) * percent / (100 + percent))


def meet_blocks(met: DataFrame, percent: int) -> DataFrame:
    """a, b, n_a, n_b, sure, p for the pairs of two blocks that positions, relations to the pivot and parity bitmaps don't rule out; sure
    where the relations prove the link, p where both were compared with the pivot. A pair of blocks is compared as one array, some
    rows of it at a time."""
    names = ("cid", "n", "pos", "shared", "label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = ({c: v for c, v in zip((*names, "parity"), block(batch.column(k), row), strict=True)} for k in (1, 2))
                n_p, pivot, fan = (batch.column(k)[row].as_py() for k in (0, 3, 4))
                step = max(1, (1 << 16) // max(len(y["cid"]), 1))
                out = [part(n_p, {c: v[at : at + step] for c, v in x.items()}, y) for at in range(0, len(x["cid"]), step)]
                a, b, n_a, n_b, sure, told = (np.concatenate(c) for c in zip(*out, strict=True))
                if len(a):
                    by = [pa.array(np.full(len(a), pivot), mask=~told), pa.array(np.full(len(a), fan, np.int32))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (a, b, n_a, n_b, sure)), *by], names=["a", "b", "n_a", "n_b", "sure", "p", "fan"])

    def block(column: pa.Array, row: int) -> list[np.ndarray]:
        own = column[row].values
        return [pc.fill_null(own.field(c), -1).to_numpy(zero_copy_only=False) for c in names] + [own.field("parity").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARITY_WORDS)]

    def part(n_p: int, x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> list[np.ndarray]:
        n1, n2 = x["n"][:, None], y["n"][None, :]
        need = -(-(n1 + n2) * percent // (100 + percent))
        ok = (np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent) & (np.minimum(n1 - x["pos"][:, None], n2 - y["pos"][None, :]) >= need)
        ok &= (x["label"][:, None] != y["label"][None, :]) & (x["cid"][:, None] != y["cid"][None, :])
        s, t = x["shared"][:, None], y["shared"][None, :]
        told = (s >= 0) & (t >= 0)
        ok &= ~told | (np.minimum(s, t) + np.minimum(n1 - s, n2 - t) >= need)
        i, j = np.nonzero(ok)
        far = np.bitwise_count((x["parity"][i] ^ y["parity"][j]).view(_U)).sum(1, dtype=np.int64)
        near = far <= (n1 + n2 - 2 * need)[i, j]
        i, j = i[near], j[near]
        sure, told = (told & (s + t - n_p >= need))[i, j], told[i, j]
        a, b, n_a, n_b = x["cid"][i], y["cid"][j], x["n"][i], y["n"][j]
        swap = a > b
        return [np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b), sure, told]

    return met.mapInArrow(compare, "a long, b long, n_a long, n_b long, sure boolean, p long, fan int")


def links(rows: DataFrame, classes: DataFrame, rule: Rule, all_links: bool = False) -> DataFrame:
    """a, b: linked classes. Without all_links, links inside a component that others already connect may be missing."""
    percent = rule.percent
    listed = repeated(classes)
    star = listed.where(reachable(F.col("n_p"), F.col("pos_p"), F.col("n"), F.col("pos"), percent) & (differing("parity", "parity_p") <= most_apart(F.col("n_p"), F.col("n"), percent)))
    fan = F.greatest(F.lit(0), F.ceil(F.log2(F.col("classes") / DEALT))).cast("int")
    pairs = star.groupBy("p", "cid", F.col("n_p").alias("n_a"), F.col("n").alias("n_b")).agg(F.max(fan).alias("fan"))
    pairs = dealt(pairs, classes, ["parity"]).where(close("parity_p", "parity_cid", F.col("n_a"), F.col("n_b"), percent)).drop("parity_p", "parity_cid")
    pairs = common.cut(pairs, "pivots")
    pivot_sets = sets_of(rows, classes, pairs.select("cid").unionByName(pairs.select(F.col("p").alias("cid"))).distinct(), rule)
    both = F.size(F.array_intersect("shingles_p", "shingles_cid")).cast("long")
    first = dealt(pairs, pivot_sets, ["shingles"]).select("p", "cid", "n_a", "n_b", both.alias("shared"))
    first = common.cut(first.withColumn("linked", enough(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)), "first")
    told = first.where("linked").select(F.col("p").alias("a"), F.col("cid").alias("b"))

    # where the pivot has one class beside it there are no other pairs
    beside = listed.where("classes > 2").select("token", "classes", "p", "n_p", "cid", "n", "pos", "parity").join(first.select("p", "cid", "shared"), ["p", "cid"], "left")
    if all_links:
        beside = beside.withColumn("label", F.col("cid"))
    else:
        label = told.groupBy(F.col("b").alias("cid")).agg(F.min("a").alias("label"))
        again = label.select(F.col("cid").alias("label"), F.col("label").alias("higher"))
        label = label.join(again, "label", "left").select("cid", F.coalesce("higher", "label").alias("label"))
        beside = beside.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    size_step = F.floor(F.ln("n") / F.lit(float(np.log(SIZE_STEP))))
    position_step = F.floor(F.col("pos") * POSITION_STEPS / F.greatest(F.lit(1), F.col("n") * (100 - percent) / 100))
    salt = F.pmod("cid", F.ceil(F.col("classes") / BLOCK_CLASSES))
    block = (
        beside.groupBy("token", "n_p", "p", fan.alias("fan"), size_step.alias("n_step"), position_step.alias("pos_step"), salt.alias("salt"))
        .agg(F.collect_list(F.struct("cid", "n", "pos", "shared", "label", "parity")).alias("of"), *(f(c).alias(f"{k}_{c}") for c in ("n", "pos", "label") for k, f in (("lo", F.min), ("hi", F.max))))
    )
    x, y = block.alias("x"), block.alias("y")
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    (lo1, lo2), (hi1, hi2), (pos1, pos2) = of("lo_n"), of("hi_n"), of("lo_pos")
    once = F.struct("x.n_step", "x.pos_step", "x.salt") <= F.struct("y.n_step", "y.pos_step", "y.salt")
    differ = ~((F.col("x.lo_label") == F.col("y.hi_label")) & (F.col("x.hi_label") == F.col("y.lo_label")))
    # no pair of the blocks can do better than the largest sizes with the least positions, nor need less than the smallest sizes
    skip_none = (F.least(hi1, hi2) * 100 >= F.greatest(lo1, lo2) * percent) & enough(F.least(hi1 - pos1, hi2 - pos2), lo1, lo2, percent)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & once & differ & skip_none).select("x.n_p", F.col("x.of").alias("x"), F.col("y.of").alias("y"), "x.p", "x.fan")
    by = F.min(F.when(F.col("p").isNotNull(), F.struct("p", "fan"))).alias("by")  # of the pivots that both were compared with, one
    rest = common.cut(meet_blocks(met, percent).groupBy("a", "b", "n_a", "n_b").agg(F.max("sure").alias("sure"), by), "rest")
    out = told.unionByName(rest.where("sure").select("a", "b"))
    open_pairs = common.cut(near(rest.where("not sure").select("a", "b", "n_a", "n_b", "by.p", "by.fan"), classes, percent), "open")
    links_of = lambda compared: compared.where(enough(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    by_pivot, others = open_pairs.where("p is not null"), open_pairs.where("p is null").drop("p", "fan")
    if by_pivot.limit(1).count():
        out = out.unionByName(links_of(derived(by_pivot, pivot_sets)))
    if others.limit(1).count():
        sets = sets_of(rows, classes, others.select(F.col("a").alias("cid")).unionByName(others.select(F.col("b").alias("cid"))).distinct(), rule)
        out = out.unionByName(links_of(shared(others, sets, "a", "b")))
    return common.cut(out.distinct(), "links")


def prepare(df: DataFrame, id_col: str, text_col: str, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame, Rule]:
    """rows, found (of index()), classes (cid, n, row, least_id); with another seed should two sets ever share a class number."""
    rows = keyed(df, id_col, text_col)
    while True:
        found = common.cut(index(rows, rule), "index")
        classes = common.cut(found.where("n > 0").groupBy("cid", "check", "n").agg(F.min("row").alias("row"), F.min("id").alias("least_id"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")), "classes")
        if classes.count() == classes.select("cid").distinct().count():
            return rows, found, classes, rule
        rule = Rule(rule.words, rule.percent, rule.seed + 1)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between classes (class_a, class_b), and membership (id, class_id, n_shingles): the whole similarity join."""
    rows, found, classes, rule = prepare(df, id_col, text_col, rule or Rule())
    pairs = links(rows, classes, rule, all_links=True)
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), found.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.col("cid")).alias("class_id"), F.col("n").alias("n_shingles"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule | None = None) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links)."""
    rows, found, classes, rule = prepare(df, id_col, text_col, rule or Rule())
    root = graph.roots(links(rows, classes, rule))
    member = classes.join(root, classes["cid"] == root["node"], "left").select("cid", "least_id", F.coalesce("root", "cid").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = member.join(least, "root").select("cid", "component_id")
    joined = found.select("id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(named, "cid", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op2_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"), rule=Rule(words=3, percent=90))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule | None = None) -> DataFrame:
    """df without the rows that another of their group stands for: the row with the group's smallest id stays (of rows with that
    id, the one with the smallest hash). Rows without a word stay, each for itself."""
    rows, found, classes, rule = prepare(df, id_col, text_col, rule or Rule())
    root = graph.roots(links(rows, classes, rule))
    member = found.where("n > 0").select("cid", "id", "row").join(root, F.col("cid") == F.col("node"), "left").select("row", "id", F.coalesce("root", "cid").alias("root"))
    # the least (id, hash) of each group in two foldings, so that a group is never sorted; ids that are null come last
    least = member.groupBy("root").agg(F.min("id").alias("least_id"))
    stay = member.join(least, "root").where(F.col("id").eqNullSafe(F.col("least_id"))).groupBy("root", "id").agg(F.min("row").alias("row"))
    row, own = F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), free("_row", df)
    # by hash and id: two documents whose hashes are the same by chance don't decide for each other
    known = free("_id", df)
    stay = common.cut(stay.select("row", "id").unionByName(found.where("n = 0").select("row", "id").distinct()), "stay").select(F.col("row").alias(own), F.col("id").alias(known))
    marked = df.withColumn(own, row)
    kept = marked.join(stay, (marked[own] == stay[own]) & marked[id_col].eqNullSafe(stay[known]), "left_semi")
    if found.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1").limit(1).count():
        kept = kept.dropDuplicates([own, id_col, text_col])
    return kept.select(*df.columns)
