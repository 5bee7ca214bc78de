"""Packing: vector bin packing. Documents become token runs; runs are placed into sequences under simultaneous limits on tokens,
segments and loss-bearing tokens by the dot-product heuristic: the open sequence takes the run with the largest product of demand
and what is left, each as a share of its limit (of equal products the first). When no run fits whole the same holds of what
can be cut from each, and the last segment goes to the run that fills most of what is left, so that sequences end full; a document
longer than a sequence is cut where its prompt ends beforehand. A sequence that nothing can fill within its limits is dealt out in powers of two, which need no padding, as is the last
one of a task.

Every task packs the rows of its own partition from a pool of bounded size, so nothing is shuffled and no task sees another's rows.
Which rows meet depends on their order there: a scan or a sort fixes it, and without one a task that runs again may pack otherwise.

Defined cases: null text is the empty text, whose only token is the end token; repeated rows are packed once each; an empty table
gives an empty table; columns other than those named are not carried. A run's first token bears no loss: nothing stands before it. Nor
do the tokens of a document's prompt: as many as a column says (null: none), or as a rule tells. The query draws prompts for its plain
documents from doc_id, and has limits at which each of the three can bind.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common

END_ID = 1


@dataclass(frozen=True)
class Limits:
    """Of one sequence. pool: runs that a task holds while it chooses, and full sequences' worth of tokens."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    pool: int = 1024


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file with its default settings. Texts without a special
    token's string go through the same ranks in tiktoken, which is faster and gives the same ids."""

    def __init__(self, json_path: str, rank_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if rank_path:
            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, rank_path: str | None) -> Encoder:
    """One for each worker."""
    key = (json_path, rank_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


@dataclass
class Run:
    doc: object
    start: int
    total: int
    ids: np.ndarray
    prompt: int = 0

    def split(self, n: int) -> tuple[Run, Run]:
        return Run(self.doc, self.start, self.total, self.ids[:n], self.prompt), Run(self.doc, self.start + n, self.total, self.ids[n:], self.prompt)

    def lead(self) -> int:
        """Its first tokens without a loss."""
        return max(1, self.prompt - self.start)

    def loss(self) -> int:
        return max(0, len(self.ids) - self.lead())


class Packer:
    """Yields sequences (lists of runs)."""

    def __init__(self, limits: Limits):
        self.most = limits
        self.runs: list[Run] = []
        self.held = 0

    def add(self, run: Run) -> Iterator[list[Run]]:
        prompt = min(run.prompt - run.start, len(run.ids))
        parts = run.split(prompt) if len(run.ids) > self.most.tokens and 0 < prompt < len(run.ids) else (run,)
        self.runs += [r for r in parts if len(r.ids)]
        self.held += len(run.ids)
        if len(self.runs) >= 2 * self.most.pool or self.held >= 2 * self.most.pool * self.most.tokens:
            yield from self.drain(self.most.pool)

    def drain(self, leave: int) -> Iterator[list[Run]]:
        """Packs until that many runs, and that many full sequences' tokens, are left."""
        size = np.array([len(r.ids) for r in self.runs], np.int64)
        lead = np.array([r.lead() for r in self.runs], np.int64)
        loss = np.maximum(size - lead, 0)
        there = np.ones(len(size), bool)
        count = len(size)
        limit = np.array([self.most.tokens, self.most.segments, self.most.loss_tokens], float)
        while count > leave or self.held > leave * self.most.tokens:
            left, taken = limit.copy(), []
            while count and left[0] >= 1 and left[1] >= 1:
                weigh = left / limit**2
                fits = there & (size <= left[0]) & (loss <= left[2])
                if left[1] > 1 and fits.any():
                    k = int(np.argmax(np.where(fits, size * weigh[0] + weigh[1] + loss * weigh[2], -1.0)))
                    n = size[k]
                else:
                    room = np.where(there, np.minimum(np.minimum(size, int(left[0])), int(left[2]) + lead), 0)
                    able = there if left[1] > 1 else room == room.max()
                    k = int(np.argmax(np.where(able, room * weigh[0] + weigh[1] + np.maximum(room - lead, 0) * weigh[2], -1.0)))
                    n = room[k]
                if n < size[k]:
                    part, self.runs[k] = self.runs[k].split(int(n))
                    size[k], lead[k] = size[k] - n, self.runs[k].lead()
                    loss[k] = max(size[k] - lead[k], 0)
                else:
                    part, there[k] = self.runs[k], False
                    count -= 1
                taken.append(part)
                left -= (n, 1, part.loss())
            full = sum(len(r.ids) for r in taken)
            if not count and full < self.most.tokens:
                self.runs, self.held = taken, full
                return
            self.held -= full
            yield from [taken] if full == self.most.tokens else self.powers(taken)
        self.runs = [r for r, x in zip(self.runs, there, strict=True) if x]

    def powers(self, runs: list[Run]) -> Iterator[list[Run]]:
        """The runs in sequences of powers of two, the largest first."""
        sequence, left = [], 0
        rest = sum(len(r.ids) for r in runs)
        queue = runs[::-1]
        while queue:
            left = left or 1 << (rest.bit_length() - 1)
            run = queue.pop()
            if len(run.ids) > left:
                run, more = run.split(left)
                queue.append(more)
            sequence.append(run)
            left -= len(run.ids)
            rest -= len(run.ids)
            if not left:
                yield sequence
                sequence = []

    def finish(self) -> Iterator[list[Run]]:
        yield from self.drain(0)
        yield from self.powers(self.runs)
        self.runs, self.held = [], 0


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, json_path: str = "", rank_path: str | None = "", keep_ids: bool = True, prompt_col: str | None = None, prompt_rule: Callable[[object, int], int] | None = None) -> DataFrame:
    """A row for each run: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, its ids. Paths: of the
    tokenizer; rank_path None keeps to the tokenizers library. sequence_id: the task's partition above its own count.
    prompt_col: how many of a document's first tokens bear no loss; else prompt_rule tells it from a document's id and number of tokens."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = public_tokenizers.path("byte_bpe_50k.tiktoken") if rank_path == "" else rank_path
    limits = limits or Limits()
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens, first = Packer(limits), encoder(json_path, rank_path), TaskContext.get().partitionId() << 40
        done, id_type = [], None

        def out() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*done, strict=True)]
            done.clear()
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def keep(sequences: Iterator[list[Run]]) -> None:
            nonlocal first
            for runs in sequences:
                at = 0
                for r in runs:
                    done.append((r.doc, r.start, len(r.ids), zlib.crc32(r.ids.astype("<u4", copy=False).tobytes()), r.total, first, at) + (r.ids,) * keep_ids)
                    at += len(r.ids)
                first += 1

        for b in batches:
            id_type = b.schema.field(0).type
            for s in common.slices(b, "_text"):
                for doc, text, prompt in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    ids = np.append(tokens.ids(text or ""), np.uint32(END_ID))
                    keep(packer.add(Run(doc, 0, len(ids), ids, prompt_rule(doc, len(ids)) if prompt_rule else prompt or 0)))
                if done:
                    yield out()
        keep(packer.finish())
        if done:
            yield out()
        common.release()

    prompt = (F.col(prompt_col) if prompt_col else F.lit(None)).cast("long").alias("_prompt")
    return common.small_batches(df).select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), prompt).mapInArrow(over, schema)


#: Of the query: 9/16 of the tokens bear loss, so 3/4 of a sequence is a limit that its choices have to mind.
QUERY_LIMITS = Limits(tokens=2048, segments=8, loss_tokens=1536)


def drawn_prompt(doc: object, tokens: int) -> int:
    """Plain documents have no prompts: none to seven eighths of their tokens, as the crc32 of doc_id as text draws it, stand for one."""
    return tokens * (zlib.crc32(str(doc).encode()) % 8) // 8


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), limits=QUERY_LIMITS, keep_ids=False, prompt_rule=drawn_prompt)
