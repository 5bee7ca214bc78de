"""Language ID. Script ranges narrow each word's candidate languages; words score by smoothed character trigrams; Viterbi with a
penalty for switching labels spans of mixed-language text. Everything is learned from the labelled rows given.

Defined cases: null text and text without a letter are `und` with score 0; so is every text when no row is labelled. Text whose
scripts no learned language uses gets the most frequent learned language with score 0. Ties go to the language first in order.
Repeated rows give repeated rows; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common

BUCKETS, PARTS = 1 << 16, 4
SWITCH_PENALTY = 12.0
#: Share of a language's letters from which a script is one of its own.
OWN_SCRIPT = 0.01

# First code points of letter ranges, by script; letters of no range here are Other.
SCRIPT_RANGES = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F),),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "Kana": ((0x3040, 0x30FF),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
SCRIPTS = ("Other", *SCRIPT_RANGES)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case (itself where that isn't one code point), and 1 + its script, 0 for what is no letter."""
    n = 0x110000
    lower, script = np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            script[i] = 1
            if len(small := c.lower()) == 1:
                lower[i] = ord(small)
    for k, ranges in enumerate(SCRIPT_RANGES.values(), 2):
        for a, b in ranges:
            script[a : b + 1] = np.where(script[a : b + 1] > 0, k, 0)
    return lower, script


@dataclass
class Letters:
    """The letters of some texts, end to end: feature of each; word starts and ends among them; script and place of each word."""

    feature: np.ndarray
    word_at: np.ndarray
    word_len: np.ndarray
    word_script: np.ndarray
    word_doc: np.ndarray
    word_start: np.ndarray


def letters_of(texts: list[str]) -> Letters:
    lower, script_of = tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    script = script_of[points]
    where = np.flatnonzero(script)
    small = lower[points[where]]
    first = np.ones(len(where), bool)
    first[1:] = np.diff(where) > 1
    last = np.append(first[1:], True) if len(where) else first
    before, after = np.roll(small, 1), np.roll(small, -1)
    before[first] = 0
    after[last] = 0
    mixed = before * np.uint32(0x9E3779B1) + small * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    at = np.flatnonzero(first)
    starts = where[at]
    doc = np.searchsorted(ends, starts, side="right")
    return Letters(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64), at, np.diff(np.append(at, len(where))), script[starts] - 1, doc, starts - (ends[doc] - np.array([len(t) + 1 for t in texts], np.int64)[doc] if len(texts) else 0))


@dataclass
class Model:
    """langs in order; logp (BUCKETS, languages); allowed (scripts, languages); prior."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts every labelled row; a task sends a fixed number of counters for each language it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for s in common.slices(b, "_text"):
                langs = np.array(s.column(1).to_pylist(), object)
                texts = s.column(0).to_pylist()
                for lang in set(langs):
                    mine = [t for t, own in zip(texts, langs, strict=True) if own == lang]
                    total = seen.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) * PARTS, np.int64))
                    for a, b in runs(mine):
                        x = letters_of(mine[a:b])
                        total[:BUCKETS] += np.bincount(x.feature, minlength=BUCKETS)
                        total[BUCKETS : BUCKETS + len(SCRIPTS)] += np.bincount(x.word_script, weights=x.word_len, minlength=len(SCRIPTS)).astype(np.int64)
        rows = [(lang, k, part.tobytes()) for lang, total in seen.items() for k, part in enumerate(np.split(total, PARTS))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "part", "counts"])
        common.release()

    rows = common.small_batches(labelled).select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_text is not null and _lang is not null")
    found: dict[str, dict[int, bytes]] = {}
    for r in common.summed(rows.mapInArrow(count, "lang string, part int, counts binary"), ["lang", "part"], "counts").collect():  # some counters for each language
        found.setdefault(r.lang, {})[r.part] = r.counts
    langs = sorted(found)
    if not langs:
        return Model([], np.empty((BUCKETS, 0), np.float32), np.empty((len(SCRIPTS), 0), bool), np.empty(0))
    total = np.array([np.frombuffer(b"".join(found[x][k] for k in range(PARTS)), np.int64) for x in langs]).reshape(len(langs), -1)
    grams, scripts = total[:, :BUCKETS], total[:, BUCKETS : BUCKETS + len(SCRIPTS)]
    size = scripts.sum(1, keepdims=True)
    logp = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).T
    return Model(langs, np.ascontiguousarray(logp, np.float32), (scripts >= OWN_SCRIPT * np.maximum(size, 1)).T & (size.T > 0), np.log((size[:, 0] + 1) / (size.sum() + len(langs))))


@dataclass
class Words:
    word_len: np.ndarray
    word_script: np.ndarray
    word_doc: np.ndarray
    word_start: np.ndarray


#: Characters whose letters are scored at a time; only their words' scores are kept.
RUN_CHARS = 1 << 18


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about RUN_CHARS characters each."""
    a = size = 0
    for b, t in enumerate(texts):
        if b > a and size + len(t or "") > RUN_CHARS:
            yield a, b
            a = b
            size = 0
        size += len(t or "")
    if len(texts) > a:
        yield a, len(texts)


def word_scores(model: Model, texts: list[str | None], first: int) -> tuple[Letters, np.ndarray]:
    """The words of texts, numbered from first on, and their scores."""
    x = letters_of([t or "" for t in texts])
    x.word_doc = x.word_doc + first
    return x, np.add.reduceat(model.logp[x.feature], x.word_at, axis=0).astype(float) if len(x.word_at) else np.empty((0, len(model.langs)))


def viterbi(scores: np.ndarray, doc: np.ndarray, docs: int, prior: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; scores (words, languages) in order of doc. All texts advance together, a word a step."""
    n, k = scores.shape
    label = np.zeros(n, np.int64)
    if not n or k < 2:
        return label
    counts = np.bincount(doc, minlength=docs)
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], begin[order]
    active = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")
    best = np.repeat(prior[None, :], len(order), 0)
    back = np.empty((n, k), np.int8 if k < 128 else np.int16)
    own = np.arange(k)
    for t, m in enumerate(active):
        v, rows = best[:m], begin[:m] + t
        top = v.argmax(1)
        switch = v[np.arange(m), top] - penalty
        stay = v >= switch[:, None]
        back[rows] = np.where(stay, own, top[:, None])
        best[:m] = np.where(stay, v, switch[:, None]) + scores[rows]
    state = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows = begin[:m] + t
        label[rows] = state[:m]
        state[:m] = back[rows, state[:m]]
    return label


def predict(model: Model, texts: list[str | None], penalty: float = SWITCH_PENALTY, spans: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, list[list[dict]] | None]:
    """Language, score and known of each text: the shares of its letters in spans of that language, and of any learned one."""
    n, k = len(texts), len(model.langs)
    lang, score, known = ["und"] * n, np.zeros(n), np.zeros(n)
    found: list[list[dict]] | None = [[] for _ in texts] if spans else None
    parts = [word_scores(model, texts[a:b], a) for a, b in runs(texts)] if k else []
    parts = [p for p in parts if len(p[0].word_at)]
    if not parts:
        return lang, score, known, found
    x = Words(*(np.concatenate([getattr(p[0], f) for p in parts]) for f in ("word_len", "word_script", "word_doc", "word_start")))
    scores = np.concatenate([p[1] for p in parts])
    own = model.allowed[x.word_script]
    some = own.any(1)
    scores[~own] = -1e6
    scores[~some] = 0
    label = viterbi(scores, x.word_doc, n, model.prior, penalty)
    share = np.bincount(x.word_doc * k + label, weights=x.word_len * some, minlength=n * k).reshape(n, k)
    total = np.bincount(x.word_doc, weights=x.word_len, minlength=n)
    top = share.argmax(1)
    for i in np.flatnonzero(total):
        if share[i, top[i]]:
            lang[i], score[i], known[i] = model.langs[top[i]], share[i, top[i]] / total[i], share[i].sum() / total[i]
        else:
            lang[i] = model.langs[int(model.prior.argmax())]
    if found is not None:
        edge = np.flatnonzero(np.append(True, (np.diff(x.word_doc) != 0) | (np.diff(label) != 0)))
        for a, b in zip(edge, [*(edge[1:] - 1), len(label) - 1], strict=True):
            found[x.word_doc[a]].append({"start": int(x.word_start[a]), "end": int(x.word_start[b] + x.word_len[b]), "lang": model.langs[label[a]]})
    return lang, score, known, found


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, keep_spans: bool = True) -> DataFrame:
    """A row for each row of df: id, lang_pred, score and, with keep_spans, spans of one language each (code points, end exclusive).
    The model has a fixed size for each language, so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col]
    part = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, _, spans = predict(shared.value, batch.column(1).to_pylist(), penalty, keep_spans)
        cols = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())] + ([pa.array(spans, part)] if keep_spans else [])
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "lang_pred", "score"] + ["spans"] * keep_spans)

    schema = f"`{id_col}` {kind}, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * keep_spans
    return common.small_batches(df).select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(common.in_slices(one, "_text", 2 * common.SLICE_BYTES), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.held_out()))
    return identify(docs, model, keep_spans=False).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


#: Share of a text's letters in learned languages from which it stays in a corpus.
LEAST_SCORE = 0.3


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """df's rows with at least that share of letters in learned languages together, with the one that has most as lang_col; text without a
    letter or mostly of other scripts goes."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, _, known, _ = predict(shared.value, common.texts_of(batch, text_col))
        at = batch.schema.get_field_index(lang_col)
        batch = batch.set_column(at, lang_col, pa.array(lang, batch.schema.field(at).type))
        return batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, known, strict=True)], pa.bool_()))

    return common.small_batches(df).mapInArrow(common.in_slices(one, text_col, 2 * common.SLICE_BYTES), df.schema)
