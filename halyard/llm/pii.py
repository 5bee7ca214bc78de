"""PII: information-theoretic sanitisation. Patterns find the protected entities; over the whole corpus, each entity's
co-occurrence with the terms of its documents tells how much of its information a term gives away; terms over the disclosure threshold
are generalised or removed, at every place and in every document. Besides single entities the classes that name an organisation are
protected, as most addresses stand in one text alone: the domain of a mail address and the network of an IP address (its first two
numbers).

Of a term t and an entity e, over the corpus's distinct texts: reveals(t, e) = log2(p(e|t) / p(e)) / log2(1 / p(e)), the share of e's
information that t gives. It counts when both stand in at least min_support distinct texts: copies of one text are one witness, else
three copies would give every word of theirs away (near copies are several; the pipeline takes them out before). Words that overlap an
entity go with it and are no terms. What a term is the rule tells: runs of shortest or more letters, and with digits also those of letters
and digits. The default of three letters leaves out short names and numbers; the query and the pipeline take EVERY_WORD.

The terms that disclose are broadcast and marked in one pass over the texts as long as they take at most broadcast_bytes; more of
them are joined to the places they stand at, with the same result.

Defined cases: null text is the empty text; repeated rows give repeated rows; an empty table gives an empty table; columns other
than the two named are not carried by find_spans and kept by sanitise. An entity that stands in every text has no information, so
nothing reveals it. Runs of letters over LONG_TERM are terms by their digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.llm import common
from halyard.names import free

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A longer run of letters is known by its digest, so that no row of a term is long.
LONG_TERM = 64
#: Places of a sieve; keys of texts that a task remembers as seen.
SIEVE, SEEN = 1 << 20, 1 << 17


@dataclass(frozen=True)
class Disclosure:
    """A term with reveals() of at least remove goes, of at least generalise is replaced by its class. shortest: of the words that are
    terms; digits: whether words may hold digits. broadcast_bytes: of the disclosing terms, beyond which they are joined."""

    shortest: int = 3
    digits: bool = False
    min_support: int = 3
    generalise: float = 0.8
    remove: float = 0.95
    broadcast_bytes: int = 8 << 20

    @property
    def word(self) -> re.Pattern:
        return re.compile(f"{'[^\\W_]' if self.digits else '[^\\W\\d_]'}{{{self.shortest},}}")


EVERY_WORD = Disclosure(shortest=1, digits=True)
_LETTERS = Disclosure().word


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: each @ is tried once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) by start, then kind."""
    out = [(a, 0, b, text[a:b].lower()) for a, b in emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end(), d))
        if "+" in text:
            out += [(m.start(), 3, m.end(), d) for m in _PHONE.finditer(text) if 10 <= len(d := _digits(m[0])) <= 15]
    return sorted(out)


def clear_words(text: str, found: list[tuple[int, int, int, str]], word: re.Pattern = _LETTERS) -> list[tuple[int, int]]:
    """Places of the words that may be terms: those that overlap none of the entities found."""
    gone: list[list[int]] = []
    for start, _, end, _ in found:
        if gone and start <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], end)
        else:
            gone.append([start, end])
    out, k = [], 0
    for m in word.finditer(text):
        a, b = m.span()
        while k < len(gone) and gone[k][1] <= a:
            k += 1
        if k == len(gone) or gone[k][0] >= b:
            out.append((a, b))
    return out


def term(word: str) -> str:
    word = word.lower()
    return word if len(word) <= LONG_TERM else "#" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def terms_of(text: str, found: list[tuple[int, int, int, str]], word: re.Pattern = _LETTERS) -> set[str]:
    if not found:
        return set(map(term, set(word.findall(text))))
    return {term(text[a:b]) for a, b in clear_words(text, found, word)}


def names_of(found: list[tuple[int, int, int, str]]) -> list[str]:
    """The distinct entities among those found, and their classes."""
    out = {}
    for _, kind, _, value in found:
        out[f"{KINDS[kind]}:{value}"] = None
        if KINDS[kind] == "email":
            out[f"email:{value[value.index('@') :]}"] = None
        elif KINDS[kind] == "ip":
            a, b, *_ = value.split(".")
            out[f"ip:{int(a)}.{int(b)}"] = None
    return list(out)


def sieve(df: DataFrame, column: str) -> Broadcast[bytes]:
    """A map of fixed size that lets all values of the column through, and few others: what passes is joined exactly."""
    places = df.select((F.crc32(F.col(column).cast("binary")) % SIEVE).cast("int").alias("at")).distinct().toArrow()
    bits = np.zeros(SIEVE, np.uint8)
    bits[places.column(0).to_numpy()] = 1
    return df.sparkSession.sparkContext.broadcast(bits.tobytes())


def passes(bits: bytes, s: str | bytes) -> int:
    return bits[zlib.crc32(s if isinstance(s, bytes) else s.encode()) % SIEVE]


_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
#: Span kinds in the order of spans that start together.
SPAN_KINDS = (*KINDS, "term_generalised", "term_removed")


def md5_of(*columns: str) -> Column:
    """The same for rows with the same values; null counts as empty."""
    return F.unhex(F.md5(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary")))


def first_seen(seen: set[bytes], key: bytes) -> bool:
    """Whether a task meets the key for the first time, as far as it remembers: the exact work is done after the shuffle."""
    if key in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(key)
    return True


def keyed_texts(df: DataFrame, text_col: str) -> DataFrame:
    return common.small_batches(df).select(md5_of(text_col).alias("text_key"), F.col(text_col).cast("string").alias("_text"))


def holders(df: DataFrame, text_col: str = "text") -> DataFrame:
    """For each row: text_key and entities (the distinct ones)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [names_of(entities(text or "")) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string()))], names=["text_key", "entities"])

    return keyed_texts(df, text_col).mapInArrow(common.in_slices(one, "_text"), "text_key binary, entities array<string>")


def counted(batches: Iterator[pa.RecordBatch], wanted: bytes, copied: bytes | None, word: re.Pattern = _LETTERS, flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """term, n: the texts of a task that hold each term that passes the first sieve, added up; and text_key, _text, without a term, of
    texts whose keys pass the second one, once each as far as the task remembers. It holds flush terms at most, and those of one text."""
    once: Counter[str] = Counter()
    seen: set[bytes] = set()
    fields = (pa.string(), pa.int64(), pa.binary(), pa.string())

    def out(terms: list, n: list, keys: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((terms, n, keys, texts), fields, strict=True)], names=["term", "n", "text_key", "_text"])

    for b in batches:
        for part in common.slices(b, "_text"):
            keys, texts = [], []
            for key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if copied is None or not passes(copied, key):
                    once.update(t for t in terms_of(text or "", entities(text or ""), word) if passes(wanted, t))
                elif first_seen(seen, key):
                    keys.append(key)
                    texts.append(text or "")
                if len(once) >= flush:
                    yield out(list(once), list(once.values()), [None] * len(once), [None] * len(once))
                    once.clear()
            if keys:
                yield out([None] * len(keys), [None] * len(keys), keys, texts)
        common.release()
    if once:
        yield out(list(once), list(once.values()), [None] * len(once), [None] * len(once))


def document_frequency(df: DataFrame, wanted: Broadcast[bytes], copied: Broadcast[bytes], text_col: str = "text", word: re.Pattern = _LETTERS) -> DataFrame:
    """term, n_term: the distinct texts that hold it, of terms that pass the first sieve. A task adds up the texts that are in the table
    once; those whose keys pass the second sieve, as all copies do, meet by key first and are added up after."""
    schema = "term string, n long, text_key binary, _text string"
    rows = common.cut(keyed_texts(df, text_col).mapInArrow(lambda batches: counted(batches, wanted.value, copied.value, word), schema), "counted")
    each = rows.where("text_key is not null").groupBy("text_key").agg(F.first("_text").alias("_text"))
    more = each.mapInArrow(lambda batches: counted(batches, wanted.value, None, word), schema)
    return rows.where("term is not null").unionByName(more).groupBy("term").agg(F.sum("n").alias("n_term"))


#: Stands for all entities in together().
ANY = ""


def together(df: DataFrame, wanted: Broadcast[bytes], text_col: str = "text", word: re.Pattern = _LETTERS, flush: int = 200_000) -> DataFrame:
    """entity, term, n_both: the distinct texts that hold both, for entities that pass the sieve; and with the entity ANY, the texts among
    these that hold the term. Texts meet by key first; a task then adds up pairs, flush at most and those of one entity with a text's
    terms."""

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for s in common.slices(b, "_text"):
                keep = [any(passes(wanted.value, e) for e in names_of(entities(text or ""))) and first_seen(seen, key) for key, text in zip(*(c.to_pylist() for c in s.columns), strict=True)]
                yield s.filter(pa.array(keep, pa.bool_()))
            common.release()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in once], pa.string()), pa.array([k[1] for k in once], pa.string()), pa.array(list(once.values()), pa.int64())], names=["entity", "term", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                found = entities(text or "")
                terms = terms_of(text or "", found, word)
                for e in (ANY, *names_of(found)):
                    if e == ANY or passes(wanted.value, e):
                        once.update((e, t) for t in terms)
                        if len(once) >= flush:
                            yield out()
                            once.clear()
            common.release()
        if once:
            yield out()

    texts = keyed_texts(df, text_col).mapInArrow(holding, "text_key binary, _text string").groupBy("text_key").agg(F.first("_text").alias("_text"))
    return texts.select("_text").mapInArrow(pairs, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_both"))


def disclosing(df: DataFrame, text_col: str = "text", rule: Disclosure | None = None) -> DataFrame:
    """entity, term, kind (of SPAN_KINDS) for the terms over the threshold."""
    rule = rule or Disclosure()
    texts = common.cut(holders(df, text_col).groupBy("text_key", "entities").agg(F.count("*").alias("copies")), "texts")
    total = texts.count()
    # an entity in every text has no information; one in fewer than min_support has no pair with support
    n_entity = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_entity = common.cut(n_entity.where((F.col("n_entity") >= rule.min_support) & (F.col("n_entity") < total)), "entities")
    p_entity = F.col("n_entity") / F.lit(float(max(total, 1)))
    reveals = lambda n: F.try_divide(F.log2(F.col("n_both") / F.col(n) / p_entity), -F.log2(p_entity))
    pair = common.cut(together(df, sieve(n_entity, "entity"), text_col, rule.word), "pairs")
    # a term stands in n_any texts at least: pairs that can't reach the threshold even so go before the terms are counted
    least = pair.where(F.col("entity") == ANY).select("term", F.col("n_both").alias("n_any"))
    pair = pair.where((F.col("entity") != ANY) & (F.col("n_both") >= rule.min_support)).join(n_entity, "entity").join(least, "term")
    pair = common.cut(pair.where(reveals("n_any") >= rule.generalise).drop("n_any"), "together")
    n_term = document_frequency(df, sieve(pair, "term"), sieve(texts.where("copies > 1"), "text_key"), text_col, rule.word)
    kind = F.when(reveals("n_term") >= rule.remove, SPAN_KINDS.index("term_removed")).when(reveals("n_term") >= rule.generalise, SPAN_KINDS.index("term_generalised"))
    return pair.join(n_term, "term").select("entity", "term", kind.alias("kind")).where("kind is not null")


def told_terms(df: DataFrame, text_col: str, rule: Disclosure) -> tuple[DataFrame, dict[str, int] | None]:
    """term, kind of the disclosing terms (the stronger kind of one told by two entities), and the same as a dictionary if it is small."""
    told = common.cut(disclosing(df, text_col, rule).groupBy("term").agg(F.max("kind").alias("kind")), "told")
    size = told.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    return told, {r.term: r.kind for r in told.collect()} if size <= rule.broadcast_bytes else None


Span = tuple[int, int, int]


def spans_of(text: str, told: dict[str, int], word: re.Pattern = _LETTERS) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the places of the told terms, by start, then kind."""
    found = entities(text)
    base = [(a, k, b) for a, k, b, _ in found]
    if not told:
        return base, base
    more = [(a, told[t], b) for a, b in clear_words(text, found, word) if (t := term(text[a:b])) in told]
    return base, sorted(base + more) if more else base


def as_structs(spans: list[Span]) -> list[dict[str, int]]:
    return [{"start": a, "kind": k, "end": b} for a, k, b in spans]


def joined_spans(df: DataFrame, told: DataFrame, id_col: str, text_col: str, word: re.Pattern = _LETTERS) -> DataFrame:
    """row_key, spans of the rows (of one id and text once) in which a told term stands; told may be of any size."""
    wanted = sieve(told, "term")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, keys, terms, places = wanted.value, [], [], []
        for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            at: dict[str, list[dict[str, int]]] = {}
            for a, b in clear_words(text or "", entities(text or ""), word):
                if passes(bits, t := term(text[a:b])):
                    at.setdefault(t, []).append({"start": a, "end": b})
            keys += [key.as_py()] * len(at)
            terms += at
            places += at.values()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.string()), pa.array(places, pa.list_(_PLACE))], names=["row_key", "term", "places"])

    rows = common.small_batches(df).select(md5_of(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("_text"))
    places = rows.mapInArrow(common.in_slices(one, "_text"), "row_key binary, term string, places array<struct<start: int, end: int>>").join(told, "term")
    distinct = places.select("row_key", "kind", F.explode("places").alias("at")).groupBy("row_key", "at.start", "at.end").agg(F.max("kind").alias("kind"))
    return distinct.groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def over_spans(df: DataFrame, id_col: str, text_col: str, rule: Disclosure | None, columns: list[str], schema: str | StructType, write: Callable) -> DataFrame:
    """write(batch of the columns, base spans, all spans) over the rows of df, by whichever way the number of disclosing terms asks for."""
    rule = rule or Disclosure()
    told, small = told_terms(df, text_col, rule)
    word = rule.word
    text = columns.index(text_col)
    if small is not None:
        shared = df.sparkSession.sparkContext.broadcast(small)

        def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [spans_of(t or "", shared.value, word) for t in batch.column(text).cast(pa.string()).to_pylist()]
            return write(batch, [b for b, _ in both], [s for _, s in both])

        return common.small_batches(df).select(*columns).mapInArrow(common.in_slices(mark, text_col), schema)
    key, extra = free("_row_key", df), free("_more", df)
    more = common.cut(joined_spans(df, told, id_col, text_col, word).select(F.col("row_key").alias(key), F.col("more").alias(extra)), "marked")

    def mark_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        base = [spans_of(t or "", {})[0] for t in batch.column(text).cast(pa.string()).to_pylist()]
        spans = [sorted(own + [(s["start"], s["kind"], s["end"]) for s in found or ()]) for own, found in zip(base, batch.column(len(columns)).to_pylist(), strict=True)]
        return write(batch.drop_columns([extra]), base, spans)

    joined = df.withColumn(key, md5_of(id_col, text_col)).join(more, key, "left").select(*columns, extra)
    return common.small_batches(joined).mapInArrow(common.in_slices(mark_joined, text_col), schema)


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure | None = None) -> DataFrame:
    """For each row: id, base, spans (arrays of start, kind's place in SPAN_KINDS, end)."""

    def write(batch: pa.RecordBatch, base: list[list[Span]], spans: list[list[Span]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(map(as_structs, x)), pa.list_(common.SPAN)) for x in (base, spans))], names=[id_col, "base", "spans"])

    return over_spans(df, id_col, text_col, rule, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, base {common.SPANS}, spans {common.SPANS}", write)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure | None = None) -> DataFrame:
    """df with its text sanitised: entities become [KIND], generalised terms [NAME] or [TERM] by their first letter's case, removed
    terms nothing. Rows without a span are as they were."""
    text = df.columns.index(text_col)

    def write(batch: pa.RecordBatch, base: list[list[Span]], spans: list[list[Span]]) -> pa.RecordBatch:
        clean = [apply_spans(t, s) for t, s in zip(batch.column(text).to_pylist(), spans, strict=True)]
        return batch.set_column(text, text_col, pa.array(clean, batch.schema.field(text).type))

    return over_spans(df, id_col, text_col, rule, df.columns, df.schema, write)


def apply_spans(text: str | None, spans: list[Span]) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, kind, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a < at:  # overlaps what is gone; its rest goes too
            at = max(at, b)
            continue
        name = SPAN_KINDS[kind]
        new = "" if name == "term_removed" else ("[NAME]" if text[a].isupper() else "[TERM]") if name == "term_generalised" else f"[{name.upper()}]"
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def op10_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(common.table(spark, sf_dir, "documents"), rule=EVERY_WORD)
    n = [common.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(common.written("base", SPAN_KINDS), 256).alias("base_sha256"), common.written("spans", SPAN_KINDS).alias("spans"))
