"""Secret scans: an Aho-Corasick automaton finds keywords in one pass over a text, anchored regular expressions are tried at its hits
alone, and tokens that carry a checksum are believed only if it is right.

Kinds that are found by their form: assign (a keyword, a colon or an equals sign, a value of MIN_VALUE or more characters), access (AKIA and
capitals, MIN_ACCESS or more in all) and hex (runs of MIN_HEX or more). A run that long covers a place whose number leaves MIN_HEX - 1
after division by MIN_HEX, so those places stand in for keywords. Matches are leftmost and non-overlapping for each kind; one that is too
short is dropped and isn't tried again inside.

Kinds with a checksum: github (gh and one of pousr, an underscore, 30 characters and 6 of their CRC-32 in base 62), npm (the same form),
age and nsec (Bech32). They neither start nor end inside a longer word.

Defined cases: null text is the empty text; repeated rows give repeated rows; an empty table gives an empty table; find_secrets carries the
id alone, whatever other columns are called, and redact keeps all columns. Places are code points, ends exclusive. Time is linear in a
text, and what a task holds beside its batch is one slice's spans.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common

BASE = ("assign", "access", "hex")
CHECKED = ("github", "npm", "age", "nsec")
#: In the order of spans that start together.
KINDS = (*BASE, *CHECKED)
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Of assignments, in either case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Of tokens with a checksum, as they are written.
PREFIXES = {**{f"gh{c}_": "github" for c in "pousr"}, "npm_": "npm", "AGE-SECRET-KEY-1": "age", "nsec1": "nsec"}

#: What follows a name, and a name with what stands before its value.
_VALUE = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMED = re.compile(r"""[A-Za-z_]+?["']?\x20*[:=]\x20*["']?""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_SAMPLED = re.compile(r"[0-9a-f]")
_HEX_DIGITS = frozenset("0123456789abcdef")
_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_TOKEN = re.compile(r"[A-Za-z]+_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
_BECH32 = re.compile(r"(AGE-SECRET-KEY-|nsec)1([0-9A-Za-z]{58})(?![0-9A-Za-z_])")

#: Digits of base 62 and of Bech32, and the generators of the latter's checksum.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base62(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def crc_is_right(body: str, check: str) -> bool:
    """Whether check is the CRC-32 of body in base 62."""
    return base62(zlib.crc32(body.encode()), len(check)) == check


def polymod(values: list[int]) -> int:
    """The checksum of Bech32: 1 over a whole valid string's values."""
    out = 1
    for v in values:
        top = out >> 25
        out = (out & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(GENERATORS):
            if top >> k & 1:
                out ^= g
    return out


def bech32_is_right(name: str, data: str) -> bool:
    """Whether data, all of one case, ends with its checksum under that name."""
    if data not in (data.lower(), data.upper()) or any(c not in BECH32 for c in data.lower()):
        return False
    own = name.lower()
    return polymod([ord(c) >> 5 for c in own] + [0] + [ord(c) & 31 for c in own] + [BECH32.index(c) for c in data.lower()]) == 1


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Keywords to (kind's place, length); the names of assignments in every mix of cases, so that texts need no lower-casing."""
    out = ahocorasick.Automaton()
    for name in NAMES:
        for mix in itertools.product(*({c, c.upper()} for c in name)):
            out.add_word("".join(mix), (0, len(name)))
    out.add_word("AKIA", (1, 4))
    for prefix, kind in PREFIXES.items():
        out.add_word(prefix, (KINDS.index(kind), len(prefix)))
    out.make_automaton()
    return out


def _checked(text: str, start: int, kind: str) -> int:
    """The end of a valid token that starts there, or 0."""
    if start and text[start - 1] in _WORD:
        return 0
    if kind in ("github", "npm"):
        m = _TOKEN.match(text, start)
        return m.end() if m and crc_is_right(m[1], m[2]) else 0
    m = _BECH32.match(text, start)
    return m.end() if m and bech32_is_right(m[1], m[2]) else 0


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _SAMPLED.finditer(text[MIN_HEX - 1 :: MIN_HEX]):
        at = MIN_HEX - 1 + MIN_HEX * m.start()
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in _HEX_DIGITS:
            start -= 1
        end = _HEX.match(text, at).end()
        if end - start >= MIN_HEX:
            yield start, end


def secrets_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) by start, then kind."""
    out = []
    free = [0] * len(KINDS)
    for last, (kind, length) in automaton().iter(text):
        start = last + 1 - length
        if start < free[kind]:
            continue
        if kind == 0:
            m = _VALUE.match(text, last + 1)
            if m:
                free[kind] = m.end()
                if m.end() - m.start(1) >= MIN_VALUE:
                    out.append((start, kind, m.end()))
        elif kind == 1:
            m = _ACCESS.match(text, start)
            if m:
                free[kind] = m.end()
                if m.end() - start >= MIN_ACCESS:
                    out.append((start, kind, m.end()))
        elif end := _checked(text, start, KINDS[kind]):
            free[kind] = end
            out.append((start, kind, end))
    out += [(a, 2, b) for a, b in _hex_runs(text)]
    return sorted(out)


def _over(df: DataFrame, text_col: str, columns: list[str], schema: object, write: Callable) -> DataFrame:
    at = columns.index(text_col)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.string()).to_pylist()
        return write(batch, texts, [secrets_of(t or "") for t in texts])

    return common.small_batches(df).select(*(f"`{c}`" for c in columns)).mapInArrow(common.in_slices(scan, text_col), schema)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, spans (array of start, kind's place in KINDS, end)."""

    def write(batch: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        spans = [[{"start": a, "kind": k, "end": b} for a, k, b in spans] for spans in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(common.SPAN))], names=[id_col, "spans"])

    return _over(df, text_col, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, spans {common.SPANS}", write)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each secret's text replaced by [SECRET]; of an assignment, its value alone. Null stays null."""

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        cuts, out, at = sorted((_NAMED.match(text, a).end() if k == 0 else a, b) for a, k, b in spans), [], 0
        for a, b in cuts:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def write(batch: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        k = batch.schema.get_field_index(text_col)
        return batch.set_column(k, batch.schema.field(k), pa.array(map(clean, texts, found), batch.schema.field(k).type))

    return _over(df, text_col, df.columns, df.schema, write)


def op11_anchored_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [common.count_of("spans", k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(common.written(base, KINDS), 256).alias("base_sha256"), common.written("spans", KINDS).alias("spans"))


#: The matches of a kind are told in order by regexp_extract_all; a match's text first occurs, after the match before it, at its place.
#: CRC-32 and Bech32 are folds over the characters of a token; the table of the former is made from its polynomial.
SQL = """
with crc_table as (
  select list(list_reduce(list_prepend(k::bigint, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) as crc
  from range(256) r(k)),
t as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
found as (
  select row, text, kind, found from (
    select row, text, 0 as kind, regexp_extract_all(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+') as found from t
    union all select row, text, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+') from t
    union all select row, text, 2, regexp_extract_all(text, '[0-9a-f]{32,}') from t
    union all select row, text, 3, regexp_extract_all(text, 'gh[pousr]_[0-9A-Za-z]{36,}') from t
    union all select row, text, 4, regexp_extract_all(text, 'npm_[0-9A-Za-z]{36,}') from t
    union all select row, text, 5, regexp_extract_all(text, 'AGE-SECRET-KEY-1[0-9A-Za-z]{58,}') from t
    union all select row, text, 6, regexp_extract_all(text, 'nsec1[0-9A-Za-z]{58,}') from t)
  where len(found) > 0),
placed as (
  select row, text, kind, unnest(list_reduce(list_prepend([{'m': '', 'stop': 0::bigint}], list_transform(found, lambda m: [{'m': m, 'stop': 0::bigint}])),
    lambda done, next: list_append(done, {'m': next[1].m, 'stop': done[-1].stop + instr(substr(text, done[-1].stop + 1), next[1].m) - 1 + length(next[1].m)}))[2:]) as place
  from found),
spans as (
  select row, text, kind, place.m as m, place.stop - length(place.m) as start, place.stop as stop,
    (place.stop = length(place.m) or not regexp_matches(substr(text, place.stop - length(place.m), 1), '[0-9A-Za-z_]'))
      and not regexp_matches(substr(text, place.stop + 1, 1), '[0-9A-Za-z_]') as whole
  from placed),
checked as (
  select row, kind, start, stop, m from spans, crc_table
  where case
    when kind = 0 then length(regexp_extract(m, '[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
    when kind = 1 then length(m) >= 16
    when kind = 2 then true
    when not whole then false
    when kind in (3, 4) then length(m) = 40 and list_reduce(list_prepend(0::bigint, list_transform(string_split(m[-6:], ''), lambda c: (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', c) - 1)::bigint)), lambda a, b: a * 62 + b)
      = xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(m[-36:-7], ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295)
    else length(m) = case kind when 5 then 74 else 63 end
      and (m[-58:] = lower(m[-58:]) or m[-58:] = upper(m[-58:])) and regexp_full_match(lower(m[-58:]), '[qpzry9x8gf2tvdw0s3jn54khce6mua7l]+')
      and list_reduce(list_prepend(1::bigint,
        list_transform(string_split(case kind when 5 then 'age-secret-key-' else 'nsec' end, ''), lambda c: (ascii(c) >> 5)::bigint) || [0::bigint]
        || list_transform(string_split(case kind when 5 then 'age-secret-key-' else 'nsec' end, ''), lambda c: (ascii(c) & 31)::bigint)
        || list_transform(string_split(lower(m[-58:]), ''), lambda c: (instr('qpzry9x8gf2tvdw0s3jn54khce6mua7l', c) - 1)::bigint)),
        lambda a, b: xor(xor(xor(xor(xor(xor((a & 33554431) << 5, b),
          case when (a >> 25) & 1 = 1 then 996825010 else 0 end), case when (a >> 26) & 1 = 1 then 642813549 else 0 end), case when (a >> 27) & 1 = 1 then 513874426 else 0 end),
          case when (a >> 28) & 1 = 1 then 1027748829 else 0 end), case when (a >> 29) & 1 = 1 then 705979059 else 0 end)) = 1
  end),
named as (
  select row, kind, start, ['assign', 'access', 'hex', 'github', 'npm', 'age', 'nsec'][kind + 1] || ':' || start || ':' || stop as said from checked)
select max(doc_id) as doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(said, ',' order by start, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(said, ',' order by start, kind), '') as spans
from t left join named using (row) group by row
"""
