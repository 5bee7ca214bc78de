"""Chat formatting: quotation linking. Quote marks give each line a level; level 0 is what a message says itself, and every quoted
paragraph (a line, white space and case aside) is hashed and joined to the paragraphs that earlier messages of its scope say
themselves. The message that most of the nearest level's paragraphs come from is the parent; parents make the threads.

A quoted paragraph is looked up in the order of the scope's messages, not paired with every message that says it: the latest
before the quote counts. The look-up goes by segments of the order, with the last saying of the segments before carried on, so that
a paragraph which a long conversation repeats is not sorted in one task. Roots and depths come by doubling of parent pointers, in as many rounds as the logarithm of the longest
thread. Threads are rows in reply order (a parent's order is before its replies'), never one collected value.

Defined cases: null text is the empty text, which quotes and says nothing; messages without an id, a scope or an order are their own
thread; what quotes nothing known is a root; of equally many votes the latest message wins; rows with one id say what each says and have one parent; an empty table gives an empty
table; other columns than those named are not carried.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from halyard.llm import common

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: A line that names whom the next lines quote.
_NAMED = re.compile(r"^\s*\S.{0,300}\b(?:wrote|writes|schrieb|a écrit|escribió)[^\n]{0,80}:\s*$")


#: A message's own line that a mark would take for a quote, as escape() writes it: one backslash more.
_ESCAPED = re.compile(r"^\\([ \t]*\\*>)")
#: Messages of a scope in a segment of the look-up, about, where their order is a number.
SEGMENT = 1024


def escape(text: Column) -> Column:
    """text with its own lines that start like quotes escaped; levels() undoes it."""
    return F.regexp_replace(text, r"(?m)^([ \t]*\\*>)", r"\\$1")


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks and escape) of each line; lines that only name a quoted writer are left out."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return [(x[0], _ESCAPED.sub(r"\1", x[1])) for k, x in enumerate(out) if not (_NAMED.match(x[1]) and k + 1 < len(out) and out[k + 1][0] > x[0])]


def paragraph_hash(line: str) -> int | None:
    """Of a line with its white space and case normalised; null for nothing."""
    plain = " ".join(line.split()).lower()
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "big", signed=True) if plain else None


def parse(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """What the message says, the hashes of its paragraphs, and (level, hash) of the quoted ones."""
    said, own, quoted = [], {}, {}
    for level, line in levels(text):
        h = paragraph_hash(line)
        if not level:
            said.append(line)
        if h is not None:
            (quoted if level else own)[(level, h)] = None
    return "\n".join(said).strip("\n"), [h for _, h in own], list(quoted)


def parsed(messages: DataFrame, id_col: str, scope_col: str, order_col: str, text_col: str) -> DataFrame:
    """id, scope, ord, said, own, quoted."""
    quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parse(t or "") for t in b.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(b.column(k) for k in range(3)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([[{"level": a, "hash": h} for a, h in r[2]] for r in rows], quote)],
            names=["id", "scope", "ord", "said", "own", "quoted"],
        )

    kinds = dict(messages.dtypes)
    rows = common.small_batches(messages).select(F.col(id_col).alias("id"), F.col(scope_col).alias("scope"), F.col(order_col).alias("ord"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kinds[id_col]}, scope {kinds[scope_col]}, ord {kinds[order_col]}, said string, own array<long>, quoted array<struct<level: int, hash: long>>"
    return common.cut(rows.mapInArrow(common.in_slices(one, "text"), schema), "quotes")


def parents(messages: DataFrame) -> DataFrame:
    """id, parent of the messages that quote a known one. messages: of parsed()."""
    there = messages.where("id is not null and scope is not null and ord is not null")
    said = there.select("scope", "ord", "id", F.explode("own").alias("hash")).select("scope", "hash", "ord", F.lit(1).alias("kind"), "id", F.lit(None).cast("int").alias("level"))
    quoted = there.select("scope", "ord", "id", F.explode("quoted").alias("q")).select("scope", F.col("q.hash").alias("hash"), "ord", F.lit(0).alias("kind"), "id", F.col("q.level").alias("level"))
    # only paragraphs that someone quotes go through the look-up
    wanted = quoted.select("scope", "hash").distinct()
    both = said.join(wanted, ["scope", "hash"], "left_semi").unionByName(quoted)
    by_number = isinstance(messages.schema["ord"].dataType, NumericType)
    both = both.withColumn("segment", F.floor(F.col("ord") / SEGMENT) if by_number else F.lit(0).cast("long"))
    before = Window.partitionBy("scope", "hash", "segment").orderBy("ord", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 1, F.struct("ord", "id")), ignorenulls=True).over(before)
    # a row a segment: what its earlier ones said last
    ends = both.groupBy("scope", "hash", "segment").agg(F.max(F.when(F.col("kind") == 1, F.struct("ord", "id"))).alias("end"))
    earlier = Window.partitionBy("scope", "hash").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("scope", "hash", "segment", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    found = both.withColumn("inside", last).where("kind = 0").join(ends, ["scope", "hash", "segment"]).withColumn("by", F.coalesce("inside", "carried")).where("kind = 0 and by is not null and by.ord < ord and by.id <> id")
    votes = found.groupBy("id", "level", "by").agg(F.count("*").alias("n"))
    best = F.max(F.struct(-F.col("level"), F.col("n"), F.col("by.ord").alias("by_ord"), F.col("by.id").alias("by_id"))).alias("b")
    return votes.groupBy("id").agg(best).select("id", F.col("b.by_id").alias("parent"))


def threads(parent: DataFrame) -> DataFrame:
    """id, root, depth for every message with a parent; a round takes up only those whose pointer isn't at a root yet."""
    now = common.cut(parent.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "threads")
    while now.where("moved").limit(1).count():
        higher = now.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        step = now.where("moved").join(higher, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved"))
        now = common.cut(step.unionByName(now.where("not moved")), "threads")
    return now.select("id", F.col("up").alias("root"), "depth")


def link(messages: DataFrame, id_col: str, scope_col: str, order_col: str, text_col: str) -> DataFrame:
    """A row for each message: id, scope, order, parent, root, depth and text without quotes."""
    rows = parsed(messages, id_col, scope_col, order_col, text_col)
    parent = common.cut(parents(rows), "parents")
    out = rows.select("id", "scope", "ord", "said").join(parent, "id", "left").join(threads(parent), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("scope").alias(scope_col), F.col("ord").alias(order_col), "parent", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.col("said").alias(text_col))


def one_of_three() -> Column:
    """The turn that a turn of branching mail answers: one of the three before it, told by its ids."""
    return F.col("turn") - 1 - F.pmod(F.col("conv_id") * 7 + F.col("turn") * 5, F.lit(3))


def as_mail(conversations: DataFrame, answers: Column | None = None) -> DataFrame:
    """The conversations as a mailing list would hold them: a turn answers that turn (the one before it; where there is no such turn it
    starts a thread), quotes it whole and in it what that one answers. A null role is empty; of repeated rows of a turn the least
    text is quoted."""
    key = (F.col("conv_id") * (1 << 20) + F.col("turn")).alias("msg")
    turns = conversations.select(key, "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.withColumn("answers", F.col("turn") - 1 if answers is None else answers)
    one = turns.groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role", "answers")).alias("m")).select("conv_id", "turn", "m.*")
    said = lambda k, at: one.select("conv_id", F.col("turn").alias(at), F.col("text").alias(f"t{k}"), F.col("role").alias(f"r{k}"), F.col("answers").alias(f"a{k}"))
    marked = lambda c, mark: F.regexp_replace(F.concat(F.lit("\n"), F.col(c)), "\n", "\n" + mark)
    second = F.when(F.col("t2").isNotNull(), F.concat(F.lit("\n> "), F.col("r2"), F.lit(" wrote:"), marked("t2", "> > "))).otherwise("")
    first = F.when(F.col("t1").isNotNull(), F.concat(F.col("r1"), F.lit(" wrote:"), second, marked("t1", "> "), F.lit("\n\n"))).otherwise("")
    answered = turns.join(said(1, "answers"), ["conv_id", "answers"], "left").join(said(2, "a1").drop("a2"), ["conv_id", "a1"], "left")
    return answered.select("msg", "conv_id", "turn", F.concat(first, "text").alias("text"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as branching mail, linked again: conv_id, turn, parent_turn, root_turn, depth, and the md5 of the text without quotes,
    white space aside."""
    linked = link(as_mail(common.table(spark, sf_dir, "conversations"), one_of_three()), "msg", "conv_id", "turn", "text")
    turn = lambda c: F.pmod(F.col(c), F.lit(1 << 20)).alias(f"{c}_turn")
    plain = F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))
    return linked.select("conv_id", "turn", turn("parent"), turn("root"), "depth", F.md5(plain).alias("text_md5"))


SQL = """
with recursive t as (select conv_id, turn::bigint as turn, coalesce(text, '') as text, turn::bigint - 1 - (conv_id * 7 + turn * 5) % 3 as answers from conversations),
lines as (select distinct conv_id, turn, lower(trim(regexp_replace(line, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))) as line from (select conv_id, turn, unnest(string_split(text, chr(10))) as line from t)),
said as (select * from lines where line <> ''),
quoted as (select t.conv_id, t.turn, 1 as level, s.line from t join said s on s.conv_id = t.conv_id and s.turn = t.answers
  union all select t.conv_id, t.turn, 2, s.line from t join t p on p.conv_id = t.conv_id and p.turn = t.answers join said s on s.conv_id = t.conv_id and s.turn = p.answers),
found as (select q.conv_id, q.turn, q.level, q.line, max(s.turn) as by_turn from quoted q join said s on s.conv_id = q.conv_id and s.line = q.line and s.turn < q.turn group by all),
votes as (select conv_id, turn, level, by_turn, count(*) as n from found group by all),
parent as (select conv_id, turn, by_turn as parent_turn from votes qualify row_number() over (partition by conv_id, turn order by level, n desc, by_turn desc) = 1),
up as (select conv_id, turn, parent_turn as root_turn, 1::bigint as depth from parent
  union all select u.conv_id, u.turn, p.parent_turn, u.depth + 1 from up u join parent p on p.conv_id = u.conv_id and p.turn = u.root_turn),
top as (select conv_id, turn, arg_max(root_turn, depth) as root_turn, max(depth) as depth from up group by 1, 2)
select t.conv_id, t.turn, p.parent_turn, coalesce(top.root_turn, t.turn) as root_turn, coalesce(top.depth, 0) as depth,
  md5(trim(regexp_replace(t.text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) as text_md5
from t left join parent p on p.conv_id = t.conv_id and p.turn = t.turn left join top on top.conv_id = t.conv_id and top.turn = t.turn
"""
