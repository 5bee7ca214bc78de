"""Corpus building on documents, events, conversations and the order tables: dedup, leakage, splits, identifiers, token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions import scalars, sequences
from halyard.operators import graph, relational, rounds
from halyard.plans.registry import Tables, query

SEED_SQL = "('0x' || substr(sha256('0:' || {k}), 1, 8))::bigint"


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def first_wins_dedup(t: Tables) -> DataFrame:
    return relational.first_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("select user_id, event_type, max(event_id) as event_id from events group by 1, 2")
def last_wins_dedup(t: Tables) -> DataFrame:
    return relational.last_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("select md5(text) as content, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def content_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def leak_exclusion(t: Tables) -> DataFrame:
    bad = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.without(t.orders.select("o_orderkey", "o_custkey"), bad, "o_custkey").select("o_orderkey", "o_custkey")


@query("select doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def semi_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("select o_orderkey, coalesce(c_mktsegment, 'none') as segment from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def dictionary_lookup(t: Tables) -> DataFrame:
    names = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return t.orders.select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("select l_orderkey, count(*) as records, any_value(o_orderstatus) as o_orderstatus from lineitem join orders on l_orderkey = o_orderkey group by 1")
def fk_join(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("records"))
    return n.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").select("l_orderkey", "records", "o_orderstatus")


@query("select doc_id as id from documents union select page_id from pages union select item_id from benchmark")
def evaluation_ids(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id")).union(t.pages.select("page_id")).union(t.benchmark.select("item_id")).distinct()


@query("select user_id from events where event_type = 'click' intersect select user_id from events where value > 50")
def intersect_ids(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").select("user_id").intersect(t.events.where("value > 50").select("user_id"))


@query("select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus = 'P'")
def except_ids(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").select("o_custkey").subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("select count(*) as n, count(*) filter (text not in (select text from benchmark)) as novel, round(count(*) filter (text not in (select text from benchmark))::double / count(*), 6) as novelty from documents")
def novelty(t: Tables) -> DataFrame:
    seen = t.benchmark.select(F.sha2(F.col("text").cast("binary"), 256).alias("key")).distinct().withColumn("seen", F.lit(True))
    rows = t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("key")).join(seen, "key", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("seen").isNull()).alias("novel")).withColumn("novelty", F.round(F.try_divide(F.col("novel").cast("double"), F.col("n")), 6))


@query(f"""with u as (select doc_id, source, {SEED_SQL.format(k="source")}::double / 4294967296 as u from documents)
select doc_id, case when u < 0.1 then 'test' when u < 0.3 then 'val' else 'train' end as split from u""")
def group_split(t: Tables) -> DataFrame:
    return relational.group_split(t.documents.select("doc_id", "source"), "source", 0.2, 0.1).select("doc_id", "split")


@query(f"""with g as (select source, row_number() over (order by {SEED_SQL.format(k="source")}, source) - 1 as k, count(*) over () as n from (select distinct source from documents))
select doc_id, case when k < floor(n * 0.25) then 'val' else 'train' end as split from documents join g using (source)""")
def counted_group_split(t: Tables) -> DataFrame:
    return relational.counted_split(t.documents.select("doc_id", "source"), "source", 0.25).select("doc_id", "split")


@query(f"""with g as (select source, count(*) as n, {SEED_SQL.format(k="source")} as u from documents group by source), p as (select source, coalesce(sum(n) over (order by u, source rows between unbounded preceding and 1 preceding), 0) as before from g)
select doc_id, case when before < 0.25 * (select count(*) from documents) then 'val' else 'train' end as split from documents join p using (source)""")
def sized_group_split(t: Tables) -> DataFrame:
    return relational.sized_split(t.documents.select("doc_id", "source"), "source", 0.25).select("doc_id", "split")


@query(f"select o_orderkey, {SEED_SQL.format(k='o_orderkey')} as seed, substr(sha256(o_orderkey || '¦' || o_orderstatus), 1, 16) as content from orders")
def named_seeds(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", scalars.named_seed(0, key).alias("seed"), F.substring(scalars.content_key(key, F.col("o_orderstatus")), 1, 16).alias("content"))


@query("""with r as (select doc_id, source, n_chars, row_number() over (partition by source order by doc_id) as k from documents) select doc_id from r where k <= 5 or n_chars < 200""")
def capped_per_group(t: Tables) -> DataFrame:
    return relational.capped(t.documents.select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], 5, F.col("n_chars") < 200).select("doc_id")


@query("""select case when toxic = 1 then 'toxic' when quality = 0 then 'quality' when n_chars < 300 then 'short' else 'accepted' end as reason, count(*) as n from documents left join labels using (doc_id) group by 1""")
def first_failing_reason(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    tagged = relational.first_reason(rows, [("toxic", F.col("toxic") == 1), ("quality", F.col("quality") == 0), ("short", F.col("n_chars") < 300)])
    return tagged.groupBy("reason").agg(F.count("*").alias("n"))


@query("select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as pair_idx from orders")
def dense_pair_idx(t: Tables) -> DataFrame:
    return relational.global_position(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("position").alias("pair_idx"))


@query("select doc_id, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as doc_offset from documents")
def doc_offsets(t: Tables) -> DataFrame:
    return relational.global_prefix(t.documents.select("doc_id", "n_chars"), ["doc_id"], "n_chars").select("doc_id", F.col("before").cast("long").alias("doc_offset"))


@query("""select user_id, event_id, coalesce(max(case when value < 5 then event_id end) over (partition by user_id order by event_id rows unbounded preceding), min(event_id) over (partition by user_id)) as start from events""")
def as_of_lookup(t: Tables) -> DataFrame:
    return relational.as_of(t.events.select("user_id", "event_id", "value"), "event_id", F.col("value") < 5, ["user_id"]).select("user_id", "event_id", "start")


@query("""select user_id, event_id, sum(case when value < 5 then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding)::bigint as grp from events""")
def group_by_sentinel(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.sum(F.when(F.col("value") < 5, 1).otherwise(0)).over(w).cast("long").alias("grp"))


@query("""with d as (select source, doc_id, least(n_chars, 4000) as n, row_number() over (partition by source order by doc_id) as k from documents),
f as (with recursive r as (select source, doc_id, k, n as used, 0::bigint as block_id from d where k = 1
 union all select d.source, d.doc_id, d.k, case when r.used + d.n > 4000 then d.n else r.used + d.n end, r.block_id + case when r.used + d.n > 4000 then 1 else 0 end from r join d on d.source = r.source and d.k = r.k + 1) select * from r)
select source, doc_id, block_id from f""")
def pack_blocks(t: Tables) -> DataFrame:
    return relational.pack_blocks(t.documents.select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 4000).select("source", "doc_id", "block_id")


@query("""with a as (select event_id, user_id as grp from events where event_id % 2 = 0), b as (select event_id, user_id as grp from events where event_id % 2 = 1)
select event_id, grp::bigint as grp from a union all select event_id, (grp + (select max(grp) + 1 from a))::bigint from b""")
def mix_with_offsets(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("user_id").alias("grp"))
    return relational.union_with_offsets([rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")], "grp")


@query("""with w as (select unnest(string_split(text, ' ')) as token from conversations), n as (select token, count(*) as n from w where token <> '' group by 1)
select token, n, row_number() over (order by n desc, token) - 1 as id from n""")
def vocab_counts(t: Tables) -> DataFrame:
    words = t.conversations.select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''")
    return relational.vocabulary(words).select("token", "n", "id")


@query("""select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by case when value > 20 then 0 else 1 end, event_id) as k from events) where k <= 4""")
def constrained_fill(t: Tables) -> DataFrame:
    return relational.constrained_fill(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id"], ["event_id"], F.col("value") > 20, 4).select("user_id", "event_type", "event_id")


@query("""select doc_id, unnest(range(0, case when doc_id % 4 = 0 then 1 else 3 end)) as copy from documents""")
def rotation_copies(t: Tables) -> DataFrame:
    last = F.when(F.col("doc_id") % 4 == 0, 0).otherwise(2)
    return t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("copy"))


@query("""select o_custkey, o_orderkey, ((row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4)::bigint as unit from orders""")
def capped_units(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.floor((k - 1) / 4).cast("long").alias("unit"))


@query("""select count(*) as blocks, count(*) filter (n > 1) as mixed from (select l_orderkey // 4 as b, count(distinct l_returnflag) as n from lineitem group by 1)""")
def partition_consistency(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.floor(F.col("l_orderkey") / 4).alias("b")).agg(F.countDistinct("l_returnflag").alias("n"))
    return n.agg(F.count("*").alias("blocks"), F.count_if(F.col("n") > 1).alias("mixed"))


@query("""select p_partkey, p_name, case when p_size > 25 then 'measured' when p_retailprice > 1000 then 'collected' else 'none' end as origin from part""")
def priority_fallback(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", F.coalesce(F.when(F.col("p_size") > 25, "measured"), F.when(F.col("p_retailprice") > 1000, "collected"), F.lit("none")).alias("origin"))


@query("""select doc_id as node, min(doc_id) over (partition by md5(text)) as root from documents where md5(text) in (select md5(text) from documents group by 1 having count(*) > 1)""")
def bond_components(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5("text").alias("key"))
    least = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return graph.roots(rows.join(least, "key").select("a", F.col("doc_id").alias("b")))


@query("""select c_custkey, lower(nullif(regexp_extract(substr(md5(c_name), 1, 4) || '_' || c_name, '^([0-9a-zA-Z]{4})_', 1), '')) as pdb, lower(nullif(regexp_extract(c_name, '^([0-9a-zA-Z]{4})_', 1), '')) as none, substr(md5(c_name), 2, 2) as bucket from customer""")
def regex_pdb_id(t: Tables) -> DataFrame:
    name = F.col("c_name")
    pdb = scalars.pdb_id(F.concat(F.substring(F.md5(name), 1, 4), F.lit("_"), name))
    return t.customer.select("c_custkey", pdb.alias("pdb"), scalars.pdb_id(name).alias("none"), scalars.bucket_code(pdb).alias("bucket"))


AFFINITY = """with a as (select event_id, case event_id % 4 when 0 then 'Kd=' when 1 then 'IC50<' when 2 then 'Ki~' else 'EC50=' end || event_id || case event_id % 3 when 0 then 'nM' when 1 then 'uM' else 'mM' end as t from events)"""


@query(f"""{AFFINITY} select event_id, t as written, round(case when event_id % 4 <> 3 and event_id > 0 then -log10(event_id * case event_id % 3 when 0 then 1e-9::double when 1 then 1e-6 else 1e-3 end) end, 6) as pk from a""")
def parse_affinity(t: Tables) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Kd=", "IC50<", "Ki~", "EC50="))), (e % 4 + 1).cast("int"))
    unit = F.element_at(F.array(*(F.lit(x) for x in ("nM", "uM", "mM"))), (e % 3 + 1).cast("int"))
    rows = t.events.select("event_id", F.concat(kind, e.cast("string"), unit).alias("written"))
    return rows.select("event_id", "written", F.round(scalars.affinity_pk(F.col("written")), 6).alias("pk"))


@query("""select event_id, (event_id % 4096) // 256 as d0, (event_id // 16) % 16 as d1, event_id % 16 as d2, greatest(-2, least(2, (event_id % 9) - 4)) as clamped,
 case when event_id % 9 < 3 then 0 when event_id % 9 < 5 then 1 when event_id % 9 = 5 then 2 when event_id % 9 = 6 then 3 else 4 end as ring, lpad(event_id::varchar, 7, '0') || '.sdf.gz' as member from events""")
def scalar_codes(t: Tables) -> DataFrame:
    e = F.col("event_id")
    d = scalars.digits(e % 4096, 4, 3)
    return t.events.select("event_id", *(d[k].cast("long").alias(f"d{k}") for k in range(3)), scalars.clamp(e % 9 - 4, -2, 2).cast("long").alias("clamped"), scalars.ring_bucket(e % 9).alias("ring"), scalars.ligand_member(e).alias("member"))


def turns(t: Tables) -> DataFrame:
    """A sequence for each conversation: users' turn lengths as the pocket, the others' as the ligand."""
    size = F.pmod(F.length("text"), F.lit(500)).cast("int")
    side = lambda user: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "user") == F.lit(user), F.struct("turn", size.alias("n"))))), lambda s: s["n"])
    return t.conversations.groupBy("conv_id").agg(side(True).alias("p"), side(False).alias("l"))


TURNS = """s as (select conv_id, coalesce(list((length(text) % 500)::int order by turn, (length(text) % 500)) filter (role = 'user'), []) as p,
 coalesce(list((length(text) % 500)::int order by turn, (length(text) % 500)) filter (role <> 'user'), []) as l from conversations group by 1),
q as (select *, list_concat([1, 3], list_transform(p, lambda x: x + 7), [4, 5], list_transform(l, lambda x: x + 7), [6, 2]) as tokens from s)"""


@query(f"with {TURNS} select conv_id, array_to_string(tokens, ' ') as tokens from q")
def build_sequence(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", F.array_join(sequences.build_sequence(F.col("p"), F.col("l")).cast("array<string>"), " ").alias("tokens"))


@query(f"with {TURNS} select conv_id, array_to_string(p, ' ') as pocket, array_to_string(l, ' ') as ligand from q")
def split_sequence(t: Tables) -> DataFrame:
    built = turns(t).select("conv_id", sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    pocket, ligand = sequences.split_sequence(F.col("tokens"))
    return built.select("conv_id", F.array_join(pocket.cast("array<string>"), " ").alias("pocket"), F.array_join(ligand.cast("array<string>"), " ").alias("ligand"))


@query(f"with {TURNS} select conv_id, repeat('0', (len(p) + 4)::bigint) || repeat('1', len(l)::bigint) || '00' as mask from q")
def ligand_mask(t: Tables) -> DataFrame:
    built = turns(t).select("conv_id", sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    return built.select("conv_id", F.array_join(F.transform(sequences.ligand_mask(F.col("tokens")), lambda m: m.cast("int").cast("string")), "").alias("mask"))


@query(f"""with {TURNS} select conv_id, array_to_string(list_concat(list_transform(range(0, (len(p) + 4)::bigint), lambda i: -100), list_transform(l, lambda x: x + 7), [6, 2]), ' ') as labels from q""")
def prompt_labels(t: Tables) -> DataFrame:
    built = turns(t).select("conv_id", sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    return built.select("conv_id", F.array_join(sequences.prompt_labels(F.col("tokens")).cast("array<string>"), " ").alias("labels"))


@query(f"""with {TURNS} select conv_id, array_to_string(list_concat(list_transform(range(0, (len(p) + 4)::bigint), lambda i: 255), list_transform(l, lambda x: x % 4), [255, 255]), ' ') as labels from q""")
def token_labels(t: Tables) -> DataFrame:
    rows = turns(t)
    labels = sequences.token_labels(F.transform("l", lambda x: x % 4), F.size("p"), F.size("l"))
    return rows.select("conv_id", F.array_join(labels.cast("array<string>"), " ").alias("labels"))


@query(f"""with {TURNS} select conv_id, array_to_string(list_resize(tokens[1:8], 8, 0), ' ') as block, least(len(tokens), 8)::bigint as attended from q""")
def padded_block(t: Tables) -> DataFrame:
    built = turns(t).select("conv_id", sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    short = sequences.truncate(F.col("tokens"), 8)
    mask = sequences.attention_mask(short, F.lit(8))
    return built.select("conv_id", F.array_join(sequences.pad_right(short, F.lit(8)).cast("array<string>"), " ").alias("block"), F.aggregate(mask, F.lit(0), lambda a, m: a + m).cast("long").alias("attended"))


@query(f"""with {TURNS} select conv_id, array_to_string(case when conv_id % 3 = 0 then list_concat([1, 3, 4, 5], list_transform(l, lambda x: x + 7), [6, 2]) else tokens end, ' ') as tokens from q""")
def pocket_dropout(t: Tables) -> DataFrame:
    built = turns(t).select("conv_id", sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    return built.select("conv_id", F.array_join(sequences.drop_pocket(F.col("tokens"), F.col("conv_id") % 3 == 0).cast("array<string>"), " ").alias("tokens"))


@query(f"with {TURNS} select array_to_string(p[1:2], ' ') as prefix, count(*) as n, min(conv_id) as first_conv from q group by 1 having count(*) > 1")
def prefix_signature_join(t: Tables) -> DataFrame:
    return turns(t).groupBy(F.array_join(F.slice("p", 1, 2).cast("array<string>"), " ").alias("prefix")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv")).where("n > 1")


@query()
def masked_tokens(t: Tables) -> DataFrame:
    built = turns(t).select("conv_id", sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    inputs, labels = sequences.masked(F.col("tokens"), sequences.ligand_mask(F.col("tokens")), 0.3, 600, 500, 0, F.col("conv_id"))
    return built.select("conv_id", inputs.alias("inputs"), labels.alias("labels"))


@query("""with w as (select doc_id, list_distinct(string_split(text, ' ')) as s from documents), p as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.s, b.s))::double as i, len(a.s) + len(b.s) as u from w a join w b on a.doc_id // 10 = b.doc_id // 10 and a.doc_id < b.doc_id)
select a // 10 as grp, round(avg(i / nullif(u - i, 0)), 6) as similarity, count(*) as pairs from p group by 1""")
def pairwise_tanimoto(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.floor(F.col("doc_id") / 10).cast("long").alias("grp"), F.array_distinct(F.split("text", " ")).alias("s"))
    a, b = words.alias("a"), words.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.grp").alias("grp"), scalars.jaccard(F.col("a.s"), F.col("b.s")).alias("j"))
    return pairs.groupBy("grp").agg(F.round(F.avg("j"), 6).alias("similarity"), F.count("*").alias("pairs"))


@query("""select event_id, (props::json ->> '$.k')::bigint as k from events""")
def nested_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


RESAMPLED = """c as (select vec_id // 20 as molecule, list(floor((embedding[1]::double + 1) * 250)::int order by vec_id) as codes from embeddings group by 1),
e as (select molecule, unnest(codes) as code, unnest(range(len(codes))) as i, len(codes) as n from c),
r as (select *, row_number() over (partition by molecule order by ('0x' || substr(sha256('0:' || molecule || ':' || i), 1, 8))::bigint, i) as place, ('0x' || substr(sha256('1:' || molecule || ':' || i), 1, 8))::bigint % 500 as drawn from e)"""


def molecule_codes(t: Tables) -> DataFrame:
    """molecule, codes: of its twenty consecutive vectors."""
    code = F.floor((F.col("embedding")[0].cast("double") + 1) * 250).cast("int")
    own = F.array_sort(F.collect_list(F.struct("vec_id", code.alias("code"))))
    return t.embeddings.groupBy(F.floor(F.col("vec_id") / 20).cast("long").alias("molecule")).agg(F.transform(own, lambda x: x["code"]).alias("codes"))


@query(f"""with {RESAMPLED} select molecule, string_agg(case when place <= round_even(n * 0.3, 0) then drawn else code end, ' ' order by i) as codes, count(*) filter (place <= round_even(n * 0.3, 0)) as n_drawn from r group by 1""")
def resampled_codes(t: Tables) -> DataFrame:
    new = sequences.resampled(F.col("codes"), 0.3, 500, 0, F.col("molecule"))
    return molecule_codes(t).select("molecule", F.array_join(new.cast("array<string>"), " ").alias("codes"), F.bround(F.size("codes") * F.lit(0.3)).cast("long").alias("n_drawn"))


#: A mask and a model without parameters for the queries of rounds: a code is told by its neighbours, its belief by both.
MASK = 500


def neighbour_model(rows: DataFrame) -> DataFrame:
    left = lambda i: F.coalesce(F.get("codes", i - 1), F.lit(0))
    right = lambda i: F.coalesce(F.get("codes", i + 1), F.lit(0))
    best = F.transform("codes", lambda c, i: (left(i) * 31 + right(i) * 17 + i * 7) % 500)
    belief = F.transform(F.zip_with("codes", best, lambda c, b: F.when(c == MASK, b).otherwise(c)), lambda c, i: ((c * 37 + left(i) * 5 + i * 11) % 101) / F.lit(101.0))
    return rows.select("key", best.alias("best"), belief.alias("confidence"))


@query()
def cold_decode(t: Tables) -> DataFrame:
    """Sequences of masks, but for every seventh code, filled in six rounds."""
    rows = molecule_codes(t).select("molecule", F.transform("codes", lambda c, i: F.when(i % 7 == 0, c).otherwise(F.lit(MASK))).alias("codes"))
    return rounds.filled(rows, neighbour_model, "molecule", MASK, 6).select("molecule", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query()
def refined_codes(t: Tables) -> DataFrame:
    out = rounds.refined(molecule_codes(t), neighbour_model, "molecule", MASK, rounds=4, share=0.2)
    return out.select("molecule", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))
