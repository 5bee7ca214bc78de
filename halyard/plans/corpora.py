"""Corpora's sidecars, caches, plans and indexes; selections, tallies and paired tests for reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard import storage
from halyard.operators import corpora, evaluation, relational
from halyard.plans.corpus import SEED_SQL
from halyard.plans.evaluation import UNITS
from halyard.plans.registry import Tables, query
from halyard.sources import indexes

SEED = SEED_SQL.replace("'0:' || {k}", "{k}")


@query("""with r as (select event_id, case when event_id % 7 = 3 then 0 else value end as rmsd from events)
select event_id, greatest(sum(case when rmsd = 0 then 1 else 0 end) over (order by event_id) - 1, 0)::bigint as grp from r""")
def native_groups(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 7 == 3, 0.0).otherwise(F.col("value")).alias("rmsd"))
    return corpora.native_groups(rows, ["event_id"], "rmsd").select("event_id", "grp")


@query("select p_partkey, p_size, round(p_retailprice * 2, 4) as teacher from part")
def sidecar_join(t: Tables) -> DataFrame:
    side = t.part.select("p_partkey", F.round(F.col("p_retailprice") * 2, 4).alias("teacher"))
    return corpora.with_sidecar(t.part.select("p_partkey", "p_size"), side, "p_partkey")


@query("""select o_orderkey, round(a + b, 6) as z from (select o_orderkey, (o_totalprice - avg(o_totalprice) over ()) / (stddev_samp(o_totalprice) over ()) as a, (o_custkey - avg(o_custkey) over ()) / (stddev_samp(o_custkey) over ()) as b from orders)""")
def aligned_sum(t: Tables) -> DataFrame:
    """Two score tables side by side, by key and not by place; their z-scores added."""
    stats = t.orders.agg(*(f(c).alias(f"{n}_{c}") for c in ("o_totalprice", "o_custkey") for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    z = lambda c: t.orders.select("o_orderkey", ((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(f"z_{c}"))
    both = corpora.aligned([z("o_totalprice"), z("o_custkey")], "o_orderkey")
    return both.select("o_orderkey", F.round(F.col("z_o_totalprice") + F.col("z_o_custkey"), 6).alias("z"))


@query("""with c as (select p_partkey, p_size as token from part where p_size <> 7),
w as (select l_orderkey, list(distinct l_partkey) as parts from lineitem group by 1), e as (select l_orderkey, unnest(parts) as p from w)
select l_orderkey, case when count(*) = count(c.token) then sum(c.token)::bigint end as token_sum, count(*) as residues from e left join c on c.p_partkey = e.p group by 1""")
def cached_tokens(t: Tables) -> DataFrame:
    """All or nothing: an order one of whose parts the cache lacks has no tokens."""
    wanted = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts")).withColumn("struct", F.lit("part"))
    cache = t.part.where("p_size <> 7").select(F.lit("part").alias("struct"), F.col("p_partkey").alias("residue"), F.col("p_size").alias("token"))
    got = corpora.cached_tokens(wanted, cache, "l_orderkey", "struct", "parts").join(wanted.select("l_orderkey", F.size("parts").cast("long").alias("residues")), "l_orderkey")
    return got.select("l_orderkey", F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("token_sum"), "residues")


@query("""with c as (select vec_id // 7 as doc, label::bigint as code, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
d as (select doc from c group by 1 having count(*) >= 3) select code, count(*) as n, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from c where doc in (select doc from d) group by 1""")
def mean_places(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 7).alias("doc"), F.col("label").cast("long").alias("code"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return corpora.mean_places(rows, "doc", "code", ["x", "y", "z"]).select("code", "n", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("""select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by coalesce(case when event_id % 9 <> 0 then value end, 0) desc, event_id) as k from events where event_type <> 'view') where k <= 2""")
def top_conformers(t: Tables) -> DataFrame:
    weight = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    return corpora.top_conformers(t.events, "user_id", weight, ["event_id"], 2, F.col("event_type") != "view").select("user_id", "event_id")


@query(f"""select o_custkey, r as orientation from (select distinct o_custkey, unnest(range(0, 6)) as r from orders) where r = {SEED.format(k="'0:' || o_custkey || ':2'")} % 6""")
def orientation_draw(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey").distinct().withColumn("orientation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return corpora.orientation_draw(rows, "o_custkey", "orientation", 6, 2)


@query("""with o as (select l_orderkey, count(*) filter (l_returnflag = 'R') as lig, count(*) filter (l_returnflag <> 'R') as pocket, sum(l_quantity) filter (l_returnflag = 'R') as lig_sum, sum(l_quantity) as q from lineitem group by 1)
select l_orderkey, lig as n_ligand, pocket as n_pocket, round(coalesce(lig_sum, 0), 4) as ligand_sum, round(q / greatest(lig, 1), 6) as label from o""")
def masked_sides(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", (F.col("l_returnflag") == "R").alias("m"))).alias("of"))
    lig, pocket = (corpora.kept_side(F.col("of.l_quantity"), F.col("of.m"), s) for s in ("ligand", "pocket"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = F.size(lig).cast("long")
    return rows.select("l_orderkey", n.alias("n_ligand"), F.size(pocket).cast("long").alias("n_pocket"), F.round(total(lig), 4).alias("ligand_sum"), F.round(corpora.by_size(total(F.col("of.l_quantity")), n), 6).alias("label"))


@query("""select case when doc_id % 10 = 0 then 'val' else 'train' end as split, doc_id // 64 as shard, array_to_string(list(distinct doc_id % 64 order by doc_id % 64), ' ') as rows_ from documents group by 1, 2""")
def dataset_plan(t: Tables) -> DataFrame:
    rows = t.documents.select(F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), F.floor(F.col("doc_id") / 64).cast("long").alias("shard"), (F.col("doc_id") % 64).alias("local"))
    return corpora.dataset_plan(rows, "split", "shard", "local").select("split", "shard", F.array_join(F.col("rows").cast("array<string>"), " ").alias("rows_"))


@query("""with p as (select doc_id // 64 as shard, count(*) as items from documents group by 1), w as (select (row_number() over (order by shard) - 1) % 3 as worker, items from p)
select worker, sum(items)::bigint as items, ((sum(items) // 8) * 8)::bigint as served from w group by 1""")
def stream_length(t: Tables) -> DataFrame:
    plan = t.documents.groupBy(F.floor(F.col("doc_id") / 64).cast("long").alias("shard")).agg(F.count("*").alias("items"))
    return corpora.stream_length(plan, "shard", "items", 8, 3)


@query("""with w as (select user_id, event_id % 4 as root from events where event_type in ('click', 'view') group by 1, 2 having count(distinct event_type) = 2) select user_id, min(root) as root from w group by 1""")
def complete_roots(t: Tables) -> DataFrame:
    return corpora.complete_roots(t.events.select("user_id", (F.col("event_id") % 4).alias("root"), "event_type"), "user_id", "root", "event_type", ["click", "view"])


@query("""with m as (select 0 as rank, p_partkey, p_name as file, p_size % 3 <> 0 as ok from part union all select 1, p_partkey, p_brand, p_size % 2 = 0 from part where p_partkey % 5 <> 0 union all select 2, p_partkey, p_type, true from part where p_partkey % 11 = 0)
select p_partkey, arg_max(file, rank) as file from m where ok group by 1""")
def manifest_union(t: Tables) -> DataFrame:
    """Of three manifests the later one wins where its file is there."""
    m = lambda c, ok, where="true": t.part.where(where).select("p_partkey", F.col(c).alias("file"), F.expr(ok).alias("ok"))
    parts = [m("p_name", "p_size % 3 <> 0"), m("p_brand", "p_size % 2 = 0", "p_partkey % 5 <> 0"), m("p_type", "true", "p_partkey % 11 = 0")]
    return corpora.union_by_priority(parts, "p_partkey", F.col("ok")).select("p_partkey", "file")


@query("""with k as (select l_orderkey, count(distinct (l_partkey, l_suppkey)) as n from lineitem group by 1) select o_orderkey, n as n_keys from orders join k on k.l_orderkey = o_orderkey""")
def residue_key_sets(t: Tables) -> DataFrame:
    sets = corpora.key_sets(t.lineitem, "l_orderkey", ["l_partkey", "l_suppkey"])
    return t.orders.select("o_orderkey").join(sets, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.size("keys").cast("long").alias("n_keys"))


@query("""select 'absent' as wanted, count(*) as n, null::bigint as first_key from supplier union all select 'present', count(*) filter (s_nationkey = (select min(s_nationkey) from supplier)), null from supplier
union all select 'first', 1, (select min(s_suppkey) from supplier)""")
def report_rows(t: Tables) -> DataFrame:
    s = t.supplier
    nation = s.agg(F.min("s_nationkey")).first()[0]
    count = lambda name, df: df.agg(F.lit(name).alias("wanted"), F.count("*").alias("n"), F.lit(None).cast("long").alias("first_key"))
    one = corpora.selected_or_first(s, F.col("s_nationkey") == -1, ["s_suppkey"]).select(F.lit("first").alias("wanted"), F.lit(1).cast("long").alias("n"), F.col("s_suppkey").alias("first_key"))
    return count("absent", corpora.selected_or_all(s, F.col("s_nationkey") == -1)).union(count("present", corpora.selected_or_all(s, F.col("s_nationkey") == nation))).union(one)


@query("select 'genscore' as method, s_suppkey as pdbid, s_acctbal as pred from supplier union all select 'vina', c_custkey, c_acctbal from customer")
def baseline_tables(t: Tables) -> DataFrame:
    return corpora.canonical(t.supplier, {"s_suppkey": "pdbid", "s_acctbal": "pred"}, "genscore").unionByName(corpora.canonical(t.customer, {"c_custkey": "pdbid", "c_acctbal": "pred"}, "vina"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_suppkey, case l_linestatus || l_returnflag when 'FA' then 1 when 'FR' then 2 when 'OA' then 3 else 4 end, hash_) as place
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag, l_linenumber::bigint * 1000000000 + l_partkey as hash_ from lineitem)""")
def reordered_atoms(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_linestatus", "l_returnflag").alias("name"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("hash_")).distinct()
    placed = corpora.reordered(rows, ["l_orderkey"], ["l_suppkey"], "name", ["FA", "FR", "OA"], "hash_")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("place").cast("long").alias("place"))


@query("""select count(*) as n_docs, sum(n_chars)::bigint as n_tokens, max(n_chars) as longest, count(*) filter (lang = 'en') as english, count(*) filter (n_chars > 2000) as long from documents""")
def corpus_snapshot(t: Tables) -> DataFrame:
    return corpora.snapshot(t.documents, F.col("n_chars"), {"english": F.col("lang") == "en", "long": F.col("n_chars") > 2000})


@query("""with r as (select p_partkey, case when p_size < 5 then 'too_small' when p_retailprice > 1800 then 'no_room' else 'accepted' end as reason from part)
select reason, count(*) as n_rows, count(distinct p_partkey) as parts, count(o) as documents from (select *, unnest(case when reason = 'accepted' then [0, 1, 2] else [null] end) as o from r) group by 1""")
def encoded_or_reason(t: Tables) -> DataFrame:
    rows = corpora.orientations_or_reason(t.part, [("too_small", F.col("p_size") < 5), ("no_room", F.col("p_retailprice") > 1800)], 3)
    return rows.groupBy("reason").agg(F.count("*").alias("n_rows"), F.count_distinct("p_partkey").alias("parts"), F.count("orientation").alias("documents"))


@query("""with w as (select o_custkey, o_orderkey from orders join customer on c_custkey = o_custkey), m as (select o_custkey, min(o_orderkey) as first_order from w where o_custkey not in (select c_custkey from customer where c_acctbal > 5000) group by 1)
select o_custkey, first_order, (select count(*) from w) as n_sites from m""")
def missing_structures(t: Tables) -> DataFrame:
    sites = t.orders.select("o_custkey", "o_orderkey")
    cached = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    whole, missing = corpora.site_store(sites, t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "o_custkey", cached, "o_orderkey")
    return missing.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.lit(whole.count()).cast("long").alias("n_sites"))


GRAPH = """n as (select vec_id // 20 as g, vec_id % 20 as k from embeddings), s as (select g, max(k) + 1 as n from n group by 1), o as (select g, coalesce(sum(n) over (order by g rows between unbounded preceding and 1 preceding), 0) as shift from s),
e as (select a.g, a.k as a, b.k as b, (b.k - a.k) = 1 as bond from n a join n b on a.g = b.g and b.k > a.k and (b.k - a.k <= 2 or (a.k * b.k) % 11 = 5)), d as (select g, a as u, b as v, bond from e union select g, b, a, bond from e)"""


@query(f"""with {GRAPH}, t3 as (select x.g, count(*) as angles from d x join d y on x.g = y.g and x.v = y.v and x.u < y.u group by 1)
select d.g as graph, count(*) as edges, count(*) filter (bond) as bonds, sum(u + shift)::bigint as sources, any_value(angles) as angles from d join o on o.g = d.g join t3 on t3.g = d.g group by 1""")
def batched_graphs(t: Tables) -> DataFrame:
    nodes = t.embeddings.select(F.floor(F.col("vec_id") / 20).cast("long").alias("graph"), (F.col("vec_id") % 20).alias("node"))
    a, b = nodes.withColumnRenamed("node", "a"), nodes.withColumnRenamed("node", "b")
    edges = a.join(b, "graph").where("b > a and (b - a <= 2 or (a * b) % 11 = 5)")
    _, pairs, angles = corpora.batched_graph(nodes, edges, edges.where("b - a = 1"), "graph", "node", "a", "b")
    n = pairs.groupBy("graph").agg(F.count("*").alias("edges"), F.count_if("is_bond").alias("bonds"), F.sum("source").alias("sources"))
    return n.join(angles.groupBy("graph").agg(F.count("*").alias("angles")), "graph")


@query("""with m as (select o_orderpriority as method, avg(o_totalprice) as price, avg(o_custkey) as cust from orders group by 1), r as (select * from m where method = '1-URGENT')
select m.method, round(m.price - r.price, 4) as delta_price, round(m.cust - r.cust, 4) as delta_cust, m.price > r.price and m.cust > r.cust as beats from m, r where m.method <> '1-URGENT'""")
def beats_reference(t: Tables) -> DataFrame:
    table = t.orders.groupBy(F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("price"), F.avg("o_custkey").alias("cust"))
    return evaluation.beats(table, "method", "1-URGENT", ["price", "cust"]).withColumns({c: F.round(c, 4) for c in ("delta_price", "delta_cust")})


@query("""with r as (select p_type, p_name as smiles, p_brand as scaffold, p_size > 10 as ok, p_retailprice > 1500 as hit, p_name in (select p_name from part where p_partkey % 3 = 0) as seen from part)
select p_type, count(*) filter (ok) as n_valid, round(count(*) filter (ok)::double / count(*), 6) as validity, round(count(distinct case when ok then smiles end)::double / nullif(count(*) filter (ok), 0), 6) as uniqueness,
 round(count(distinct case when ok and not seen then smiles end)::double / nullif(count(distinct case when ok then smiles end), 0), 6) as novelty, round(count(distinct case when ok then scaffold end)::double / nullif(count(*) filter (ok), 0), 6) as scaffold_diversity,
 round(count(distinct case when ok and hit then scaffold end)::double / count(*), 6) as hit_scaffolds from r group by 1""")
def set_diversity(t: Tables) -> DataFrame:
    rows = t.part.select("p_type", F.col("p_name").alias("smiles"), F.col("p_brand").alias("scaffold"), "p_size", "p_retailprice")
    known = t.part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("smiles"))  # the training set that novelty is against
    out = evaluation.diversity(rows, ["p_type"], "smiles", "scaffold", F.col("p_size") > 10, F.col("p_retailprice") > 1500, known)
    return out.withColumns({c: F.round(c, 6) for c in ("validity", "uniqueness", "novelty", "scaffold_diversity", "hit_scaffolds")})


@query(f"""with {UNITS}, d as (select c.method, c.value - r.value as d from v c join v r on c.unit = r.unit and r.method = '1-URGENT' where c.method <> '1-URGENT'),
k as (select method, d, rank() over (partition by method order by abs(d)) + (count(*) over (partition by method, abs(d)) - 1) / 2.0 as r, count(*) over (partition by method, abs(d)) as t from d where d <> 0),
s as (select method, count(*)::double as m, sum(case when d > 0 then r else 0 end)::double as plus, sum((t * t - 1)::double) as ties from k group by 1), w as (select *, least(plus, m * (m + 1) / 2 - plus) as w from s)
select w.method, n.n, w.m::bigint as n_nonzero, round(w, 4) as w, round((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 6) as z from w join (select method, count(*) as n from d group by 1) n using (method)""")
def signed_ranks(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.signed_ranks(v, "1-URGENT").withColumns({"w": F.round("w", 4), "z": F.round("z", 6)})


@query(f"""with {UNITS}, d as (select c.method, c.unit, c.value - r.value as d from v c join v r on c.unit = r.unit and r.method = '1-URGENT' where c.method <> '1-URGENT'),
u as (select unit, b, {SEED.format(k="'0:' || unit || ':' || b")}::double / 4294967296 as u from (select distinct unit from d), unnest(range(0, 60)) as x(b)),
p as (select k, sum(exp(-1) / gamma(k + 1)) over (order by k) as upto from range(0, 8) as y(k)),
w as (select unit, b, (select count(*) from p where u.u >= p.upto) as n from u), m as (select method, b, sum(d * n) / sum(n) as mean from d join w using (unit) where n > 0 group by 1, 2)
select s.method, s.n, round(s.delta, 4) as delta, round(quantile_cont(m.mean, 0.025), 3) as low, round(quantile_cont(m.mean, 0.975), 3) as high from m join (select method, count(*) as n, avg(d) as delta from d group by 1) s using (method) group by 1, 2, 3""")
def paired_bootstrap(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.paired_bootstrap(v, "1-URGENT", 60).withColumns({"delta": F.round("delta", 4), "low": F.round("low", 3), "high": F.round("high", 3)})


@query("""select 'per_molecule' as part, count(*) as n from orders union all select 'per_target', count(distinct (o_orderpriority, o_custkey)) from orders union all select 'per_model', count(distinct o_orderpriority) from orders""")
def evaluation_triple(t: Tables) -> DataFrame:
    folder = storage.new_folder(t.spark, "triple")
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    by_target = rows.groupBy("o_orderpriority", "o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    indexes.write_triple(rows, by_target, by_target.groupBy("o_orderpriority").agg(F.avg("mean").alias("mean")), folder)
    csv = lambda name: t.spark.read.option("header", True).csv(f"{folder}/{name}.csv")
    parts = {"per_molecule": t.spark.read.parquet(f"{folder}/per_molecule.parquet"), "per_target": csv("per_target"), "per_model": csv("per_model")}
    out = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("select p_size::bigint as bucket, count(distinct p_name) as n from part group by 1")
def receptor_dump(t: Tables) -> DataFrame:
    folder = storage.new_folder(t.spark, "receptors")
    rows = t.part.select(F.concat_ws("/", "p_name", "p_size").alias("sid"), "p_name", F.col("p_size").cast("long").alias("bucket"), "p_partkey")
    indexes.write_json_buckets(rows, folder, "sid", "bucket", ["p_partkey"])
    back = t.spark.read.schema("sid string, p_name string, p_partkey long, bucket long").json(folder)
    return back.groupBy("bucket").agg(F.count("*").alias("n"))


@query("""with w as (select doc_id, list_distinct(string_split(lower(text), ' ')) as s from documents), r as (select s from w order by doc_id limit 1)
select doc_id, case when len(w.s) > 0 then round(len(list_intersect(w.s, r.s))::double / (len(w.s) + len(r.s) - len(list_intersect(w.s, r.s))), 6) end as similarity from w, r""")
def reference_similarity(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    first = words.orderBy("doc_id").limit(1).first().s  # one reference
    ref = F.from_json(F.lit(json.dumps(first)), "array<string>")
    both = F.size(F.array_intersect("s", ref)).cast("double")
    return words.select("doc_id", F.round(F.try_divide(both, F.size("s") + len(first) - both), 6).alias("similarity"))


@query("""select doc_id from documents d where text is null or not exists (select 1 from benchmark b where b.text <> '' and contains(' ' || d.text || ' ', ' ' || b.text || ' '))""")
def passage_exclusion(t: Tables) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    held = corpora.passages_in(t.documents, t.benchmark.select("item_id", F.col("text").alias("words")), "doc_id", "text", "item_id", "words")
    return relational.without(t.documents.select("doc_id"), held, "doc_id")


@query("""with c as (select doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) as codes from documents where text is not null),
p as (select doc_id, codes, codes[1:6] as head from c where len(codes) >= 6), b as (select * from p where doc_id % 2 = 1), a as (select * from p where doc_id % 2 = 0)
select a.doc_id, (select count(*) from b where b.head = a.head) as n_prefix, (select min(b.doc_id) from b where b.head = a.head) as first, (select count(*) from b where b.codes = a.codes) as n_whole from a""")
def prefix_matches(t: Tables) -> DataFrame:
    """Documents of even number against those of odd number, by the lengths of their first six words."""
    rows = t.documents.where("text is not null").select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("codes"))
    return corpora.prefix_matches(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id", "codes", 6)


@query("""with w as (select unnest(string_split(text, ' ')) as token from documents), n as (select token, count(*) as n from w where token <> '' group by 1)
select token, n, row_number() over (order by n desc, token) - 1 as id from n""")
def document_vocabulary(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.split("text", " ", -1)).alias("token")).where("token <> ''")
    return relational.vocabulary(words).select("token", "n", "id")


@query(f"""with {UNITS}, u as (select unit, b, {SEED.format(k="'0:' || unit || ':' || b")}::double / 4294967296 as u from (select distinct unit from v), unnest(range(0, 60)) as x(b)),
p as (select k, sum(exp(-1) / gamma(k + 1)) over (order by k) as upto from range(0, 8) as y(k)),
w as (select unit, b, (select count(*) from p where u.u >= p.upto) as n from u), m as (select method, b, sum(value * n) / sum(n) as mean from v join w using (unit) where n > 0 group by 1, 2)
select m.method, s.n, round(s.mean, 4) as mean, round(quantile_cont(m.mean, 0.025), 3) as low, round(quantile_cont(m.mean, 0.975), 3) as high from m join (select method, count(*) as n, avg(value) as mean from v group by 1) s using (method) group by 1, 2, 3""")
def bootstrap_means(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.bootstrap(v, ["method"], "unit", "value", 60).withColumns({"mean": F.round("mean", 4), "low": F.round("low", 3), "high": F.round("high", 3)})


@query()
def pairwise_wilcoxon_holm(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.pairwise_wilcoxon(v, "1-URGENT").withColumns({c: F.round(c, 6) for c in ("w", "p", "p_holm")})
