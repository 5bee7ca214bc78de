"""Evaluation analytics on orders (a target is a customer, a pose an order), lineitem, events, part and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard import storage
from halyard.functions import scalars
from halyard.operators import evaluation, relational
from halyard.plans.registry import Tables, query

POSES = """poses as (select o_custkey as pdbid, o_orderkey as pose, dayofyear(o_orderdate)::double / 100 as rmsd,
 o_totalprice as s1, (o_orderkey * 7919 % 1000)::double as s2 from orders)"""
LONG = POSES + ", scores as (select 's1' as method, pdbid, pose, rmsd, s1 as score from poses union all select 's2', pdbid, pose, rmsd, s2 from poses)"


def poses(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("pdbid"), F.col("o_orderkey").alias("pose"), (F.dayofyear("o_orderdate").cast("double") / 100).alias("rmsd"), F.col("o_totalprice").alias("s1"), (F.col("o_orderkey") * 7919 % 1000).cast("double").alias("s2"))


def long_scores(t: Tables) -> DataFrame:
    return poses(t).unpivot(["pdbid", "pose", "rmsd"], ["s1", "s2"], "method", "score")


def six(*columns: str) -> dict:
    return {c: F.round(c, 6) for c in columns}


RANKS = """(rank() over (partition by {k} order by {c}) + (count(*) over (partition by {k}, {c}) - 1) / 2.0)"""
R1, R2 = (RANKS.format(k="method, pdbid", c=c) for c in ("score", "rmsd"))


@query(f"""with {LONG}, g as (select *, row_number() over (partition by method, pdbid order by score desc, pose) as k,
 count(*) over (partition by method, pdbid) as n from scores)
select method, count(*) as n_targets, round(avg(case when rmsd < 1 then 100.0::double else 0 end), 6) as success_1,
 round(avg(case when rmsd < 2 then 100.0::double else 0 end), 6) as success_2 from g where k = 1 and n >= 3 group by method""")
def docking_power(t: Tables) -> DataFrame:
    return evaluation.docking_power(long_scores(t)).withColumns(six("success_1", "success_2"))


@query(f"""with {POSES}, z as (select *, (s1 - avg(s1) over w) / (stddev_samp(s1) over w + 1e-9) as z1, (s2 - avg(s2) over w) / (stddev_samp(s2) over w + 1e-9) as z2
 from poses window w as (partition by pdbid))
select pdbid, pose, round(coalesce(z1, 0) + coalesce(z2, 0), 6) + 0.0::double as fused from z""")
def zsum_ensemble(t: Tables) -> DataFrame:
    return evaluation.zsum(poses(t), ["pdbid"], ["s1", "s2"]).select("pdbid", "pose", (F.round("fused", 6) + F.lit(0.0)).alias("fused"))


@query(f"""with {LONG}, z as (select method, pdbid, pose, (score - avg(score) over w) / (stddev_samp(score) over w + 1e-9) as z from scores window w as (partition by pdbid, method))
select pdbid, pose, round(sum(coalesce(z, 0)), 6) + 0.0::double as fused from z group by pdbid, pose having count(distinct method) = 2""")
def fused_members(t: Tables) -> DataFrame:
    return evaluation.fuse_members(long_scores(t), ["pdbid", "pose"], "method", "score", ["pdbid"]).withColumn("fused", F.round("fused", 6) + F.lit(0.0))


@query(f"""with {LONG}, z as (select *, (score - avg(score) over w) / (stddev_samp(score) over w + 1e-9) as z from scores window w as (partition by pdbid, method)),
f as (select pdbid, pose, any_value(rmsd) as rmsd, sum(coalesce(z, 0)) as score from z group by 1, 2),
g as (select *, row_number() over (partition by pdbid order by round(score, 9) desc, pose) as k, count(*) over (partition by pdbid) as n from f)
select 'fused' as method, count(*) as n_targets, round(avg(case when rmsd < 1 then 100.0::double else 0 end), 6) as success_1,
 round(avg(case when rmsd < 2 then 100.0::double else 0 end), 6) as success_2 from g where k = 1 and n >= 3""")
def docking_power_fused(t: Tables) -> DataFrame:
    fused = evaluation.zsum(poses(t), ["pdbid"], ["s1", "s2"]).select(F.lit("fused").alias("method"), "pdbid", "pose", "rmsd", F.round("fused", 9).alias("score"))
    return evaluation.docking_power(fused).withColumns(six("success_1", "success_2"))


@query("""with r as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rv, rank() over (order by user_id) + (count(*) over (partition by user_id) - 1) / 2.0 as ru
 from events where value is not null and user_id is not null), c as (select corr(rv, ru) as rho from r)
select event_id, round(case when (select rho from c) > 0 then -value else value end, 6) as score from events""")
def orient_scores(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("value").alias("score"), F.col("user_id").alias("rmsd"))
    return evaluation.orient(rows).select("event_id", F.round("score", 6).alias("score"))


@query(f"""with {LONG}, r as (select method, pdbid, {R1} as a, {R2} as b from scores), g as (select method, pdbid, count(*) as n,
 covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) as rho from r group by 1, 2)
select method, round(avg(rho), 6) as rho, count(*) as n_groups from g where n >= 3 and rho is not null group by 1""")
def group_spearman(t: Tables) -> DataFrame:
    return evaluation.ranking_power(long_scores(t), ["method"], ["pdbid"], "score", "rmsd").withColumns(six("rho"))


@query("""select p_brand, count(*) as n, round(case when count(*) >= 2 then covar_samp(p_size, p_retailprice) / nullif(stddev_samp(p_size) * stddev_samp(p_retailprice), 0) end, 6) as r from part group by 1""")
def scoring_pearson(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(relational.correlation("p_size", "p_retailprice"), 6).alias("r"))


PVALUES = """p as (select o_orderpriority, o_orderstatus, case when o_orderstatus = 'P' and o_orderpriority like '1%' then null else (count(*) % 97)::double / 970 end as p from orders group by 1, 2)"""


@query(f"""with {PVALUES}, m as (select *, (count(p) over () - row_number() over (partition by p is null order by p, o_orderpriority, o_orderstatus) + 1) * p as own from p)
select o_orderpriority, o_orderstatus, round(p, 6) as p, round(case when p is not null then least(max(own) over (partition by p is null order by p, o_orderpriority, o_orderstatus rows unbounded preceding), 1.0) end, 6) as p_holm from m""")
def holm_adjust(t: Tables) -> DataFrame:
    skip = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1")
    p = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg((F.count("*") % 97).cast("double").alias("n")).select("o_orderpriority", "o_orderstatus", F.when(~skip, F.col("n") / 970).alias("p"))
    return relational.holm(p, "p", ["o_orderpriority", "o_orderstatus"]).withColumns(six("p", "p_holm"))


@query("""select source, count(*) as n, count(*) filter (quality = 1 and toxic = 1) as both, count(*) filter (quality = 1 and toxic <> 1) as first_only,
 count(*) filter (quality <> 1 and toxic = 1) as second_only, round(count(*) filter (quality = 1 and toxic <> 1)::double / nullif(count(*) filter ((quality = 1) <> (toxic = 1)), 0), 6) as win_rate
from documents join labels using (doc_id) group by 1""")
def mcnemar_counts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    return evaluation.discordant(rows, ["source"], F.col("quality") == 1, F.col("toxic") == 1).withColumns(six("win_rate"))


SEEDS = "by_seed as (select l_returnflag as arm, l_linenumber::bigint as seed, avg(l_discount) as value from lineitem where not (l_returnflag = 'R' and l_linenumber > 4) group by 1, 2)"


def by_seed(t: Tables) -> DataFrame:
    rows = t.lineitem.where(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 4))).select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").cast("long").alias("seed"), "l_discount")
    return evaluation.seed_metric(rows, "arm", "seed", F.avg("l_discount"))


@query(f"with {SEEDS} select arm, count(value) as n_seeds, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from by_seed group by 1")
def seed_spread(t: Tables) -> DataFrame:
    return evaluation.seed_spread(by_seed(t)).withColumns(six("mean", "sd"))


@query(f"""with {SEEDS} select b.arm, count(*) as n_shared, round(avg(b.value - a.value), 6) as delta, round(stddev_samp(b.value - a.value), 6) as delta_sd, count(*) filter (b.value - a.value > 0) as n_better
from by_seed b join by_seed a on a.seed = b.seed and a.arm = 'A' where b.arm <> 'A' group by 1""")
def paired_by_seed(t: Tables) -> DataFrame:
    return evaluation.paired_by_seed(by_seed(t), "A").withColumns(six("delta", "delta_sd"))


UNITS = "v as (select o_orderpriority as method, o_custkey as unit, avg(o_totalprice) as value from orders group by 1, 2)"


@query(f"""with {UNITS} select c.method, count(*) as n, round(avg(c.value - r.value), 4) as delta, round(stddev_samp(c.value - r.value), 4) as sd
from v c join v r on c.unit = r.unit and r.method = '1-URGENT' where c.method <> '1-URGENT' group by 1""")
def pairwise_vs_reference(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.pairwise(v, "1-URGENT").withColumns({c: F.round(c, 4) for c in ("delta", "sd")})


@query()
def pairwise_ttest_holm(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.pairwise_ttest(v, "1-URGENT").withColumns(six("delta", "sd", "p", "p_holm"))


@query(f"""with {LONG}, g as (select *, row_number() over (partition by method, pdbid order by score desc, pose) as k, count(*) over (partition by method, pdbid) as n from scores),
best as (select method, pdbid, rmsd < 2 as ok from g where k = 1 and n >= 3),
t as (select c.method, count(*) as n, count(*) filter (r.ok and c.ok) as both, count(*) filter (r.ok and not c.ok) as first_only, count(*) filter (not r.ok and c.ok) as second_only
 from best c join best r on c.pdbid = r.pdbid and r.method = 's1' where c.method <> 's1' group by 1),
m as (select *, first_only + second_only as m from t),
tail as (select method, sum(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) - m * ln(2))) as tail from (select method, m, unnest(range(0, least(first_only, second_only) + 1)) as j from m) group by 1)
select method, n, "both", first_only, second_only, round(first_only::double / nullif(m, 0), 6) as win_rate, round(least(1.0::double, 2 * tail), 6) as p, round(least(1.0::double, 2 * tail), 6) as p_holm from m join tail using (method)""")
def pairwise_mcnemar_holm(t: Tables) -> DataFrame:
    """One method against the reference, so that Holm's adjustment leaves its p as it is."""
    best = evaluation.top_pose(long_scores(t), ["method", "pdbid"]).select("method", F.col("pdbid").alias("unit"), (F.col("rmsd") < 2).alias("success"))
    return evaluation.pairwise_mcnemar(best, "s1").withColumns(six("win_rate", "p", "p_holm"))


@query()
def pairwise_williams_holm(t: Tables) -> DataFrame:
    return evaluation.pairwise_williams(poses(t), "rmsd", "s1", ["s2"]).withColumns(six("r_reference", "r_method", "r_between", "p", "p_holm"))


@query("""select l_returnflag as model, count(*) as n_targets, round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 4) as l_extendedprice, round(avg(l_discount), 6) as l_discount, round(avg(l_tax), 6) as l_tax from lineitem group by 1""")
def per_model_table(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumnRenamed("l_returnflag", "model")
    table = evaluation.mean_table(rows, ["model"], only=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return table.withColumns({"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 4), "l_discount": F.round("l_discount", 6), "l_tax": F.round("l_tax", 6)})


MOLECULES = """mol as (select event_type as model, user_id as target_id, event_id as idx, event_id % 7 <> 0 as valid, case when event_id % 5 = 0 then null else event_id % 3 = 0 end as pb_valid,
 case when event_id % 11 = 0 then null else (event_id % 90)::double / 10 end as sa, (event_id % 100)::double / 100 as qed, case when value = 0 then null else 20 - value end as vina_dock,
 case when event_id % 13 = 0 then null else (event_id % 4)::bigint end as clash_count, case when event_id % 2 = 0 then -1.0::double end as ref_dock from events)"""


def molecules(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return t.events.select(
        F.col("event_type").alias("model"), F.col("user_id").alias("target_id"), e.alias("idx"), (e % 7 != 0).alias("valid"), F.when(e % 5 != 0, e % 3 == 0).alias("pb_valid"),
        F.when(e % 11 != 0, (e % 90).cast("double") / 10).alias("sa"), ((e % 100).cast("double") / 100).alias("qed"), (20 - F.nullif(v, F.lit(0.0))).alias("vina_dock"),
        F.when(e % 13 != 0, e % 4).alias("clash_count"), F.when(e % 2 == 0, -1.0).alias("ref_dock"),
    )


HIT = """(valid and coalesce(pb_valid, false) and coalesce(sa <= 5, false) and coalesce(qed >= 0.4, false) and coalesce(vina_dock <= coalesce(ref_dock, 0), false))"""


@query(f"with {MOLECULES} select model, target_id, idx, {HIT} as hit from mol")
def hit_flags(t: Tables) -> DataFrame:
    return evaluation.hits(molecules(t)).select("model", "target_id", "idx", "hit")


@query(f"""with {MOLECULES} select model, target_id, count(*) as n_generated, round(avg(valid::int), 6) as valid_frac, round(avg(pb_valid::int), 6) as pb_valid_frac, round(avg(sa), 6) as sa_mean, round(avg(qed), 6) as qed_mean,
 round(median(vina_dock), 6) as vina_dock_median, round(avg(case when clash_count = 0 then 1.0::double else 0 end), 6) as clash_count_free_rate, round(avg({HIT}::int), 6) as hit_rate from mol group by 1, 2""")
def per_target_summary(t: Tables) -> DataFrame:
    out = evaluation.summary(evaluation.hits(molecules(t)), ["model", "target_id"], ["valid", "pb_valid", "absent"], ["sa", "qed"], ["vina_dock"], ["clash_count"], ["hit"])
    return out.withColumns(six(*out.columns[3:]))


@query(f"""with {MOLECULES} select model, count(*) as n, round(avg(case when valid then qed end), 6) as qed, round(avg(case when valid then sa end), 6) as sa, round(avg(coalesce(pb_valid, false)::int), 6) as pb_valid, round(avg(vina_dock / greatest(idx % 30, 1)), 6) as efficiency from mol group by 1""")
def molecule_pool(t: Tables) -> DataFrame:
    valid = lambda c: F.avg(F.when(F.col("valid"), F.col(c)))
    size = F.greatest(F.col("idx") % 30, F.lit(1))
    return molecules(t).groupBy("model").agg(F.count("*").alias("n"), valid("qed").alias("qed"), valid("sa").alias("sa"), F.avg(F.coalesce(F.col("pb_valid"), F.lit(False)).cast("int")).alias("pb_valid"), F.avg(F.col("vina_dock") / size).alias("efficiency")).withColumns(six("qed", "sa", "pb_valid", "efficiency"))


@query(f"""with {MOLECULES}, c as (select model, count(*) as a, count(*) filter (valid) as b, count(*) filter (valid and pb_valid) as d, count(*) filter (valid and pb_valid and vina_dock < 0) as e from mol group by 1)
select model, unnest(range(0, 4)) as step, unnest(['generated', 'valid', 'passing', 'docked']) as stage, unnest([a, b, d, e]) as n, round(unnest([a, b, d, e])::double / nullif(a, 0), 6) as share from c""")
def funnel_counts(t: Tables) -> DataFrame:
    v = F.col("valid")
    p = v & F.coalesce(F.col("pb_valid"), F.lit(False))
    out = evaluation.funnel(molecules(t), ["model"], [("generated", F.lit(True)), ("valid", v), ("passing", p), ("docked", p & (F.col("vina_dock") < 0))])
    return out.withColumn("step", F.col("step").cast("long")).withColumns(six("share"))


@query("""select l_returnflag as model, l_linestatus as modality, coalesce(nullif(case when l_linenumber % 2 = 0 then 'pocket' end, ''), 'native') as eval_scope, count(distinct l_orderkey) as n,
 round(avg(l_quantity), 6) as q_mean, round(stddev_samp(l_quantity), 6) as q_std, case when avg(l_quantity) is null then '—' else printf('%.1f', round(avg(l_quantity), 1)) end as text
from lineitem group by 1, 2, 3""")
def recon_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("modality"), F.when(F.col("l_linenumber") % 2 == 0, "pocket").alias("eval_scope"), "l_orderkey", F.col("l_quantity").alias("q"))
    out = evaluation.spread_table(rows, ["model", "modality"], "eval_scope", ["q"], "l_orderkey")
    return out.withColumn("text", F.when(F.col("q_mean").isNull(), "—").otherwise(F.format_string("%.1f", F.round("q_mean", 1)))).withColumns(six("q_mean", "q_std"))


@query("""with n as (select user_id, event_type, count(*) as k from events where event_type is not null group by 1, 2)
select user_id, count(*) as active, round(count(*) / 5.0::double, 6) as utilisation, round(exp(ln(sum(k)::double) - sum(k * ln(k::double)) / sum(k)), 6) as perplexity from n group by 1""")
def code_usage(t: Tables) -> DataFrame:
    return evaluation.usage(t.events, ["user_id"], "event_type", 5).withColumns(six("utilisation", "perplexity"))


@query("""select 'even' as a, 'odd' as b, (select count(*) from (select distinct user_id from events where event_id % 2 = 0 intersect select distinct user_id from events where event_id % 2 = 1)) as shared""")
def shared_codes(t: Tables) -> DataFrame:
    even, odd = (t.events.where(F.col("event_id") % 2 == k).select("user_id").distinct() for k in (0, 1))
    return even.intersect(odd).agg(F.count("*").alias("shared")).select(F.lit("even").alias("a"), F.lit("odd").alias("b"), "shared")


@query(f"""with {LONG}, m as (select method, pdbid, pose, score, max(score) over w as top, count(*) over w as n from scores window w as (partition by method, pdbid)),
e as (select *, exp((score - top) / 1000) as e from m)
select method, pdbid, pose, round(e / sum(e) over (partition by method, pdbid), 6) as share from e where n > 1""")
def group_softmax(t: Tables) -> DataFrame:
    rows = long_scores(t).withColumn("score", F.col("score") / 1000)
    return evaluation.group_softmax(rows, ["method", "pdbid"], "score").select("method", "pdbid", "pose", F.round("share", 6).alias("share"))


@query("""with a as (select l_orderkey, l_linenumber, avg(l_discount) as l from lineitem where l_discount > 0 group by 1, 2), b as (select l_orderkey, avg(l) as l from a group by 1)
select round(avg(l), 6) as loss, count(*) as n_examples from b""")
def balanced_loss(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("loss", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    return evaluation.balanced_mean(rows, "l_orderkey", "l_linenumber", "loss").withColumns(six("loss"))


@query("""with n as (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2)
select l_returnflag, l_linestatus, count(*) as rows_, round((select sum(n)::double / count(*) from n) / count(*), 6) as weight from lineitem group by 1, 2""")
def inverse_frequency(t: Tables) -> DataFrame:
    out = relational.classes_balanced(t.lineitem.select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows_"), F.round(F.first("weight"), 6).alias("weight"))


@query("""select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) as p10, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.9), 6) as p90 from lineitem group by 1""")
def quantiles(t: Tables) -> DataFrame:
    q = relational.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])
    return q.groupBy("l_returnflag").agg(*(F.round(F.max(F.when(F.col("prob") == k, F.col("q"))), 6).alias(n) for k, n in enumerate(("p10", "p50", "p90"))))


@query("""with q as (select l_returnflag as f, quantile_cont(l_extendedprice, [i / 63.0 for i in range(0, 64)]) as q from lineitem group by 1)
select b.f as flag, round(list_avg([abs(x[1] - x[2]) for x in list_zip(a.q, b.q)]), 4) as w1 from q a join q b on a.f = 'A' and b.f <> 'A'""")
def w1_distance(t: Tables) -> DataFrame:
    q = relational.quantiles(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice", [k / 63.0 for k in range(64)])
    q = storage.cut(q, "quantiles")
    base = q.where("flag = 'A'").select("prob", F.col("q").alias("base"))  # 64 rows
    return q.where("flag <> 'A'").join(base, "prob").groupBy("flag").agg(F.round(F.avg(F.abs(F.col("base") - F.col("q"))), 4).alias("w1"))


@query("""select floor(l_quantity / 10)::bigint as bucket, count(*) as n from lineitem group by 1""")
def histogram(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.floor(F.col("l_quantity") / 10).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""select p_partkey, p_size::bigint as p_size, round(p_retailprice, 6) as p_retailprice from part a where not exists
 (select 1 from part b where b.p_size <= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size < a.p_size or b.p_retailprice < a.p_retailprice))""")
def pareto_front(t: Tables) -> DataFrame:
    front = relational.pareto(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return front.select("p_partkey", F.col("p_size").cast("long").alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query("""select o_orderkey, round(o_totalprice, 2) as o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""")
def top_hits(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey from r where k <= greatest(1, round_even(n * 0.25, 0))""")
def nsmallest_frac(t: Tables) -> DataFrame:
    return relational.smallest_share(t.orders, ["o_custkey"], ["o_totalprice", "o_orderkey"], 0.25).select("o_custkey", "o_orderkey")


@query("""select o_orderkey from orders order by o_orderkey offset 10 limit 15""")
def offset_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(10).limit(15)


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) - 1 as k, count(*) over (partition by o_custkey) as n from orders)
select distinct o_custkey, o_orderkey from r, (select unnest(range(0, 5)) as i) where k = round_even(i * (n - 1) / 4.0, 0)""")
def evenly_spaced(t: Tables) -> DataFrame:
    return relational.evenly_spaced(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 5).select("o_custkey", "o_orderkey")


@query("""select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as f, round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as o, count(*) filter (o_orderstatus = 'P') as n_p from orders group by 1""")
def fold_pivot(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice").alias("s"), F.count("o_orderkey").alias("n"))
    return wide.select("o_orderpriority", F.round("F_s", 2).alias("f"), F.round("O_s", 2).alias("o"), F.coalesce("P_n", F.lit(0).cast("long")).alias("n_p"))


@query("""select user_id, round(avg(value) filter (event_type = (select min(event_type) from events)), 6) as first_arm, round(avg(value) filter (event_type = (select max(event_type) from events)), 6) as last_arm from events group by 1""")
def pivot_long_wide(t: Tables) -> DataFrame:
    ends = t.events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    wide = t.events.groupBy("user_id").pivot("event_type", [ends.a, ends.b]).agg(F.avg("value"))
    return wide.select("user_id", F.round(wide[ends.a], 6).alias("first_arm"), F.round(wide[ends.b], 6).alias("last_arm"))


@query("""select o_custkey, arg_min(o_totalprice, o_orderkey) filter (o_totalprice > 100000) as first_large, min(o_orderkey) as first_key from orders group by 1""")
def first_non_null(t: Tables) -> DataFrame:
    large = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return t.orders.groupBy("o_custkey").agg(F.min_by(large, F.when(large.isNotNull(), F.col("o_orderkey"))).alias("first_large"), F.min("o_orderkey").alias("first_key"))


@query("""with n as (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) select o_custkey, string_agg(o_orderstatus || '=' || n, ';' order by o_orderstatus) as counts from n group by 1""")
def value_counts_map(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.concat_ws("=", "o_orderstatus", "n"))).alias("c")).select("o_custkey", F.array_join("c", ";").alias("counts"))


@query("""select arg_min(p_name, (p_retailprice, p_partkey)) as name, min(p_retailprice) as price from part""")
def global_argmin(t: Tables) -> DataFrame:
    return t.part.agg(F.min_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("name"), F.min("p_retailprice").alias("price"))


@query("""select l_returnflag, count(*) as n_all, count(distinct l_orderkey) as n_distinct, round(count(distinct l_orderkey)::double / nullif(count(*), 0), 6) as uniqueness from lineitem group by 1""")
def uniqueness(t: Tables) -> DataFrame:
    n = F.countDistinct("l_orderkey")
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n_all"), n.alias("n_distinct"), F.round(F.try_divide(n.cast("double"), F.count("*")), 6).alias("uniqueness"))


@query("""select coalesce(l_returnflag, 'all') as flag, coalesce(l_linestatus, 'all') as status, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def three_grains(t: Tables) -> DataFrame:
    out = t.lineitem.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], F.col("l_returnflag"), F.col("l_linestatus")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("""with w as (select user_id, sum(value) as s, count(value) as n from events group by 1) select round(sum(s) / greatest(sum(n), 1), 6) as weighted from w""")
def weighted_mean(t: Tables) -> DataFrame:
    w = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    return w.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("weighted"))


@query("""with m as (select o_custkey, o_orderdate, o_orderkey, o_totalprice from orders) select count(*) filter (isfinite(o_totalprice)) as n_finite, count(*) filter (o_totalprice between 1000 and 200000) as n_range, count(*) filter (o_orderkey % 3 = 1) as n_shard from m""")
def filters(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.agg(F.count_if(scalars.finite(price)).alias("n_finite"), F.count_if(price.between(1000, 200000)).alias("n_range"), F.count_if(F.pmod("o_orderkey", F.lit(3)) == 1).alias("n_shard"))


@query("""select o_custkey, o_orderkey, dense_rank() over (partition by o_custkey order by o_orderpriority) - 1 as dense_id, sum(case when o_orderstatus = 'F' then 1 else 0 end) over (partition by o_custkey order by o_orderkey rows unbounded preceding)::bigint as run_id from orders""")
def dense_and_run_ids(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    run = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return t.orders.select("o_custkey", "o_orderkey", (F.dense_rank().over(w.orderBy("o_orderpriority")) - 1).cast("long").alias("dense_id"), run.cast("long").alias("run_id"))
