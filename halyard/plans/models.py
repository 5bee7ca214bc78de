"""Model-side operators on embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators import models
from halyard.plans.registry import Tables, query


@query("""with v as (select label::bigint as code, unnest(range(0, 64)) as dim, unnest(embedding)::double as x from embeddings),
s as (select code, dim, sum(x) as s, count(*) as n from v group by 1, 2), k as (select code, max(n) as n from s group by 1),
z as (select code, 0.99::double * 5 + 0.01::double * n as size from k), t as (select sum(size) as total, count(*) as codes from z)
select s.code, round(z.size, 6) as size, round(sum((0.01::double * s.s) / ((z.size + 1e-5::double) / (t.total + t.codes * 1e-5::double) * t.total)), 6) as centre_sum, false as restarted
from s join z on s.code = z.code cross join t group by all""".replace("group by all", "group by s.code, z.size"))
def codebook_step(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").cast("long").alias("code"), "embedding")
    old = rows.select("code").distinct().select("code", F.lit(5.0).alias("size"), F.array_repeat(F.lit(0.0), 64).alias("sums"))
    new = models.codebook_step(rows, "embedding", "code", old)
    return new.select("code", F.round("size", 6).alias("size"), F.round(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x), 6).alias("centre_sum"), "restarted")


@query("""select a.conv_id, a.turn::bigint as i, b.turn::bigint as j from conversations a join conversations b on a.conv_id = b.conv_id and b.turn <= a.turn and (a.turn // 2) = (b.turn // 2)""")
def attention_pairs(t: Tables) -> DataFrame:
    tokens = t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / 2).cast("long").alias("segment"))
    return models.attention_pairs(tokens, "conv_id", "turn", "segment")


@query("""with e as (select label::bigint as label, vec_id, -abs(u.x::double) as lp, u.dim from (select label, vec_id, unnest(embedding) as x, unnest(range(0, 64)) as dim from embeddings) u)
select label, round(avg(lp), 6) as score, count(*) as n from e where dim % 3 = 0 group by 1""")
def masked_score(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("dim", "x")).withColumn("lp", -F.abs(F.col("x").cast("double")))
    return models.masked_score(e, ["label"], "lp", F.col("dim") % 3 == 0).withColumn("score", F.round("score", 6))


@query("""with r as (select label::bigint as label, embedding[1]::double as p, embedding[2]::double as q from embeddings), s as (select label, ln(sum(exp(-p))) as zp, ln(sum(exp(-q))) as zq, count(*) as n from r group by 1)
select r.label, round(avg(case when abs(p - q) < 1 then (p - q) * (p - q) / 2 else abs(p - q) - 0.5 end), 6) as smooth_l1, round(case when any_value(n) > 1 then -sum(exp(-q - zq) * (-p - zp)) end, 6) as listwise from r join s on r.label = s.label group by 1""")
def group_losses(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").cast("long").alias("label"), F.col("embedding")[0].cast("double").alias("p"), F.col("embedding")[1].cast("double").alias("q"))
    return models.group_losses(rows, ["label"], "p", "q").withColumns({c: F.round(c, 6) for c in ("smooth_l1", "listwise")})


@query("""with d as (select vec_id // 50 as sequence, unnest(embedding)::double as v, unnest(range(0, 64)) as dim, vec_id from embeddings)
select sequence, dim, round(avg(case when vec_id % 2 = 0 then v end), 6) as mean from d group by 1, 2""")
def pooled_readout(t: Tables) -> DataFrame:
    """Sequences of 50 states, all dimensions."""
    state = F.struct("vec_id", F.col("embedding").cast("array<double>").alias("state"), (F.col("vec_id") % 2 == 0).alias("on"))
    rows = t.embeddings.groupBy(F.floor(F.col("vec_id") / 50).cast("long").alias("sequence")).agg(F.collect_list(state).alias("of")).select("sequence", "of.state", "of.on")
    pooled = models.pooled(rows, ["sequence"], "state", "on").select("sequence", F.posexplode("mean").alias("dim", "mean"))
    return pooled.select("sequence", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))
