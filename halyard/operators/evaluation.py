"""Long result tables to metric tables: docking power, rankings, ensembles, paired tests, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from halyard import storage
from halyard.functions import scalars, statistics
from halyard.names import free
from halyard.operators import relational

GROUP_FLOOR, SA_MOST, QED_LEAST = 3, 5.0, 0.4


def top_pose(scores: DataFrame, keys: list[str], score: str = "score", order: str = "pose", keep: str = "rmsd", floor: int = GROUP_FLOOR) -> DataFrame:
    """keep of each group's best score (ties to the first in order); groups under floor scored rows go, as do null scores."""
    best = F.min_by(keep, F.struct(-F.col(score), F.col(order)))
    return scores.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys).agg(F.count("*").alias("_n"), best.alias(keep)).where(F.col("_n") >= floor).drop("_n")


def docking_power(scores: DataFrame, cuts: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """For each method, the percent of targets whose best-scored pose is nearer than each cut (strictly)."""
    best = top_pose(scores, ["method", "pdbid"])
    return best.groupBy("method").agg(F.count("*").alias("n_targets"), *(F.avg(F.when(F.col("rmsd") < c, 100.0).otherwise(0.0)).alias(f"success_{c:g}".replace(".", "_")) for c in cuts))


def orient(scores: DataFrame, score: str = "score", rmsd: str = "rmsd") -> DataFrame:
    """score negated where its pooled rank correlation with rmsd is over 0, so that larger is better. One number reaches the driver."""
    ranked = relational.global_ranks(relational.global_ranks(scores.where(F.col(score).isNotNull() & F.col(rmsd).isNotNull()), score), rmsd)
    rho = ranked.agg(relational.correlation(f"rank_{score}", f"rank_{rmsd}").alias("rho")).first().rho
    return scores.withColumn(score, -F.col(score) if rho is not None and rho > 0 else F.col(score))


def zsum(scores: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """fused: sum of the columns' z-scores within each group; a missing member adds nothing."""
    z = relational.zscores(scores, group, columns)
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(F.nanvl(F.col(f"z_{c}"), F.lit(0.0)), F.lit(0.0))
    return z.withColumn("fused", out)


def fuse_members(members: DataFrame, keys: list[str], member: str, score: str, group: list[str]) -> DataFrame:
    """The same from a long table of members: keys that every member has, summed."""
    count = members.select(member).distinct().count()
    z = relational.zscores(members, [*group, member], [score])
    return z.groupBy(*keys).agg(F.sum(F.coalesce(f"z_{score}", F.lit(0.0))).alias("fused"), F.countDistinct(member).alias("_n")).where(F.col("_n") == count).drop("_n")


def group_spearman(df: DataFrame, group: list[str], x: str, y: str, floor: int = GROUP_FLOOR) -> DataFrame:
    """rho of each group of floor rows or more; constant sides give none."""
    there = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    ranked = relational.group_ranks(there, group, [x, y])
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), relational.correlation(f"rank_{x}", f"rank_{y}").alias("rho")).where((F.col("n") >= floor) & F.col("rho").isNotNull())


def ranking_power(df: DataFrame, methods: list[str], group: list[str], x: str, y: str) -> DataFrame:
    """Mean of the groups' rho for each method: over groups, not rows."""
    return group_spearman(df, [*methods, *group], x, y).groupBy(*methods).agg(F.avg("rho").alias("rho"), F.count("*").alias("n_groups"))


def mean_table(df: DataFrame, keys: list[str], size: str = "n_targets", only: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column, nulls aside, and the number of rows."""
    numeric = only or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias(size), *(F.avg(c).alias(c) for c in numeric))


def summary(df: DataFrame, keys: list[str], fractions: list[str], means: list[str], medians: list[str], zero_rates: list[str], flags: list[str]) -> DataFrame:
    """Columns that aren't there are passed over. Fractions and means leave nulls out; zero and flag rates divide by all rows."""
    has = set(df.columns)
    own = [F.avg(F.col(c).cast("double")).alias(f"{c}_frac") for c in fractions if c in has]
    own += [F.avg(c).alias(f"{c}_mean") for c in means if c in has]
    own += [F.median(c).alias(f"{c}_median") for c in medians if c in has]
    own += [F.avg(F.when(F.col(c) == 0, 1.0).otherwise(0.0)).alias(f"{c}_free_rate") for c in zero_rates if c in has]
    own += [F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}_rate") for c in flags if c in has]
    return df.groupBy(*keys).agg(F.count("*").alias("n_generated"), *own)


def spread_table(df: DataFrame, keys: list[str], scope: str, values: list[str], unit: str, default: str = "native") -> DataFrame:
    """Mean, sample deviation and distinct units by keys and scope, a null scope as default."""
    own = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.withColumn(scope, F.coalesce(scope, F.lit(default))).groupBy(*keys, scope).agg(F.countDistinct(unit).alias("n"), *own)


def hits(df: DataFrame, ref_dock: str | None = "ref_dock") -> DataFrame:
    """hit: valid, passing, easy enough to make, drug-like, and docking no worse than the reference (without one: no worse than 0).
    Columns that aren't there pass, but for valid and vina_dock; nulls don't pass."""
    has = set(df.columns)
    ok = F.col("valid") if "valid" in has else F.lit(False)
    for column, rule in (("pb_valid", lambda c: c), ("sa", lambda c: c <= SA_MOST), ("qed", lambda c: c >= QED_LEAST)):
        if column in has:
            ok = ok & F.coalesce(rule(F.col(column)), F.lit(False))
    least = F.coalesce(F.col(ref_dock), F.lit(0.0)) if ref_dock in has else F.lit(0.0)
    dock = F.coalesce(F.col("vina_dock") <= least, F.lit(False)) if "vina_dock" in has else F.lit(False)
    return df.withColumn("hit", F.coalesce(ok, F.lit(False)) & dock)


def funnel(df: DataFrame, keys: list[str], stages: list[tuple[str, Column]]) -> DataFrame:
    """stage, n and share of the first stage, a row for each stage."""
    counts = df.groupBy(*keys).agg(*(F.count_if(rule).alias(name) for name, rule in stages))
    first = F.col(stages[0][0])
    each = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n"), F.try_divide(F.col(n).cast("double"), first).alias("share")) for k, (n, _) in enumerate(stages)))
    return counts.select(*keys, F.inline(each))


def seed_metric(df: DataFrame, arm: str, seed: str, value: Column) -> DataFrame:
    return df.groupBy(arm, seed).agg(value.alias("value"))


def seed_spread(by_seed: DataFrame, arm: str = "arm") -> DataFrame:
    """Mean and sample deviation over seeds; null for one seed."""
    return by_seed.groupBy(arm).agg(F.count("value").alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def paired_by_seed(by_seed: DataFrame, first: str, arm: str = "arm", seed: str = "seed") -> DataFrame:
    """Each other arm against first on the seeds both have: mean difference, its deviation, seeds where it is better."""
    base = by_seed.where(F.col(arm) == first).select(seed, F.col("value").alias("base"))
    d = F.col("value") - F.col("base")
    return by_seed.where(F.col(arm) != first).join(base, seed).groupBy(arm).agg(F.count("*").alias("n_shared"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("delta_sd"), F.count_if(d > 0).alias("n_better"))


def discordant(df: DataFrame, keys: list[str], first: Column, second: Column) -> DataFrame:
    """Numbers of paired outcomes and the win rate over discordant pairs."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"))
    return out.withColumn("win_rate", F.try_divide(F.col("first_only").cast("double"), (F.col("first_only") + F.col("second_only")).cast("double")))


def differences(values: DataFrame, reference: str, method: str, unit: str, value: str, into: str) -> DataFrame:
    """method, unit and the difference from the reference's value on shared units, as a column into; missing ones are left out."""
    base = values.where(F.col(method) == reference).select(unit, F.col(value).alias(into))
    rows = values.where(F.col(method) != reference).select(method, unit, value).join(base, unit)
    return rows.select(method, unit, (F.col(value) - F.col(into)).alias(into)).where(F.col(into).isNotNull() & ~F.isnan(into))


def pairwise(values: DataFrame, reference: str, method: str = "method", unit: str = "unit", value: str = "value") -> DataFrame:
    """Each method against the reference on their shared units: n, mean and deviation of the difference."""
    base = free("_base", values)
    other = values.where(F.col(method) == reference).select(unit, F.col(value).alias(base))
    d = F.col(value) - F.col(base)
    return values.where(F.col(method) != reference).join(other, unit).where(d.isNotNull()).groupBy(method).agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"))


def _with_pvalues(spark: SparkSession, rows: list, schema: T.StructType, names: list[str]) -> DataFrame:
    """rows: (row, pvalue): one for each method, on the driver after all aggregation."""
    adjusted = statistics.holm([p for _, p in rows])
    out = [(*r, p, h) for (r, p), h in zip(rows, adjusted, strict=True)]
    more = [T.StructField(n, T.DoubleType()) for n in names]
    return spark.createDataFrame(out, T.StructType([*schema.fields, *more]))


def pairwise_ttest(values: DataFrame, reference: str, **names: str) -> DataFrame:
    """pairwise() with the paired t-test's p and Holm's adjustment over methods."""
    table = pairwise(values, reference, **names)
    rows = [(r, statistics.t_from_sums(r.n, r.delta, r.sd if r.sd is not None else statistics.NAN).pvalue) for r in table.collect()]  # a row for each method
    return _with_pvalues(values.sparkSession, rows, table.schema, ["p", "p_holm"])


def pairwise_mcnemar(outcomes: DataFrame, reference: str, method: str = "method", unit: str = "unit", success: str = "success") -> DataFrame:
    base = free("_base", outcomes)
    other = outcomes.where(F.col(method) == reference).select(unit, F.col(success).alias(base))
    table = discordant(outcomes.where(F.col(method) != reference).join(other, unit), [method], F.col(base), F.col(success))
    rows = [(r, statistics.mcnemar(r.first_only, r.second_only, r.n).pvalue) for r in table.collect()]  # a row for each method
    return _with_pvalues(outcomes.sparkSession, rows, table.schema, ["p", "p_holm"])


def pairwise_williams(wide: DataFrame, label: str, reference: str, methods: list[str]) -> DataFrame:
    """Whether each method's correlation with the label differs from the reference's, on rows where all three are finite."""
    from halyard.functions import scalars

    parts = None
    for m in methods:
        there = wide.where(scalars.finite(F.col(label), F.col(reference), F.col(m)))
        c = relational.correlation
        part = there.agg(F.lit(m).alias("method"), F.count("*").alias("n"), c(label, reference).alias("r_reference"), c(label, m).alias("r_method"), c(reference, m).alias("r_between"))
        parts = part if parts is None else parts.unionByName(part)
    nan = lambda x: statistics.NAN if x is None else x
    rows = [(r, statistics.williams(nan(r.r_reference), nan(r.r_method), nan(r.r_between), r.n).pvalue) for r in parts.collect()]  # a row for each method
    return _with_pvalues(wide.sparkSession, rows, parts.schema, ["p", "p_holm"])


def usage(codes: DataFrame, keys: list[str], code: str, size: int) -> DataFrame:
    """Distinct codes, their share of size, and perplexity."""
    n = codes.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.count("*").alias("_n"))
    total = F.sum("_n")
    # -sum p ln p with p = n / total is ln(total) - sum(n ln n) / total, which needs no second pass
    return n.groupBy(*keys).agg(F.count("*").alias("active"), (F.count("*") / F.lit(float(size))).alias("utilisation"), F.exp(F.ln(total.cast("double")) - F.sum(F.col("_n") * F.ln(F.col("_n").cast("double"))) / total).alias("perplexity"))


def group_softmax(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """share: softmax of the score within each group; groups of one are left out."""
    w = Window.partitionBy(*keys)
    top = F.max(score).over(w)
    e = F.exp(F.col(score) - top)
    own, n = free("_e", df), free("_n", df)
    return df.withColumn(own, e).withColumn(n, F.count("*").over(w)).withColumn("share", F.col(own) / F.sum(own).over(w)).where(F.col(n) > 1).drop(own, n)


def balanced_mean(df: DataFrame, example: str, component: str, loss: str) -> DataFrame:
    """Mean over examples of the mean over present components of the mean loss."""
    inner = df.where(F.col(loss).isNotNull()).groupBy(example, component).agg(F.avg(loss).alias("_l"))
    return inner.groupBy(example).agg(F.avg("_l").alias("_l")).agg(F.avg("_l").alias("loss"), F.count("*").alias("n_examples"))


def beats(table: DataFrame, method: str, reference: str, metrics: list[str]) -> DataFrame:
    """Each other method against the reference row: the metrics' differences, and beats where all are positive (not where one is null)."""
    base = table.where(F.col(method) == reference).select(*metrics).first()
    out = table.where(F.col(method) != reference)
    delta = {f"delta_{m}": F.col(m) - F.lit(None if base is None else base[m]).cast("double") for m in metrics}
    won = F.lit(True)
    for d in delta.values():
        won = won & F.coalesce(d > 0, F.lit(False))
    return out.withColumns(delta | {"beats": won}).select(method, *delta, "beats")


def diversity(df: DataFrame, keys: list[str], smiles: str, scaffold: str, valid: Column, hit: Column, known: DataFrame) -> DataFrame:
    """Of each key n_valid, validity, uniqueness, novelty (of distinct valid ones, against known's smiles), scaffold_diversity (over valid
    ones) and hit_scaffolds (distinct ones of hits over all rows)."""
    ok, won = F.coalesce(valid, F.lit(False)), F.coalesce(hit, F.lit(False))
    seen = free("_known", df)
    novel = known.select(F.col(smiles)).distinct().withColumn(seen, F.lit(True))
    rows = df.join(novel, smiles, "left").groupBy(*keys)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    n, n_valid = F.count("*"), F.count_if(ok)
    unique = F.count_distinct(F.when(ok, F.col(smiles)))
    return rows.agg(
        n_valid.alias("n_valid"), ratio(n_valid, n).alias("validity"), ratio(unique, n_valid).alias("uniqueness"),
        ratio(F.count_distinct(F.when(ok & F.col(seen).isNull(), F.col(smiles))), unique).alias("novelty"),
        ratio(F.count_distinct(F.when(ok, F.col(scaffold))), n_valid).alias("scaffold_diversity"), ratio(F.count_distinct(F.when(ok & won, F.col(scaffold))), n).alias("hit_scaffolds"),
    )


def _rank_sums(values: DataFrame, reference: str, method: str, unit: str, value: str) -> DataFrame:
    """method, n, m (differences that aren't zero), w (the smaller rank sum), ties (the sum of t ** 3 - t over ties)."""
    d, size, t, up, rank = (free(c, values.select(method)) for c in ("_d", "_size", "_t", "_plus", "_rank"))
    rows = differences(values, reference, method, unit, value, d)
    sizes = rows.groupBy(method, F.abs(d).alias(size)).agg(F.count("*").alias(t), F.count_if(F.col(d) > 0).alias(up))
    before = F.coalesce(F.sum(t).over(Window.partitionBy(method).orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # zeros come first: they take no part, nor places
    zeros = F.sum(F.when(F.col(size) == 0, F.col(t)).otherwise(0)).over(Window.partitionBy(method))
    some = sizes.withColumn(rank, before - zeros + (F.col(t) + 1) / 2).where(F.col(size) > 0)
    count, m = F.col(t).cast("double"), F.col("m").cast("double")
    sums = some.groupBy(method).agg(F.sum(t).alias("m"), F.sum(F.col(rank) * F.col(up)).alias("plus"), F.sum(count * count * count - count).alias("ties"))
    n = sizes.groupBy(method).agg(F.sum(t).alias("n"))
    return n.join(sums, method, "left").select(method, "n", F.coalesce("m", F.lit(0).cast("long")).alias("m"), F.least(F.col("plus"), m * (m + 1) / 2 - F.col("plus")).alias("w"), "ties")


def signed_ranks(values: DataFrame, reference: str, method: str = "method", unit: str = "unit", value: str = "value") -> DataFrame:
    """Wilcoxon's signed ranks of each method against the reference on shared units, zeros left out: n, n_nonzero, w (the smaller rank
    sum), z of the normal form with its variance corrected for ties. No task holds a method's units at once but the window's sort."""
    m = F.col("m").cast("double")
    z = F.try_divide(F.col("w") - m * (m + 1) / 4, F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48))
    return _rank_sums(values, reference, method, unit, value).select(method, "n", F.col("m").alias("n_nonzero"), "w", z.alias("z"))


def pairwise_wilcoxon(values: DataFrame, reference: str, method: str = "method", unit: str = "unit", value: str = "value") -> DataFrame:
    """method, n, n_nonzero, w with the test's p (exact where it can be) and Holm's adjustment over methods."""
    sums = _rank_sums(values, reference, method, unit, value).collect()  # a row for each method
    rows = [((r[0], r.n, r.m, r.w), statistics.signed_rank_p(r.w or 0.0, r.m, r.n, r.ties or 0.0)) for r in sums]
    kind = values.schema[method].dataType
    schema = T.StructType([T.StructField(method, kind), T.StructField("n", T.LongType()), T.StructField("n_nonzero", T.LongType()), T.StructField("w", T.DoubleType())])
    return _with_pvalues(values.sparkSession, rows, schema, ["p", "p_holm"])


def bootstrap(rows: DataFrame, keys: list[str], unit: str, value: str, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Of each key n and mean of the values that are numbers, and low and high: the percentile interval of the means of Poisson resamples. A
    unit counts as often in a resample as its name draws, so units are resampled wherever they lie and all keys see the same draws."""
    times, mean, draw, own, total, count = (free(c, rows.select(*keys, unit)) for c in ("_times", "_mean", "_draw", "_own", "_total", "_count"))
    rows = rows.select(*keys, unit, value).where(F.col(value).isNotNull() & ~F.isnan(value))
    sums = storage.cut(rows.groupBy(*keys, unit).agg(F.sum(F.col(value).cast("double")).alias(total), F.count("*").alias(count)), "units")
    steps, share, upto = [], math.exp(-1), 0.0
    for k in range(1, 9):  # the chance of nine and more is 1e-6
        upto += share
        steps.append(upto)
        share /= k
    name = lambda b: F.concat_ws(":", F.col(own).cast("string"), b.cast("string"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: scalars.uniform(seed, name(b)))
    drawn = F.transform(drawn, lambda u: sum(((u >= p).cast("int") for p in steps), F.lit(0)))
    # a unit draws once, whatever its keys; hashing is the work, so that the number of tasks must not follow from the few bytes; the plain
    # explode would draw again for a filter on the size
    context = rows.sparkSession.sparkContext
    tasks = max(context.defaultParallelism * 4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = sums.select(F.col(unit).alias(own)).repartition(tasks, own).distinct().select(own, drawn.alias(times))
    each = sums.join(units, F.col(unit).eqNullSafe(F.col(own))).select(*keys, total, count, F.posexplode_outer(times).alias(draw, times)).where(F.col(times) > 0)
    means = each.groupBy(*keys, draw).agg(F.try_divide(F.sum(F.col(total) * F.col(times)), F.sum(F.col(count) * F.col(times)).cast("double")).alias(mean))
    edges = means.groupBy(*keys).agg(F.percentile(mean, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("interval"))  # of resamples, not of rows
    whole = sums.groupBy(*keys).agg(F.sum(count).alias("n"), F.try_divide(F.sum(total), F.sum(count).cast("double")).alias("mean"))
    return whole.join(edges, keys).select(*keys, "n", "mean", F.col("interval")[0].alias("low"), F.col("interval")[1].alias("high"))


def paired_bootstrap(values: DataFrame, reference: str, resamples: int = 200, level: float = 0.95, seed: int = 0, method: str = "method", unit: str = "unit", value: str = "value") -> DataFrame:
    """bootstrap() of each method's differences from the reference on shared units; their mean is delta."""
    d = free("_d", values.select(method, unit))
    return bootstrap(differences(values, reference, method, unit, value, d), [method], unit, d, resamples, level, seed).withColumnRenamed("mean", "delta")
