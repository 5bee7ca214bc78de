"""Deduplication, ranks, splits, leakage, identifiers and ordered folds over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard import storage
from halyard.functions import scalars
from halyard.names import free


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; order must be total for the result to be one."""
    return top_k(df, keys, order, 1)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.desc(c) for c in order])


def top_k(df: DataFrame, keys: list[str], order: list[str | Column], k: int | Column) -> DataFrame:
    n = free("_n", df)
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= k).drop(n)


def smallest_share(df: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """Of each key the first max(1, round(n * share)) rows, halves to even."""
    n = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    place, most = free("_k", df), free("_most", df)
    return df.withColumns({place: k, most: F.greatest(F.lit(1), F.bround(n * F.lit(share)))}).where(F.col(place) <= F.col(most)).drop(place, most)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """Of each key rows at count even steps of the order, ends included; each once."""
    n = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    size, place = free("_n", df), free("_k", df)
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col(size) - 1) / F.lit(max(count - 1, 1))))
    return df.withColumns({size: n, place: k.cast("double")}).where(F.array_contains(at, F.col(place))).drop(size, place)


def zscores(df: DataFrame, keys: list[str], columns: list[str], kind: str = "sample") -> DataFrame:
    """z_<column> within each key. sample: over the sample deviation + 1e-9, null in a group of one; population: over the deviation
    without a guard; centred: only the difference where the population deviation is at most 1e-8."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in columns:
        off = F.col(c) - F.avg(c).over(w)
        if kind == "sample":
            out[f"z_{c}"] = off / (F.stddev_samp(c).over(w) + 1e-9)
        elif kind == "population":
            out[f"z_{c}"] = F.try_divide(off, F.stddev_pop(c).over(w))
        else:
            spread = F.stddev_pop(c).over(w)
            out[f"z_{c}"] = F.when(spread > 1e-8, F.try_divide(off, spread)).otherwise(off)
    return df.withColumns(out)


def group_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rank_<column> within each key, ties sharing the mean."""
    return df.withColumns({f"rank_{c}": F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2 for c in columns})


def global_ranks(df: DataFrame, column: str) -> DataFrame:
    """rank_<column> over the whole table, ties sharing the mean. Values are counted, dealt by range and summed a part at a time, so
    that no task has to sort them all; the parts' totals alone meet, one row a part."""
    n, part, total, before, up_to = (free(c, df) for c in ("_n", "_part", "_total", "_before", "_up_to"))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n))
    parts = storage.cut(counts.repartitionByRange(column).withColumn(part, F.spark_partition_id()), "ranks")
    sums = parts.groupBy(part).agg(F.sum(n).alias(total))
    start = sums.select(part, F.coalesce(F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = F.sum(n).over(Window.partitionBy(part).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn(up_to, inside).join(F.broadcast(start), part).select(column, (F.col(before) + F.col(up_to) - (F.col(n) - 1) / 2).alias(f"rank_{column}"))
    return df.join(ranks, column, "left")


def correlation(x: str | Column, y: str | Column, floor: int = 2) -> Column:
    """Pearson aggregate; null under floor pairs or for a constant side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when(F.count(a) >= floor, F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))))


def holm(df: DataFrame, p: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """<p>_holm: step-down adjusted within keys; nulls stay and don't count."""
    keys = keys or []
    w = Window.partitionBy(*keys, F.col(p).isNull()).orderBy(p, *order)
    m = F.count(p).over(Window.partitionBy(*keys))
    own = (m - F.row_number().over(w) + 1) * F.col(p)
    name = free("_own", df)
    top = F.max(name).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, own).withColumn(f"{p}_holm", F.when(F.col(p).isNotNull(), F.least(top, F.lit(1.0)))).drop(name)


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Leak exclusion: rows whose key is excluded go; rows without a key stay."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def group_split(df: DataFrame, group: str, val: float, test: float = 0.0, seed: int = 0) -> DataFrame:
    """split by the group's hash: a group is never on two sides, and keeps its side when others come."""
    return df.withColumn("split", scalars.hash_split(seed, F.col(group), test, val))


def counted_split(df: DataFrame, group: str, val: float, seed: int = 0) -> DataFrame:
    """split with int(groups * val) groups in val, in the order of their hashes. Only group names are ordered."""
    u = free("_u", df)
    names = df.select(group).distinct().withColumn(u, scalars.named_seed(seed, F.col(group).cast("string")))
    place = free("_place", names)
    ranked = global_position(names, [u, group], place)
    total = names.count()
    side = ranked.select(group, F.when(F.col(place) < int(total * val), "val").otherwise("train").alias("split"))
    return df.join(side, group)


def sized_split(df: DataFrame, group: str, val: float, seed: int = 0) -> DataFrame:
    """split with whole groups in val, in the order of their hashes, until val of all rows are in it. A null group is its own."""
    key = F.coalesce(F.col(group).cast("string"), F.lit("\0none"))
    own, n, u = (free(c, df) for c in ("_g", "_n", "_u"))
    sizes = df.groupBy(key.alias(own)).agg(F.count("*").alias(n)).withColumn(u, scalars.named_seed(seed, F.col(own)))
    total = df.count()
    ranked = global_prefix(sizes, [u, own], n)
    side = ranked.select(own, F.when(F.col("before") < F.lit(total * val), "val").otherwise("train").alias("split"))
    return df.withColumn(own, key).join(side, own).drop(own)


def global_prefix(df: DataFrame, order: list[str], amount: str, name: str = "before") -> DataFrame:
    """df with the column name: sum of amount over all rows that come earlier. Dealt by range and summed a part at a time. A column of that
    name that is there already is an error."""
    absent(df, name)
    part, start, here = (free(c, df) for c in ("_part", "_before", "_inside"))
    parts = storage.cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "prefix")
    total = parts.groupBy(part).agg(F.sum(amount).alias(start))
    before = total.withColumn(start, F.coalesce(F.sum(start).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn(here, inside).join(F.broadcast(before), part).withColumn(name, F.col(start) + F.col(here)).drop(part, start, here)


def absent(df: DataFrame, *names: str) -> None:
    """ValueError if df has one of the columns that an operator is about to add."""
    there = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if there:
        raise ValueError(f"columns are there already: {', '.join(there)}")


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with the column name: from 0 in that order, over the whole table."""
    one = free("_one", df)
    return global_prefix(df.withColumn(one, F.lit(1).cast("long")), order, one, name).drop(one)


def capped(df: DataFrame, keys: list[str], order: list[str | Column], most: int, always: Column | None = None) -> DataFrame:
    """most rows of each key at most; rows where always holds stay beyond it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = F.row_number().over(w) <= most
    name = free("_kept", df)
    return df.withColumn(name, kept | F.coalesce(always, F.lit(False)) if always is not None else kept).where(F.col(name)).drop(name)


def first_reason(df: DataFrame, rules: list[tuple[str, Column]], accepted: str = "accepted") -> DataFrame:
    """reason: of the first rule that holds. Nulls hold nothing."""
    out = F.lit(accepted)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return df.withColumn("reason", out)


def union_with_offsets(parts: list[DataFrame], key: str, singles: bool = True) -> DataFrame:
    """The union with each part's key moved past the greatest of those before. A part without the column gets a key for each row
    (singles) or fails. Of each part one number reaches the driver."""
    out, shift = None, 0
    for k, part in enumerate(parts):
        if key not in part.columns:
            if not singles:
                raise ValueError(f"part {k} has no {key}")
            part = global_position(part, part.columns[:1], key)
        part = part.withColumn(key, (F.col(key) + shift).cast("long"))
        top = part.agg(F.max(key)).first()[0]
        shift = shift if top is None else top + 1
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def as_of(df: DataFrame, order: str, starts: Column, keys: list[str] | None = None) -> DataFrame:
    """start: the last order value at or before a row's where starts holds; the first row's where none does yet."""
    if not keys:
        return _as_of_all(df, order, starts)
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.last(F.when(starts, F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start", F.coalesce(last, F.min(order).over(Window.partitionBy(*keys))))


def _as_of_all(df: DataFrame, order: str, starts: Column) -> DataFrame:
    """The same over the whole table: dealt by range, with the last start of the ranges before carried on, one number a range."""
    part, own, before = (free(c, df) for c in ("_part", "_own", "_before"))
    parts = storage.cut(df.repartitionByRange(order).withColumns({part: F.spark_partition_id(), own: F.when(starts, F.col(order))}), "as-of")
    last, least = (free(c, df) for c in ("_last", "_least"))
    ends = parts.groupBy(part).agg(F.max(own).alias(last), F.min(order).alias(least))
    carried = F.coalesce(F.max(last).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.min(least).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.last(own, ignorenulls=True).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = parts.withColumn("start", inside).join(F.broadcast(ends.select(part, carried.alias(before))), part)
    return met.withColumn("start", F.coalesce("start", before)).drop(part, own, before)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def pack_blocks(df: DataFrame, shelf: str, order: list[str], size: str, block: int) -> DataFrame:
    """block_id within each shelf: consecutive rows share a block while their sizes fit; a larger row stands alone. The fold needs a
    shelf's rows in order, so shelves, not the table, are what a task holds, a batch at a time."""

    def fold(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, at = None, 0, -1
        for part in pdf:
            ids = []
            for s, n in zip(part[shelf], part[size], strict=True):
                if s != now or used + min(n, block) > block:
                    at = 0 if s != now else at + 1
                    now, used = s, 0
                used += min(n, block)
                ids.append(at)
            yield part.assign(block_id=ids)

    dealt = df.repartition(shelf).sortWithinPartitions(shelf, *order)
    return dealt.mapInPandas(fold, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", block_id long")


def constrained_fill(df: DataFrame, keys: list[str], order: list[str | Column], ok: Column, keep: int) -> DataFrame:
    """Of each key the first keep rows that are ok, and where there are fewer, the first of the others after them."""
    w = Window.partitionBy(*keys).orderBy((~F.coalesce(ok, F.lit(False))).cast("int"), *order)
    n = free("_n", df)
    return df.withColumns({"filled": ~F.coalesce(ok, F.lit(False)), n: F.row_number().over(w)}).where(F.col(n) <= keep).drop(n)


def pareto(df: DataFrame, low: list[str]) -> DataFrame:
    """Rows that no other is at least as good as in all, and better in one, of two columns that are to be small. A staircase: rows of
    one first value compete, then the running least of the second decides, which takes an order and no pairs."""
    x, y = low
    own, part, low_y, before, inside = (free(c, df) for c in ("_y", "_part", "_least", "_before", "_inside"))
    best = df.groupBy(x).agg(F.min(y).alias(own))
    parts = storage.cut(best.repartitionByRange(x).withColumn(part, F.spark_partition_id()), "front")
    least = parts.groupBy(part).agg(F.min(own).alias(low_y))
    start = least.select(part, F.min(low_y).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    running = F.min(own).over(Window.partitionBy(part).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    front = parts.withColumn(inside, running).join(F.broadcast(start), part).where(F.coalesce(F.col(own) < F.least(before, inside), F.lit(True))).select(x, own)
    return df.join(front, x).where(F.col(y) == F.col(own)).drop(own)


#: Of a key's places in quantiles(): so many stretches at most are met by equality.
STRETCHES = 1024


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], prob: str = "prob", q: str = "q") -> DataFrame:
    """Of each key and prob (its place in probs, from 0) the quantile q of value, linear between neighbours; nulls don't count. Values
    are counted and their places found by range, so that no task holds a key's values; a value meets only the places that are asked for in
    its own stretch of the key's, by an equi join. A key that is called as one of the new columns is an error."""
    absent(df.select(*keys), prob, q)
    v, c, before, first, n, at, side, place, wide, on = (free(x, df) for x in ("_v", "_c", "_sum", "_first", "_n", "_at", "_side", "_place", "_wide", "_on"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(v)).agg(F.count("*").alias(c))
    placed = storage.cut(global_prefix(counts, [*keys, v], c, before), "places")
    groups = placed.groupBy(*keys).agg(F.min(before).alias(first), F.sum(c).alias(n)).withColumn(wide, F.greatest(F.floor(F.col(n) / STRETCHES), F.lit(1).cast("long")))
    stretch = lambda x: F.floor(x / F.col(wide))
    values = placed.join(groups.select(*keys, first, wide), keys).withColumn(place, F.col(before) - F.col(first))
    values = values.select(*keys, v, c, place, F.explode(F.sequence(stretch(F.col(place)), stretch(F.col(place) + F.col(c) - 1))).alias(on))
    asked = groups.select(*keys, n, wide, F.posexplode(F.array(*(F.lit(float(p)) for p in probs))).alias(prob, at)).withColumn(at, (F.col(n) - 1) * F.col(at))
    ends = asked.select(*keys, wide, prob, at, F.posexplode(F.array(F.floor(at), F.ceil(at))).alias(side, n)).withColumn(on, stretch(F.col(n))).drop(wide)
    met = values.join(ends, [*keys, on]).where((F.col(place) <= F.col(n)) & (F.col(n) < F.col(place) + F.col(c)))
    low, high = (F.max(F.when(F.col(side) == k, F.col(v))).cast("double") for k in (0, 1))
    found = met.groupBy(*keys, prob, at).agg(low.alias(place), high.alias(v))
    return found.select(*keys, prob, (F.col(place) + (F.col(v) - F.col(place)) * (F.col(at) - F.floor(at))).alias(q))


def classes_balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """weight: inverse of the key's size, one on average over rows."""
    n = free("_n", df)
    sizes = df.groupBy(*keys).agg(F.count("*").alias(n))
    total = sizes.agg(F.sum(n).alias("rows"), F.count("*").alias("groups")).first()
    return df.join(sizes, keys).withColumn("weight", F.lit(float(total.rows or 0) / max(total.groups, 1)) / F.greatest(n, F.lit(1))).drop(n)


def vocabulary(tokens: DataFrame, token: str = "token", extra: DataFrame | None = None) -> DataFrame:
    """token, n, id: ids by falling count, then token; extra: tokens that belong to it unseen."""
    n = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n"))
    if extra is not None:
        n = n.unionByName(extra.select(F.col(token).alias("token"), F.lit(0).cast("long").alias("n"))).groupBy("token").agg(F.max("n").alias("n"))
    return global_position(n.withColumn("_fall", -F.col("n")), ["_fall", "token"]).withColumnRenamed("position", "id").drop("_fall")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df by keys in a number of tasks that doesn't follow from its bytes: for kernels whose work is large for them."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism * 4, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)
