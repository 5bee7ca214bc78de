"""Rounds over a table of code sequences: a model, given by the caller as a function of a DataFrame, is asked again and again, and between its
answers positions are masked, filled or decided anew by array functions. A round's table is written and the one before it deleted, so
neither lineage nor storage grows with the rounds; sequences that are settled leave the loop.

A model takes columns key and codes (an array, some of them the mask) and returns key, best (the code it would put at each position) and
confidence (its belief, for a masked position in best, for any other in the code that stands there).

Defined cases: a null sequence stays null, an empty one empty; of equal beliefs the smaller position comes first; keys must be unique; a
model that loses a key is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard import storage

Model = Callable[[DataFrame], DataFrame]
ORDERS = ("confidence", "late_first", "clash")


def driven(state: DataFrame, step: Callable[[int, DataFrame], DataFrame], rounds: int, settled: Column | None = None) -> DataFrame:
    """The state after so many steps, each of which gives rows with the state's columns. Rows for which settled holds after a step are kept
    aside and not stepped again; the loop ends when none is left."""
    now, done = storage.cut(state, "round"), []
    for k in range(rounds):
        new = storage.cut(step(k, now).select(*state.columns), "round")
        if settled is None:
            storage.discard(now)
            now = new
            continue
        over = F.coalesce(settled, F.lit(False))
        done.append(storage.cut(new.where(over), "settled"))
        left = storage.cut(new.where(~over), "round")
        storage.discard(now)
        storage.discard(new)
        now = left
        if not now.limit(1).count():
            break
    for part in done:
        now = now.unionByName(part)
    return now


def _asked(model: Model, rows: DataFrame, key: str) -> DataFrame:
    """rows with the model's best and confidence; a key that has codes and no answer is an error."""
    answer = model(rows.select(F.col(key).alias("key"), "codes")).select(F.col("key").alias(key), "best", "confidence")
    met = rows.join(answer, key, "left")
    lost = F.raise_error(F.lit("the model gave no answer for a sequence"))
    return met.withColumn("best", F.when(F.col("codes").isNotNull() & F.col("best").isNull(), lost.cast("array<int>")).otherwise(F.col("best")))


def first_positions(value: Column, able: Column, count: Column) -> Column:
    """Of the positions where able holds (an array of booleans) the count of smallest value (an array), as booleans for each position."""
    each = F.zip_with(value, able, lambda v, a: F.struct((~F.coalesce(a, F.lit(False))).alias("off"), v.alias("v")))
    ranked = F.array_sort(F.transform(each, lambda x, i: F.struct(x["off"].alias("off"), x["v"].alias("v"), i.alias("i"))))
    chosen = F.transform(F.filter(F.slice(ranked, 1, F.greatest(count, F.lit(0))), lambda x: ~x["off"]), lambda x: x["i"])
    return F.transform(value, lambda v, i: F.array_contains(chosen, i))


def masked_left(k: int, rounds: int, n: Column) -> Column:
    """Masked positions left of n after round k of a cosine schedule; none after the last."""
    return F.floor(n * F.cos(F.lit(1.5707963267948966 * (k + 1) / rounds))).cast("int") if k + 1 < rounds else F.lit(0)


def filled(df: DataFrame, model: Model, key: str, mask: int, rounds: int) -> DataFrame:
    """key, codes: masked positions filled over rounds of a cosine schedule, the most believed first. A sequence that is all mask is decoded
    cold, one with codes is filled around them; these stay."""
    n = F.size(F.filter("codes", lambda c: c == mask))
    state = df.select(key, "codes", n.alias("n"))

    def step(k: int, now: DataFrame) -> DataFrame:
        met = _asked(model, now, key)
        open_ = F.transform("codes", lambda c: c == mask)
        take = first_positions(F.transform("confidence", lambda c: -c), open_, n - masked_left(k, rounds, F.col("n")))
        new = F.zip_with(F.zip_with("codes", "best", lambda c, b: F.struct(c.alias("c"), b.alias("b"))), take, lambda x, t: F.when(t, x["b"]).otherwise(x["c"]))
        return met.select(key, new.alias("codes"), "n")

    return driven(state, step, rounds, settled=F.col("codes").isNull() | (n == 0)).select(key, "codes")


def refined(df: DataFrame, model: Model, key: str, mask: int, rounds: int = 8, share: float = 0.25, order: str = "confidence", clash: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key, codes: in each round share of a sequence's positions (one at least) are masked and decided anew. order: confidence (the least
    believed as they stand), late_first (blocks from the end backwards), clash (those where clash, a function of key and codes that returns
    key and clash, an array, is over 0: the worst first). Sequences that a round leaves as they were are settled, but for late_first."""
    if order not in ORDERS or (order == "clash") != (clash is not None):
        raise ValueError(f"no order {order}, or a clash function where it isn't asked or missing where it is")
    state = df.select(key, "codes")
    n = F.size("codes")
    count = F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))

    def step(k: int, now: DataFrame) -> DataFrame:
        if order == "late_first":
            here = F.transform("codes", lambda c, i: (i >= n - (k + 1) * count) & (i < n - k * count))
            marked = now.withColumn("_here", here)
        elif order == "clash":
            met = now.join(clash(now.select(F.col(key).alias("key"), "codes")).select(F.col("key").alias(key), "clash"), key, "left")
            marked = met.withColumn("_here", first_positions(F.transform("clash", lambda c: -c), F.transform("clash", lambda c: c > 0), count)).drop("clash")
        else:
            met = _asked(model, now, key)
            marked = met.withColumn("_here", first_positions(F.col("confidence"), F.transform("codes", lambda c: F.lit(True)), count)).drop("best", "confidence")
        hidden = marked.select(key, F.col("codes").alias("_was"), "_here", F.zip_with("codes", "_here", lambda c, h: F.when(h, F.lit(mask)).otherwise(c)).alias("codes"))
        met = _asked(model, hidden, key)
        new = F.zip_with(F.zip_with("codes", "best", lambda c, b: F.struct(c.alias("c"), b.alias("b"))), "_here", lambda x, h: F.when(h, x["b"]).otherwise(x["c"]))
        return met.select(key, new.alias("codes"), F.coalesce(new == F.col("_was"), F.lit(True)).alias("_same"))

    rows = state if order == "late_first" else state.withColumn("_same", F.lit(False))
    if order == "late_first":
        return driven(rows, lambda k, now: step(k, now).select(key, "codes"), rounds)
    return driven(rows, step, rounds, settled=F.col("_same")).select(key, "codes")
