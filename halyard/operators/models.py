"""What stands around models: codebook updates, pooled readouts, masks, schedules, losses, adapters, sweeps and budgets. A model itself
is a function of arrays that the caller gives."""

from __future__ import annotations

import itertools
import math
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.names import free


def codebook_step(vectors: DataFrame, vector: str, code: str, old: DataFrame, decay: float = 0.99, restart: float = 0.1, smooth: float = 1e-5) -> DataFrame:
    """code, size, centre, restarted after one averaged update of old (code, size, sums: array). A code whose size falls under restart
    starts again at the vector with the smallest hash. Sums are folded by partial aggregation; a row for each code comes back."""
    dims = vectors.select(code, F.posexplode(vector).alias("dim", "v"))
    fresh = dims.groupBy(code, "dim").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    fresh = fresh.groupBy(code).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"))
    both = old.join(fresh, code, "left")
    size = F.col("size") * decay + F.coalesce("n", F.lit(0)) * (1 - decay)
    sums = F.when(F.col("s").isNull(), F.transform("sums", lambda x: x * decay)).otherwise(F.zip_with("sums", "s", lambda a, b: a * decay + b * (1 - decay)))
    new = both.select(code, size.alias("size"), sums.alias("sums"))
    total = F.sum("size").over(Window.partitionBy())
    codes = F.count("*").over(Window.partitionBy())
    new = new.withColumn("even", (F.col("size") + smooth) / (total + codes * smooth) * total)
    first = vectors.agg(F.min_by(vector, F.xxhash64(vector)).alias("v")).first().v
    start = F.array(*(F.lit(float(x)) for x in first or []))
    dead = F.col("size") < restart
    return new.select(code, "size", F.when(dead, start).otherwise(F.transform("sums", lambda x: x / F.col("even"))).alias("centre"), dead.alias("restarted"))


def pooled(df: DataFrame, keys: list[str], states: str, mask: str) -> DataFrame:
    """mean: of the token states (array of arrays) where mask (array of booleans) holds; null where it never does."""
    each = df.select(*keys, F.explode(F.arrays_zip(F.col(states).alias("state"), F.col(mask).alias("on"))).alias("t")).select(*keys, "t.on", F.posexplode("t.state").alias("dim", "v"))
    mean = each.groupBy(*keys, "dim").agg(F.avg(F.when(F.col("on"), F.col("v"))).alias("m"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("mean"))


def attention_pairs(tokens: DataFrame, block: str, position: str, segment: str) -> DataFrame:
    """Pairs of a block-diagonal causal mask: block, i, j with j <= i in one segment. Blocks have a fixed size; padding has none."""
    a = tokens.where(F.col(segment) >= 0)
    b = a.select(block, segment, F.col(position).alias("j"))
    return a.select(block, segment, F.col(position).alias("i")).join(b, [block, segment]).where("j <= i").select(block, "i", "j")


def masked_score(df: DataFrame, keys: list[str], log_p: str, mask: Column, normalise: bool = True) -> DataFrame:
    """score: mean or sum of log probabilities where mask holds."""
    return df.where(mask).groupBy(*keys).agg((F.avg if normalise else F.sum)(log_p).alias("score"), F.count("*").alias("n"))


def remaining(round_: int, rounds: int, n: int) -> int:
    """Masked positions left after a round of a cosine schedule; none after the last."""
    return int(math.floor(n * math.cos(math.pi / 2 * (round_ + 1) / rounds))) if round_ + 1 < rounds else 0


def refine_order(confidence: np.ndarray, positions: np.ndarray, frac: float, order: str = "confidence", clash: np.ndarray | None = None) -> np.ndarray:
    """Positions to resample in one round: the least confident, the latest first, or the clashing ones first."""
    k = max(1, round(frac * len(positions))) if len(positions) else 0
    keys = {"confidence": (positions, confidence), "late_first": (-positions,), "clash": (positions, confidence, -(clash if clash is not None else np.zeros(len(positions))))}
    if order not in keys:
        raise ValueError(f"no order {order}")
    return positions[np.lexsort(keys[order])[:k]]


def group_losses(df: DataFrame, keys: list[str], pred: str, target: str) -> DataFrame:
    """Mean smooth-L1 and listwise cross-entropy of each group (rows are better the lower they are); groups of one have no listwise loss.
    Shares are kept as logarithms, so that no spread of values overflows or vanishes."""
    w = Window.partitionBy(*keys)
    d = F.abs(F.col(pred) - F.col(target))
    l1, top, most = (free(c, df) for c in ("_l1", "_top", "_most"))
    rows = df.withColumns({l1: F.when(d < 1, d * d / 2).otherwise(d - 0.5), top: F.max(-F.col(pred)).over(w), most: F.max(-F.col(target)).over(w)})
    of_pred, of_target = -F.col(pred) - F.col(top), -F.col(target) - F.col(most)
    # with p = e / sum(e) and q likewise: -sum(q ln p) = ln(sum e) - sum(e' x) / sum(e')
    weight = F.exp(of_target)
    listwise = F.ln(F.sum(F.exp(of_pred))) - F.sum(weight * of_pred) / F.sum(weight)
    return rows.groupBy(*keys).agg(F.avg(l1).alias("smooth_l1"), F.when(F.count("*") > 1, listwise).alias("listwise"))


def check_coverage(scores: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """scores, if every wanted key is in them; else ValueError with the first of the missing ones."""
    missing = [r[0] for r in wanted.select(key).join(scores.select(key), key, "left_anti").orderBy(key).limit(10).collect()]
    if missing:
        raise ValueError(f"no score for {missing}")
    return scores


def run_models(samples: DataFrame, models: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], schema: str, key: str) -> DataFrame:
    """model, the schema's columns and error of every model on every sample; a batch that fails gives a row with its error for each
    sample."""
    names = [f.split()[0] for f in schema.split(", ")]
    out = None
    for name, score in models.items():

        def run(batches: Iterator[pd.DataFrame], name: str = name, score: Callable = score) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                try:
                    got = score(pdf).assign(model=name, error=None)
                except Exception as e:  # the row says what failed
                    got = pd.DataFrame({key: pdf[key], "model": name, "error": f"{type(e).__name__}: {e}"})
                yield got.reindex(columns=["model", *names, "error"])

        part = samples.mapInPandas(run, f"model string, {schema}, error string")
        out = part if out is None else out.unionByName(part)
    return out


class WorkBudget:
    """Seconds for one unit of work; spent() tells a loop to stop and say so."""

    def __init__(self, seconds: float):
        self.until = time.monotonic() + seconds

    def spent(self) -> bool:
        return time.monotonic() > self.until


def sweep(specs: list[str], template: str, most: int = 64) -> list[str]:
    """Commands of a template with {key} places over the product of key=v1,v2 axes. ValueError for an axis that is given twice, has a
    value twice or isn't used, a place without an axis, and for more commands than most."""
    axes: dict[str, list[str]] = {}
    for s in specs:
        key, _, values = s.partition("=")
        own = values.split(",")
        if not key or not values or key in axes or len(set(own)) < len(own):
            raise ValueError(f"bad axis {s}")
        axes[key] = own
    places = set(re.findall(r"\{(\w+)\}", template))
    if places != set(axes):
        raise ValueError(f"places and axes differ in {sorted(places ^ set(axes))}")
    every = list(itertools.product(*axes.values()))
    if len(every) > most:
        raise ValueError(f"{len(every)} commands; {most} are allowed")
    return [template.format(**dict(zip(axes, values, strict=True))) for values in every]
