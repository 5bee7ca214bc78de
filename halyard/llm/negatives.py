"""Hard-negative mining by vantage-point trees. Vectors get one more component that fills them up to the largest norm, so that a larger
inner product is a shorter distance: d^2 = |q|^2 + most - 2 score, most the largest squared norm. A window of scores is then an
annulus around the anchor, and its best rows are those nearest to the inner edge. Every inner node of a tree has a vantage point, halves
its rows by their distance from it and knows the nearest and the farthest of each half; the triangle inequality turns an anchor's
distances from the vantage points into bounds of its distance from every leaf. Leaves are met nearest first within the annulus, until
the next one is farther than the k-th row found.

Rows are dealt by id into blocks of about block_rows, each a tree of its own, and anchors into blocks of about anchor_rows; a task meets
one pair of blocks, and the best of the blocks are merged. So no task grows with the table, while the work as a whole grows with anchors
times blocks: bounds of a distance prune clustered vectors well and vectors that point anywhere hardly.

Vectors hold integers; scores are exact: in doubles as long as 2^53 holds them, else in longs.

Defined cases: rows null in id, label or vector, with a null component or an empty vector, or whose squared norm reaches 2^62 (their
scores may be no longs), take no part; vectors are compared with those of their length only; of the rows of one id and length the one of
the smallest label, then the smallest vector, counts; nothing is a partner of its own id; ties go to the smaller id; an anchor with
fewer positives or negatives gives fewer rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm import common

#: Rows of a leaf at most.
LEAF_ROWS = 256
#: Of the sum of two squared norms: what rounding may do to a squared distance.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Rule:
    """positives: of each anchor; negatives: of each positive; those with low % to high % of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


class VantageTree:
    """A balanced tree over integer vectors. order: rows by leaf; starts: of the leaves in it. Inner nodes of a level follow each other,
    those of the next level after them."""

    def __init__(self, vectors: np.ndarray, most: float, leaf_rows: int = LEAF_ROWS):
        self.vectors, self.most = vectors.astype(float), float(most)
        self.exact = vectors if most >= 2**52 else self.vectors
        sq = np.einsum("ij,ij->i", self.vectors, self.vectors)
        rest = np.sqrt(np.maximum(0, self.most - sq))

        def far(rows: np.ndarray, v: int) -> np.ndarray:
            """Distances of rows from row v, all filled up."""
            return np.sqrt(np.maximum(0, 2 * self.most - 2 * (self.vectors[rows] @ self.vectors[v] + rest[rows] * rest[v])))

        parts, levels = [np.arange(len(vectors))], []
        while max(map(len, parts)) > leaf_rows:
            nodes, halves, ranges = [], [], []
            for rows in parts:
                v = rows[far(rows, rows[0]).argmax()]
                d = far(rows, v)
                by = np.argsort(d, kind="stable")
                nodes.append(v)
                for half in (by[: len(by) // 2], by[len(by) // 2 :]):
                    halves.append(rows[half])
                    ranges.append((d[half].min(), d[half].max()) if len(half) else (np.inf, -np.inf))
            levels.append((np.array(nodes), np.array(ranges)))
            parts = halves
        self.levels = levels
        self.order = np.concatenate(parts)
        self.starts = np.append(0, np.cumsum([len(p) for p in parts]))
        self.by_leaf = self.exact[self.order]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query's distance from the rows of each leaf."""
        sq = np.einsum("ij,ij->i", queries, queries)
        low, high = np.zeros((len(queries), 1)), np.full((len(queries), 1), np.inf)
        for nodes, ranges in self.levels:
            d2 = sq[:, None] + self.most - 2 * queries @ self.vectors[nodes].T
            slack = np.sqrt(ROUNDING * (sq + self.most))[:, None]
            d = np.repeat(np.sqrt(np.maximum(0, d2)), 2, axis=1)
            low = np.maximum(np.repeat(low, 2, axis=1), np.maximum(d - ranges[:, 1], ranges[:, 0] - d) - 2 * slack)
            high = np.minimum(np.repeat(high, 2, axis=1), d + ranges[:, 1] + 2 * slack)
        return low, high

    def nearest(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, windows: np.ndarray, k: int, ids: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query and window (least and largest score; queries x windows x 2) the best k of the rows that fit: rows (-1 where there
        are fewer) and scores, best first and ties by id; and how many scores were computed. low, high: the queries' bounds; fits: of
        queries and rows, a matrix. Each query takes its leaves nearest first; in a round those that are at one leaf share a product."""
        sq = np.einsum("ij,ij->i", queries.astype(float), queries.astype(float))[:, None]
        reach = lambda q, s: np.sqrt(np.maximum(0, q + self.most - 2 * s.astype(float)))
        slack = np.sqrt(ROUNDING * (sq + self.most))
        inner, outer = reach(sq, windows[:, :, 1]) - slack, np.where(windows[:, :, 0] <= windows[:, :, 1], reach(sq, windows[:, :, 0]) + slack, -1)
        rows, scores, least = np.full((*windows.shape[:2], k), -1), np.zeros((*windows.shape[:2], k), np.int64), windows[:, :, 0].copy()
        leaves = np.argsort(np.maximum(low, inner.min(1)[:, None]), axis=1, kind="stable")
        live, met = np.arange(len(queries)), 0
        for turn in range(leaves.shape[1]):
            leaf = leaves[live, turn]
            near = low[live, leaf] <= outer[live].max(1)
            live, leaf = live[near], leaf[near]
            open_ = (low[live, leaf][:, None] <= outer[live]) & (high[live, leaf][:, None] >= inner[live])
            for one in np.unique(leaf[open_.any(1)]):
                here = (leaf == one) & open_.any(1)
                q, own = live[here], self.order[self.starts[one] : self.starts[one + 1]]
                s = (queries[q] @ self.by_leaf[self.starts[one] : self.starts[one + 1]].T).astype(np.int64)
                met += s.size
                good = open_[here][:, :, None] & fits(q, own)[:, None, :] & (s[:, None, :] >= least[q][:, :, None]) & (s[:, None, :] <= windows[q, :, 1][:, :, None])
                at, w, c = np.nonzero(good)
                if not len(at):
                    continue
                at_q, n_w = q[at], windows.shape[1]
                slots = np.unique(at_q * n_w + w)
                old = rows[slots // n_w, slots % n_w]
                slot = np.concatenate((np.repeat(slots, k)[old.ravel() >= 0], at_q * n_w + w))
                row = np.concatenate((old[old >= 0], own[c]))
                score = np.concatenate((scores[slots // n_w, slots % n_w][old >= 0], s[at, c]))
                order = np.lexsort((ids[row], -score, slot))
                slot, row, score = slot[order], row[order], score[order]
                place = np.arange(len(slot)) - np.searchsorted(slot, slot)
                slot, row, score, place = (x[place < k] for x in (slot, row, score, place))
                rows[slot // n_w, slot % n_w, place], scores[slot // n_w, slot % n_w, place] = row, score
                full = place == k - 1
                full_q, full_w = slot[full] // n_w, slot[full] % n_w
                least[full_q, full_w] = score[full]
                outer[full_q, full_w] = np.minimum(outer[full_q, full_w], reach(sq[full_q, 0], score[full]) + slack[full_q, 0])
        return rows, scores, met


def _one_each(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Places of the rows that count, by id."""
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (ids[order][1:] == ids[order][:-1]).any():
        order = np.array(sorted(order.tolist(), key=lambda k: (ids[k], labels[k], vectors[k].tolist())))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    return order


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    return t.column("id").to_numpy(), t.column("label").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


_POSITIVE = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")])
_NEGATIVE = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])
#: Anchors that search together.
TOGETHER = 1024


def _positives(data: pa.Table, anchors: pa.Table, rule: Rule) -> pa.Table:
    every = np.array([[-(2**62), 2**62]])
    return _met(data, anchors, rule.positives, lambda part: np.broadcast_to(every, (len(part), 1, 2)), True, lambda part, at, w: (part.column("id").to_numpy()[at],), _POSITIVE)


def _negatives(data: pa.Table, anchors: pa.Table, rule: Rule) -> pa.Table:
    def windows(part: pa.Table) -> np.ndarray:
        """Of each positive of each anchor; one that holds no score where there is no positive or its score is below 0."""
        out = np.full((len(part), rule.positives, 2), (1, 0))
        for j, positives in enumerate(part.column("positives").to_pylist()):
            for w, p in enumerate(positives):
                if p["positive_score"] >= 0:
                    out[j, w] = -(-rule.low * p["positive_score"] // 100), rule.high * p["positive_score"] // 100
        return out

    def keys(part: pa.Table, at: np.ndarray, w: np.ndarray) -> tuple:
        positives = part.column("positives").to_pylist()
        named = [positives[j][x] for j, x in zip(at, w, strict=True)]
        return part.column("id").to_numpy()[at], np.array([p["positive_id"] for p in named], np.int64), np.array([p["positive_score"] for p in named], np.int64)

    return _met(data, anchors, rule.negatives, windows, False, keys, _NEGATIVE)


def _met(data: pa.Table, anchors: pa.Table, k: int, windows_of: Callable, same: bool, keys_of: Callable, schema: pa.Schema) -> pa.Table:
    """What the anchors of a pair of blocks find among rows of their label (same) or of others: keys_of(anchors, their places, windows), id
    and score of each find."""
    if not data.num_rows or not anchors.num_rows:
        return schema.empty_table()
    ids, labels, vectors = _matrix(data)
    keep = _one_each(ids, labels, vectors)
    ids, labels = ids[keep], labels[keep]
    tree = VantageTree(vectors[keep], data.column("most")[0].as_py())
    out = []
    for start in range(0, anchors.num_rows, TOGETHER):
        part = anchors.slice(start, TOGETHER)
        own_ids, own_labels, queries = _matrix(part)
        fits = lambda q, rows, i=own_ids, b=own_labels: ((b[q][:, None] == labels[rows]) == same) & (i[q][:, None] != ids[rows])
        low, high = tree.bounds(queries.astype(float))
        rows, scores, _ = tree.nearest(queries.astype(tree.exact.dtype), low, high, windows_of(part), k, ids, fits)
        at, w, place = np.nonzero(rows >= 0)
        out.append((*keys_of(part, at, w), ids[rows[at, w, place]], scores[at, w, place]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], schema=schema)


def mine(df: DataFrame, is_anchor: Column, rule: Rule | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", block_rows: int = 8192, anchor_rows: int = 32768) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that is_anchor tells, over vectors of
    integers (array of longs)."""
    rule = rule or Rule()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where("id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null)").withColumn("sq", norm).where(F.col("sq") < 2.0**62)
    rows = rows.withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a"), F.max("sq").alias("most")).collect()  # a row for each vector length
    shape = df.sparkSession.createDataFrame([(r.dim, -(-r.n // block_rows), max(1, -(-r.a // anchor_rows)), r.most) for r in sizes if r.a], "dim int, blocks long, anchor_blocks long, most double")
    rows = rows.join(F.broadcast(shape), "dim")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = rows.select("dim", own("blocks").alias("block"), every("anchor_blocks").alias("anchor_block"), "id", "label", "v", "most")
    anchors = rows.where("is_anchor").groupBy("dim", "blocks", "anchor_blocks", "id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = common.cut(anchors.select("dim", "blocks", "anchor_blocks", "id", "x.label", "x.v"), "anchors")

    def meet(to: DataFrame, f: Callable, schema: str) -> DataFrame:
        dealt = to.withColumn("anchor_block", own("anchor_blocks")).withColumn("block", every("blocks"))
        return data.groupBy("dim", "block", "anchor_block").cogroup(dealt.groupBy("dim", "block", "anchor_block")).applyInArrow(lambda a, b: f(a, b, rule), schema)

    def first(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    positives = first(meet(anchors, _positives, "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], "positive_score", "positive_id", rule.positives)
    positives = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = meet(anchors.join(positives, "id"), _negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", rule.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_vantage_point_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one of ten; components become floor(256 x)."""
    rows = common.table(spark, sf_dir, "embeddings")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10).cast("long"))).otherwise(F.col("label").cast("long"))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return mine(rows.where(sound).select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 50 == 0)


SQL = """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from sound a join sound b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
