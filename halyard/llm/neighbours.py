"""Approximate nearest neighbours by collision counting. Every vector is projected on PROJECTIONS random lines, each kept as a sorted
array. A query's window on each line starts around its own projection and is widened level by level (virtual rehashing: the radius
grows, the arrays stay); a vector inside enough windows has its score computed. The search ends once the k-th best score found is as
near as the radius: most vectors that near have collided often enough by then.

Largest inner product becomes nearest distance: vectors are divided by the largest norm and get one more component that fills them
up to length 1; queries are divided by their own norm.

Candidates are dealt by their ids into blocks of about block_rows and queries into blocks of about query_rows; each task searches
one pair of blocks, and the blocks' best are merged, so no task grows with the table and none has to hold it.

Defined cases: null, empty and zero vectors and those with null or non-finite components take no part, nor do rows without an id;
vectors of one length are compared with each other only; rows with the same id and vector count once, and of one query id the
smallest vector is the query; ties go to the smaller id; fewer candidates than k give them all; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm import common

PROJECTIONS, SEED, GROWTH, FIRST_RADIUS = 48, 7, 1.05, 0.1
#: Chance that a standard normal is within 1, and the collisions that a vector at the radius reaches in 6 of 7 cases (nearer ones
#: more often: measured recall of the best 20 is 0.96).
NEAR = 0.6827
COLLISIONS = int(PROJECTIONS * NEAR - 1.05 * (PROJECTIONS * NEAR * (1 - NEAR)) ** 0.5)
#: Vectors of a block whose nearest one tells where a query's windows start: at this share of its distance.
PROBES, START = 64, 0.85


def usable(v: str) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def radii() -> np.ndarray:
    out = [FIRST_RADIUS]
    while out[-1] < 2:
        out.append(out[-1] * GROWTH)
    return np.array(out)


class Block:
    """Vectors with their projections sorted on each line. most: largest norm of the table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.most = ids[order], vectors[order], most
        scaled = self.vectors / most
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
        self.lines = np.random.RandomState(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        on = (scaled @ self.lines[:-1] + rest[:, None] * self.lines[-1]).T
        self.order = np.argsort(on, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(on, self.order, 1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, place among the ids, score) of the best k or fewer of each, and how many scores were computed."""
        norms = np.sqrt((queries * queries).sum(1))
        on = (queries / norms[:, None]) @ self.lines[:-1]
        levels = radii()
        probes = self.vectors[:: max(1, len(self.vectors) // PROBES)]
        found, checked = [], 0
        for at in range(0, len(queries), 256):
            part = on[at : at + 256]
            low = np.stack([np.searchsorted(s, part[:, i, None] - levels) for i, s in enumerate(self.sorted)], 1)
            high = np.stack([np.searchsorted(s, part[:, i, None] + levels, side="right") for i, s in enumerate(self.sorted)], 1)
            close = (queries[at : at + 256] @ probes.T).max(1) / (norms[at : at + 256] * self.most)
            first = np.searchsorted(levels, START * np.sqrt(np.maximum(0, 2 - 2 * close))).clip(max=len(levels) - 1)
            for j in range(len(part)):
                q = queries[at + j]
                places, near = self.one(query_ids[at + j], q, norms[at + j], low[j], high[j], levels, first[j], k)
                checked += len(places)
                if len(places) > k:  # the products above may differ in their last bits; those that can be among the best are summed anew, all alike
                    worst = np.partition(near, len(near) - k)[len(near) - k]
                    places = places[near >= worst - 1e-9 * norms[at + j] * self.most]
                scores = (self.vectors[places] * q).sum(1)
                best = np.lexsort((places, -scores))[:k]
                found.append((np.full(len(best), at + j), places[best], scores[best]))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0), 0
        return *(np.concatenate(x) for x in zip(*found, strict=True)), checked

    def one(self, own: int, query: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray, levels: np.ndarray, first: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all vectors that collided often enough before the search ended, and their scores."""
        n = len(self.ids)
        hits = np.zeros(n, np.int64)
        open_ = self.ids != own
        places, scores = np.empty(0, np.int64), np.empty(0)
        left = right = low[:, first]
        for level in range(first, len(levels)):
            new = [self.order[i, a:b] for i, (a, b) in enumerate(zip(low[:, level], left, strict=True)) if a < b] + [self.order[i, a:b] for i, (a, b) in enumerate(zip(right, high[:, level], strict=True)) if a < b]
            left, right = low[:, level], high[:, level]
            if not new:
                continue
            hits += np.bincount(np.concatenate(new), minlength=n)
            near = np.flatnonzero(open_ & (hits >= COLLISIONS))
            if len(near):
                open_[near] = False
                places = np.concatenate((places, near))
                scores = np.concatenate((scores, self.vectors[near] @ query))
            if len(places) >= k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                if 2 - 2 * worst / (norm * self.most) <= levels[level] ** 2:
                    return places, scores
        near = np.flatnonzero(open_)
        return np.concatenate((places, near)), np.concatenate((scores, self.vectors[near] @ query))


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192, query_rows: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("id").isNotNull() & usable("v"))
    rows = rows.withColumn("dim", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max(norm).alias("most")).collect()  # a row for each vector length
    spark = df.sparkSession
    shape = spark.createDataFrame([(r.dim, -(-r.n // block_rows), max(1, -(-r.q // query_rows)), r.most) for r in sizes if r.q], "dim int, blocks long, query_blocks long, most double")
    rows = rows.join(F.broadcast(shape), "dim")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = rows.select("dim", own("blocks").alias("block"), every("query_blocks").alias("query_block"), "id", "v", "most")
    queries = rows.where("is_query").groupBy("dim", "blocks", "query_blocks", "id").agg(F.min("v").alias("v"))
    queries = queries.select(F.col("dim").alias("q_dim"), every("blocks").alias("q_block"), own("query_blocks").alias("q_query_block"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))

    def matrix(t: pa.Table, dim: int, of: str = "") -> tuple[np.ndarray, np.ndarray]:
        v = t.column(f"{of}v").combine_chunks()
        return t.column(f"{of}id").to_numpy().astype(np.int64), np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), dim)

    def meet(data: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not data.num_rows or not queries.num_rows:
            return kind.empty_table()
        dim = data.column("dim")[0].as_py()
        ids, vectors = matrix(data, dim)
        if len(np.unique(ids)) < len(ids):
            first = list({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), vectors, strict=True))}.values())
            ids, vectors = ids[first], vectors[first]
        block = Block(ids, vectors, data.column("most")[0].as_py())
        query_ids, q = matrix(queries, dim, "q_")
        which, place, score, _ = block.search(query_ids, q, k)
        return pa.Table.from_arrays([pa.array(query_ids[which]), pa.array(block.ids[place]), pa.array(score)], schema=kind)

    keys = ["dim", "block", "query_block"]
    met = data.groupBy(*keys).cogroup(queries.groupBy(*(f"q_{x}" for x in keys))).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
