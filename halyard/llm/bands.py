"""Numeric band join: each query's points within a band around its centre, nearest first, without listing the pairs. Points are
cut by value into shards; a shard is a segment tree over its distinct values, whose nodes hold sums and, from either end, the first points
diversified by item. A centre's band is two intervals, below and above it; each is a walk over canonical nodes from the centre outwards.

A list is diversified when, whatever item is left out, it still has the first k points of the others: at most k points of each
item, in order, and the first 2 k of those. Lists of two sets make the list of both, so tasks shrink what they read before anything
is shuffled, and a value that a third of all points has costs each task one list. Sums over a band hold the query's own item; its part
is taken off again from running sums over the values of that item. Queries of one centre share one answer.

A shard is as wide as a 64th of its values' power of two, 256 to 16384 apart, so a band of some thousandths touches two or
three; a band beyond 2^21 asks more of them, one row a shard.

Defined cases: lines null in sale_id, item_id, quantity or amount, those of quantity 0 and those whose amount isn't finite or beyond
LARGEST never pair, nor do items null in item_id or price or with such a price; a null line_no comes first among its sale's and is
the empty text in the checksum; repeated lines each count, repeated items each have their rows; empty tables give no row, or a row of
rank 0 an item; of other columns nothing is read, whatever they are called. Sums that don't fit a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm import common

#: Of amounts and prices: their cents, doubled, still fit a long.
LARGEST = 1e16
#: Rows that a task gathers before it shrinks them.
GATHER = 1 << 18
#: Binary digits of the narrowest and the widest shard, and by how many a shard is narrower than its values' power of two.
NARROW, WIDE, FINER = 8, 14, 6
#: Stands for a null line_no.
NO_LINE = -(2**63)


@dataclass(frozen=True)
class Band:
    """A centre reaches least, or so many thousandths of itself if that is more; k points are told."""

    least: int = 10
    per_mille: int = 2
    k: int = 5

    def reach(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, p * self.per_mille // 1000)

    def reach_of(self, p: str) -> Column:
        return F.greatest(F.lit(self.least), F.floor(F.col(p) * self.per_mille / F.lit(1000).cast("decimal(4,0)"))).cast("long")


def cents(x: str) -> Column:
    """floor(100 x + 0.5) as a long; null if x isn't finite or is beyond LARGEST."""
    x = F.col(x).cast("double")
    return F.when(F.abs(x) <= LARGEST, F.floor(F.lit(100.0) * x + F.lit(0.5)))


def points_of(lines: DataFrame) -> DataFrame:
    """u, item_id, sale_id, line_no, crc of the lines that can pair."""
    rows = lines.select(*(F.col(c).cast("long").alias(c) for c in ("sale_id", "line_no", "item_id", "quantity")), cents("amount").alias("a"))
    rows = rows.where("sale_id is not null and item_id is not null and quantity <> 0 and a is not null")
    rows = rows.select("*", F.expr("sign(quantity) * (2 * a + quantity)").cast("long").alias("top"), F.abs(F.col("quantity") * 2).alias("under"))
    said = F.concat_ws(",", "sale_id", F.coalesce(F.col("line_no").cast("string"), F.lit("")), "item_id")
    return rows.select(F.expr("(top - pmod(top, under)) div under").alias("u"), "item_id", "sale_id", F.coalesce("line_no", F.lit(NO_LINE)).alias("line_no"), F.crc32(said.cast("binary")).alias("crc"))


def places_in_runs(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among those before it that agree in the keys, which are sorted."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def diversified(u: np.ndarray, item: np.ndarray, sale: np.ndarray, line: np.ndarray, k: int) -> np.ndarray:
    """Rows of each u's list, by u and then the list's order: sale, line, item."""
    order = np.lexsort((line, sale, item, u))
    order = order[places_in_runs(u[order], item[order]) < k]
    order = order[np.lexsort((item[order], line[order], sale[order], u[order]))]
    return order[places_in_runs(u[order]) < 2 * k]


POINT = ("u", "item_id", "sale_id", "line_no")
_POINTS = ", ".join(f"{c} long" for c in POINT)


def _arrays(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in batches]) for c in POINT]


def _shrunk(batches: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    columns = _arrays(batches)
    keep = diversified(*columns, k)
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=list(POINT))


def first_points(points: DataFrame, k: int) -> DataFrame:
    """u, points (its diversified list: an array of sale_id, line_no, item_id)."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GATHER:
                held = [_shrunk(held, k)]
                n = held[0].num_rows
                if n > GATHER // 2:  # many values: what comes after goes into lists of its own, and all lists meet later
                    yield held.pop()
                    n = 0
        if n:
            yield _shrunk(held, k)
        common.release()

    def lists(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, item, sale, line = _arrays([_shrunk(batches, k)])
        starts = np.flatnonzero(places_in_runs(u) == 0)
        inner = pa.StructArray.from_arrays([pa.array(x) for x in (sale, line, item)], names=["sale_id", "line_no", "item_id"])
        return pa.RecordBatch.from_arrays([pa.array(u[starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(u)), pa.int32()), inner)], names=["u", "points"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by u; those of the last u wait for more."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            u = b.column(0).to_numpy()
            cut = int(np.searchsorted(u, u[-1]))
            if cut or held and held[-1].column(0)[-1].as_py() != u[-1]:
                yield lists([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
            if sum(x.num_rows for x in held) >= GATHER:
                held = [_shrunk(held, k)]
        if held:
            yield lists(held)
        common.release()

    shrunk = common.small_batches(points).select(*POINT).mapInArrow(shrink, _POINTS)
    return shrunk.repartition("u").sortWithinPartitions("u").mapInArrow(finish, "u long, points array<struct<sale_id: long, line_no: long, item_id: long>>")


class Tree:
    """Segment tree over the distinct values of a shard. Level 0 has a node a value, each further level one for two. Per level: n,
    total (sum of u) and crc; up and down: places of the points of the node's lists from its smallest and from its largest value, -1
    beyond their ends."""

    def __init__(self, u: np.ndarray, n: np.ndarray, crc: np.ndarray, at: np.ndarray, item: np.ndarray, k: int):
        """u: sorted; at: place of the value of each point, sorted; item: of each point, in the order of its value's list."""
        self.u, self.item, self.k = u, item, k
        size = 1 << max(0, (len(u) - 1)).bit_length()
        leaf = np.full((size, 2 * k), -1)
        leaf[at, places_in_runs(at)] = np.arange(len(at))
        fill = lambda x: np.concatenate((x, np.zeros(size - len(u), np.int64)))
        self.sums, self.up, self.down = [np.stack((fill(n), fill(n * u), fill(crc)))], [leaf], [leaf]
        while len(self.up[-1]) > 1:
            s, up, down = self.sums[-1], self.up[-1], self.down[-1]
            self.sums.append(s[:, ::2] + s[:, 1::2])
            self.up.append(self.joined(up[::2], up[1::2]))
            self.down.append(self.joined(down[1::2], down[::2]))

    def joined(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Lists of rows of first followed by those of then."""
        both = np.concatenate((first, then), axis=1)
        held = both >= 0
        item = self.item[both]
        same = (item[:, :, None] == item[:, None, :]) & held[:, None, :] & np.tri(both.shape[1], k=-1, dtype=bool)
        keep = held & (same.sum(2) < self.k)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : 2 * self.k]
        return np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(both, order, 1), -1)

    def ask(self, low: np.ndarray, high: np.ndarray, upwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums (3 rows) and lists over the values from place low to before place high, nearest to that end first where the walk
        starts: at low if upwards, else at high."""
        sums, lists = np.zeros((3, len(low)), np.int64), np.full((len(low), 2 * self.k), -1)
        at, left = (low if upwards else high).copy(), high - low
        while len(open_ := np.flatnonzero(left > 0)):
            here, rest = at[open_], left[open_]
            fits = np.frexp(rest.astype(float))[1] - 1
            even = np.where(here == 0, 63, np.frexp((here & -here).astype(float))[1] - 1)
            level = np.minimum(np.minimum(fits, even), len(self.up) - 1)
            node = (here >> level) - (not upwards)
            for j in np.unique(level):
                rows, nodes = open_[level == j], node[level == j]
                sums[:, rows] += self.sums[j][:, nodes]
                short = lists[rows, -1] < 0
                lists[rows[short]] = self.joined(lists[rows[short]], (self.up if upwards else self.down)[j][nodes[short]])
            step = np.int64(1) << level
            at[open_] += step if upwards else -step
            left[open_] -= step
        return sums, lists


_ANSWER = "p long, n long, gap_sum long, crc long, points array<struct<gap: long, u: long, sale_id: long, line_no: long, item_id: long>>"
_FOUND = pa.struct([(c, pa.int64()) for c in ("gap", "u", "sale_id", "line_no", "item_id")])


def _ask_shard(leaves: pa.Table, centres: pa.Table, rule: Band) -> pa.Table:
    schema = pa.schema([*((c, pa.int64()) for c in ("p", "n", "gap_sum", "crc")), ("points", pa.list_(_FOUND))])
    if not leaves.num_rows or not centres.num_rows:
        return schema.empty_table()
    leaves = leaves.sort_by("u").combine_chunks()
    u, n, crc = (leaves.column(c).to_numpy() for c in ("u", "n", "crc"))
    lists = leaves.column("points").combine_chunks()
    sale, line, item = (lists.flatten().field(c).to_numpy() for c in ("sale_id", "line_no", "item_id"))
    at = np.repeat(np.arange(len(u)), np.diff(lists.offsets.to_numpy()))
    tree = Tree(u, n, crc, at, item, rule.k)
    p = np.sort(centres.column("p").to_numpy())
    w = rule.reach(p)
    low, mid, high = np.searchsorted(u, p - w), np.searchsorted(u, p, side="right"), np.searchsorted(u, p + w, side="right")
    below, down = tree.ask(low, mid, False)
    above, up = tree.ask(mid, high, True)
    gaps = p * below[0] - below[1] + above[1] - p * above[0]
    which, column = np.nonzero((both := np.concatenate((down, up), axis=1)) >= 0)
    point = both[which, column]
    value = u[at[point]]
    gap = np.abs(value - p[which])
    order = np.lexsort((item[point], line[point], sale[point], value, gap, which))
    which, point, value, gap = which[order], point[order], value[order], gap[order]
    inner = pa.StructArray.from_arrays([pa.array(x) for x in (gap, value, sale[point], line[point], item[point])], fields=list(_FOUND))
    found = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(p) + 1)), pa.int32()), inner)
    out = pa.Table.from_arrays([*(pa.array(x) for x in (p, below[0] + above[0], gaps, below[2] + above[2])), found], schema=schema)
    return out.filter(pa.array(below[0] + above[0] > 0))


def _digits(u: str) -> Column:
    """Binary digits of a shard at u."""
    u = F.col(u)
    most = F.length(F.bin(F.when(u < 0, F.bitwise_not(u)).otherwise(u))) - 1
    return F.least(F.greatest(most - FINER, F.lit(NARROW)), F.lit(WIDE))


def shard(u: str) -> Column:
    """The smallest value of u's shard."""
    j = _digits(u)
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(u), j), j)


def answers(points: DataFrame, by_item: DataFrame, centres: DataFrame, rule: Band) -> DataFrame:
    """p, n, gap_sum, crc, points for the distinct centres p whose band holds a point; points: enough of the nearest that
    whichever item is left out the first k of the others are among them, by gap, u, sale_id, line_no, item_id."""
    sums = by_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    leaves = first_points(points, rule.k).join(sums, "u").select(shard("u").alias("shard"), "u", "n", "crc", "points")
    asked = centres.select("p").distinct().withColumn("w", rule.reach_of("p")).select("p", (F.col("p") - F.col("w")).alias("low"), (F.col("p") + F.col("w")).alias("high"))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(_digits("low"), _digits("high")))
    asked = asked.select("p", F.explode(F.sequence(F.col("low"), F.col("high") + step - 1, step)).alias("at"), "high").select("p", F.least("at", "high").alias("at")).select("p", shard("at").alias("shard")).distinct()
    met = leaves.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(lambda a, b: _ask_shard(a, b, rule), _ANSWER)
    total = [F.sum(c).alias(c) for c in ("n", "gap_sum", "crc")]
    return met.groupBy("p").agg(*total, F.array_sort(F.flatten(F.collect_list("points"))).alias("points"))


def own_sums(by_item: DataFrame, items: DataFrame, rule: Band) -> DataFrame:
    """item_id, p, own_n, own_gap_sum, own_crc: of the points of the item itself in its band. Running sums over the item's values, which
    the ends of the band read: its values are never paired with its prices."""
    nothing = F.lit(0).cast("long")
    point = by_item.select("item_id", F.col("u").alias("at"), F.lit(-1).alias("edge"), F.lit(None).cast("long").alias("p"), "n", (F.col("n") * F.col("u")).alias("s"), "crc")
    w = rule.reach_of("p")
    ends = items.select("item_id", "p").distinct().select("item_id", "p", F.posexplode(F.array(F.col("p") - w - 1, F.col("p"), F.col("p") + w)).alias("edge", "at"))
    ends = ends.select("item_id", "at", "edge", "p", nothing.alias("n"), nothing.alias("s"), nothing.alias("crc"))
    so_far = Window.partitionBy("item_id").orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, 0)
    read = point.unionByName(ends).select("item_id", "p", "edge", *(F.sum(c).over(so_far).alias(c) for c in ("n", "s", "crc"))).where("edge >= 0")
    by = {e: {c: F.sum(F.when(F.col("edge") == e, F.col(c))) for c in ("n", "s", "crc")} for e in range(3)}
    below = {c: by[1][c] - by[0][c] for c in ("n", "s")}
    above = {c: by[2][c] - by[1][c] for c in ("n", "s")}
    gaps = F.col("p") * below["n"] - below["s"] + above["s"] - F.col("p") * above["n"]
    out = read.groupBy("item_id", "p").agg((by[2]["n"] - by[0]["n"]).alias("own_n"), gaps.alias("own_gap_sum"), (by[2]["crc"] - by[0]["crc"]).alias("own_crc"))
    return out.where("own_n > 0")


def near_prices(sale_lines: DataFrame, items: DataFrame, rule: Band | None = None) -> DataFrame:
    """Of each item the first k lines of other items whose unit price is near its own, and sums over all of them: item_id, rank, gap,
    u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc."""
    rule = rule or Band()
    points = points_of(sale_lines)
    by_item = common.cut(points.groupBy("item_id", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "by_item")
    item = items.select(F.col("item_id").cast("long").alias("item_id"), cents("price").alias("p"))
    item = item.withColumn("p", F.when(F.col("item_id").isNotNull(), F.col("p")))
    known = item.where("p is not null")
    own = own_sums(by_item, known, rule)
    told = common.cut(answers(points, by_item, known, rule), "told")  # a table, so that the join below can split a price of many items
    rows = item.join(own, ["item_id", "p"], "left").join(told, "p", "left")
    others = F.slice(F.filter("points", lambda x: x["item_id"] != F.col("item_id")), 1, rule.k)
    left = lambda c: (F.coalesce(c, F.lit(0)) - F.coalesce(f"own_{c}", F.lit(0))).alias
    rows = rows.select("item_id", left("n")("n_pairs"), left("gap_sum")("gap_sum"), left("crc")("lines_crc"), F.posexplode_outer(others).alias("place", "x"))
    line = F.nullif(F.col("x.line_no"), F.lit(NO_LINE))
    return rows.select("item_id", F.coalesce(F.col("place") + 1, F.lit(0)).alias("rank"), "x.gap", "x.u", "x.sale_id", line.alias("line_no"), F.col("x.item_id").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")


def op12_segment_tree_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prices(common.table(spark, sf_dir, "sale_lines"), common.table(spark, sf_dir, "items"))


#: The checksum is a fold over the characters, its table made from the polynomial.
SQL = """
with crc_table as (
  select list(list_reduce(list_prepend(k::bigint, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) as crc
  from range(256) r(k)),
read as (
  select sale_id, line_no, item_id, sign(quantity)::bigint * (2 * floor(100 * amount + 0.5)::bigint + quantity) as top, abs(2 * quantity::bigint) as under
  from sale_lines where sale_id is not null and item_id is not null and quantity <> 0 and abs(amount) <= 1e16),
said as (select *, sale_id || ',' || coalesce(line_no::varchar, '') || ',' || item_id as t from read),
points as (
  select sale_id, line_no, item_id, (top - ((top % under) + under) % under) // under as u,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(t, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295) as crc
  from said, crc_table),
centres as (select row_number() over () as row, item_id, case when item_id is not null and abs(price) <= 1e16 then floor(100 * price + 0.5)::bigint end as p from items),
asked as (select *, greatest(10, floor(2 * p::hugeint / 1000.0)::bigint) as w from centres),
pairs as (
  select a.row, abs(l.u - a.p) as gap, l.u, l.sale_id, l.line_no, l.item_id as line_item_id, l.crc,
    row_number() over (partition by a.row order by abs(l.u - a.p), l.u, l.sale_id, l.line_no nulls first, l.item_id) as rank
  from asked a join points l on l.u >= a.p - a.w and l.u <= a.p + a.w and l.item_id <> a.item_id),
sums as (select row, count(*) as n_pairs, sum(gap)::bigint as gap_sum, sum(crc)::bigint as lines_crc from pairs group by row)
select a.item_id, coalesce(q.rank, 0)::int as rank, q.gap, q.u, q.sale_id, q.line_no::bigint as line_no, q.line_item_id,
  coalesce(s.n_pairs, 0) as n_pairs, coalesce(s.gap_sum, 0) as gap_sum, coalesce(s.lines_crc, 0) as lines_crc
from asked a left join sums s using (row) left join pairs q on q.row = a.row and q.rank <= 5
"""
