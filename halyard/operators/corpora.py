"""Token corpora and their sidecars, caches, plans and index tables; selections and tallies for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions import scalars
from halyard.names import free
from halyard.operators import relational


def native_groups(df: DataFrame, order: list[str], rmsd: str) -> DataFrame:
    """df with grp for a corpus that has none: a group begins at each native row (rmsd 0); rows before the first are in group 0. Null
    rmsd is no native. The order must be total; no task sees the whole table."""
    relational.absent(df, "grp")
    native, before = free("_native", df), free("_sum", df)
    placed = relational.global_prefix(df.withColumn(native, F.coalesce(F.col(rmsd) == 0, F.lit(False)).cast("long")), order, native, before)
    return placed.withColumn("grp", F.greatest(F.col(before) + F.col(native) - 1, F.lit(0).cast("long"))).drop(before, native)


def with_sidecar(df: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """df with the sidecar's columns by key; other rows on either side are an error, as are keys that repeat in the sidecar."""
    names = [c for c in sidecar.columns if c != key]
    mark, seen = free("_mark", df, sidecar), free("_seen", df, sidecar)
    both = df.withColumn(seen, F.lit(True)).join(sidecar.withColumn(mark, F.lit(True)), key, "full")
    n = sidecar.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
    if n.n != n["keys"] or both.where(F.col(mark).isNull() | F.col(seen).isNull()).limit(1).count():
        raise ValueError(f"the sidecar's rows are not the corpus's: {', '.join(names)}")
    return both.drop(mark, seen)


def aligned(frames: list[DataFrame], key: str) -> DataFrame:
    """The frames side by side by key; a key that one of them lacks is an error, as is one that repeats."""
    out = frames[0]
    for other in frames[1:]:
        out = with_sidecar(out, other, key)
    return out


def cached_tokens(requests: DataFrame, cache: DataFrame, request: str, struct: str, residues: str) -> DataFrame:
    """request and tokens in the order of the residues (an array of keys), null when any residue is missing from the cache (struct,
    residue, token; of repeated ones the least token). A request without residues has no tokens. Columns of requests may be called
    as those of the cache."""
    wanted = requests.select(F.col(request).alias("_1"), F.col(struct).alias("_2"), F.posexplode(residues).alias("_4", "_3"))
    known = cache.groupBy(F.col(struct).alias("_2"), F.col("residue").alias("_3")).agg(F.min("token").alias("_5"))
    met = wanted.join(known, ["_2", "_3"], "left").groupBy("_1")
    found = met.agg(F.count("*").alias("_6"), F.count("_5").alias("_7"), F.collect_list(F.struct("_4", "_5")).alias("_8"))
    tokens = F.when(F.col("_6") == F.col("_7"), F.transform(F.array_sort("_8"), lambda x: x["_5"]))
    return requests.select(F.col(request).alias("_1")).join(found.select("_1", tokens.alias("_9")), "_1", "left").select(F.col("_1").alias(request), F.col("_9").alias("tokens"))


def mean_places(df: DataFrame, doc: str, code: str, xyz: list[str], least: int = 3) -> DataFrame:
    """code, n and the mean of the xyz of its places, over documents with at least that many codes."""
    n = free("_n", df)
    long = df.groupBy(doc).agg(F.count("*").alias(n)).where(F.col(n) >= least).select(doc)
    return df.join(long, doc, "left_semi").groupBy(code).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in xyz))


def top_conformers(df: DataFrame, molecule: str, weight: str, order: list[str], most: int, usable: Column) -> DataFrame:
    """Of each molecule the usable conformers of greatest weight; a missing weight counts as 0, equal ones go by order."""
    return relational.top_k(df.where(F.coalesce(usable, F.lit(False))), [molecule], [F.desc(F.coalesce(weight, F.lit(0.0))), *order], most)


def orientation_draw(df: DataFrame, complex_: str, orientation: str, count: int, epoch: int, seed: int = 0) -> DataFrame:
    """Of the count orientations of each complex (from 0) the one that its name draws in that epoch."""
    drawn = scalars.named_seed(seed, F.concat(F.col(complex_).cast("string"), F.lit(f":{epoch}"))) % count
    return df.where(F.col(orientation) == drawn)


def kept_side(tokens: Column, is_ligand: Column, side: str) -> Column:
    """The tokens of one side (ligand or pocket), or of both, by a mask of booleans as long."""
    if side not in ("ligand", "pocket", "both"):
        raise ValueError(f"unknown side {side}")
    pairs = F.zip_with(tokens, is_ligand, lambda t, m: F.struct(t.alias("t"), F.coalesce(m, F.lit(False)).alias("m")))
    keep = (lambda p: p["m"]) if side == "ligand" else (lambda p: ~p["m"])
    return tokens if side == "both" else F.transform(F.filter(pairs, keep), lambda p: p["t"])


def by_size(label: Column, tokens: Column) -> Column:
    """A label over the number of its ligand's tokens, 1 at least."""
    return label / F.greatest(tokens, F.lit(1))


def dataset_plan(df: DataFrame, split: str, shard: str, local: str) -> DataFrame:
    """split, shard, rows: the sorted local indices to read; a shard has a bounded size."""
    return df.groupBy(split, shard).agg(F.sort_array(F.collect_set(local)).alias("rows"))


def stream_length(plan: DataFrame, shard: str, items: str, batch: int, workers: int) -> DataFrame:
    """worker, items, served: shards are dealt to the workers in turn by their order; a worker serves whole batches only."""
    placed = relational.global_position(plan.select(shard, items), [shard])
    dealt = placed.groupBy((F.col("position") % workers).alias("worker")).agg(F.sum(items).alias("items"))
    return dealt.withColumn("served", F.floor(F.col("items") / batch) * batch)


def complete_roots(listing: DataFrame, key: str, root: str, kind: str, kinds: list[str]) -> DataFrame:
    """Of each key the first root (in order) that has every kind of file; keys without one are left out. Index builders and directory
    look-ups alike."""
    whole = listing.where(F.col(kind).isin(kinds)).groupBy(key, root).agg(F.count_distinct(kind).alias("_kinds")).where(F.col("_kinds") == len(set(kinds)))
    return whole.groupBy(key).agg(F.min(root).alias(root))


def union_by_priority(parts: list[DataFrame], key: str, usable: Column) -> DataFrame:
    """The usable rows of the parts, one a key: of the latest part that has it, and there the last in order of all columns."""
    names = parts[0].columns
    rank = free("_rank", parts[0])
    rows = None
    for k, part in enumerate(parts):
        part = part.where(F.coalesce(usable, F.lit(False))).select(*names).withColumn(rank, F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(key).agg(F.max(F.struct(rank, *(c for c in names if c != key))).alias("_best"))
    return best.select(*(F.col(key) if c == key else F.col(f"_best.{c}").alias(c) for c in names))


def key_sets(rows: DataFrame, sample: str, parts: list[str]) -> DataFrame:
    """sample, keys: the distinct keys of a sample's rows, sorted; null parts make no key."""
    return rows.dropna(subset=[sample, *parts]).groupBy(sample).agg(F.array_sort(F.collect_set(F.struct(*parts))).alias("keys"))


def selected_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that the condition selects; all of them if it selects none."""
    some = df.agg(F.max(F.coalesce(condition, F.lit(False)).cast("int"))).first()[0]
    return df.where(condition) if some else df


def selected_or_first(df: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row that the condition selects; the first of all if it selects none."""
    return df.orderBy(F.desc(F.coalesce(condition, F.lit(False)).cast("int")), *order).limit(1)


def canonical(df: DataFrame, names: dict[str, str], method: str) -> DataFrame:
    """A baseline's table under the canonical names (old to new), with its method; a missing column is an error."""
    relational.require(df, list(names))
    return df.select(F.lit(method).alias("method"), *(F.col(old).alias(new) for old, new in names.items()))


def reordered(df: DataFrame, keys: list[str], residue: list[str], name: str, backbone: list[str], order: str) -> DataFrame:
    """df with place (from 1): atoms of each key by residue, its backbone atoms first in their order, the others as they come."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(b) for b in backbone)), F.col(name)), F.lit(0))
    rank = F.when(rank == 0, len(backbone) + 1).otherwise(rank)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*residue, rank, order)))


def snapshot(df: DataFrame, tokens: Column, tallies: dict[str, Column]) -> DataFrame:
    """One row of a corpus's metadata: documents, tokens, longest, and how many rows each tally holds for."""
    return df.agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("n_tokens"), F.max(tokens).alias("longest"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in tallies.items()))


def orientations_or_reason(df: DataFrame, rules: list[tuple[str, Column]], orientations: int) -> DataFrame:
    """df with reason and orientation: an accepted row once for each orientation (0 is as deposited), a rejected one once, without."""
    told = relational.first_reason(df, rules)
    count = F.when(F.col("reason") == "accepted", F.sequence(F.lit(0), F.lit(orientations - 1))).otherwise(F.array(F.lit(None).cast("int")))
    return told.withColumn("orientation", F.explode(count))


def site_store(sites: DataFrame, parts: DataFrame, key: str, struct: str, cached: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The sites that have both parts, and the structures that the cache lacks: of each the first by order."""
    whole = sites.join(parts, key)
    missing = relational.first_wins(whole.select(struct, order).join(cached.select(struct).distinct(), struct, "left_anti"), [struct], [order])
    return whole, missing


def batched_graph(nodes: DataFrame, edges: DataFrame, bonds: DataFrame, graph: str, node: str, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of graphs as one: nodes with global, edges of both directions as source and target (global numbers) with is_bond, and
    angles left, centre, right of neighbours (left < right). nodes: graph, node from 0 in each; edges and bonds: graph, a, b."""
    size, shift, bond, u, v = (free(c, nodes, edges, bonds) for c in ("_size", "_shift", "_bond", "_u", "_v"))
    sizes = nodes.groupBy(graph).agg((F.max(node) + 1).cast("long").alias(size))
    shifts = relational.global_prefix(sizes, [graph], size, shift).select(graph, shift)
    every = nodes.join(shifts, graph).withColumn("global", F.col(node) + F.col(shift)).drop(shift)
    both = lambda df: df.select(graph, F.col(a).alias(u), F.col(b).alias(v)).union(df.select(graph, F.col(b), F.col(a))).distinct()
    flagged = both(edges).join(both(bonds).withColumn(bond, F.lit(True)), [graph, u, v], "left").join(shifts, graph)
    pairs = flagged.select(graph, (F.col(u) + F.col(shift)).alias("source"), (F.col(v) + F.col(shift)).alias("target"), F.coalesce(bond, F.lit(False)).alias("is_bond"))
    one, two = pairs.select(graph, F.col("target").alias("centre"), F.col("source").alias("left")), pairs.select(graph, F.col("target").alias("centre"), F.col("source").alias("right"))
    return every, pairs, one.join(two, [graph, "centre"]).where("left < right").select(graph, "left", "centre", "right")


def passages_in(docs: DataFrame, passages: DataFrame, doc: str, text: str, passage: str, words: str, width: int = 5) -> DataFrame:
    """doc, passage: pairs of a document and a passage whose words (split at single spaces) stand one after another in it. A passage's first
    width words are looked for among the runs of so many words of each document, as hashes; what is found is compared whole. Passages of
    fewer words are looked for by all of them; those without a word, and null texts, are in nothing."""
    split = lambda c: F.split(F.col(c).cast("string"), " ", -1)
    runs = lambda w: F.xxhash64(F.array_join(w, " "))
    run_of = lambda n: lambda i: runs(F.slice("_w", i, n))
    of = passages.where(F.col(words) != "").select(F.col(passage).alias("_passage"), F.col(words).alias("_words"), split(words).alias("_w"))
    of = of.withColumn("_n", F.least(F.size("_w"), F.lit(width))).withColumn("_h", runs(F.slice("_w", 1, F.col("_n"))))
    own = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    found = None
    for n in sorted(r[0] for r in of.select("_n").distinct().collect()):  # width of them at most
        long_enough = own.select("_doc", split("_text").alias("_w")).where(F.size("_w") >= n)
        each = long_enough.select("_doc", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), run_of(n)))).alias("_h"))
        met = each.join(of.where(F.col("_n") == n).select("_h", "_passage"), "_h").select("_doc", "_passage")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return own.where("false").crossJoin(of.where("false")).select(F.col("_doc").alias(doc), F.col("_passage").alias(passage))
    whole = found.join(of.select("_passage", "_words"), "_passage").join(own, "_doc")
    inside = F.concat(F.lit(" "), "_text", F.lit(" ")).contains(F.concat(F.lit(" "), "_words", F.lit(" ")))
    return whole.where(inside).select(F.col("_doc").alias(doc), F.col("_passage").alias(passage)).distinct()


def prefix_matches(left: DataFrame, right: DataFrame, key: str, codes: str, k: int) -> DataFrame:
    """For each row of left that has k codes or more: n_prefix rows of right share its first k (first of them by key), n_whole all codes. Met
    by hash, then compared. Equal ones of right are added up before they meet, so a common prefix makes no pairs."""
    head = F.slice(codes, 1, k)
    able = lambda df: df.where(F.size(codes) >= k)
    by = lambda c: able(right).groupBy(F.xxhash64(c).alias("_h"), c.alias("_c")).agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
    rows = able(left).select(key, codes, F.xxhash64(head).alias("_hp"), F.xxhash64(codes).alias("_hw"), head.alias("_head"))
    some, all_ = by(head).toDF("_hp", "_cp", "n_prefix", "first"), by(F.col(codes)).drop("_first").toDF("_hw", "_cw", "n_whole")
    met = rows.join(some, (rows["_hp"] == some["_hp"]) & (rows["_head"] == some["_cp"]), "left").join(all_, (rows["_hw"] == all_["_hw"]) & (rows[codes] == all_["_cw"]), "left")
    return met.select(rows[key], F.coalesce("n_prefix", F.lit(0).cast("long")).alias("n_prefix"), "first", F.coalesce("n_whole", F.lit(0).cast("long")).alias("n_whole"))
