"""From structures to a token corpus and back: made from embeddings' coordinates, written as archives, read, parsed, tokenised."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard import storage
from halyard.functions import scalars, sequences
from halyard.operators import relational
from halyard.plans import geometry
from halyard.plans.registry import Tables, query
from halyard.sources import members, packed, records, tables


def ligand_files(t: Tables) -> DataFrame:
    """member, content: an SDF entry for each molecule."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        mol = {"atoms": list(zip(pdf["element"], pdf["x"], pdf["y"], pdf["z"], strict=True)), "bonds": [(k, k + 1, 1) for k in range(len(pdf) - 1)]}
        return pd.DataFrame({"member": [f"{pdf['molecule'].iloc[0]:07d}.sdf"], "content": [records.write_sdf(mol)]})

    return geometry.atoms(t).withColumn("molecule", geometry.molecule()).groupBy("molecule").applyInPandas(write, "member string, content string")


@query("""with a as (select vec_id // 20 as pair_idx, embedding[1]::double * 10 as x from embeddings where (vec_id // 20) % 2 = 0)
select pair_idx, count(*) as n_atoms, count(*) - 1 as n_bonds, round(avg(round(x, 4)), 3) as cx from a group by 1""")
def archive_round_trip(t: Tables) -> DataFrame:
    folder = storage.new_folder(t.spark, "ligands")
    tables.write_archives(ligand_files(t), folder, "member", "content", 4)
    manifest = t.embeddings.select(geometry.molecule().alias("pair_idx")).distinct().where("pair_idx % 2 = 0")
    poses = tables.poses(t.spark, folder, manifest)
    mean = F.aggregate("mol.atoms", F.lit(0.0), lambda s, a: s + a["x"]) / F.size("mol.atoms")
    return poses.select("pair_idx", F.size("mol.atoms").cast("long").alias("n_atoms"), F.size("mol.bonds").cast("long").alias("n_bonds"), F.round(mean, 3).alias("cx"))


@query("""with c as (select vec_id // 20 as molecule, vec_id, (greatest(0, least(7, floor((embedding[1]::double * 10 + 10) / 2.5)))::bigint * 4 + vec_id % 4)::int as code from embeddings),
s as (select molecule, coalesce(list(code order by vec_id) filter (vec_id % 5 <> 0), []) as p, coalesce(list(code order by vec_id) filter (vec_id % 5 = 0), []) as l from c group by 1)
select split, count(*) as num_docs, sum(n)::bigint as num_tokens, max(n) as max_len from (select case when molecule % 4 = 0 then 'val' else 'train' end as split, len(p) + len(l) + 6 as n from s) group by 1""")
def token_corpus(t: Tables) -> DataFrame:
    code = (scalars.grid_cell(F.col("x"), F.lit(-10.0), F.lit(2.5), 8) * 4 + F.col("vec_id") % 4).cast("int")
    rows = geometry.atoms(t).withColumn("code", code)
    side = lambda ligand: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_ligand") == ligand, F.struct("vec_id", "code")))), lambda s: s["code"])
    docs = rows.groupBy(geometry.molecule()).agg(side(False).alias("p"), side(True).alias("l"))
    docs = docs.select(F.when(F.col("molecule") % 4 == 0, "val").otherwise("train").alias("split"), sequences.build_sequence(F.col("p"), F.col("l")).alias("tokens"))
    folder = storage.new_folder(t.spark, "tokens")
    tables.write_tokens(docs, folder)
    return tables.token_counts(t.spark.read.parquet(folder))


@query("""select vec_id // 20 as molecule, count(*) as n from embeddings group by 1""")
def pdb_round_trip(t: Tables) -> DataFrame:
    atoms = geometry.atoms(t).withColumns({"molecule": geometry.molecule(), "name": F.col("element"), "resname": F.lit("ALA"), "chain": F.lit("A"), "resseq": (F.col("vec_id") % 9999).cast("int")})
    text = tables.pdb_text(atoms, ["molecule"], "vec_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"molecule": pdf["molecule"], "n": [len(records.parse_pdb(x)) for x in pdf["text"]]})

    return text.mapInPandas(count, "molecule long, n long")


@query("""with b as (select label::bigint * 1000 as n, label, vec_id from embeddings) select shard, count(*) as rows_ from (select floor(coalesce(sum(n) over (order by label, vec_id rows between unbounded preceding and 1 preceding), 0) / 100000)::bigint as shard from b) group by 1""")
def size_shards(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", (F.col("label").cast("long") * 1000).alias("n"))
    return tables.shard_by_size(rows, ["label", "vec_id"], "n", 100_000).groupBy("shard").agg(F.count("*").alias("rows_"))


@query("select label::bigint as label, count(*) as records, any_value(label % 3)::bigint as kind from embeddings group by 1")
def normalised_tables(t: Tables) -> DataFrame:
    folder = storage.new_folder(t.spark, "normalised")
    rows = t.embeddings.select(F.col("label").cast("long").alias("label"), "vec_id", (F.col("label") % 3).cast("long").alias("kind"))
    tables.write_normalised(rows, folder, "label", ["kind"])
    n = t.spark.read.parquet(f"{folder}/records").groupBy("label").agg(F.count("*").alias("records"))
    return n.join(t.spark.read.parquet(f"{folder}/complexes"), "label")


@query("select l_returnflag as arm, count(*) as n from lineitem group by 1")
def resumed_arms(t: Tables) -> DataFrame:
    """Written in two runs; what the first left isn't written again."""
    folder = storage.new_folder(t.spark, "arms")
    rows = t.lineitem.select(F.col("l_returnflag").alias("arm"), "l_orderkey")
    tables.write_new_arms(rows.where("arm = 'A'"), folder)
    tables.write_new_arms(rows, folder)
    return t.spark.read.parquet(folder).groupBy("arm").agg(F.count("*").alias("n"))


@query("select p_partkey, p_name from part where p_size > 40 and p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def resume_work_list(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return relational.without(t.part.where("p_size > 40").select("p_partkey", "p_name"), done, "p_partkey")


def text_archives(t: Tables, rows: DataFrame, form: str) -> DataFrame:
    """Archives of texts in the shared folder, and the index of their members."""
    named = rows.select(F.format_string("texts/%d.txt", "doc_id").alias("member"), "text")
    done = tables.write_archives(named, storage.new_folder(t.spark, "texts"), "member", "text", 2000, form)
    return storage.cut(members.index_of(done, "archive"), "index")


@query("""select doc_id, text is not null as found, strlen(text)::bigint as size, md5(text) as digest from labels left join documents using (doc_id)""")
def member_lookup(t: Tables) -> DataFrame:
    """The text of every labelled document, each read by its range out of tar archives of all documents."""
    index = text_archives(t, t.documents, "tar")
    wanted = t.labels.select("doc_id", F.format_string("texts/%d.txt", "doc_id").alias("member")).join(index.select("archive", "member"), "member", "left")
    got = members.lookup(wanted, index)
    return got.select("doc_id", F.col("content").isNotNull().alias("found"), F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


@query("""select doc_id, length(text)::bigint as n_chars, md5(text) as digest from documents""")
def resolved_texts(t: Tables) -> DataFrame:
    """Documents whose records hold the text or name a member of a zip, a tar or a compressed tar file, by turns."""
    turn = lambda k: t.documents.where(F.pmod("doc_id", F.lit(4)) == k)
    rows = turn(0).select("doc_id", F.col("text").alias("pdb"), *(F.lit(None).cast("string").alias(c) for c in ("zip", "tar", "member")))
    for k, form in enumerate(("zip", "tar", "tar.gz"), 1):
        there = text_archives(t, turn(k), form).select(F.col("member").alias("name"), "archive")
        named = turn(k).select("doc_id", F.format_string("texts/%d.txt", "doc_id").alias("name")).join(there, "name", "left")
        none = F.lit(None).cast("string")
        rows = rows.unionByName(named.select("doc_id", none.alias("pdb"), (F.col("archive") if k == 1 else none).alias("zip"), (none if k == 1 else F.col("archive")).alias("tar"), F.col("name").alias("member")))
    return members.resolve(rows).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("""with d as (select row_number() over (order by doc_id) - 1 as place, list_transform(string_split(coalesce(text, ''), ' '), lambda x: least(length(x), 65535)) as tokens from documents)
select place, len(tokens)::bigint as n_tokens, list_sum(tokens)::bigint as total, list_sum(list_transform(tokens, lambda x, k: x * k))::bigint as weighted, len(list_filter(tokens, lambda x: x % 2 = 1))::bigint as n_odd from d""")
def packed_tokens(t: Tables) -> DataFrame:
    """Documents as the lengths of their words, with a stream of odd and even: written flat, read back by splits."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.least(F.length(w), F.lit(65535)))
    docs = t.documents.select("doc_id", words.alias("tokens")).withColumn("odd", F.transform("tokens", lambda x: x % 2))
    folder = storage.new_folder(t.spark, "flat")
    packed.write_packed(docs, folder, ["doc_id"], lengths="<u4", streams={"odd": "u1"})
    back = relational.global_position(packed.read_packed(t.spark, folder, lengths="<u4", streams={"odd": "u1"}), ["name", "doc"], "place")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = F.zip_with("tokens", F.sequence(F.lit(1), F.size("tokens")), lambda x, k: x.cast("long") * k)
    return back.select("place", F.size("tokens").cast("long").alias("n_tokens"), total("tokens").alias("total"), total(weighted).alias("weighted"), total("odd").alias("n_odd"))
