"""Readers of the text formats, over files that Spark writes from the tables: what comes back is what the tables hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard import storage
from halyard.plans.registry import Tables, query
from halyard.sources import cif, tables


def written(t: Tables, rows: DataFrame, line: Column, label: str) -> str:
    """A folder of text files with a line a row."""
    folder = storage.new_folder(t.spark, label)
    rows.select(line.alias("value")).write.text(folder)
    return folder


@query("""select (l_linenumber % 2)::int as label, l_discount as score1, l_tax as score2, 'r' || l_orderkey || '.pdb' as receptor, 'g' || l_linenumber || '_3.gninatypes' as ligand
from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_discount, l_tax) as k, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n = 1""")
def types_pairs(t: Tables) -> DataFrame:
    """Pairs of a types file, each line once."""
    once = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_discount").alias("d"), F.min("l_tax").alias("x")).where("n = 1")
    line = F.concat_ws(" ", F.col("l_linenumber") % 2, "d", "x", F.concat(F.lit("r"), "l_orderkey", F.lit(".pdb")), F.concat(F.lit("g"), "l_linenumber", F.lit("_3.gninatypes")))
    return tables.read_types(t.spark, written(t, once, line, "types")).select("label", "score1", "score2", "receptor", "ligand")


@query("""select 'C' || c_custkey as ccd, c_name as smiles from customer""")
def smiles_dictionary(t: Tables) -> DataFrame:
    return tables.read_smiles(t.spark, written(t, t.customer, F.concat_ws("\t", F.concat(F.lit("C"), "c_custkey"), F.lit("a"), F.lit("b"), F.lit("c"), "c_name"), "smiles"))


@query("""select ('p' || o_orderkey) as pdbid, o_totalprice as logka, ('k' || o_custkey) as cluster from orders""")
def core_set(t: Tables) -> DataFrame:
    line = F.concat_ws("  ", F.concat(F.lit("p"), "o_orderkey"), F.lit("2.0"), F.lit("2010"), F.col("o_totalprice").cast("string"), F.lit("Kd=1nM"), F.concat(F.lit("k"), "o_custkey"))
    return tables.read_core_set(t.spark, written(t, t.orders, line, "core"))


@query("""select ('p' || l_orderkey) as pdbid, ('p' || l_orderkey || '_' || l_linenumber) as pose, l_extendedprice as score from lineitem where l_quantity <> 1""")
def pose_score_files(t: Tables) -> DataFrame:
    """Scores that don't parse are passed over."""
    score = F.when(F.col("l_quantity") != 1, F.col("l_extendedprice").cast("string")).otherwise("none")
    return tables.read_pose_scores(t.spark, written(t, t.lineitem, F.concat_ws(" ", F.concat_ws("_", F.concat(F.lit("p"), "l_orderkey"), "l_linenumber"), score), "scores"))


@query("""with a as (select vec_id // 20 as molecule, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, ['C', 'N', 'O', 'S'][vec_id % 4 + 1] as element from embeddings)
select molecule, count(*) as n, count(*) filter (element = 'N') as nitrogens, round(avg(round(x, 3)), 3) as cx, round(min(round(y, 3)), 3) as least_y from a group by 1""")
def cif_atoms(t: Tables) -> DataFrame:
    """Molecules as residues of mmCIF files, a file for each range of vectors."""
    element = F.element_at(F.array(*(F.lit(e) for e in "CNOS")), (F.col("vec_id") % 4 + 1).cast("int"))
    number = lambda k: F.format_string("%.3f", F.col("embedding")[k].cast("double") * 10)
    lines = t.embeddings.select("vec_id", F.concat_ws(" ", F.lit("ATOM"), "vec_id", element, F.lit("'C 1'"), F.lit("LIG"), F.lit("A"), F.floor(F.col("vec_id") / 20), *(number(k) for k in range(3))).alias("value"))
    folder = storage.new_folder(t.spark, "cif")
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in ("group_PDB", "id", "type_symbol", "auth_atom_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    cif.write_files(lines, folder, "vec_id", "value", head)
    atoms = cif.read_atoms(t.spark, folder)
    return atoms.groupBy(F.col("resseq").cast("long").alias("molecule")).agg(F.count("*").alias("n"), F.count_if(F.col("element") == "N").alias("nitrogens"), F.round(F.avg("x"), 3).alias("cx"), F.round(F.min("y"), 3).alias("least_y"))
