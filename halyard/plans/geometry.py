"""Geometry on embeddings: the first three components are coordinates, the label is the complex, every fifth vector a ligand atom."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from halyard.functions import chemistry, geometry, scalars
from halyard.operators import molecules, spatial
from halyard.plans.registry import Tables, query

ATOMS = """atoms as (select vec_id, label::bigint as label, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, embedding[3]::double * 10 as z,
 case vec_id % 4 when 0 then 'C' when 1 then 'N' when 2 then 'O' else 'S' end as element, vec_id % 5 = 0 as is_ligand from embeddings),
l as (select * from atoms where is_ligand), r as (select * from atoms where not is_ligand),
pairs as (select l.label, l.vec_id as lig, r.vec_id as rec, l.element as e1, r.element as e2, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) as d from l join r using (label))"""
RADIUS = "case {e} when 'C' then 1.70::double when 'N' then 1.55 when 'O' then 1.52 else 1.80 end"
VINA = "case {e} when 'C' then 1.90::double when 'N' then 1.80 when 'O' then 1.70 else 2.00 end"


def atoms(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    element = F.element_at(F.array(*(F.lit(e) for e in "CNOS")), (v % 4 + 1).cast("int"))
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), *((F.col("embedding")[k].cast("double") * 10).alias(c) for k, c in enumerate("xyz")), element.alias("element"), (v % 5 == 0).alias("is_ligand"))


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = atoms(t)
    return a.where("not is_ligand").drop("is_ligand"), a.where("is_ligand").drop("is_ligand")


@query(f"with {ATOMS} select label, lig, rec, round(d, 6) as d from pairs where d < 2")
def radius_contacts(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    return spatial.within(pocket, ligand, 2.0, ["label"]).select("label", F.col("vec_id_b").alias("lig"), F.col("vec_id").alias("rec"), F.round("d", 6).alias("d"))


@query(f"with {ATOMS} select label, count(*) as clash_count, count(distinct lig) as clashing_atoms from pairs where d < 0.75 * ({RADIUS.format(e='e1')} + {RADIUS.format(e='e2')}) group by 1")
def clash_count(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    return spatial.clashes(pocket, ligand, ["label"]).groupBy("label").agg(F.count("*").alias("clash_count"), F.countDistinct("vec_id_b").alias("clashing_atoms"))


@query(f"""with {ATOMS}, g as (select label, d - {VINA.format(e='e1')} - {VINA.format(e='e2')} as g, e1 in ('C', 'S') and e2 in ('C', 'S') as h, e1 in ('N', 'O') and e2 in ('N', 'O') as b from pairs where d < 8)
select label, round(sum(exp(-(g / 0.5) * (g / 0.5))), 4) as gauss1, round(sum(exp(-((g - 3) / 2) * ((g - 3) / 2))), 4) as gauss2, round(sum(case when g < 0 then g * g else 0 end), 4) as repulsion,
 round(sum(case when h then least(greatest(1.5::double - g, 0), 1) else 0 end), 4) as hydrophobic, round(sum(case when b then least(greatest(-g / 0.7::double, 0), 1) else 0 end), 4) as hbond, count(*) as n_pairs from g group by 1""")
def vina_terms(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    pairs = spatial.within(pocket, ligand, 8.0, ["label"])
    gap = F.col("d") - spatial.radius_of("element", chemistry.SCORING, chemistry.SCORING_DEFAULT) - spatial.radius_of("element_b", chemistry.SCORING, chemistry.SCORING_DEFAULT)
    both = lambda *e: F.col("element").isin(*e) & F.col("element_b").isin(*e)
    terms = spatial.pair_terms(pairs, ["label"], gap, both("C", "S"), both("N", "O"))
    return terms.withColumns({c: F.round(c, 4) for c in ("gauss1", "gauss2", "repulsion", "hydrophobic", "hbond")})


@query(f"""with {ATOMS}, m as (select label, lig, min(d - {RADIUS.format(e='e1')} - {RADIUS.format(e='e2')}) as gap from pairs where d < 8 group by 1, 2)
select label, count(*) as n, round(avg(case when gap < 0 then 1.0::double else 0 end), 6) as overlapping, round(quantile_cont(gap, 0.5), 6) as median_gap from m group by 1""")
def surface_gap(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    gap = F.col("d") - spatial.radius_of("element", chemistry.VAN_DER_WAALS, 1.70) - spatial.radius_of("element_b", chemistry.VAN_DER_WAALS, 1.70)
    least = spatial.within(pocket, ligand, 8.0, ["label"]).groupBy("label", "vec_id_b").agg(F.min(gap).alias("gap"))
    return least.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("gap") < 0, 1.0).otherwise(0.0)), 6).alias("overlapping"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median_gap"))


@query(f"""with {ATOMS}, m as (select lig, rec, d, row_number() over (partition by lig order by d, rec) as k from pairs where d <= 4.5) select lig, rec, round(d, 6) as d from m where k = 1""")
def nearest_within(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    near = spatial.nearest_of(pocket, ligand, ["label"], "vec_id", 1, 4.5).where(F.size("near") > 0)
    best = ligand.join(near, ["label", *spatial.XYZ]).select(F.col("vec_id").alias("lig"), F.col("near")[0].alias("m"))
    return best.select("lig", F.col("m.row").alias("rec"), F.round("m.d", 6).alias("d"))


@query(f"""with {ATOMS}, q as (select a.label, a.vec_id as row_, b.vec_id as neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d from atoms a join atoms b on a.label = b.label and a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by row_ order by d, neighbour) as place from q where d <= 3) select label, row_ as vec_id, neighbour, round(d, 6) as d, place from k where place <= 4""")
def knn4(t: Tables) -> DataFrame:
    near = spatial.nearest_k(atoms(t).select("label", "vec_id", "x", "y", "z"), ["label"], "vec_id", 4, 3.0)
    return near.select("label", "vec_id", "neighbour", F.round("d", 6).alias("d"), F.col("place").cast("long").alias("place"))


@query("""with c as (select row_number() over (order by vec_id) - 1 as code, embedding::double[] as e from embeddings where vec_id < 16),
d as (select v.vec_id, c.code, list_distance(v.embedding::double[], c.e) as d from embeddings v, c), k as (select *, row_number() over (partition by vec_id order by d, code) as k from d)
select vec_id, code, round(d, 5) as code_d from k where k = 1""")
def nearest_code(t: Tables) -> DataFrame:
    book = np.array([r.embedding for r in t.embeddings.where("vec_id < 16").orderBy("vec_id").collect()])  # a codebook of 16 rows
    return spatial.nearest_code(t.embeddings.select("vec_id", "embedding"), "embedding", book).select("vec_id", "code", F.round("code_d", 5).alias("code_d"))


@query("""with c as (select vec_id as code, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, embedding[3]::double * 10 as z from embeddings),
d as (select a.code, b.code as neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from c a, c b),
k as (select *, row_number() over (partition by code order by d2, neighbour) as k from d where d2 <= 25), w as (select code, neighbour, exp(-d2 / 2) as w from k where k <= 4)
select code, neighbour, round(w / sum(w) over (partition by code), 6) as weight from w""")
def soft_codes(t: Tables) -> DataFrame:
    book = atoms(t).select(F.col("vec_id").alias("code"), "x", "y", "z")
    return spatial.soft_codes(book, "code", 4, 1.0, 5.0).select("code", "neighbour", F.round("weight", 6).alias("weight"))


@query(f"""with {ATOMS}, s as (select vec_id, sqrt(x * x + y * y + z * z) as r, x, y, z from atoms)
select vec_id, round(r, 6) as r, round(acos(greatest(-1, least(1, z / r))), 6) as theta, round(sin(atan2(y, x)), 6) as sin_phi, round(cos(atan2(y, x)), 6) as cos_phi from s""")
def spherical(t: Tables) -> DataFrame:
    return atoms(t).select("vec_id", *(F.round(c, 6).alias(n) for n, c in scalars.spherical(F.col("x"), F.col("y"), F.col("z")).items()))


@query(f"with {ATOMS} select label, round(sqrt(avg((0.1 * x) * (0.1 * x) + (0.2 * y) * (0.2 * y))), 6) as rmsd, count(*) as n, round(avg(x), 6) as cx, round(max(x) - min(x) + 8, 3) as edge from atoms group by 1")
def rmsd(t: Tables) -> DataFrame:
    d2 = (0.1 * F.col("x")) * (0.1 * F.col("x")) + (0.2 * F.col("y")) * (0.2 * F.col("y"))
    return atoms(t).groupBy("label").agg(F.round(F.sqrt(F.avg(d2)), 6).alias("rmsd"), F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.max("x") - F.min("x") + 8, 3).alias("edge"))


MOVED = """, m as (select label, lig, rec, d, sqrt((l.x * 1.1 - r.x) * (l.x * 1.1 - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) as d2 from pairs join l on l.vec_id = lig join (select vec_id, x, y, z from r) r on r.vec_id = rec where l.label = pairs.label)"""


@query(f"""with {ATOMS}{MOVED} select label, count(*) as n, round((avg((abs(d - d2) < 0.5)::int) + avg((abs(d - d2) < 1)::int) + avg((abs(d - d2) < 2)::int) + avg((abs(d - d2) < 4)::int)) / 4, 6) as lddt from m where d < 6 group by 1""".replace("select label, lig, rec, d, sqrt", "select pairs.label, lig, rec, d, sqrt"))
def lddt_pairs(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    pairs = spatial.within(pocket, ligand, 6.0, ["label"])
    moved = F.sqrt((F.col("x_b") * 1.1 - F.col("x")) * (F.col("x_b") * 1.1 - F.col("x")) + (F.col("y_b") - F.col("y")) * (F.col("y_b") - F.col("y")) + (F.col("z_b") - F.col("z")) * (F.col("z_b") - F.col("z")))
    off = F.abs(F.col("d") - moved)
    share = sum((F.avg((off < s).cast("int")) for s in (0.5, 1.0, 2.0, 4.0)), F.lit(0.0)) / 4
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.round(share, 6).alias("lddt"))


@query(f"""with {ATOMS}{MOVED}, c as (select label, count(*) filter (d < 2) as want, count(*) filter (d2 < 2) as got, count(*) filter (d < 2 and d2 < 2) as hits from m group by 1)
select label, round(hits::double / nullif(got, 0), 6) as precision_, round(hits::double / nullif(want, 0), 6) as recall_ from c where want > 0""".replace("select label, lig, rec, d, sqrt", "select pairs.label, lig, rec, d, sqrt"))
def contact_prf(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    want = spatial.within(pocket, ligand, 2.0, ["label"]).select("label", "vec_id", "vec_id_b", F.lit(1).alias("w"))
    got = spatial.within(pocket, ligand.withColumn("x", F.col("x") * 1.1), 2.0, ["label"]).select("label", "vec_id", "vec_id_b", F.lit(1).alias("g"))
    n = want.join(got, ["label", "vec_id", "vec_id_b"], "full").groupBy("label").agg(F.count("w").alias("want"), F.count("g").alias("got"), F.count_if(F.col("w").isNotNull() & F.col("g").isNotNull()).alias("both"))
    ratio = lambda c: F.round(F.try_divide(F.col("both").cast("double"), F.col(c)), 6)
    return n.where("want > 0").select("label", ratio("got").alias("precision_"), ratio("want").alias("recall_"))


@query("""with d as (select unnest(range(0, 64)) as dim, unnest(embedding)::double as v from embeddings) select dim, round(case when dim % 16 = 15 then 0 else avg(v) end, 6) as mean, round(case when dim % 16 = 15 then 1 else stddev_pop(v) + 1e-8 end, 6) as std from d group by 1""")
def norm_stats(t: Tables) -> DataFrame:
    d = t.embeddings.select(F.posexplode("embedding").alias("dim", "v")).select(F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("v"))
    keep = F.col("dim") % 16 == 15
    s = d.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return s.select("dim", F.round(F.when(keep, 0.0).otherwise(F.col("m")), 6).alias("mean"), F.round(F.when(keep, 1.0).otherwise(F.col("s") + 1e-8), 6).alias("std"))


@query(f"""with {ATOMS} select vec_id, (greatest(0, least(7, floor((x + 10) / 2.5)))::bigint * 64 + greatest(0, least(7, floor((y + 10) / 2.5)))::bigint * 8 + greatest(0, least(7, floor((z + 10) / 2.5)))::bigint) * 4 + vec_id % 4 as code from atoms""")
def grid_tokens(t: Tables) -> DataFrame:
    cell = lambda c: scalars.grid_cell(F.col(c), F.lit(-10.0), F.lit(2.5), 8)
    return atoms(t).select("vec_id", ((cell("x") * 64 + cell("y") * 8 + cell("z")) * 4 + F.col("vec_id") % 4).alias("code"))


#: Atoms of a molecule: consecutive vectors, so that no molecule grows with the table.
MOLECULE = 20


def molecule() -> Column:
    return F.floor(F.col("vec_id") / MOLECULE).cast("long").alias("molecule")


def _per_molecule(t: Tables, schema: str, f) -> DataFrame:
    """Rows that f of (molecule, xyz, elements) gives for each molecule, atoms in order of vec_id."""
    made = StructType.fromDDL(schema)
    types = list(to_arrow_schema(made).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [tuple(r) for m, e, x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("molecule", "elements", "xyz")), strict=True) for r in f(m, np.array(x), e)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names=made.names)

    return molecules.gathered(atoms(t).withColumn("molecule", molecule()), ["molecule"], "vec_id").mapInArrow(run, made)


@query()
def superposition(t: Tables) -> DataFrame:
    def f(molecule: int, x: np.ndarray, _: list[str]) -> Iterator[tuple]:
        moved = x @ geometry.random_rotation(geometry.named_rng(0, str(molecule))).T + 3
        return [(molecule, len(x), geometry.rmsd(moved, x), geometry.kabsch_rmsd(moved, x), geometry.tm_score(x, moved), geometry.lddt(x, moved))]

    return _per_molecule(t, "molecule long, n long, rmsd double, kabsch_rmsd double, tm double, lddt double", f)


@query()
def molecule_graphs(t: Tables) -> DataFrame:
    def f(molecule: int, x: np.ndarray, elements: list[str]) -> list[tuple]:
        bonds = chemistry.infer_bonds(elements, x)
        whole = chemistry.connect(elements, bonds, x)
        fitted = chemistry.prune_to_valence(elements, [0] * len(x), [0] * len(x), whole, x)
        return [(molecule, len(x), len(bonds), chemistry.fragments(len(x), bonds), len(whole), len(fitted), len(chemistry.rotatable(len(x), whole)), chemistry.formula(elements))]

    return _per_molecule(t, "molecule long, n long, bonds long, fragments long, connected long, fitted long, rotatable long, formula string", f)


@query()
def pose_codes(t: Tables) -> DataFrame:
    def f(molecule: int, x: np.ndarray, _: list[str]) -> list[tuple]:
        codec = geometry.PoseCodec(18)
        centre, axes = geometry.canonical_frame(x)
        code = codec.encode(centre, axes, np.full(3, -10.0), np.full(3, 20.0))
        back, _ = codec.decode(code, np.full(3, -10.0), np.full(3, 20.0))
        return [(molecule, code, float(np.linalg.norm(back - centre)))]

    return _per_molecule(t, "molecule long, code long, off double", f)


@query()
def descriptors(t: Tables) -> DataFrame:
    def f(molecule: int, x: np.ndarray, elements: list[str]) -> list[tuple]:
        centre, axes = geometry.canonical_frame(x)
        kinds = ["CNOS".index(e) for e in elements]
        rows = geometry.describe(x, centre, axes, 1, kinds, np.zeros((len(x), 5)), [20] * len(x), [2] * len(x))
        back = geometry.described_places(rows, centre, axes)
        return [(molecule, rows.shape[1], float(np.abs(back - x).max()), [float(v) for v in rows.mean(0)])]

    return _per_molecule(t, "molecule long, width long, off double, means array<double>", f)


@query()
def decoys(t: Tables) -> DataFrame:
    def f(molecule: int, x: np.ndarray, _: list[str]) -> list[tuple]:
        rng = geometry.named_rng(1, str(molecule))
        out = []
        for k in range(6):
            new = geometry.perturb(x, rng, (k + 1) / 6) if k % 2 == 0 else geometry.spin(x, rng)
            new, share = geometry.place(new, x + 4, rng)
            out.append((molecule, k, geometry.rmsd(new, x), geometry.decompose(new, x)[0], share))
        return out

    return _per_molecule(t, "molecule long, slot long, rmsd double, shift double, clash double", f)
