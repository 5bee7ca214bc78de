"""Molecules of twenty consecutive vectors against pockets made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard import storage
from halyard.functions import chemistry
from halyard.operators import molecules, relational
from halyard.plans.geometry import ATOMS, RADIUS, atoms, molecule, sides
from halyard.plans.registry import Tables, query
from halyard.sources import versions

REACH = f"({RADIUS.format(e='e1')} + {RADIUS.format(e='e2')})"


@query(f"""with {ATOMS}, s as (select label, power({REACH} / greatest(d, 0.4::double), 6) as six, greatest(0.75::double * {REACH} - d, 0) as short from pairs where d < 8)
select label, round(log10(1 + abs(sum(six * six - 2 * six))), 6) as lennard_jones, sum(six * six - 2 * six) > 0 as repelled, round(sum(short * short), 4) as overlap from s group by 1""")
def pair_energies(t: Tables) -> DataFrame:
    """The sum spans ten powers of ten, so its logarithm is what is compared."""
    pocket, ligand = sides(t)
    sums = molecules.pair_energies(pocket, ligand, ["label"])
    return sums.select("label", F.round(F.log10(1 + F.abs("lennard_jones")), 6).alias("lennard_jones"), (F.col("lennard_jones") > 0).alias("repelled"), F.round("overlap", 4).alias("overlap"))


@query(f"""with {ATOMS}, n as (select p.*, substr('DERKH', (rec % 5 + 1)::int, 1) as residue, case when rec % 3 <> 0 then 'CA' else list_extract(['OD1', 'OE1', 'NE', 'NZ', 'ND1'], (rec % 5 + 1)::int) end as name from pairs p where d <= 4.5),
c as (select *, e1 in ('N', 'O') and e2 in ('N', 'O') as polar, e1 in ('C', 'S') and e2 in ('C', 'S') as apolar from n),
k as (select label, lig, arg_min(residue, (d, rec)) as near, min(case when polar and name <> 'CA' and d between 2 and 4 then 1 when polar and d between 2.4 and 3.5 then 2 when apolar and d between 3.3 and 4.5 then 3 else 9 end) as i from c group by 1, 2)
select l.label, l.vec_id, k.near, coalesce(k.i % 9, 255)::int as interaction from l left join k on l.label = k.label and l.vec_id = k.lig""")
def contact_labels(t: Tables) -> DataFrame:
    pocket, ligand = sides(t)
    v = F.col("vec_id")
    of = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), (v % 5 + 1).cast("int"))
    pocket = pocket.withColumns({"residue": of(*"DERKH"), "name": F.when(v % 3 != 0, "CA").otherwise(of("OD1", "OE1", "NE", "NZ", "ND1"))})
    return molecules.contacts(pocket, ligand, ["label"], "vec_id")


def gathered(t: Tables) -> DataFrame:
    return molecules.gathered(atoms(t).withColumn("molecule", molecule()), ["molecule"], "vec_id")


@query()
def fitted_poses(t: Tables) -> DataFrame:
    """Into a pocket that is the molecule itself, four away in each direction."""
    rows = gathered(t).withColumn("wall", molecules.shifted(F.col("xyz"), 4.0))
    fit = molecules.fitted(rows, "xyz", "elements", "wall", "elements", restarts=2)
    return fit.select("molecule", F.round("overlap_before", 6).alias("overlap_before"), F.round("overlap_after", 6).alias("overlap_after"))


@query()
def bond_orders(t: Tables) -> DataFrame:
    """Every atom with hydrogens for all but two of its bonds. These places are noise, so the valences of few molecules can be met."""
    spare = F.create_map(*(F.lit(x) for e in "CNOS" for x in (e, max(0, chemistry.VALENCES[e][0] - 2))))
    rows = gathered(t).withColumns({"charges": F.transform("elements", lambda e: F.lit(0)), "num_h": F.transform("elements", lambda e: spare[e])})
    found = molecules.bond_orders(rows, "xyz", "elements", "charges", "num_h")
    at = lambda k: F.size(F.filter("bonds", lambda b: b["order"] == k)).cast("long")
    return found.select("molecule", F.size("bonds").cast("long").alias("n_bonds"), at(1).alias("single"), at(2).alias("double"))


@query()
def interface_scores(t: Tables) -> DataFrame:
    """The first half of a molecule against the second, after the first component of each place is doubled."""
    rows = gathered(t).withColumns({"moved": F.transform("xyz", lambda p: F.array(p[0] * 2, p[1], p[2])), "half": F.floor(F.size("xyz") / 2).cast("int")})
    return molecules.interface_scores(rows, "xyz", "moved", "elements", "half").select("molecule", *(F.round(c, 6).alias(c) for c in (*molecules.INTERFACE, *molecules.BONDED)))


@query()
def pose_changes(t: Tables) -> DataFrame:
    rows = gathered(t).withColumns({"moved": F.transform("xyz", lambda p: F.array(p[0], p[1] * 1.25, p[2])), "wall": molecules.shifted(F.col("xyz"), 4.0)})
    out = molecules.pose_changes(rows, "xyz", "moved", "elements", "wall", "elements")
    return out.select("molecule", F.size("torsions").cast("long").alias("torsions"), F.round("least_rmsd", 6).alias("least_rmsd"), "impossible")


# --- graphs drawn from the data: each atom but a molecule's first hangs on an earlier one, some on a second, three places before

GRAPH = """a as (select vec_id // 20 as molecule, row_number() over (partition by vec_id // 20 order by vec_id) - 1 as k, embedding from embeddings),
b as (select molecule, floor((embedding[2]::double + 1) * 1000)::bigint % k as i, k as j from a where k > 0 union select molecule, k - 3, k from a where k >= 3 and embedding[3]::double > 0.15)"""


def drawn(t: Tables) -> DataFrame:
    """molecule, elements, xyz, n and bonds (i, j)."""
    own = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    rows = t.embeddings.select(molecule(), "vec_id", "embedding").groupBy("molecule").agg(own.alias("own"))
    at = lambda v, k: v["embedding"][k].cast("double")
    hung = F.transform("own", lambda v, k: F.when(k > 0, F.struct((F.floor((at(v, 1) + 1) * 1000) % k).cast("int").alias("i"), k.cast("int").alias("j"))))
    ring = F.transform("own", lambda v, k: F.when((k >= 3) & (at(v, 2) > 0.15), F.struct((k - 3).cast("int").alias("i"), k.cast("int").alias("j"))))
    bonds = F.array_distinct(F.filter(F.concat(hung, ring), lambda b: b.isNotNull()))
    return gathered(t).join(rows.select("molecule", F.size("own").cast("long").alias("n"), bonds.alias("bonds")), "molecule")


@query(f"""with recursive {GRAPH}, e as (select molecule, i as u, j as v from b union all select molecule, j, i from b),
reach(molecule, u, v, w) as (select molecule, u, v, v from e union select r.molecule, r.u, r.v, e.v from reach r join e on e.molecule = r.molecule and e.u = r.w and not (e.u = r.u and e.v = r.v) and not (e.u = r.v and e.v = r.u)),
s as (select molecule, u, v, count(*) as size, sum(w) as total, bool_or(w = u) as ring from reach group by 1, 2, 3),
d as (select molecule, u, count(*) as degree from e group by 1, 2),
n as (select molecule, sum(count(*)) over (order by molecule) - count(*) as shift from a group by 1)
select s.molecule, (s.u + n.shift)::bigint as begin, (s.v + n.shift)::bigint as tip, s.size - 1 as n_moving, (s.total - s.v + (s.size - 1) * n.shift)::bigint as moving_sum
from s join s o on o.molecule = s.molecule and o.u = s.v and o.v = s.u join n on n.molecule = s.molecule
join d p on p.molecule = s.molecule and p.u = s.u join d q on q.molecule = s.molecule and q.u = s.v
where not s.ring and p.degree > 1 and q.degree > 1 and (s.size < o.size or s.size = o.size and s.u < s.v)""")
def turning_sides(t: Tables) -> DataFrame:
    """The rotatable bonds of all molecules as one batch."""
    found = molecules.turning_bonds(drawn(t), "molecule", "n", "bonds")
    return found.select("molecule", "begin", "tip", F.size("moving").cast("long").alias("n_moving"), F.aggregate("moving", F.lit(0).cast("long"), lambda s, x: s + x).alias("moving_sum"))


COVALENT = "case {e} when 'C' then 0.76::double when 'N' then 0.71 when 'O' then 0.66 else 1.05 end"


@query(f"""with a as (select vec_id // 20 as molecule, vec_id, embedding[1]::double * 40 as x, embedding[2]::double * 40 as y, embedding[3]::double * 40 as z, ['C', 'N', 'O', 'S'][vec_id % 4 + 1] as e, case when vec_id % 7 = 0 then 'C' else ['C', 'N', 'O', 'S'][vec_id % 4 + 1] end as g from embeddings),
p as (select a.molecule, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < {COVALENT.format(e="a.e")} + {COVALENT.format(e="b.e")} + 0.4 as want,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y * 1.25 - b.y * 1.25) * (a.y * 1.25 - b.y * 1.25) + (a.z - b.z) * (a.z - b.z)) < {COVALENT.format(e="a.g")} + {COVALENT.format(e="b.g")} + 0.4 as got
  from a join a b on a.molecule = b.molecule and a.vec_id < b.vec_id),
q as (select molecule, count(*) filter (want and not got) as missing, count(*) filter (got and not want) as extra from p group by 1)
select molecule, round(avg(case when e = g then 1.0::double else 0 end), 6) as element_share, round(avg(case when vec_id % 3 = 0 and vec_id % 2 = 1 then 0.0::double else 1 end), 6) as charge_share,
  round(avg(case when e = g and not (vec_id % 3 = 0 and vec_id % 2 = 1) then 1.0::double else 0 end), 6) as determined_share, coalesce(any_value(missing), 0)::int as missing, coalesce(any_value(extra), 0)::int as extra, coalesce(any_value(missing + extra), 0) = 0 as graph_exact
from a left join q using (molecule) group by 1""")
def molecule_comparison(t: Tables) -> DataFrame:
    """Molecules against decoded ones with some wrong elements and charges, stretched along one axis."""
    named = atoms(t).withColumn("molecule", molecule()).withColumns({c: F.col(c) * 4 for c in "xyz"})
    v, none = F.col("vec_id"), F.lit(0)
    own = F.struct("vec_id", "element", F.when(v % 7 == 0, "C").otherwise(F.col("element")).alias("e"), none.alias("q"), F.when((v % 3 == 0) & (v % 2 == 1), 1).otherwise(0).alias("c"), none.alias("h"), F.array("x", "y", "z").alias("x"), F.array(F.col("x"), F.col("y") * 1.25, F.col("z")).alias("y"))
    rows = relational.spread(named, "molecule").groupBy("molecule").agg(F.array_sort(F.collect_list(own)).alias("of")).select("molecule", "of.element", "of.e", "of.q", "of.c", "of.h", "of.x", "of.y")
    rows = molecules.with_results(rows, ["x", "element"], "bonds array<struct<i: int, j: int>>", lambda x, e: ([{"i": i, "j": j} for i, j in chemistry.infer_bonds(e, x)],))
    out = molecules.compared(rows, "y", "e", "c", "h", "element", "q", "h", "bonds")
    return out.select("molecule", *(F.round(c, 6).alias(c) for c in ("element_share", "charge_share", "determined_share")), "missing", "extra", "graph_exact")


@query()
def graph_keys(t: Tables) -> DataFrame:
    """Molecules against themselves with their atoms the other way round: which keys meet, by an equi join."""
    rows = drawn(t)
    last = F.col("n").cast("int") - 1
    back = rows.select("molecule", F.reverse("elements").alias("elements"), F.transform("bonds", lambda b: F.struct((last - b["j"]).alias("i"), (last - b["i"]).alias("j"))).alias("bonds"))
    one, two = (molecules.graph_keys(r.select("molecule", "elements", "bonds"), ["elements"], "bonds").select("molecule", "key", "certain") for r in (rows, back))
    met = one.join(two.select("key", F.col("molecule").alias("other")), "key")
    return met.groupBy("molecule", "certain").agg(F.count("*").alias("n_equal"), F.max((F.col("molecule") == F.col("other")).cast("int")).alias("itself"))


@query()
def symmetric_rmsds(t: Tables) -> DataFrame:
    """Of graphs in which every atom is alike, so that their shape alone decides."""
    rows = drawn(t).withColumns({"moved": F.transform("xyz", lambda p: F.array(p[0], p[1] * 1.25, p[2])), "alike": F.transform("elements", lambda e: F.lit("C"))})
    out = molecules.symmetric_rmsds(rows, "xyz", "moved", "alike", "bonds")
    return out.select("molecule", F.round("least_rmsd", 6).alias("least_rmsd"), "certain")


@query()
def torsion_fits(t: Tables) -> DataFrame:
    """Into a pocket that is the molecule itself, four away in each direction."""
    rows = drawn(t).withColumn("wall", molecules.shifted(F.col("xyz"), 1.0))
    fit = molecules.turned(rows, "xyz", "elements", "bonds", "wall", "elements", restarts=1)
    return fit.select("molecule", F.round("overlap_before", 6).alias("overlap_before"), F.round("overlap_after", 6).alias("overlap_after"))


@query()
def projected_distances(t: Tables) -> DataFrame:
    """Molecules stretched along one axis, set right again."""
    rows = drawn(t).withColumn("moved", F.transform("xyz", lambda p: F.array(p[0], p[1] * 1.1, p[2])))
    return molecules.projected(rows, "moved", "xyz", "bonds").select("molecule", "converged", "rounds")


@query()
def displacement_parts(t: Tables) -> DataFrame:
    rows = drawn(t).withColumn("moved", F.transform("xyz", lambda p: F.array(p[0] + 1, p[1] * 1.25, p[2])))
    out = molecules.split_displacements(rows, "xyz", "moved", "bonds")
    length = lambda c: F.round(F.sqrt(F.aggregate(F.flatten(c), F.lit(0.0), lambda s, v: s + v * v)), 6)
    return out.select("molecule", length("along").alias("along"), length("rest").alias("rest"))


@query(f"""with a as (select vec_id // 20 as molecule, row_number() over (partition by vec_id // 20 order by vec_id) - 1 as k, embedding[1]::double * 40 as x, embedding[2]::double * 40 as y, embedding[3]::double * 40 as z, ['C', 'N', 'O', 'S'][vec_id % 4 + 1] as e from embeddings),
p as (select a.molecule, a.k as i, b.k as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d, {COVALENT.format(e="a.e")} + {COVALENT.format(e="b.e")} + 0.4 as reach,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) * 4 + (a.z - b.z) * (a.z - b.z)) as target from a join a b on a.molecule = b.molecule and a.k < b.k)
select molecule as complex, count(*) as n_edges, sum(i * 100 + j)::bigint as ends, round(sum(target), 6) as length from p where d < reach group by 1""")
def rebuilt_edges(t: Tables) -> DataFrame:
    """A table of complexes at two scales whose part of edges, wrong at first, is made anew."""
    own = F.array_sort(F.collect_list(F.struct("vec_id", "element", F.array("x", "y", "z").alias("x"), F.array(F.col("x"), F.col("y") * 2, F.col("z")).alias("t"))))
    named = atoms(t).withColumn("molecule", molecule()).withColumns({c: F.col(c) * 4 for c in "xyz"})
    one = named.groupBy("molecule").agg(own.alias("of")).select("molecule", "of.element", "of.x", "of.t")
    records = one.withColumn("scale", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("xyz", F.when(F.col("scale") == 0, F.col("x")).otherwise(F.col("t")))
    folder = storage.new_folder(t.spark, "complexes")
    wrong = records.select(F.col("molecule").alias("complex"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("length"))
    versions.write({"records": records, "edges": wrong}, folder)
    versions.rebuild_edges(t.spark, folder, complex_="molecule", scale="scale", order="scale", elements="element", xyz="xyz", target="t")
    edges = versions.read(t.spark, folder, "edges")
    return edges.groupBy("complex").agg(F.count("*").alias("n_edges"), F.sum(F.col("i") * 100 + F.col("j")).alias("ends"), F.round(F.sum("length"), 6).alias("length"))


@query()
def decoy_slots(t: Tables) -> DataFrame:
    """Two near, four perturbed and one given decoy of each molecule, against a pocket that is the molecule itself, one away in each direction."""
    rows = drawn(t).withColumns({"wall": molecules.shifted(F.col("xyz"), 1.0), "given": F.array(F.transform("xyz", lambda p: F.array(p[0], p[1] * 1.25, p[2])))})
    out = molecules.decoys(rows, "molecule", "xyz", "elements", "bonds", "wall", "given", near=2, perturbed=4)
    return out.select("molecule", "slot", "kind", F.size("displacements").alias("n"), *(F.round(c, 6).alias(c) for c in ("rmsd", "shift", "fit", "clash")))


@query(f"""with a as (select vec_id // 20 as molecule, vec_id, embedding[1]::double * 40 as x, embedding[2]::double * 40 as y, embedding[3]::double * 40 as z, ['C', 'N', 'O', 'S'][vec_id % 4 + 1] as e from embeddings),
p as (select a.molecule, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < {COVALENT.format(e="a.e")} + {COVALENT.format(e="b.e")} + 0.4 as want,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y * 1.25 - b.y * 1.25) * (a.y * 1.25 - b.y * 1.25) + (a.z - b.z) * (a.z - b.z)) < {COVALENT.format(e="a.e")} + {COVALENT.format(e="b.e")} + 0.4 as got
  from a join a b on a.molecule = b.molecule and a.vec_id < b.vec_id),
q as (select molecule, count(*) filter (want and got) as agreed, count(*) filter (want or got) as either from p group by 1)
select molecule, round(sqrt(avg((y * 0.25) * (y * 0.25))), 6) as off, round(case when coalesce(any_value(either), 0) = 0 then 1 else any_value(agreed) / any_value(either) end, 6) as edge_overlap from a left join q using (molecule) group by 1""")
def edge_overlaps(t: Tables) -> DataFrame:
    """Molecules stretched along one axis against themselves."""
    named = atoms(t).withColumn("molecule", molecule()).withColumns({c: F.col(c) * 4 for c in "xyz"})
    rows = molecules.gathered(named, ["molecule"], "vec_id").withColumn("moved", F.transform("xyz", lambda p: F.array(p[0], p[1] * 1.25, p[2])))
    rows = molecules.with_results(rows, ["xyz", "elements"], "bonds array<struct<i: int, j: int>>", lambda x, e: ([{"i": i, "j": j} for i, j in chemistry.infer_bonds(e, x)],))
    return molecules.edge_overlaps(rows, "moved", "elements", "xyz", "bonds").select("molecule", F.round("off", 6).alias("off"), F.round("edge_overlap", 6).alias("edge_overlap"))


@query()
def placed_poses(t: Tables) -> DataFrame:
    """Molecules turned and moved, coded in a pocket's box and placed again; every fifth without a pose."""
    rows = gathered(t).withColumn("moved", F.transform("xyz", lambda p: F.array(p[1] * -1 + 2, p[0] + 1, p[2])))
    wall = F.array(*(F.array(*(F.lit(v) for v in c)) for c in ((-9.0, -9.0, -9.0), (9.0, 9.0, 9.0))))
    coded = molecules.pose_codes(rows.withColumn("wall", wall), "moved", "xyz", "wall").withColumn("pose", F.when(F.col("molecule") % 5 != 0, F.col("pose")))
    back = molecules.placed(coded, "xyz", "pose", "wall").withColumn("none", F.transform("elements", lambda e: F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    return molecules.edge_overlaps(back, "placed", "elements", "moved", "none").select("molecule", "pose", F.round("off", 4).alias("off"))
