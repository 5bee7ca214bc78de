"""Molecules as rows: contacts and energies between two tables of atoms as grid joins, and kernels that need a whole molecule at once over
rows that hold its atoms in arrays. A molecule is bounded, so a row is.

Defined cases: a row with a null among a kernel's inputs gets null results; an empty table gives an empty table; columns of the results'
names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from halyard.functions import chemistry, flexible, geometry, isomorphism
from halyard.names import free
from halyard.operators import relational, spatial


def gathered(atoms: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, elements, xyz: the atoms (x, y, z, element) of each molecule in that order."""
    own = F.array_sort(F.collect_list(F.struct(order, "element", F.array(*spatial.XYZ).alias("xyz"))))
    return atoms.groupBy(*keys).agg(own.alias("_own")).select(*keys, F.col("_own.element").alias("elements"), F.col("_own.xyz").alias("xyz"))


def with_results(df: DataFrame, inputs: list[str], schema: str, f: Callable[..., tuple]) -> DataFrame:
    """df with the columns of schema: what f gives for the inputs of a row."""
    return with_batches(df, inputs, schema, lambda rows: [f(*r) for r in rows])


def with_batches(df: DataFrame, inputs: list[str], schema: str, f: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """The same for an f that takes the inputs of many rows at once."""
    made = StructType.fromDDL(schema)
    new = {n.lower() for n in made.names}
    kept = [k for k, c in enumerate(df.columns) if c.lower() not in new]
    types = list(to_arrow_schema(made).types)
    nothing = (None,) * len(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True))
            whole = iter(f([r for r in rows if all(v is not None for v in r)]))
            got = [nothing if any(v is None for v in r) else next(whole) for r in rows]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + columns, names=[b.schema.names[k] for k in kept] + made.names)

    return df.mapInArrow(run, StructType([*(df.schema[k] for k in kept), *made]))


def _pairs(bonds: list[dict]) -> list[tuple[int, int]]:
    return [(b["i"], b["j"]) for b in bonds]


def _edges(bonds: list[dict]) -> dict[tuple[int, int], object]:
    return {(min(b["i"], b["j"]), max(b["i"], b["j"])): b.get("order") or 0 for b in bonds}


def _radii(elements: list[str]):
    return chemistry.radii(elements)


def pair_energies(pocket: DataFrame, ligand: DataFrame, keys: list[str], cutoff: float = 8.0, floor: float = 0.4, share: float = 0.75) -> DataFrame:
    """keys, lennard_jones, overlap: sums over pairs of atoms nearer than the cutoff."""
    pairs = spatial.within(pocket, ligand, cutoff, keys)
    table = (chemistry.VAN_DER_WAALS, chemistry.VAN_DER_WAALS_DEFAULT)
    reach = spatial.radius_of("element", *table) + spatial.radius_of("element_b", *table)
    six = F.pow(reach / F.greatest("d", F.lit(floor)), F.lit(6.0))
    short = F.greatest(share * reach - F.col("d"), F.lit(0.0))
    return pairs.groupBy(*keys).agg(F.sum(six * six - 2 * six).alias("lennard_jones"), F.sum(short * short).alias("overlap"))


def contacts(pocket: DataFrame, ligand: DataFrame, keys: list[str], row: str) -> DataFrame:
    """For each ligand atom (by keys and row): near (the residue of the nearest heavy pocket atom within the cut, ties to the smaller
    row) and interaction (its number in INTERACTIONS, the strongest within the cut); null and 255 without one. The pocket has residue
    and name besides."""
    e = F.upper("element")
    residue, name = F.upper(F.trim("residue")), F.upper(F.trim("name"))
    tip = F.concat_ws(" ", residue, name).isin(sorted(f"{r} {n}" for r, n in geometry.CHARGED_TIPS))
    kind = lambda kinds: F.coalesce(e.isin(sorted(kinds)), F.lit(False))
    polar, apolar = kind(geometry.POLAR), kind(geometry.APOLAR)
    rows, place = pocket.where(e != "H"), [*keys, *spatial.XYZ]
    heavy = spatial.placed(rows.select(*place, row, residue.alias("_residue"), polar.alias("_polar"), apolar.alias("_apolar"), (polar & tip).alias("_tip")), keys)
    tiles, points = spatial.tiled(spatial.firsts(heavy, [*keys, "_polar", "_apolar", "_tip"], row, 1), keys)
    near = spatial.nearest_in(tiles, points, ligand, keys, row, 1, geometry.CONTACT_CUT).where(F.size("near") > 0)
    near = near.select(*place, F.col("near")[0]["row"].alias("_row"), F.col("near")[0]["d"].alias("_d"))
    theirs = points.select(*keys, F.col(row).alias("_row"), "_residue", *(F.col(c).alias(f"{c}_p") for c in spatial.XYZ))
    same = F.sqrt(spatial.squared(tuple(f"{c}_p" for c in spatial.XYZ), spatial.XYZ)) == F.col("_d")  # rows of one name in other places
    best = near.join(theirs, [*keys, "_row"]).where(same).groupBy(*place).agg(F.first("_residue").alias("near"), F.lit(True).alias("_met"))
    own = ligand.select(*keys, row, *(F.col(c).cast("double").alias(c) for c in spatial.XYZ), polar.alias("_polar"), apolar.alias("_apolar"))
    out = own.join(best, place, "left")
    label = F.lit(9)
    for number, theirs, ours, bounds in ((3, "_apolar", "_apolar", geometry.HYDROPHOBIC), (2, "_polar", "_polar", geometry.HBOND), (1, "_tip", "_polar", geometry.IONIC)):
        seen = spatial.any_in(points.where(theirs), own.where(ours), keys, row, bounds[0], min(bounds[1], geometry.CONTACT_CUT))
        out = out.join(seen.withColumn(f"_seen{number}", F.lit(True)), place, "left")
        label = F.when(F.col(ours) & F.col(f"_seen{number}"), number).otherwise(label)
    interaction = F.when(F.col("_met").isNull(), 255).otherwise(label % 9).cast("int")
    return out.select(*keys, row, "near", interaction.alias("interaction"))


def fitted(df: DataFrame, xyz: str, elements: str, pocket: str, pocket_elements: str, restarts: int = 4, seed: int = 0) -> DataFrame:
    """fitted, overlap_before, overlap_after: the bounded rigid motion with least overlap."""

    def f(x: list, own: list[str], wall: list, theirs: list[str]) -> tuple:
        a, b = _radii(own), _radii(theirs)
        new = geometry.rigid_fit(x, wall, a, b, restarts=restarts, seed=seed) if x else geometry.points(x)
        return new.tolist(), geometry.overlap(x, wall, a, b), geometry.overlap(new, wall, a, b)

    return with_results(df, [xyz, elements, pocket, pocket_elements], "fitted array<array<double>>, overlap_before double, overlap_after double", f)


def bond_orders(df: DataFrame, xyz: str, elements: str, charges: str, num_h: str) -> DataFrame:
    """bonds (i, j, order): perceived by distance, pruned to what the valences allow, with orders that meet them; the order is null
    where no orders do."""

    def f(x: list, own: list[str], charge: list[int], h: list[int]) -> tuple:
        bonds = chemistry.prune_to_valence(own, charge, h, chemistry.infer_bonds(own, x), x) if own else []
        orders = chemistry.assign_orders(own, charge, h, bonds) if bonds else {}
        return ([{"i": int(i), "j": int(j), "order": None if orders is None else orders[(i, j)]} for i, j in bonds],)

    return with_results(df, [xyz, elements, charges, num_h], "bonds array<struct<i: int, j: int, order: int>>", f)


def pruned(df: DataFrame, xyz: str, elements: str, pocket: str, pocket_elements: str, most: int = 8) -> DataFrame:
    """left: the atoms left when the worst clashing ends of bonds have gone."""

    def f(x: list, own: list[str], wall: list, theirs: list[str]) -> tuple:
        return ([int(k) for k in chemistry.prune_leaves(own, chemistry.infer_bonds(own, x) if own else [], x, wall, theirs, most)],)

    return with_results(df, [xyz, elements, pocket, pocket_elements], "left array<int>", f)


INTERFACE = ("lddt_pli", "contact_precision", "contact_recall", "contact_f1", "iface_rmsd", "clash_pair_frac", "clash_lig_atom_frac", "min_dist_ratio")
BONDED = ("bond_mae", "bond_max", "angle_mae", "angle_max")


def interface_scores(df: DataFrame, ref: str, rec: str, elements: str, n_first: str) -> DataFrame:
    """Interface metrics of the first n_first atoms against the others, and errors of the bonds perceived in ref; null where a part is
    empty, NaN where there is no bond."""

    def f(a: list, b: list, own: list[str], n: int) -> tuple:
        got = geometry.complex_metrics(a, b, n, _radii(own[:n]), _radii(own[n:]))
        got |= geometry.bond_geometry(a, b, chemistry.infer_bonds(own, a) if own else [])
        return tuple(None if (v := got.get(c)) is None else float(v) for c in (*INTERFACE, *BONDED))

    return with_results(df, [ref, rec, elements, n_first], ", ".join(f"{c} double" for c in (*INTERFACE, *BONDED)), f)


def pose_changes(df: DataFrame, before: str, after: str, elements: str, pocket: str, pocket_elements: str, permutations: Callable[[list[str]], list[list[int]]] | None = None) -> DataFrame:
    """torsions (changes of the rotatable bonds' dihedrals), least_rmsd over the automorphisms of before's perceived bonds, or over the
    permutations that the caller allows, impossible (whether after runs into the pocket or itself)."""

    def f(x: list, y: list, own: list[str], wall: list, theirs: list[str]) -> tuple:
        if not own:
            return [], None, False
        bonds = chemistry.infer_bonds(own, x)
        turns = chemistry.torsion_deltas(len(own), bonds, x, y)
        least = geometry.symmetric_rmsd(x, y, permutations(own))[0] if permutations else isomorphism.nearest_copy(y, x, own, dict.fromkeys(bonds, 0))[0]
        return [float(t) for t in turns], float(least), bool(chemistry.closes(y, wall, _radii(theirs), _radii(own), bonds=bonds))

    return with_results(df, [before, after, elements, pocket, pocket_elements], "torsions array<double>, least_rmsd double, impossible boolean", f)


# In what follows bonds is an array of structs with i, j and, if it is to count, order.


def symmetric_rmsds(df: DataFrame, before: str, after: str, labels: str, bonds: str) -> DataFrame:
    """least_rmsd of before from after over the automorphisms of the labelled graph, copy (before's atoms in after's order), certain.
    Both are taken where they lie; arrays of unlike lengths give nulls."""

    def f(x: list, y: list, own: list, b: list[dict]) -> tuple:
        if not len(x) == len(y) == len(own):
            return None, None, None
        return isomorphism.nearest_copy(geometry.points(y), geometry.points(x), own, _edges(b))

    return with_results(df, [before, after, labels, bonds], "least_rmsd double, copy array<int>, certain boolean", f)


def graph_keys(df: DataFrame, labels: list[str], bonds: str) -> DataFrame:
    """key: the same for two rows if, and only if, one's graph is the other's with its atoms in another order; labels: arrays of one value an
    atom. canonical: the atoms in the order the key is made from; certain: whether the search ended (else equal graphs may differ)."""

    def f(b: list[dict], *own: list) -> tuple:
        return isomorphism.canonical(list(zip(*own, strict=True)), _edges(b))

    return with_results(df, [bonds, *labels], "key string, canonical array<int>, certain boolean", f)


CHEMISTRY = ("elements", "charges", "num_h")


def same_graph(colours: list[tuple], bonds: set, others: list[tuple], other_bonds: set) -> bool | None:
    """Whether two coloured graphs agree in some order of their atoms; None if that can't be told. Graphs that are equal as they stand or
    whose atoms differ in their colours or neighbours' colours need no canonical form."""

    def around(of: list[tuple], pairs: set) -> list[str]:
        near = chemistry.neighbours(len(of), sorted(pairs))
        return sorted(repr((of[i], sorted(repr(of[j]) for j in near[i]))) for i in range(len(of)))

    if colours == others and bonds == other_bonds:
        return True
    if around(colours, bonds) != around(others, other_bonds):
        return False
    one, _, sure = isomorphism.canonical(colours, dict.fromkeys(bonds, 0))
    two, _, certain = isomorphism.canonical(others, dict.fromkeys(other_bonds, 0))
    return one == two if sure and certain or one == two else None


def compared(df: DataFrame, xyz: str, elements: str, charges: str, num_h: str, ref_elements: str, ref_charges: str, ref_num_h: str, ref_bonds: str) -> DataFrame:
    """Whether a decoded molecule is the reference's: shares of atoms with the right element, charge, hydrogens and all three; missing and
    extra bonds and graph_exact, with the decoded bonds perceived from places; buildable (orders meet every valence); same_molecule (the
    coloured graphs agree in some order of the atoms, so an exchange of like atoms is no error). Molecules of unlike sizes have no shares
    and no count of bonds."""

    def f(x: list, e: list, c: list, h: list, re: list, rc: list, rh: list, rb: list[dict]) -> tuple:
        got, want = set(chemistry.infer_bonds(e, x)), {(min(p), max(p)) for p in _pairs(rb)}
        n = len(e)
        agree = [[a == b for a, b in zip(u, v, strict=False)] for u, v in ((e, re), (c, rc), (h, rh))] if n == len(re) else None
        share = (lambda v: sum(v) / n if n else None) if agree else (lambda v: None)
        shares = [share(v) for v in (*agree, [all(t) for t in zip(*agree, strict=True)])] if agree else [None] * 4
        built = bool(n) and chemistry.assign_orders(e, c, h, sorted(got)) is not None
        same = same_graph(list(zip(e, c, h, strict=True)), got, list(zip(re, rc, rh, strict=True)), want)
        counts = (len(want - got), len(got - want), got == want) if agree else (None, None, False)
        return *shares, *counts, built, same

    schema = "element_share double, charge_share double, num_h_share double, determined_share double, missing int, extra int, graph_exact boolean, buildable boolean, same_molecule boolean"
    return with_results(df, [xyz, elements, charges, num_h, ref_elements, ref_charges, ref_num_h, ref_bonds], schema, f)


def turned(df: DataFrame, xyz: str, elements: str, bonds: str, pocket: str, pocket_elements: str, restarts: int = 2, seed: int = 0) -> DataFrame:
    """fitted, overlap_before, overlap_after: moved within bounds and turned about rotatable bonds, with no more overlap than before."""

    def f(x: list, own: list[str], b: list[dict], wall: list, theirs: list[str]) -> tuple:
        r, s = _radii(own), _radii(theirs)
        new = flexible.torsion_fit(x, own, _pairs(b), wall, r, s, restarts=restarts, seed=seed)
        return new.tolist(), geometry.overlap(x, wall, r, s), geometry.overlap(new, wall, r, s)

    return with_results(df, [xyz, elements, bonds, pocket, pocket_elements], "fitted array<array<double>>, overlap_before double, overlap_after double", f)


def projected(df: DataFrame, xyz: str, ref: str, bonds: str, tolerance: float = 1e-3, rounds: int = 60) -> DataFrame:
    """projected: xyz with the distances of atoms one and two bonds apart as in ref; converged, rounds. The molecules of a batch are solved
    together."""

    def f(rows: list[tuple]) -> list[tuple]:
        got = flexible.set_distances([r[0] for r in rows], [r[1] for r in rows], [flexible.bonded_pairs(len(r[0]), _pairs(r[2])) for r in rows], tolerance, rounds)
        return [(x.tolist(), ok, took) for x, ok, took in got]

    return with_batches(df, [xyz, ref, bonds], "projected array<array<double>>, converged boolean, rounds int", f)


def split_displacements(df: DataFrame, before: str, after: str, bonds: str) -> DataFrame:
    """along and rest of the displacement from before to after: what shifts, turns and turns about bonds can do to first order, and what is
    at right angles to all of them; followed: before with after's dihedrals, moved onto after."""

    def f(x: list, y: list, b: list[dict]) -> tuple:
        return *(p.tolist() for p in flexible.split_displacement(x, y, _pairs(b))), flexible.followed(x, y, _pairs(b)).tolist()

    return with_results(df, [before, after, bonds], "along array<array<double>>, rest array<array<double>>, followed array<array<double>>", f)


def decoys(df: DataFrame, key: str, xyz: str, elements: str, bonds: str, pocket: str, conformers: str | None = None, near: int = 2, perturbed: int = 6, target: tuple[float, float] = (0.3, 1.2), tries: int = 12, enough: float = 0.15, seed: int = 0) -> DataFrame:
    """Rows of decoys for each molecule: slot, kind, xyz, rmsd (least over automorphisms), displacements (an atom each, in that order), shift and
    fit (deviation by translation, and what a rigid motion leaves), clash (pairs an atom). Slots: near ones turned about their bonds to an
    RMSD within target; perturbed ones, growing with their slot, by turns moved as a whole and turned about bonds as well; then the given
    conformers (an array of places), moved onto the molecule's centre. Each is drawn again while it clashes more than enough, so many
    times at most, and the least clashing stays. A draw depends on seed, key and slot alone; molecules without atoms have no decoys."""
    given = [conformers] if conformers else []

    def f(name: object, x: list, e: list[str], b: list[dict], wall: list, confs: list = ()) -> tuple:
        out, pairs, base = [], _pairs(b), geometry.points(x)
        for slot in range(near + perturbed + len(confs)) if len(base) else ():
            rng = geometry.named_rng(seed, f"{name}:{slot}")
            scale = (slot - near + 1) / max(1, perturbed)

            def draw(slot: int = slot, rng: object = rng, scale: float = scale) -> tuple[str, object]:
                if slot < near:
                    new = flexible.turned_near(base, pairs, rng, rng.uniform(*target))
                    return ("near", new) if new is not None else ("rigid", geometry.perturb(base, rng, 0.1))
                if slot < near + perturbed:
                    if (slot - near) % 2 == 0:
                        return "rigid", geometry.perturb(base, rng, scale)
                    return "flexible", geometry.perturb(flexible.turned_by(base, pairs, rng, scale * 3.14159), rng, scale)
                own = geometry.points(confs[slot - near - perturbed])
                return "conformer", own - own.mean(0) + base.mean(0)

            kind, best = draw()
            least = geometry.clash_share(best, wall)
            for _ in range(tries if slot < near + perturbed else 0):
                if least <= enough:
                    break
                again, new = draw()
                if (share := geometry.clash_share(new, wall)) < least:
                    kind, best, least = again, new, share
            if len(best) != len(base):
                continue
            rmsd, order, _ = isomorphism.nearest_copy(base, best, e, _edges(b))
            lined = best[order]
            shift, fit = geometry.decompose(lined, base)
            away = [float(v) for v in ((lined - base) ** 2).sum(1) ** 0.5]
            out.append({"slot": slot, "kind": kind, "xyz": best.tolist(), "rmsd": rmsd, "displacements": away, "shift": shift, "fit": fit, "clash": least})
        return (out,)

    one = "struct<slot: int, kind: string, xyz: array<array<double>>, rmsd: double, displacements: array<double>, shift: double, fit: double, clash: double>"
    made = free("_decoys", df)
    found = with_results(df.select(key, xyz, elements, bonds, pocket, *given), [key, xyz, elements, bonds, pocket, *given], f"{made} array<{one}>", f)
    return found.select(key, F.explode(made).alias(made)).select(key, f"{made}.*")


def pocket_box(backbone: list) -> tuple:
    """The corner and the edge of the cube that a pocket's places alone tell."""
    x = geometry.points(backbone)
    low = x.min(0)
    return low, float((x.max(0) - low).max())


def pose_codes(df: DataFrame, xyz: str, reference: str, backbone: str, bits: int = 18) -> DataFrame:
    """pose: the code of where xyz lies in the pocket's box and how it is turned from the reference, row for row. Null where there is no
    pocket or no atom."""
    codec = geometry.PoseCodec(bits)

    def f(x: list, ref: list, wall: list) -> tuple:
        if not x or not wall or len(x) != len(ref):
            return (None,)
        a, b = geometry.points(ref), geometry.points(x)
        low, edge = pocket_box(wall)
        return (int(codec.encode(b.mean(0), geometry.best_rotation(a - a.mean(0), b - b.mean(0)).T, low, edge)),)

    return with_results(df, [xyz, reference, backbone], "pose long", f)


def placed(df: DataFrame, reference: str, pose: str, backbone: str, bits: int = 18) -> DataFrame:
    """placed: the reference turned and moved to where its pose says; a null pose leaves it as it is turned, in the middle of the box."""
    codec, own = geometry.PoseCodec(bits), free("_pose", df)

    def f(ref: list, code: int, wall: list) -> tuple:
        if not ref or not wall:
            return (None,)
        x = geometry.points(ref)
        low, edge = pocket_box(wall)
        if code < 0:
            return ((x - x.mean(0) + low + edge / 2).tolist(),)
        centre, turn = codec.decode(code, low, edge)
        return (((x - x.mean(0)) @ turn.T + centre).tolist(),)

    known = df.withColumn(own, F.coalesce(F.col(pose).cast("long"), F.lit(-1).cast("long")))
    return with_results(known, [reference, own, backbone], "placed array<array<double>>", f).drop(own)


def edge_overlaps(df: DataFrame, xyz: str, elements: str, truth: str, bonds: str) -> DataFrame:
    """off (RMSD of xyz from truth, where they lie; null for unlike sizes) and edge_overlap (Jaccard of the bonds perceived in xyz and the
    true ones; 1 where there is none on either side)."""

    def f(x: list, e: list[str], y: list, b: list[dict]) -> tuple:
        got, want = set(chemistry.infer_bonds(e, x)), {(min(p), max(p)) for p in _pairs(b)}
        return float(geometry.rmsd(x, y)) if x and len(x) == len(y) else None, len(got & want) / len(got | want) if got | want else 1.0

    return with_results(df, [xyz, elements, truth, bonds], "off double, edge_overlap double", f)


def turning_bonds(df: DataFrame, key: str, n_atoms: str, bonds: str) -> DataFrame:
    """A row for each rotatable bond of a batch of molecules: the key, bond (its place among its molecule's), and in numbers that run over the
    whole batch, molecules by key, begin, tip and moving (what turns with the tip). The key must be unique; no task holds the batch."""
    local, shift, x = (free(c, df) for c in ("_local", "_shift", "_x"))
    found = with_results(df.select(key, n_atoms, bonds), [n_atoms, bonds], f"{local} array<struct<i: int, j: int, moving: array<int>>>", lambda n, b: ([{"i": i, "j": j, "moving": side} for (i, j), side in flexible.turning_sides(n, _pairs(b))],))
    shifts = relational.global_prefix(df.select(key, n_atoms), [key], n_atoms, shift).select(key, shift)
    each = found.join(shifts, key).select(key, shift, F.posexplode(local).alias("bond", x))
    return each.select(key, "bond", (F.col(shift) + F.col(f"{x}.i")).alias("begin"), (F.col(shift) + F.col(f"{x}.j")).alias("tip"), F.transform(f"{x}.moving", lambda m: F.col(shift) + m).alias("moving"))


def spliced(df: DataFrame, original: str, refined: str, changed: str) -> DataFrame:
    """spliced: refined moved onto original by the atoms that aren't changed, which go back in place."""
    return with_results(df, [original, refined, changed], "spliced array<array<double>>", lambda a, b, c: (geometry.reconcile(a, b, c).tolist() if a else [],))


def shifted(xyz: Column, by: float) -> Column:
    return F.transform(xyz, lambda p: F.transform(p, lambda v: v + F.lit(by)))
