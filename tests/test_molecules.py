"""Molecules as rows against the kernels, atom by atom."""

import math

import numpy as np
import pytest
from halyard.functions import chemistry, geometry, isomorphism
from halyard.operators import molecules

ATOM = "label long, vec_id long, x double, y double, z double, element string"
ROW = "id long, x array<array<double>>, e array<string>, w array<array<double>>, f array<string>, c array<int>, h array<int>"


@pytest.fixture(scope="module")
def atoms():
    rng = np.random.default_rng(3)
    elements = ["C", "N", "O", "S", "H"]
    return [(0, k, *map(float, rng.uniform(-4, 4, 3)), elements[k % 5]) for k in range(60)]


def test_contacts_and_energies(spark, atoms):
    pocket, ligand = atoms[:40], atoms[40:]
    named = [(*a, "DERKHG"[a[1] % 6], ["OD1", "OE1", "NE", "NZ", "ND1", "CA"][a[1] % 6]) for a in pocket]
    p = spark.createDataFrame(named, f"{ATOM}, residue string, name string")
    lig = spark.createDataFrame([*ligand, (0, 99, 90.0, 90.0, 90.0, "C")], ATOM)
    got = {r.vec_id: (r.near, r.interaction) for r in molecules.contacts(p, lig, ["label"], "vec_id").collect()}
    xyz = lambda rows: [a[2:5] for a in rows]
    near, kind = geometry.contact_labels(xyz(ligand), [a[5] for a in ligand], xyz(pocket), [a[5] for a in pocket], [a[6] for a in named], [a[7] for a in named])
    assert got == {a[1]: (n, k) for a, n, k in zip(ligand, near, kind, strict=True)} | {99: (None, 255)}
    assert len(set(kind)) > 2

    r = molecules.pair_energies(p, lig, ["label"]).first()
    radii = [chemistry.radii([a[5] for a in side]) for side in (ligand, pocket)]
    assert math.isclose(r.lennard_jones, geometry.lennard_jones(xyz(ligand), xyz(pocket), *radii), rel_tol=1e-9)
    assert math.isclose(r.overlap, geometry.overlap(xyz(ligand), xyz(pocket), *radii), rel_tol=1e-9)


def test_kernels_over_rows(spark):
    pair = [[0.0, 0.0, 0.0], [1.2, 0.0, 0.0]]
    rows = [
        (1, pair, ["C", "O"], [[0.6, 2.0, 0.0]], ["C"], [0, 0], [2, 0]),
        (2, None, ["C"], [], [], [0], [0]),
        (3, [], [], [], [], [], []),
        (4, pair, ["C", "O"], [], [], [0, 0], [1, 0]),
    ]
    df = spark.createDataFrame(rows, ROW).repartition(2)
    fit = {r.id: r for r in molecules.fitted(df, "x", "e", "w", "f").collect()}
    assert fit[1].overlap_after < fit[1].overlap_before and fit[2].fitted is None and fit[3].fitted == [] and fit[4].fitted == pair
    bonds = {r.id: r.bonds and [tuple(b) for b in r.bonds] for r in molecules.bond_orders(df, "x", "e", "c", "h").collect()}
    assert bonds == {1: [(0, 1, 2)], 2: None, 3: [], 4: [(0, 1, None)]}
    assert {r.id: r.left for r in molecules.pruned(df, "x", "e", "w", "f").collect()} == {1: [0, 1], 2: None, 3: [], 4: [0, 1]}
    changes = {r.id: (r.torsions, r.least_rmsd, r.impossible) for r in molecules.pose_changes(df, "x", "x", "e", "w", "f", lambda e: [list(range(len(e))), list(range(len(e)))[::-1]]).collect()}
    assert changes[4] == ([], 0.0, False) and changes[1] == ([], 0.0, True) and changes[2] == (None, None, None) and changes[3] == ([], None, False)
    assert molecules.fitted(df.limit(0), "x", "e", "w", "f").count() == 0


def test_splice_and_replaced_columns(spark):
    x = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    turned = (np.array(x) @ geometry.axis_rotation([0, 0, 1], 0.7).T + 5).tolist()
    df = spark.createDataFrame([(1, x, turned, [False, False, False, True], "old")], "id int, a array<array<double>>, b array<array<double>>, c array<boolean>, Spliced string")
    out = molecules.spliced(df, "a", "b", "c")
    assert out.columns == ["id", "a", "b", "c", "spliced"]
    assert np.allclose(out.first().spliced, x)


def test_interface(spark, atoms):
    x = [[v * 0.4 for v in a[2:5]] for a in atoms[:10]]
    e = [a[5] for a in atoms[:10]]
    df = spark.createDataFrame([(1, x, e, 5), (2, x, e, 0)], "id int, x array<array<double>>, e array<string>, n int")
    got = {r.id: r for r in molecules.interface_scores(df, "x", "x", "e", "n").collect()}
    assert got[1].lddt_pli == 1.0 and got[1].bond_mae == 0.0 and got[1].angle_max == 0.0 and got[2].lddt_pli is None


BOND = "array<struct<i: int, j: int, order: int>>"


def test_graph_operators(spark):
    ring = [{"i": k, "j": (k + 1) % 6, "order": 1 + k % 2} for k in range(6)]
    other = [{"i": (k + 1) % 6, "j": k, "order": 1 + (k + 1) % 2} for k in range(6)]
    flat = [[float(np.cos(k * np.pi / 3)), float(np.sin(k * np.pi / 3)), 0.0] for k in range(6)]
    turned = flat[2:] + flat[:2]
    rows = [(1, list("CCCCCC"), ring, flat, turned, "k"), (2, list("CCCCCC"), other, flat, flat[1:] + flat[:1], "k"), (3, list("NCCCCC"), ring, flat, turned, "k"), (4, None, ring, flat, flat, "k"), (5, [], [], [], [], "k"), (6, list("CC"), [], flat[:2], flat, "k")]
    df = spark.createDataFrame(rows, f"id int, e array<string>, b {BOND}, x array<array<double>>, y array<array<double>>, key_ string").repartition(2)
    keys = {r.id: r for r in molecules.graph_keys(df, ["e"], "b").collect()}
    assert keys[1].key == keys[2].key != keys[3].key and keys[4].key is None and keys[5].certain and keys[1].key_ == "k"
    rmsd = {r.id: r for r in molecules.symmetric_rmsds(df, "x", "y", "e", "b").collect()}
    assert rmsd[1].least_rmsd == pytest.approx(0, abs=1e-9)
    for k, row in ((2, rows[1]), (3, rows[2])):
        every = isomorphism.automorphisms(row[1], {tuple(sorted((b["i"], b["j"]))): b["order"] for b in row[2]})[0]
        assert len(every) == (6 if k == 2 else 1) and rmsd[k].least_rmsd == pytest.approx(geometry.symmetric_rmsd(row[3], row[4], every)[0])
    assert rmsd[4].least_rmsd is None and rmsd[5].least_rmsd == 0 and rmsd[6].least_rmsd is None
    assert molecules.graph_keys(df.limit(0), ["e"], "b").count() == 0


def test_compared(spark):
    x = [[0.0, 0.0, 0.0], [1.4, 0.0, 0.0], [2.1, 1.2, 0.0]]
    bonds = [{"i": 0, "j": 1}, {"i": 1, "j": 2}]
    e, q = list("CCO"), [0, 0, 0]
    rows = [
        (1, x, e, q, [3, 2, 1], e, q, [3, 2, 1], bonds), (2, x[::-1], e[::-1], q, [1, 2, 3], e, q, [3, 2, 1], bonds), (3, [x[0], x[1], [9.0, 9.0, 9.0]], list("CNO"), q, [3, 1, 1], e, q, [3, 2, 1], bonds),
        (4, x[:2], e[:2], q[:2], [3, 3], e, q, [3, 2, 1], bonds), (5, x, e, q, [3, 2, 1], e, None, [3, 2, 1], bonds), (6, [], [], [], [], [], [], [], []),
    ]
    kinds = "x array<array<double>>, e array<string>, c array<int>, h array<int>, re array<string>, rc array<int>, rh array<int>, rb array<struct<i: int, j: int>>"
    got = {r[0]: r for r in molecules.compared(spark.createDataFrame(rows, f"id int, {kinds}"), *("x", "e", "c", "h", "re", "rc", "rh", "rb")).select("id", "element_share", "num_h_share", "determined_share", "missing", "extra", "graph_exact", "buildable", "same_molecule").collect()}
    assert got[1][1:] == (1, 1, 1, 0, 0, True, True, True)
    assert got[2][1:] == (1 / 3, 1 / 3, 1 / 3, 0, 0, True, True, True)  # the same molecule the other way round
    assert got[3][1:] == (2 / 3, 2 / 3, 2 / 3, 1, 0, False, False, False)
    assert got[4][1:] == (None, None, None, None, None, False, True, False) and got[5][1:] == (None,) * 8 and got[6].same_molecule


def test_turns_fits_and_projections(spark):
    x = [[1.3 * k, 0.6 * (k % 2), 0.2 * (k % 3)] for k in range(6)]
    bonds = [{"i": k, "j": k + 1} for k in range(5)]
    wall = [[1.0, 1.2, 0.3], [4.0, 1.0, 0.0]]
    rows = [(3, x, list("CCCCCC"), bonds, wall, ["C", "O"], [[p[0] * 1.1, p[1], p[2]] for p in x], 6), (1, x[:2], ["C", "C"], bonds[:1], wall, ["C", "O"], x[:2], 2), (2, None, None, bonds, wall, [], x, 0), (4, [], [], [], [], [], [], 0), (9, x, list("CCCCCC"), bonds, [], [], x, 6)]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, e array<string>, b array<struct<i: int, j: int>>, w array<array<double>>, f array<string>, y array<array<double>>, n int").repartition(3)
    fit = {r.id: r for r in molecules.turned(df, "x", "e", "b", "w", "f", restarts=1).collect()}
    assert fit[3].overlap_after < fit[3].overlap_before and fit[1].overlap_after <= fit[1].overlap_before and fit[2].fitted is None and fit[4].fitted == [] and fit[9].fitted == x
    right = {r.id: r for r in molecules.projected(df, "y", "x", "b").collect()}
    assert right[3].converged and right[2].converged is None and right[9].rounds == 0
    for i, j in [(0, 1), (1, 2), (0, 2), (3, 5)]:
        assert math.dist(right[3].projected[i], right[3].projected[j]) == pytest.approx(math.dist(x[i], x[j]), abs=2e-3)
    parts = {r.id: r for r in molecules.split_displacements(df, "x", "y", "b").collect()}
    assert np.allclose(np.add(parts[3].along, parts[3].rest), np.subtract(rows[0][6], x)) and parts[4].along == []
    batch = [tuple(r) for r in molecules.turning_bonds(df.where("x is not null"), "id", "n", "b").orderBy("id", "bond").collect()]
    # ids 1, 3, 4, 9 hold 2, 6, 0, 6 atoms: numbers run over the batch by id
    want = []
    for key, shift in ((3, 2), (9, 8)):
        for k, (begin, tip, moving) in enumerate([(2, 1, [0]), (3, 4, [5]), (2, 3, [4, 5])]):
            want.append((key, k, shift + begin, shift + tip, [shift + m for m in moving]))
    assert batch == want


def test_decoys(spark):
    x = [[1.3 * k, 0.6 * (k % 2), 0.2 * (k % 3)] for k in range(7)]
    bonds = [{"i": k, "j": k + 1} for k in range(6)]
    rows = [(1, x, list("CCCCCCC"), bonds, [], [x[::-1]]), (2, x[:2], list("CC"), bonds[:1], [[0.5, 0.5, 0.0]], []), (3, [], [], [], [], []), (4, None, None, bonds, [], []), (5, x, list("CNOCCCC"), bonds, [[2.0, 1.0, 0.5], [4.0, 1.0, 0.5]], [x, x[:3]])]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, e array<string>, b array<struct<i: int, j: int>>, w array<array<double>>, c array<array<array<double>>>")
    make = lambda d: molecules.decoys(d, "id", "x", "e", "b", "w", "c", near=2, perturbed=4)
    got = {(r.id, r.slot): r for r in make(df.repartition(3)).collect()}
    assert {k: r.xyz for k, r in got.items()} == {(r.id, r.slot): r.xyz for r in make(df.coalesce(1)).collect()}
    assert {k[0] for k in got} == {1, 2, 5} and [r.kind for _, r in sorted(got.items()) if r.id == 1] == ["near", "near", "rigid", "flexible", "rigid", "flexible", "conformer"]
    # the chain the other way round is the same molecule; a conformer of another size is no decoy; two atoms have nothing to turn
    assert got[1, 6].rmsd == pytest.approx(0, abs=1e-9) and (5, 6) in got and (5, 7) not in got and got[2, 0].kind == "rigid"
    for (k, slot), r in got.items():
        base = np.array(rows[k - 1][1])
        for b in rows[k - 1][3] if slot < 6 else ():
            assert math.dist(r.xyz[b["i"]], r.xyz[b["j"]]) == pytest.approx(math.dist(base[b["i"]], base[b["j"]]))
        assert len(r.displacements) == len(base) and r.rmsd == pytest.approx(np.sqrt(np.mean(np.square(r.displacements))))
        if slot < 2 and k == 5:
            assert 0.25 < geometry.rmsd(r.xyz, base) < 1.25


def test_placement_and_edge_overlap(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8, 3))
    turn = geometry.random_rotation(rng)
    there = (x - x.mean(0)) @ turn.T + [3.0, -2.0, 1.0]
    wall = [[-8.0, -8.0, -8.0], [8.0, 6.0, 7.0]]
    rows = [(1, x.tolist(), there.tolist(), wall), (2, x.tolist(), None, wall), (3, x.tolist(), there.tolist(), []), (4, [], [], wall), (5, x.tolist(), there.tolist()[:3], wall)]
    df = spark.createDataFrame(rows, "id int, ref array<array<double>>, x array<array<double>>, w array<array<double>>")
    coded = molecules.pose_codes(df, "x", "ref", "w", bits=30)
    got = {r.id: r for r in molecules.placed(coded, "ref", "pose", "w", bits=30).collect()}
    assert got[1].pose is not None and all(got[k].pose is None for k in (2, 3, 4, 5)) and "_pose" not in molecules.placed(coded, "ref", "pose", "w", bits=30).columns
    # within a cell of the box and a step of the rotation grid
    assert np.abs(np.mean(got[1].placed, 0) - there.mean(0)).max() <= 16 / 31 and geometry.kabsch_rmsd(got[1].placed, there) < 1e-9 and geometry.rmsd(got[1].placed, there) < 0.9
    assert np.allclose(got[2].placed, x - x.mean(0)) and got[3].placed is None and got[4].placed is None
    line = [[0.0, 0.0, 0.0], [1.4, 0.0, 0.0], [2.8, 0.0, 0.0]]
    far = [[0.0, 0.0, 0.0], [1.4, 0.0, 0.0], [9.0, 0.0, 0.0]]
    pairs = [(1, line, list("CCC"), line, [{"i": 0, "j": 1}, {"i": 2, "j": 1}]), (2, far, list("CCC"), line, [{"i": 0, "j": 1}, {"i": 1, "j": 2}]), (3, far[1:], list("CC"), line, []), (4, None, list("C"), line, []), (5, [], [], [], [])]
    kinds = "id int, x array<array<double>>, e array<string>, y array<array<double>>, b array<struct<i: int, j: int>>"
    out = {r.id: (r.off, r.edge_overlap) for r in molecules.edge_overlaps(spark.createDataFrame(pairs, kinds), "x", "e", "y", "b").collect()}
    assert out[1] == (0.0, 1.0) and out[2] == (pytest.approx(6.2 / 3**0.5), 0.5) and out[3] == (None, 1.0) and out[4] == (None, None) and out[5] == (None, 1.0)


def test_same_graph_needs_few_canonical_forms(monkeypatch):
    ring = {(k, k + 1) for k in range(5)} | {(0, 5)}
    carbon, path = [("C", 0, 0)] * 6, {(k, k + 1) for k in range(5)}
    turned = {(min(a, b), max(a, b)) for a, b in (((i + 2) % 6, (j + 2) % 6) for i, j in path)}
    assert molecules.same_graph(carbon, path, carbon, turned) is True
    assert molecules.same_graph(carbon, ring, carbon, {(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)}) is False  # alike around each atom
    monkeypatch.setattr(molecules.isomorphism, "canonical", None)
    assert molecules.same_graph(carbon, ring, carbon, ring) is True
    assert molecules.same_graph(carbon, ring, carbon, path) is False
    assert molecules.same_graph(carbon, ring, [("N", 0, 0), *carbon[1:]], ring) is False
