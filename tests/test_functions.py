"""Kernels and expressions against closed forms, slow versions and invariants."""

import itertools
import math
import time

import numpy as np
import pytest
from halyard.functions import chemistry, geometry, scalars, sequences, statistics
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

RNG = np.random.default_rng(0)
CLOUD = RNG.normal(size=(12, 3)) * 3


# --- statistics


def test_t_distribution():
    # closed form for one degree of freedom: 1 - 2 atan(t) / pi
    for t in (0.1, 1.0, 5.0):
        assert statistics.t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)
        assert statistics.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    assert math.isnan(statistics.paired_ttest([1.0], [2.0]).pvalue)
    with pytest.raises(ValueError, match="differ"):
        statistics.paired_ttest([1.0], [1.0, 2.0])


def brute_wilcoxon(d):
    ranks = statistics.average_ranks(np.abs(d))
    total = ranks.sum()
    own = min(ranks[np.array(d) > 0].sum(), total - ranks[np.array(d) > 0].sum())
    every = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * np.mean([e <= own for e in every]))


def test_wilcoxon_exact():
    d = [0.5, -1.5, 2.5, 3.5, -4.5, 6.0, 7.25]
    assert statistics.wilcoxon(d).pvalue == pytest.approx(brute_wilcoxon(d))
    assert math.isnan(statistics.wilcoxon([0.0, 0.0]).pvalue) and math.isnan(statistics.wilcoxon([]).pvalue)
    assert 0 < statistics.wilcoxon([1.0, 1.0, -1.0, 2.0, 0.0]).pvalue <= 1


def test_mcnemar_and_holm():
    assert statistics.mcnemar(0, 0, 5).pvalue == 1 and statistics.mcnemar(5, 0, 9).pvalue == pytest.approx(2 / 32)
    got = statistics.holm([0.01, float("nan"), 0.04, 0.03])
    assert got[0] == pytest.approx(0.03) and math.isnan(got[1]) and got[2] == got[3] == pytest.approx(0.06)


def test_mcnemar_of_many_pairs():
    for a, b in ((480, 530), (1000, 1001), (1500, 1400), (16, 1100), (3, 1200), (2000, 2000)):
        exact = sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)
        assert statistics.mcnemar(a, b, a + b).pvalue == pytest.approx(min(1.0, 2 * exact), rel=1e-9)
    began = time.time()
    assert 0 < statistics.mcnemar(2_000_000, 2_001_000, 9_000_000).pvalue < 1
    assert time.time() - began < 5


def test_williams():
    assert math.isnan(statistics.williams(0.5, 0.4, 0.3, 3).pvalue)
    assert statistics.williams(0.5, 0.5, 0.3, 50).pvalue == pytest.approx(1)
    assert statistics.williams(0.9, 0.1, 0.2, 50).pvalue < 1e-4


def test_bootstrap_is_seeded():
    a, b = (statistics.bootstrap([1.0, 2.0, 3.0, float("nan")], resamples=500, seed=3) for _ in range(2))
    assert a == b and a[1] <= a[0] <= a[2]


@given(st.lists(st.floats(-5, 5), min_size=2, max_size=20))
@settings(max_examples=50, deadline=None)
def test_ranks_sum(x):
    assert statistics.average_ranks(x).sum() == pytest.approx(len(x) * (len(x) + 1) / 2)


def test_wasserstein():
    x = RNG.normal(size=100)
    assert statistics.wasserstein(x, x + 2) == pytest.approx(2) and math.isnan(statistics.wasserstein([], x))


# --- geometry


def test_superposition_undoes_a_motion():
    for k in range(5):
        turn = geometry.random_rotation(np.random.default_rng(k))
        assert np.linalg.det(turn) == pytest.approx(1) and np.allclose(turn @ turn.T, np.eye(3))
        moved = CLOUD @ turn.T + 5
        assert geometry.kabsch_rmsd(moved, CLOUD) == pytest.approx(0, abs=1e-9)
        assert geometry.lddt(CLOUD, moved) == 1 and geometry.tm_score(CLOUD, moved) == pytest.approx(1)
    mirror = CLOUD * [1, 1, -1]
    assert geometry.kabsch_rmsd(mirror, CLOUD) > 0.1
    assert math.isnan(geometry.lddt(CLOUD[:1], CLOUD[:1])) and math.isnan(geometry.tm_score(np.empty((0, 3)), np.empty((0, 3))))
    with pytest.raises(ValueError, match="differ"):
        geometry.rmsd(CLOUD, CLOUD[:3])


def test_contacts_and_bonds():
    a, b = np.zeros((1, 3)), np.array([[3.0, 0, 0], [9.0, 0, 0]])
    assert geometry.contact_prf(a, b, a, b) == (1, 1, 1)
    assert geometry.contact_prf(a, b, a, b + 20)[2] == 0
    stats = geometry.clash_stats(a, b, [1.7], [1.7, 1.7])
    assert stats["clash_pair_frac"] == 0 and stats["min_dist_ratio"] == pytest.approx(3 / 3.4)
    out = geometry.bond_geometry(CLOUD, CLOUD, [(0, 1), (1, 2)])
    assert out["bond_max"] == 0 and out["angle_max"] == 0
    assert math.isnan(geometry.bond_geometry(CLOUD, CLOUD, [])["bond_mae"])


def test_frame_is_canonical():
    centre, axes = geometry.canonical_frame(CLOUD)
    turn = geometry.random_rotation(np.random.default_rng(1))
    other_centre, other = geometry.canonical_frame(CLOUD @ turn.T + 2)
    assert np.allclose((CLOUD - centre) @ axes, (CLOUD @ turn.T + 2 - other_centre) @ other, atol=1e-8)
    assert np.linalg.det(axes) == pytest.approx(1) and np.allclose(geometry.canonical_frame(CLOUD[:1])[1], np.eye(3))


def test_spherical_round_trip():
    assert np.allclose(geometry.cartesian(geometry.spherical(CLOUD)), CLOUD)
    assert geometry.spherical([[0, 0, 0]]).tolist() == [[0, 0, 0, 1]]


def test_descriptors():
    centre, axes = geometry.canonical_frame(CLOUD)
    rows = geometry.describe(CLOUD, centre, axes, 1, [0] * 12, np.zeros((12, 5)), [20] * 12, [2] * 12)
    assert rows.shape == (12, 33) and geometry.WIDTH == 33
    assert np.allclose(geometry.described_places(rows, centre, axes), CLOUD)
    turn = geometry.random_rotation(np.random.default_rng(2))
    turned = geometry.rotate_rows(rows, turn)
    assert np.allclose(turned[:, [0, 13, 17, 21, 25]], rows[:, [0, 13, 17, 21, 25]]) and np.array_equal(turned[:, 4:13], rows[:, 4:13])
    place, kind = geometry.nearest_offsets(CLOUD[:2], np.array([5, 6]))
    assert kind[0].tolist() == [6, 0, 0, 0] and np.allclose(place[0, 0], CLOUD[1] - CLOUD[0])


@pytest.mark.parametrize("bits", [13, 18, 21])
def test_pose_codec(bits):
    codec = geometry.PoseCodec(bits)
    turn = geometry.random_rotation(np.random.default_rng(4))
    code = codec.encode([1.0, 2, 3], turn, np.zeros(3), np.full(3, 8.0))
    centre, back = codec.decode(code, np.zeros(3), np.full(3, 8.0))
    assert 0 <= code < 1 << bits and codec.encode(centre, back, np.zeros(3), np.full(3, 8.0)) == code
    assert np.abs(centre - [1, 2, 3]).max() <= 4.0 / codec.steps + 1e-9


def test_torsions():
    x = np.array([[1.0, 1, 0], [0, 0, 0], [0, 0, 1.5], [1.0, 0, 2.5]])
    before = geometry.dihedral(*x)
    after = geometry.apply_torsions(x, [(1, 2)], [np.array([3])], [0.7])
    assert geometry.wrap(geometry.dihedral(*after) - before) == pytest.approx(0.7)
    assert geometry.distances(after, after)[2, 3] == pytest.approx(geometry.distances(x, x)[2, 3])
    assert geometry.dihedral(*[[0, 0, 0]] * 4) == 0 and geometry.wrap(-math.pi) == math.pi


def test_fit_never_gets_worse():
    pocket = RNG.normal(size=(40, 3)) * 4
    r, s = np.full(12, 1.7), np.full(40, 1.7)
    fitted = geometry.rigid_fit(CLOUD, pocket, r, s, restarts=2)
    assert geometry.overlap(fitted, pocket, r, s) <= geometry.overlap(CLOUD, pocket, r, s)
    assert np.allclose(geometry.distances(fitted, fitted), geometry.distances(CLOUD, CLOUD))
    assert np.allclose(geometry.rigid_fit(CLOUD, pocket + 50, r, s), CLOUD)


def test_reconcile_and_order():
    turn = geometry.random_rotation(np.random.default_rng(5))
    moved = CLOUD @ turn.T + 1
    changed = np.zeros(12, bool)
    changed[:2] = True
    assert np.allclose(geometry.reconcile(CLOUD, moved, changed), CLOUD)
    assert np.allclose(geometry.reconcile(CLOUD, moved, np.ones(12, bool)), moved)
    assert sorted(geometry.buried_first(CLOUD, [(k, k + 1) for k in range(11)])) == list(range(12))


def test_contact_labels():
    to = [[0, 0, 3.0], [0, 0, 3.4], [0, 0, 30.0]]
    residue, kind = geometry.contact_labels([[0, 0, 0], [99, 0, 0]], ["N", "C"], to, ["C", "O", "H"], ["A", "D", "G"], ["CA", "OD1", "H"])
    assert residue == ["A", None] and kind == [1, 255]
    assert geometry.contact_labels([[0, 0, 0]], ["N"], [], [], [], [])[1] == [255]


# --- chemistry


def test_bonds_and_fragments():
    x = np.array([[0, 0, 0], [1.5, 0, 0], [3.0, 0, 0], [9.0, 0, 0]])
    bonds = chemistry.infer_bonds(["C"] * 4, x)
    assert bonds == [(0, 1), (1, 2)] and chemistry.fragments(4, bonds) == 2
    assert chemistry.connect(["C"] * 4, bonds, x) == [(0, 1), (1, 2), (2, 3)]
    assert chemistry.infer_bonds([], []) == [] and chemistry.infer_bonds(["Xx", "C"], x[:2]) == []


RING = [(k, (k + 1) % 6) for k in range(6)]


def test_bridges_against_removal():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        bonds = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.35]
        slow = {b for b in bonds if chemistry.fragments(n, [c for c in bonds if c != b]) > chemistry.fragments(n, bonds)}
        assert chemistry.bridges(n, bonds) == slow
    assert chemistry.ring_bonds(7, [*RING, (0, 6)]) == RING
    assert chemistry.rotatable(8, [*RING, (0, 6), (6, 7)]) == [((0, 6), [7])]


def brute_orders(sums, bonds):
    for orders in itertools.product((1, 2, 3), repeat=len(bonds)):
        total = [0] * len(sums)
        for (i, j), o in zip(bonds, orders, strict=True):
            total[i] += o
            total[j] += o
        if total == sums:
            return True
    return False


def test_orders_against_search():
    rng = np.random.default_rng(7)
    for _ in range(120):
        n = int(rng.integers(2, 7))
        bonds = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5][:7]
        sums = [int(v) for v in rng.integers(1, 5, n)]
        got = chemistry._orders_for(sums, bonds)
        assert (got is not None) == brute_orders(sums, bonds), (sums, bonds)
        if got is not None:
            total = [0] * n
            for (i, j), o in got.items():
                total[i] += o
                total[j] += o
            assert total == sums and all(1 <= o <= 3 for o in got.values())


def test_orders_of_molecules():
    benzene = chemistry.assign_orders(["C"] * 6, [0] * 6, [1] * 6, RING)
    assert sorted(benzene.values()) == [1, 1, 1, 2, 2, 2]
    assert chemistry.assign_orders(["C", "N"], [0, 0], [1, 0], [(0, 1)]) == {(0, 1): 3}
    assert chemistry.assign_orders(["C", "C"], [0, 0], [0, 0], [(0, 1)]) is None
    assert chemistry.assign_orders(["S", "O", "O", "O", "O"], [0] * 5, [0, 1, 1, 0, 0], [(0, k) for k in range(1, 5)])[(0, 3)] == 2
    assert chemistry.assign_orders(["Xx"], [0], [0], []) is None


def test_pruning():
    x = np.array([[0, 0, 0], [1.5, 0, 0], [-1.5, 0, 0], [0, 1.5, 0], [0, -1.5, 0], [1.4, 1.4, 0]])
    bonds = [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 5), (3, 5)]
    kept = chemistry.prune_to_valence(["C"] * 6, [0] * 6, [0] * 6, bonds, x)
    assert (0, 5) not in kept and len(kept) == 6
    star = [(0, k) for k in range(1, 6)]
    assert chemistry.prune_to_valence(["C"] * 6, [0] * 6, [0] * 6, star, x) == star
    # a ring bond can go, then only bridges are left at an atom that still has too many: what went stays away
    spokes = [(0, k) for k in range(1, 7)] + [(1, 2)]
    far = np.array([[0, 0, 0], [1.5, 0, 0], [1.6, 1.4, 0], [-1.5, 0, 0], [0, -1.5, 0], [0, 0, 1.5], [0, 0, -1.5]])
    assert chemistry.prune_to_valence(["C"] * 7, [0] * 7, [0] * 7, spokes, far) == [b for b in spokes if b != (0, 2)]
    chain = [(k, k + 1) for k in range(7)]
    line = np.array([[1.5 * k, 0, 0] for k in range(8)])
    assert chemistry.prune_leaves(["C"] * 8, chain, line, line[-1:] + 0.5, ["C"]) == list(range(6))
    assert chemistry.prune_leaves(["C"] * 8, chain, line, line[-1:] + 0.5, ["H"]) == list(range(8))
    assert chemistry.relax_hydrogens(["C"] * 6, [0] * 6, [2] * 6, RING, [True] * 6) == [1] * 6
    assert chemistry.greedy_bonds([(0.9, 0, 1), (0.8, 0, 2), (0.4, 1, 2)], [1, 1, 1]) == [(0, 1)]
    assert chemistry.bond_distances(4, [(0, 1), (1, 2)])[0].tolist() == [0, 1, 2, 7]
    assert chemistry.formula(["O", "C", "C"]) == "C2O1"


# --- expressions


def test_scalars(spark):
    df = spark.createDataFrame([("1ABC_rec.pdb", "x/1abc_lig_7.gninatypes", "Kd<=3nM Ki=2.5uM", "C6 H12O6N", "a/b/c.pdb"), (None, None, None, None, None), ("abc", "", "IC50=-1nM", "", "c")], "a string, b string, c string, d string, e string")
    rows = df.select(scalars.pdb_id(F.col("a")), scalars.gninatypes_receptor(F.col("b")), scalars.pose_index(F.col("b")), scalars.affinity_pk(F.col("c")), scalars.heavy_atoms(F.col("d")), scalars.slug(F.lit("a b/c"))).collect()
    assert rows[0][:3] == ("1abc", "x/1abc_lig.pdb", 7) and rows[0][3] == pytest.approx(5.602, abs=1e-3) and rows[0][4:] == (13, "a-b-c")
    assert rows[2][0] is None and rows[2][3] is None
    code = spark.range(200).select(scalars.from_digits(scalars.digits(F.col("id"), 3, 4), 3) == F.col("id")).collect()
    assert all(r[0] for r in code)
    assert [scalars.cube_steps(b) for b in (0, 3, 9, 10)] == [1, 2, 8, 10]
    split = spark.range(4000).select(scalars.hash_split(0, F.col("id"), 0.1, 0.2).alias("s")).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 4000, 1) for r in split} == {"test": 0.1, "val": 0.2, "train": 0.7}


def test_sequences(spark):
    df = spark.createDataFrame([(1, [1, 2], [3]), (2, [], []), (3, None, [9, 9, 9])], "k int, p array<int>, l array<int>")
    built = df.select("k", sequences.build_sequence(F.col("p"), F.col("l")).alias("t")).orderBy("k")
    assert [r.t for r in built.collect()][:2] == [[1, 3, 8, 9, 4, 5, 10, 6, 2], [1, 3, 4, 5, 6, 2]]
    p, l = sequences.split_sequence(F.col("t"))  # noqa: E741
    assert [tuple(r) for r in built.select(p, l).collect()] == [([1, 2], [3]), ([], []), ([], [9, 9, 9])]
    inputs, labels = sequences.masked(F.col("t"), sequences.ligand_mask(F.col("t")), 0.5, 99, 50, 1, F.col("k"))
    for r in built.select("t", inputs.alias("i"), labels.alias("l")).collect():
        hidden = [k for k, v in enumerate(r.l) if v != -100]
        assert len(hidden) == {9: 1, 6: 0, 10: 2}.get(len(r.t), 2) or len(r.t) == 9
        assert all(r.l[k] == r.t[k] for k in hidden) and all(a == b for k, (a, b) in enumerate(zip(r.t, r.i, strict=True)) if k not in hidden)
    with pytest.raises(Exception, match="must have"):
        df.select(sequences.ranged_sequence([(F.col("l"), 10, 1)])).collect()
    ranged = df.where("k = 1").select(sequences.ranged_sequence([(F.col("p"), 10, None), (F.col("l"), 100, 1)]).alias("t"))
    assert [tuple(r) for r in ranged.select(*sequences.split_ranges(F.col("t"), [(10, 100, None), (100, 200, 1)])).collect()] == [([1, 2], [3])]


def test_own_columns_with_temporary_names(spark):
    from halyard.operators import relational, spatial

    plain = spark.createDataFrame([(k, float(k % 4), float(-k), f"g{k % 3}") for k in range(12)], "id int, a double, b double, g string")
    names = ("_n", "_part", "_total", "_y", "_u", "_g", "_before", "_up_to", "_least", "_inside", "_cx")
    clash = plain.withColumns({c: F.col("id") + k for k, c in enumerate(names)})
    for f in (lambda d: relational.global_ranks(d, "a"), lambda d: relational.pareto(d, ["a", "b"]), lambda d: relational.sized_split(d, "g", 0.4), lambda d: relational.counted_split(d, "g", 0.4)):
        want, got = f(plain), f(clash)
        assert set(got.columns) == {*want.columns, *names}
        assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
        assert all(r[c] == r.id + k for r in got.collect() for k, c in enumerate(names))
    at = clash.selectExpr("id", "a as x", "b as y", "a as z", "_cx")
    assert spatial.within(at, at.drop("_cx"), 1.5).where(f"_cx <> id + {names.index('_cx')}").count() == 0


def test_large_codebook(spark, monkeypatch):
    from halyard.operators import spatial

    df = spark.createDataFrame([([0.9, 0.0],)], "v array<double>")
    assert spatial.nearest_code(df, "v", np.eye(2)).first().code == 0
    monkeypatch.setattr(spatial, "CODEBOOK_BYTES", 31)
    with pytest.raises(ValueError, match="codebook"):
        spatial.nearest_code(df, "v", np.eye(2))


def test_affinities_are_read_by_the_rule(spark):
    cases = {
        "Kd=1nM": 9.0, "ki < 2.5E-1 uM": -math.log10(2.5e-7), "IC50~.5mM": -math.log10(5e-4), "Kd>3.pM": -math.log10(3e-12), "x Ki=1e3fM y": 12.0, "Kd=2M": -math.log10(2), "KD = 10 NM": 8.0,
        "Kd=1e--9nM": None, "Kd==1nM": None, "Kd=nM": None, "Kd=.nM": None, "Kd=1 kM": None, "EC50=1nM": None, "Kd=0nM": None, "Kd 1nM": None, "": None, None: None, "Kd=1nM Ki=1uM": 9.0,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", scalars.affinity_pk(F.col("c")).alias("pk"), scalars.found(F.col("c"), scalars.AFFINITY, 1).alias("kind")).collect()
    for r in rows:
        want = cases[r.c]
        assert (r.pk is None) == (want is None) and (want is None or abs(r.pk - want) < 1e-9), r
    assert {r.c: r.kind for r in rows}["Kd=1nM Ki=1uM"] == "Kd"
