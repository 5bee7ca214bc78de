"""Turns about bonds, fits, projections and distances."""

import random

import numpy as np
import pytest
from halyard.functions import chemistry, flexible, geometry


def random_bonds(rng, n):
    tree = {(rng.randrange(v), v) for v in range(1, n) if rng.random() < 0.9}
    return sorted(tree | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(3))}) if n > 1 else []


def test_turning_sides_are_the_bridges_parts():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(0, 14)
        bonds = [b if rng.random() < 0.5 else b[::-1] for b in random_bonds(rng, n)]
        got = {frozenset(b): (b, side) for b, side in flexible.turning_sides(n, bonds)}
        want = {frozenset(b): (b, side) for b, side in chemistry.rotatable(n, bonds)}
        assert got.keys() == want.keys()
        for key, ((i, j), side) in got.items():
            label = chemistry.component_of(n, [b for b in bonds if frozenset(b) != key])
            assert side == [v for v in range(n) if label[v] == label[j] and v != j]
            assert len(side) == len(want[key][1])


def chain(n, seed):
    """A zigzag with a branch, in three dimensions."""
    rng = np.random.default_rng(seed)
    x = np.array([[1.25 * k, 0.6 * (k % 2), 0.3 * (k % 3)] for k in range(n)]) + rng.normal(scale=0.05, size=(n, 3))
    return x, [(k, k + 1) for k in range(n - 1)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_torsion_fit(seed):
    rng = np.random.default_rng(seed)
    x, bonds = chain(7, seed)
    elements, wall = list("CCNCOCC"), x[[1, 3, 5]] + rng.normal(scale=0.8, size=(3, 3)) + 0.8
    radii, theirs = chemistry.radii(elements), chemistry.radii(list("CNO"))
    new = flexible.torsion_fit(x, elements, bonds, wall, radii, theirs, restarts=1, seed=seed)
    before, after = (geometry.overlap(p, wall, radii, theirs) for p in (x, new))
    rigid = geometry.overlap(geometry.rigid_fit(x, wall, radii, theirs, restarts=1, seed=seed), wall, radii, theirs)
    assert after <= before and before > 0 and after <= rigid + 1e-6
    for i, j in flexible.bonded_pairs(7, bonds):
        assert np.linalg.norm(new[i] - new[j]) == pytest.approx(np.linalg.norm(x[i] - x[j]))
    again = flexible.torsion_fit(x, elements, bonds, wall, radii, theirs, restarts=1, seed=seed)
    assert np.array_equal(new, again)
    assert np.array_equal(flexible.torsion_fit(x, elements, bonds, [], radii, []), x)


def test_displacements_split_at_right_angles():
    rng = np.random.default_rng(5)
    x, bonds = chain(9, 4)
    after = x + rng.normal(scale=0.3, size=x.shape)
    along, rest = flexible.split_displacement(x, after, bonds)
    basis = flexible.directions(x, bonds)
    assert basis.shape[1] == 6 + 6 and np.abs(basis.T @ rest.ravel()).max() < 1e-9 and np.allclose(along + rest, after - x)
    # a small turn about each bond and a small motion are followed wholly, to first order
    for column in basis.T:
        along, rest = flexible.split_displacement(x, x + 1e-3 * column.reshape(-1, 3), bonds)
        assert np.abs(rest).max() < 1e-12
    assert flexible.split_displacement([], [], [])[0].shape == (0, 3)


def test_followed_turns_keep_bonds():
    rng = np.random.default_rng(6)
    x, bonds = chain(8, 2)
    turns = flexible.turning_sides(8, bonds)
    after = geometry.apply_torsions(x, [t[0] for t in turns], [np.array(t[1]) for t in turns], rng.uniform(-1, 1, len(turns)))
    after = after @ geometry.random_rotation(rng).T + 4
    assert np.abs(flexible.followed(x, after, bonds) - after).max() < 1e-6
    noisy = flexible.followed(x, after + rng.normal(scale=0.2, size=x.shape), bonds)
    for i, j in flexible.bonded_pairs(8, bonds):
        assert np.linalg.norm(noisy[i] - noisy[j]) == pytest.approx(np.linalg.norm(x[i] - x[j]))


def test_distances_are_set():
    rng = np.random.default_rng(7)
    xs, refs, pairs = [], [], []
    for n in (1, 2, 6, 12, 0):
        x, bonds = chain(n, n) if n else (np.empty((0, 3)), [])
        bonds = [*bonds, (0, 5)] if n == 6 else bonds
        refs.append(x)
        xs.append(x + rng.normal(scale=0.15, size=x.shape))
        pairs.append(flexible.bonded_pairs(n, bonds))
    got = flexible.set_distances(xs, refs, pairs)
    for (new, ok, took), x, ref, p in zip(got, xs, refs, pairs, strict=True):
        assert ok and new.shape == ref.shape and np.abs(new - x).max(initial=0) < 1.0
        for i, j in p:
            assert abs(np.linalg.norm(new[i] - new[j]) - np.linalg.norm(ref[i] - ref[j])) <= 1e-3
    alone = flexible.set_distances(xs[3:4], refs[3:4], pairs[3:4])[0]
    assert np.allclose(alone[0], got[3][0]) and alone[2] == got[3][2]
    # two atoms on one place are pulled apart; too few rounds are told
    assert flexible.set_distances([[[0, 0, 0], [0, 0, 0]]], [[[0, 0, 0], [1, 0, 0]]], [[(0, 1)]])[0][1]
    assert not flexible.set_distances(xs[3:4], refs[3:4], pairs[3:4], rounds=1)[0][1]
