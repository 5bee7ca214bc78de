"""Molecules that turn about their bonds: which atoms follow a bond, fits into a pocket by turns, displacements split into what a pose can
follow and the rest, and distances set right for many molecules at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from halyard.functions import chemistry, geometry

Bonds = list[tuple[int, int]]
#: Pairs nearer than this along bonds keep their distance whatever turns.
FAR = 4


def turning_sides(n: int, bonds: Bonds) -> list[tuple[tuple[int, int], list[int]]]:
    """Bridges with a further neighbour at both ends, each with the atoms beyond its second atom, which is on the smaller side; smallest
    sides first. One walk numbers the atoms so that what hangs on a bond of the walk is an interval of numbers; a bond that no other way
    round leads past is a bridge."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (i, j) in enumerate(bonds):
        near[i].append((j, k))
        near[j].append((i, k))
    number, last, low, up, order = [-1] * n, [0] * n, [0] * n, [(-1, -1)] * n, []
    size = [0] * n
    for root in range(n):
        if number[root] >= 0:
            continue
        begin = len(order)
        number[root] = low[root] = len(order)
        order.append(root)
        stack = [(root, iter(near[root]))]
        while stack:
            v, rest = stack[-1]
            for w, k in rest:
                if number[w] < 0:
                    up[w] = (v, k)
                    number[w] = low[w] = len(order)
                    order.append(w)
                    stack.append((w, iter(near[w])))
                    break
                if k != up[v][1]:
                    low[v] = min(low[v], number[w])
            else:
                stack.pop()
                last[v] = len(order)
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[v])
        for v in order[begin:]:
            size[v] = len(order) - begin
    out = []
    for w in order:
        v, k = up[w]
        if k < 0 or low[w] <= number[v] or len(near[v]) < 2 or len(near[w]) < 2:
            continue
        a, b = number[w], last[w]
        beyond, begin = order[a:b], number[v]
        while up[order[begin]][1] >= 0:
            begin = number[up[order[begin]][0]]
        others = order[begin:a] + order[b : begin + size[w]]
        i, j = bonds[k]
        down = beyond if j == w else others  # what is on j's side
        if 2 * len(down) > size[w]:
            i, j, down = j, i, others if down is beyond else beyond
        out.append(((i, j), sorted(x for x in down if x != j)))
    return sorted(out, key=lambda t: (len(t[1]), t[0]))


def far_pairs(n: int, bonds: Bonds) -> np.ndarray:
    """Pairs i < j that are FAR bonds or more apart, or not joined at all."""
    steps = np.full((n, n), FAR)
    near = chemistry.neighbours(n, bonds)
    for v in range(n):
        edge, seen = {v}, {v}
        for d in range(FAR):
            steps[v, list(edge)] = d
            edge = {w for x in edge for w in near[x]} - seen
            seen |= edge
            if not edge:
                break
    i, j = np.nonzero(np.triu(steps >= FAR, 1))
    return np.stack([i, j], 1)


def least(cost: Callable[[np.ndarray], float], start: np.ndarray, bound: np.ndarray, restarts: int, rng: np.random.Generator) -> np.ndarray:
    """Within the bounds the cheapest place that a coordinate search finds from start and from random places; start unless another is
    cheaper. Each coordinate takes its step where that is cheaper; steps halve when a round over them gains less than a hundredth."""
    best, value = start, cost(start)
    for k in range(restarts):
        v = start if not k else rng.uniform(-bound, bound)
        now, step = value if not k else cost(v), bound / 2
        while (step / bound).max() > 2e-3:
            before = now
            for i in range(len(v)):
                for s in (step[i], -step[i]):
                    t = v.copy()
                    t[i] = np.clip(t[i] + s, -bound[i], bound[i])
                    if (c := cost(t)) < now - 1e-12:
                        v, now = t, c
                        break
            if not before - now > 0.01 * abs(now) + 1e-9:
                step = step / 2
        if now < value - 1e-12:
            best, value = v, now
    return best


def torsion_fit(x, elements: list[str], bonds: Bonds, pocket, radii_x, radii_pocket, max_shift: float = 2.5, max_angle: float = 30.0, restarts: int = 2, seed: int = 0) -> np.ndarray:
    """x moved as a whole and turned about its rotatable bonds, in two stages: first to the least overlap with the pocket and with itself
    (pairs FAR bonds apart), then to the deepest wells of both that are to be had at no more overlap than that; of the found motion the
    smallest of 21 scalings that is as good. The pocket's overlap never rises; bonds and angles stay."""
    x, wall = geometry.points(x), geometry.points(pocket)
    if not len(x) or not len(wall):
        return x
    heavy = np.array([e.upper() != "H" for e in elements])
    turns = turning_sides(len(x), bonds)
    pairs, sides = [t[0] for t in turns], [np.array(t[1], int) for t in turns]
    radii = np.asarray(radii_x, float)
    far = far_pairs(len(x), bonds)
    reach = radii[far].sum(1)

    def placed(v: np.ndarray) -> np.ndarray:
        return geometry.move(geometry.apply_torsions(x, pairs, sides, list(v[6:])) if pairs else x, geometry.axis_rotation(v[3:6], float(np.linalg.norm(v[3:6]))), v[:3])

    def own(y: np.ndarray) -> float:
        six = (reach / np.maximum(np.sqrt(((y[far[:, 0]] - y[far[:, 1]]) ** 2).sum(1)), 0.4)) ** 6
        return float((six * six - 2 * six).sum())

    def wide(y: np.ndarray) -> float:
        return geometry.overlap(y[heavy], wall, radii[heavy], radii_pocket)

    start = np.zeros(6 + len(pairs))
    bound = np.array([max_shift] * 3 + [np.radians(max_angle)] * 3 + [np.pi] * len(pairs))
    first = wide(x)

    def relieved(v: np.ndarray, most: float) -> float:
        y = placed(v)
        return np.inf if (w := wide(y)) > most else w + max(own(y), 0.0)

    rng = np.random.default_rng(seed)
    eased = least(lambda v: relieved(v, first), start, bound, restarts, rng)
    most, total = wide(placed(eased)), relieved(eased, first)

    def deep(v: np.ndarray) -> float:
        if relieved(v, most + 1e-12) > total + 1e-9:
            return np.inf
        y = placed(v)
        return geometry.lennard_jones(y[heavy], wall, radii[heavy], radii_pocket) + own(y)

    found = least(deep, eased, bound, restarts, rng)
    value = deep(found)
    for s in np.linspace(0, 1, 21):
        if deep(found * s) <= value + 1e-12:
            return placed(found * s)
    return placed(found)


def directions(x, bonds: Bonds) -> np.ndarray:
    """What a pose can do at once, as columns of 3 n numbers: three shifts, three turns about the centre, and a turn of the smaller side
    about each rotatable bond."""
    x = geometry.points(x)
    out = [np.tile(np.eye(3)[k], (len(x), 1)) for k in range(3)]
    out += [np.cross(np.eye(3)[k], x - x.mean(0)) for k in range(3)]
    for (i, j), side in turning_sides(len(x), bonds):
        turn = np.zeros_like(x)
        turn[side] = np.cross(x[j] - x[i], x[side] - x[j])
        out.append(turn)
    return np.stack([d.ravel() for d in out], 1)


def split_displacement(before, after, bonds: Bonds) -> tuple[np.ndarray, np.ndarray]:
    """The displacement's part along directions(before), by least squares, and the rest, which is at right angles to each of them."""
    before, after = geometry.points(before), geometry.points(after)
    if not len(before):
        return before, before
    basis, d = directions(before, bonds), (after - before).ravel()
    along = basis @ np.linalg.lstsq(basis, d, rcond=None)[0]
    return along.reshape(-1, 3), (d - along).reshape(-1, 3)


def followed(before, after, bonds: Bonds) -> np.ndarray:
    """before with the turns that its rotatable bonds' dihedrals made on the way to after, then moved onto after as a whole: bonds and
    angles stay before's."""
    before, after = geometry.points(before), geometry.points(after)
    if len(before) != len(after):
        return after
    turns = turning_sides(len(before), bonds)
    near = chemistry.neighbours(len(before), bonds)
    x = before
    for (i, j), side in turns:
        ends = (min(v for v in near[i] if v != j), i, j, min(v for v in near[j] if v != i))
        angle = geometry.wrap(geometry.dihedral(*after[list(ends)]) - geometry.dihedral(*before[list(ends)]))
        x = geometry.apply_torsions(x, [(i, j)], [np.array(side, int)], [angle])
    return geometry.superpose(x, after) if len(x) else x


def bonded_pairs(n: int, bonds: Bonds) -> Bonds:
    """Pairs one or two bonds apart."""
    near = chemistry.neighbours(n, bonds)
    return sorted({(min(i, j), max(i, j)) for i, j in bonds} | {(a, b) for v in range(n) for a in near[v] for b in near[v] if a < b})


def set_distances(xs: list, refs: list, pairs: list[Bonds], tolerance: float = 1e-3, rounds: int = 60) -> list[tuple[np.ndarray, bool, int]]:
    """For each molecule its places moved until its pairs have their reference distances to within tolerance, whether that was reached, and
    the rounds it took. In a round each molecule takes the shortest move that sets all its distances right to first order, no atom more
    than half a unit; all molecules of the list are solved together, and those that are done rest."""
    n, most = max([len(geometry.points(x)) for x in xs], default=0), max(map(len, pairs), default=0)
    x, r = np.zeros((len(xs), n, 3)), np.zeros((len(xs), n, 3))
    i, j, real = np.zeros((len(xs), most), int), np.zeros((len(xs), most), int), np.zeros((len(xs), most), bool)
    for b, (own, ref, p) in enumerate(zip(xs, refs, pairs, strict=True)):
        x[b, : len(geometry.points(own))], r[b, : len(geometry.points(ref))] = geometry.points(own), geometry.points(ref)
        if p:
            i[b, : len(p)], j[b, : len(p)], real[b, : len(p)] = *np.array(p).T, True
    molecule = np.arange(len(xs))[:, None]
    want = np.sqrt(((r[molecule, i] - r[molecule, j]) ** 2).sum(2))
    took, done = np.full(len(xs), rounds), np.zeros(len(xs), bool)
    for k in range(rounds + 1):
        gap = x[molecule, i] - x[molecule, j]
        d = np.sqrt((gap * gap).sum(2))
        off = np.where(real, want - d, 0.0)
        new = (np.abs(off).max(1, initial=0) <= tolerance) & ~done
        took[new], done = k, done | new
        live = np.flatnonzero(~done)
        if k == rounds or not len(live):
            break
        side = np.where((d > 1e-9)[:, :, None], gap / np.maximum(d, 1e-9)[:, :, None], np.array([1.0, 0.0, 0.0]))[live] * real[live][:, :, None]
        row, pair = np.arange(len(live))[:, None], np.arange(most)
        pull = np.zeros((len(live), most, n, 3))
        pull[row, pair, i[live]] += side
        pull[row, pair, j[live]] -= side
        pull = pull.reshape(len(live), most, 3 * n)
        held = np.linalg.solve(pull @ pull.transpose(0, 2, 1) + 1e-6 * np.eye(most), off[live][:, :, None])
        move = (pull.transpose(0, 2, 1) @ held).reshape(len(live), n, 3)
        far = np.sqrt((move * move).sum(2)).max(1)
        x[live] += move * np.minimum(1, 0.5 / np.maximum(far, 1e-9))[:, None, None]
    return [(x[b, : len(geometry.points(own))], bool(done[b]), int(took[b])) for b, own in enumerate(xs)]


def turned_by(x, bonds: Bonds, rng: np.random.Generator, most: float) -> np.ndarray:
    """Every rotatable bond turned by up to most, either way."""
    turns = turning_sides(len(geometry.points(x)), bonds)
    return geometry.apply_torsions(x, [t[0] for t in turns], [np.array(t[1], int) for t in turns], list(rng.uniform(-most, most, len(turns))))


def turned_near(x, bonds: Bonds, rng: np.random.Generator, target: float) -> np.ndarray | None:
    """Random turns of all rotatable bonds, scaled so that the places differ by an RMSD of about target; None if no turns lead there."""
    x = geometry.points(x)
    turns = turning_sides(len(x), bonds)
    if not turns:
        return None
    pairs, sides, angles = [t[0] for t in turns], [np.array(t[1], int) for t in turns], rng.normal(size=len(turns))
    off = lambda s: geometry.rmsd(geometry.apply_torsions(x, pairs, sides, list(s * angles)), x)
    low, high = 0.0, 0.02
    while off(high) < target:
        low, high = high, high * 1.5
        if high * np.abs(angles).max() > np.pi:
            return None
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if off(middle) < target else (low, middle)
    return geometry.apply_torsions(x, pairs, sides, list(high * angles))
