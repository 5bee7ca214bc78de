"""Text of structure files to plain records. A molecule is {"atoms": [(element, x, y, z)], "bonds": [(i, j, order)]}, bonds from 0."""

from __future__ import annotations

import re

Molecule = dict[str, list]

# Bond types of MOL2 as orders (4: aromatic); atom types that are no atoms; residue letters.
MOL2_ORDERS = {"1": 1, "2": 2, "3": 3, "ar": 4, "am": 1}
MOL2_SKIPPED = {"Du", "LP"}
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def _counts(line: str) -> tuple[int, int] | None:
    for a, b in ((line[:3], line[3:6]), (line.split() + ["", ""])[:2]):
        try:
            return int(a), int(b)
        except ValueError:
            continue
    return None


def parse_sdf(text: str) -> list[Molecule]:
    """V2000 entries; one with a bad counts line is passed over, short atom and bond lines within one too."""
    out = []
    for entry in re.split(r"^\$\$\$\$.*$", text, flags=re.M):
        lines = entry.strip("\n").split("\n") if entry.strip() else []
        lead = entry[: len(entry) - len(entry.lstrip("\n"))].count("\n")
        lines = [""] * max(0, lead - (1 if out or lead and text[:1] != "\n" else 0)) + lines if lead else lines
        counts = next((k for k, x in enumerate(lines[:6]) if x.rstrip().endswith("V2000")), 3 if len(lines) > 3 else None)
        found = _counts(lines[counts]) if counts is not None else None
        if found is None:
            continue
        n_atoms, n_bonds = found
        atoms, bonds = [], []
        for line in lines[counts + 1 : counts + 1 + n_atoms]:
            f = line.split()
            try:
                atoms.append((f[3], float(f[0]), float(f[1]), float(f[2])))
            except (IndexError, ValueError):
                continue
        for line in lines[counts + 1 + n_atoms : counts + 1 + n_atoms + n_bonds]:
            try:
                bonds.append((int(line[:3]) - 1, int(line[3:6]) - 1, int(line[6:9])))
            except ValueError:
                continue
        out.append({"atoms": atoms, "bonds": bonds})
    return out


def write_sdf(molecule: Molecule, title: str = "") -> str:
    """One V2000 entry."""
    lines = [title, "", "", f"{len(molecule['atoms']):3d}{len(molecule['bonds']):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"{x:10.4f}{y:10.4f}{z:10.4f} {e:<3} 0  0  0  0  0  0  0  0  0  0  0  0" for e, x, y, z in molecule["atoms"]]
    lines += [f"{i + 1:3d}{j + 1:3d}{o:3d}  0" for i, j, o in molecule["bonds"]]
    return "\n".join([*lines, "M  END", "$$$$", ""])


def parse_mol2(text: str) -> list[tuple[str, Molecule]]:
    """(name, molecule) of each MOLECULE section."""
    out = []
    for block in text.split("@<TRIPOS>MOLECULE")[1:]:
        sections = {s.split("\n", 1)[0].strip(): s.split("\n", 1)[1] if "\n" in s else "" for s in ("MOLECULE" + block).split("@<TRIPOS>")}
        atoms, bonds, place = [], [], {}
        for f in map(str.split, sections.get("ATOM", "").splitlines()):
            if len(f) >= 6 and f[5].split(".")[0] not in MOL2_SKIPPED:
                place[f[0]] = len(atoms)
                atoms.append((f[5].split(".")[0], float(f[2]), float(f[3]), float(f[4])))
        for f in map(str.split, sections.get("BOND", "").splitlines()):
            if len(f) >= 4 and f[1] in place and f[2] in place:
                bonds.append((place[f[1]], place[f[2]], MOL2_ORDERS.get(f[3], 1)))
        out.append((block.strip("\n").split("\n", 1)[0].strip(), {"atoms": atoms, "bonds": bonds}))
    return out


def parse_pdb(text: str, heavy: bool = True) -> list[dict]:
    """Atoms of ATOM and HETATM lines; without hydrogens if heavy; lines with bad coordinates are passed over."""
    out = []
    for line in text.splitlines():
        if not line.startswith(("ATOM", "HETATM")):
            continue
        name = line[12:16].strip()
        element = (line[76:78].strip() or name.lstrip("0123456789")[:1]).capitalize()
        try:
            x, y, z = (float(line[k : k + 8]) for k in (30, 38, 46))
        except ValueError:
            continue
        if not (heavy and element in ("H", "D")):
            number = line[22:26].strip()
            out.append({"het": line.startswith("HETATM"), "name": name, "resname": line[17:20].strip(), "chain": line[21:22].strip(), "resseq": int(number) if number.lstrip("-").isdigit() else None, "element": element, "x": x, "y": y, "z": z})
    return out


def pocket_residues(atoms: list[dict]) -> list[dict]:
    """Standard residues that have a CA, in file order, with their atoms."""
    out: dict[tuple, dict] = {}
    for a in atoms:
        if not a["het"] and a["resname"] in RESIDUES:
            own = out.setdefault((a["chain"], a["resseq"]), {"chain": a["chain"], "resseq": a["resseq"], "resname": a["resname"], "ca": None, "atoms": []})
            own["atoms"].append((a["name"], a["element"], a["x"], a["y"], a["z"]))
            if a["name"] == "CA":
                own["ca"] = (a["x"], a["y"], a["z"])
    return [r for r in out.values() if r["ca"] is not None]


def backbone(atoms: list[dict]) -> list[dict]:
    """N, CA and C of each residue that has a CA; the CA stands in for what is missing."""
    out = []
    for r in pocket_residues(atoms):
        by = {n: (x, y, z) for n, _, x, y, z in r["atoms"]}
        out.append({"chain": r["chain"], "resseq": r["resseq"], "resname": r["resname"], **{n.lower(): by.get(n, r["ca"]) for n in ("N", "CA", "C")}})
    return out


def write_pdb(atoms: list[dict], bonds: list[tuple[int, int]] = ()) -> str:
    """Fixed-column lines, with CONECT records for bonds."""
    lines = []
    for k, a in enumerate(atoms, 1):
        name = f" {a['name']:<3}" if len(a["name"]) < 4 else a["name"][:4]
        lines.append(f"{'HETATM' if a['het'] else 'ATOM':<6}{k:5d} {name} {a['resname']:>3} {a['chain'] or ' ':1}{a['resseq'] or 0:4d}    {a['x']:8.3f}{a['y']:8.3f}{a['z']:8.3f}{1.0:6.2f}{0.0:6.2f}          {a['element']:>2}")
    lines += [f"CONECT{i + 1:5d}{j + 1:5d}" for i, j in bonds]
    return "\n".join([*lines, "END", ""])


def write_xyz(elements: list[str], x: list, comment: str = "") -> str:
    return "\n".join([str(len(elements)), comment, *(f"{e} {a:.6f} {b:.6f} {c:.6f}" for e, (a, b, c) in zip(elements, x, strict=True)), ""])


def parse_pdbqt(text: str) -> list[list[tuple[str, float, float, float]]]:
    """Heavy atoms of each model; a file without MODEL lines is one."""
    out, now = [], []
    for line in text.splitlines():
        if line.startswith("MODEL"):
            now = []
        elif line.startswith("ENDMDL"):
            out.append(now)
            now = []
        elif line.startswith(("ATOM", "HETATM")):
            kind = (line.split() or [""])[-1]
            if not kind.startswith("H"):
                now.append((kind, *(float(line[k : k + 8]) for k in (30, 38, 46))))
    return [*out, now] if now else out


def best_score(text: str) -> float | None:
    """Least score of a docking result's remarks; exact zeros are failures."""
    scores = [float(s) for s in re.findall(r"REMARK VINA RESULT:\s*(-?[0-9.]+)", text)]
    return min((s for s in scores if s), default=None)


def pocket(residues: list[dict], ligand: list[tuple[float, float, float]], cutoff: float = 8.0, most: int = 128, metric: str = "heavy", order: str = "chain") -> list[dict] | None:
    """The most nearest residues within the cutoff of any ligand atom, by CA or by heavy atoms, in chain order or farthest first; None
    where there are none."""
    if metric not in ("ca", "heavy"):
        raise ValueError(f"no metric {metric}")
    near = []
    for k, r in enumerate(residues):
        own = [r["ca"]] if metric == "ca" else [a[2:] for a in r["atoms"]]
        d = min((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) for a in own for b in ligand), default=float("inf")) ** 0.5
        if d <= cutoff:
            near.append((d, k))
    chosen = sorted(near)[:most]
    chosen = sorted(chosen, key=lambda t: (residues[t[1]]["chain"], residues[t[1]]["resseq"])) if order == "chain" else chosen[::-1]
    return [residues[k] for _, k in chosen] or None
