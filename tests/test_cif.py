"""mmCIF against the PDB form of the same structure."""

import gzip
import random

import pytest
from halyard.sources import cif, tables

TEXT = """data_1ABC
# a comment
_entry.id 1ABC
_struct.title
;A title of
two lines; with a semicolon
;
_cell.length_a   10.5
loop_
_citation.id
_citation.title
1 'it''s quoted' # no escape, the quote ends before a space
2 "a 'b' c"
3 d'Arc
4 ?
5 '?'
6
;
;
_atom_sites.x .
"""


def test_tokens_and_rows():
    assert list(cif.rows(TEXT.splitlines(True), "_citation")) == [
        {"id": "1", "title": "it''s quoted"}, {"id": "2", "title": "a 'b' c"}, {"id": "3", "title": "d'Arc"}, {"id": "4", "title": None}, {"id": "5", "title": "?"}, {"id": "6", "title": ""},
    ]
    assert list(cif.rows(TEXT.splitlines(True), "_struct")) == [{"title": "A title of\ntwo lines; with a semicolon"}]
    assert list(cif.rows(TEXT.splitlines(True), "_entry.")) == [{"id": "1ABC"}] and list(cif.rows(TEXT.splitlines(True), "_atom_sites")) == [{"x": None}]
    assert list(cif.rows(iter(()), "_x")) == [] and list(cif.rows(["data_a\n", "_x.a 1\n", "data_b\n", "_x.a 2\n"], "_x")) == [{"a": "1"}, {"a": "2"}]


@pytest.mark.parametrize(
    ("text", "match"),
    [("loop_\n_a.x\n_a.y\n1 2\n3\n", "within a row"), ("loop_\n_a.x\n_a.y\n1 2 3\n_b.z 1\n", "within a row"), ("_a.x\n_a.y 2\n", "no value"), ("_a.x", "no value"), ("_a.x 'open\n", "quote"), ("_a.x\n;open\n", "text field"), ("loop_\n1 2\n", "without names")],
)
def test_broken_files_are_errors(text, match):
    with pytest.raises(ValueError, match=match):
        list(cif.rows(text.splitlines(True), "_a"))


def structure(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append((rng.random() < 0.3, rng.choice(["CA", "N", "O5'", "HB1", "C\"1"][: 4 if k % 2 else 5]), rng.choice(["ALA", "LIG"]), rng.choice("AB"), k // 3 + 1, rng.choice(["C", "N", "O", "H", "CL"]), *(round(rng.uniform(-99, 99), 3) for _ in range(3))))
    return out


def test_atoms_are_the_pdbs(spark, tmp_path):
    (tmp_path / "cif").mkdir()
    (tmp_path / "pdb").mkdir()
    for s in range(4):
        atoms = structure(s, 30 * s)
        lines = [f"{'HETATM' if het else 'ATOM  '}{k + 1:>5} {name:<4} {res:>3} {chain}{seq:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{0:6.2f}          {element:>2}" for k, (het, name, res, chain, seq, element, x, y, z) in enumerate(atoms)]
        (tmp_path / "pdb" / f"{s}.pdb").write_text("\n".join(lines) + "\nEND\n")
        rows = [{"group_PDB": "HETATM" if het else "ATOM", "id": k, "type_symbol": element, "label_atom_id": "X", "auth_atom_id": name, "label_comp_id": res, "auth_asym_id": chain, "auth_seq_id": seq, "label_seq_id": None, "Cartn_x": x, "Cartn_y": y, "Cartn_z": z, "note": None if k % 2 else "two\nlines", "pdbx_PDB_model_num": 1} for k, (het, name, res, chain, seq, element, x, y, z) in enumerate(atoms)]
        more = [{**r, "pdbx_PDB_model_num": 2} for r in rows[:5]]
        data = cif.write_cif(rows + more, str(s)).encode()
        (tmp_path / "cif" / (f"{s}.cif.gz" if s % 2 else f"{s}.cif")).write_bytes(gzip.compress(data) if s % 2 else data)
    columns = ["het", "name", "resname", "chain", "resseq", "element", "x", "y", "z"]
    read = lambda df: sorted(((r.file.split(".")[0], r.ord), tuple(r[c] for c in columns)) for r in df.select("file", "ord", *columns).collect())
    got, want = read(cif.read_atoms(spark, str(tmp_path / "cif"))), read(tables.read_pdb_atoms(spark, str(tmp_path / "pdb")))
    assert [g[1] for g in got] == [w[1] for w in want] and len(got) > 100
    (tmp_path / "cif" / "bad.cif").write_text("loop_\n_atom_site.id\n_atom_site.x\n1\n")
    with pytest.raises(Exception, match="bad.cif.*within a row"):
        cif.read_atoms(spark, str(tmp_path / "cif")).count()
