"""Scalar column expressions: identifiers, affinities, hashes, numbers. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Molar size of each affinity unit.
MOLAR = {"mm": 1e-3, "um": 1e-6, "nm": 1e-9, "pm": 1e-12, "fm": 1e-15, "m": 1.0}
# Measures of affinity.
MEASURES = ("Kd", "Ki", "IC50")
# Of an affinity: the measure, a relation, the number (with an exponent or without) and its molar unit, in either case; spaces may
# stand around the number.
DECIMAL = r"(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?"
AFFINITY = rf"(?i)(?<measure>{'|'.join(MEASURES)})\s*[<=>~]\s*(?<number>{DECIMAL})\s*(?<unit>{'|'.join(MOLAR)})"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def pdb_id(receptor: Column) -> Column:
    """Four characters before the first underscore, in lower case."""
    return F.lower(found(receptor, "^([0-9a-zA-Z]{4})_"))


def system_pdb(system: Column) -> Column:
    """What stands before the first double underscore, in lower case."""
    return F.lower(F.substring_index(system, "__", 1))


def bucket_code(pdb: Column) -> Column:
    """The two middle characters that name an archive."""
    return F.substring(pdb, 2, 2)


def gninatypes_receptor(path: Column) -> Column:
    return F.regexp_replace(path, r"_\d+\.gninatypes$", ".pdb")


def gninatypes_ligand(path: Column) -> Column:
    return F.regexp_replace(path, r"_\d+\.gninatypes$", ".sdf.gz")


def pose_index(path: Column) -> Column:
    return F.coalesce(found(path, r"_(\d+)\.gninatypes$").try_cast("int"), F.lit(0))


def source_type(name: Column) -> Column:
    """Of a types file's name: what stands before the first train, test or fold mark; other where nothing does."""
    return F.coalesce(found(name, r"^([A-Za-z0-9]+?)_?(?:train|test|fold|_|\.|$)"), F.lit("other"))


def fold_of(name: Column) -> Column:
    return found(name, r"(?:train|test)(\d+)").try_cast("int")


def split_of(name: Column) -> Column:
    return F.when(name.contains("train"), "train").when(name.contains("test"), "test")


def affinity_pk(text: Column) -> Column:
    """-log10 of the molar affinity written in text; null where none is or it isn't over 0."""
    value = found(text, AFFINITY, 2).try_cast("double")
    unit = F.lower(found(text, AFFINITY, 3))
    size = F.element_at(F.create_map(*(F.lit(x) for kv in MOLAR.items() for x in kv)), unit)
    return F.when(value > 0, -F.log10(value * size))


def micromolar_log_pk(value: Column) -> Column:
    """pK of a log10 in micromolar."""
    return 6 - value


def struct_id(path: Column) -> Column:
    """Folder and stem."""
    return F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def ligand_member(pair_idx: Column) -> Column:
    return F.format_string("%07d.sdf.gz", pair_idx)


def shard_name(shard: Column) -> Column:
    return F.format_string("%06d.tar", shard)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")


def named_seed(seed: int, name: Column) -> Column:
    """First four bytes of sha256 of seed:name, big-endian."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """In [0, 1), the same for a key wherever it is computed."""
    return named_seed(seed, key.cast("string")) / F.lit(float(1 << 32))


def hash_split(seed: int, key: Column, test: float, val: float) -> Column:
    """test, val or train by the key's hash, so a key never changes sides when the table grows."""
    u = uniform(seed, key)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def crc_seed(key: Column) -> Column:
    return F.crc32(key.cast("binary")) % (1 << 31)


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("¦", *parts).cast("binary"), 256)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ring_bucket(size: Column) -> Column:
    """0 none, 1 three or four, 2 five, 3 six, 4 larger."""
    return F.when(size < 3, 0).when(size < 5, 1).when(size == 5, 2).when(size == 6, 3).otherwise(4)


def index_or(value: Column, names: list[str], other: int) -> Column:
    """Place of value among names, else other."""
    at = F.array_position(F.array(*(F.lit(n) for n in names)), value) - 1
    return F.when(at >= 0, at).otherwise(F.lit(other)).cast("int")


def digits(code: Column, bits: int, count: int) -> Column:
    """The code's count digits in base 2 ** bits, most significant first."""
    return F.transform(F.sequence(F.lit(count - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftrightunsigned", code, k * bits).bitwiseAND(F.lit((1 << bits) - 1)))


def from_digits(parts: Column, bits: int) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, d: a * (1 << bits) + d)


def grid_cell(x: Column, origin: Column, cell: Column, count: int) -> Column:
    """Whole cells from the origin, within [0, count)."""
    return clamp(F.floor((x - origin) / cell), 0, count - 1).cast("long")


def cube_steps(bits: int) -> int:
    """The largest s with s**3 <= 2**bits."""
    s = round((1 << bits) ** (1 / 3))
    while s**3 > 1 << bits:
        s -= 1
    while (s + 1) ** 3 <= 1 << bits:
        s += 1
    return s


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def number(c: Column) -> Column:
    """c with NaN as null: what every source is passed through."""
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def mean_std(mean: Column, std: Column) -> Column:
    """Text with two digits; a dash where there is no mean."""
    return F.when(mean.isNull(), F.lit("—")).otherwise(F.format_string("%.2f ± %.2f", mean, F.coalesce(std, F.lit(0.0))))


def heavy_atoms(formula: Column) -> Column:
    """Atoms of a formula but for hydrogen: symbols with optional counts."""
    symbols = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)\s*(\d*)"), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)\s*(\d*)"), F.lit(2))
    each = F.zip_with(symbols, counts, lambda s, n: F.when(s == "H", 0).otherwise(F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1))))
    return F.aggregate(each, F.lit(0), lambda a, n: a + n)


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    """Of two arrays as sets; empty: the value where both are empty (callers differ: null, 0 or 1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def spherical(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """r, theta, sin_phi, cos_phi; all but at the origin, which is (0, 0, 0, 1)."""
    r = F.sqrt(x * x + y * y + z * z)
    near = r < 1e-8
    phi = F.atan2(y, x)
    theta = F.acos(clamp(z / F.nullif(r, F.lit(0.0)), -1.0, 1.0))
    return {"r": F.when(near, 0.0).otherwise(r), "theta": F.when(near, 0.0).otherwise(theta), "sin_phi": F.when(near, 0.0).otherwise(F.sin(phi)), "cos_phi": F.when(near, 1.0).otherwise(F.cos(phi))}


def cartesian(r: Column, theta: Column, sin_phi: Column, cos_phi: Column) -> tuple[Column, Column, Column]:
    return r * F.sin(theta) * cos_phi, r * F.sin(theta) * sin_phi, r * F.cos(theta)
