"""mmCIF: a stream of tokens (plain, quoted, multi-line and commented), its loops a row at a time, and the data source "cif", which gives the
rows of one category of every file. A file is read once, in pieces; what is held is one row."""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from halyard import storage
from halyard.names import free
from halyard.sources import archives

#: A token that stands for itself, and one in quotes, whose end is a quote before white space.
_PLAIN = re.compile(r"[^\s]+")
_QUOTED = {q: re.compile(rf"{q}(.*?){q}(?=\s|$)") for q in "'\""}
SUFFIXES = (".cif", ".cif.gz", ".mmcif", ".mmcif.gz")

Token = tuple[str, bool]


def tokens(lines: Iterator[str]) -> Iterator[Token]:
    """(text, whether it is a bare word) of each token. A quote that isn't closed on its line and a text field that isn't closed at all are
    a ValueError."""
    lines = iter(lines)
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(";"):
            field = [line[1:]]
            for more in lines:
                more = more.rstrip("\r\n")
                if more.startswith(";"):
                    break
                field.append(more)
            else:
                raise ValueError("a text field isn't closed")
            yield "\n".join(field), False
            line = more[1:]
        at = 0
        while at < len(line):
            c = line[at]
            if c.isspace():
                at += 1
            elif c == "#":
                break
            elif c in _QUOTED:
                m = _QUOTED[c].match(line, at)
                if not m:
                    raise ValueError(f"a quote isn't closed: {line[at : at + 40]}")
                yield m[1], False
                at = m.end()
            else:
                m = _PLAIN.match(line, at)
                yield m[0], True
                at = m.end()


def value(token: Token) -> str | None:
    """None for what is unknown or doesn't apply."""
    return None if token[1] and token[0] in ("?", ".") else token[0]


def rows(lines: Iterator[str], category: str) -> Iterator[dict[str, str | None]]:
    """The category's rows, by the names of its items (without the category), whether it is a loop or stands alone. A loop that ends within a
    row, or an item without a value, is a ValueError."""
    lead = category.lower().rstrip(".") + "."
    each = tokens(lines)
    alone: dict[str, str | None] = {}
    back: list[Token] = []
    word = lambda t: t[1] and (t[0].startswith("_") or t[0].lower().startswith(("data_", "loop_", "save_", "global_", "stop_")))

    def following() -> Token | None:
        return back.pop() if back else next(each, None)

    while (t := following()) is not None:
        low = t[0].lower()
        if t[1] and low.startswith("data_") and alone:
            yield alone
            alone = {}
        if t[1] and low == "loop_":
            names: list[str] = []
            while (t := following()) is not None and t[1] and t[0].startswith("_"):
                names.append(t[0].lower())
            mine = bool(names) and names[0].startswith(lead)
            row: list[str | None] = []
            while t is not None and not word(t):
                if not names:
                    raise ValueError("a loop without names")
                row.append(value(t))
                if len(row) == len(names):
                    if mine:
                        yield {n.removeprefix(lead): v for n, v in zip(names, row, strict=True)}
                    row = []
                t = following()
            if row:
                raise ValueError(f"a loop of {names[0]} ends within a row")
            if t is not None:
                back.append(t)
        elif t[1] and t[0].startswith("_"):
            v = following()
            if v is None or word(v):
                raise ValueError(f"{t[0]} has no value")
            if low.startswith(lead):
                alone[low.removeprefix(lead)] = value(v)
    if alone:
        yield alone


def lines_of(uri: str) -> Iterator[str]:
    fs, path = archives.file_system(uri)
    with archives.Reads(fs.open_input_stream(path, compression=None)) as f:
        data = gzip.GzipFile(fileobj=io.BufferedReader(f)) if path.endswith(".gz") else io.BufferedReader(f)
        yield from io.TextIOWrapper(data, encoding="utf-8", errors="replace")


class _CifReader(DataSourceReader):
    def __init__(self, path: str, category: str):
        self.path, self.category = path, category

    def partitions(self) -> list[InputPartition]:
        return [archives.Archive(u) for u in archives.list_files(self.path, SUFFIXES)]

    def read(self, partition: archives.Archive) -> Iterator[tuple]:
        try:
            for k, row in enumerate(rows(lines_of(partition.uri), self.category)):
                yield partition.uri, k, row
        except ValueError as e:
            raise ValueError(f"{partition.uri}: {e}") from e


class CifSource(DataSource):
    """spark.read.format("cif").option("category", "_atom_site").load(path): file, ord (from 0), item (a map of names to values)."""

    @classmethod
    def name(cls) -> str:
        return "cif"

    def schema(self) -> str:
        return "file string, ord long, item map<string, string>"

    def reader(self, schema: StructType) -> _CifReader:
        return _CifReader(self.options["path"], self.options.get("category", "_atom_site"))


def read_category(spark: SparkSession, path: str, category: str) -> DataFrame:
    """file, ord and item for the rows of a category of all files at path."""
    spark.dataSource.register(CifSource)
    return spark.read.format("cif").option("category", category).load(path)


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Heavy atoms of the first model, with the columns of tables.read_pdb_atoms: names and numbers are the authors' where they are given."""
    r = read_category(spark, path, "_atom_site")
    at = lambda *names: F.coalesce(*(F.col("item")[n] for n in names))
    number = lambda n: F.col("item")[n].try_cast("double").alias(n[-1])
    element = F.initcap(F.coalesce(at("type_symbol"), F.substring(F.regexp_replace(at("auth_atom_id", "label_atom_id"), r"^\d+", ""), 1, 1)))
    rows_ = r.select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "ord", (at("group_pdb") == "HETATM").alias("het"), at("auth_atom_id", "label_atom_id").alias("name"),
        at("auth_comp_id", "label_comp_id").alias("resname"), at("auth_asym_id", "label_asym_id").alias("chain"), at("auth_seq_id", "label_seq_id").try_cast("int").alias("resseq"),
        element.alias("element"), number("cartn_x"), number("cartn_y"), number("cartn_z"), F.coalesce(at("pdbx_pdb_model_num").try_cast("int"), F.lit(1)).alias("model"),
    )
    first = rows_.groupBy(F.col("file").alias("_f")).agg(F.min("model").alias("_m"))
    kept = rows_.join(first, (F.col("file") == F.col("_f")) & (F.col("model") == F.col("_m"))).drop("_f", "_m", "model")
    return kept.where(~F.col("element").isin("H", "D") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def write_cif(atoms: list[dict], name: str = "x") -> str:
    """A file of _atom_site rows, values quoted where they must be."""
    if not atoms:
        return f"data_{name}\n#\n"
    names = list(atoms[0])

    def quoted(v: object) -> str:
        s = "?" if v is None else str(v)
        if v is not None and ("\n" in s or "'" in s and '"' in s):
            return f"\n;{s}\n;\n"
        bare = s and not re.search(r"\s", s) and s[0] not in "_#$'\"[];" and s.lower() not in ("?", ".") and not s.lower().startswith(("data_", "loop_", "save_", "stop_", "global_"))
        return s if bare or v is None else f'"{s}"' if "'" in s else f"'{s}'"

    body = "\n".join(" ".join(quoted(a[n]) for n in names) for a in atoms)
    return f"data_{name}\n#\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names) + body + "\n#\n"


def write_files(lines: DataFrame, path: str, order: str, line: str, head: str) -> DataFrame:
    """A file for each range of the order, of the head and the lines of the range; returns their names. A file gets its name when it is
    whole."""
    part = free("_part", lines)
    ranged = lines.repartitionByRange(order).sortWithinPartitions(order).select(F.spark_partition_id().alias(part), F.col(line).alias("line"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, name = None, "", ""
        for b in batches:
            if out is None and b.num_rows:
                name = f"{path.rstrip('/')}/{b.column(0)[0].as_py():06d}.cif"
                fs, at = archives.file_system(name)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                own = f"{at}.{uuid.uuid4().hex}.part"
                out = fs.open_output_stream(own, compression=None)
                out.write(head.encode())
            if b.num_rows:
                out.write("".join(f"{x}\n" for x in b.column(1).to_pylist()).encode())
        if out is not None:
            out.close()
            fs.move(own, at)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return storage.cut(ranged.mapInArrow(write, "file string"), "cif-files")
