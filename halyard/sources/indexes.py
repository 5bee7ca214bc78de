"""Label tables, target indexes, summaries, and the sinks of evaluations and receptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_labels(spark: SparkSession, paths: list[str], key: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """key and value of several CSV files with a header: of a key the last file's last row counts; only measures of those kinds, whatever
    relation (<, >, =, ~) stands behind their names."""
    rows = None
    for k, path in enumerate(paths):
        part = spark.read.option("header", True).csv(path).select(key, kind, F.col(value).cast("double").alias(value), F.lit(k).alias("_file"), F.monotonically_increasing_id().alias("_row"))
        rows = part if rows is None else rows.unionByName(part)
    plain = F.regexp_replace(F.trim(kind), "[<>=~]+$", "")
    rows = rows.where(plain.isin(kinds) & F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.max_by(value, F.struct("_file", "_row")).alias(value))


def read_index(spark: SparkSession, path: str, key: str, schema: str, paths: list[str], ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A JSON index of targets: those ids, then the first so many in order of key, with the named columns' paths made absolute."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    if ids is not None:
        rows = rows.where(F.col(key).isin(ids))
    if limit is not None:
        rows = rows.orderBy(key).limit(limit)
    root = path.rsplit("/", 1)[0]
    absolute = lambda c: F.when(F.col(c).startswith("/") | F.col(c).contains("://"), F.col(c)).otherwise(F.concat(F.lit(f"{root}/"), F.col(c)))
    return rows.withColumns({c: absolute(c) for c in paths})


def read_summary(spark: SparkSession, root: str, subsets: list[str], known: list[str]) -> DataFrame:
    """subset, smiles, pickle_path of the summaries <root>/summary_<subset>.json, objects keyed by SMILES; entries without a path are
    passed over; a subset that is not known is an error."""
    strange = sorted(set(subsets) - set(known))
    if strange:
        raise ValueError(f"unknown subsets: {', '.join(strange)}")
    out = None
    for s in subsets:
        text = spark.read.text(f"{root}/summary_{s}.json", wholetext=True)
        entries = text.select(F.explode(F.from_json("value", "map<string,struct<pickle_path:string>>")).alias("smiles", "entry"))
        part = entries.select(F.lit(s).alias("subset"), "smiles", F.col("entry.pickle_path").alias("pickle_path")).where("pickle_path is not null")
        out = part if out is None else out.unionByName(part)
    return out


def write_triple(rows: DataFrame, by_target: DataFrame, by_model: DataFrame, path: str) -> None:
    """An evaluation's three tables: per_molecule (Parquet), per_target and per_model (CSV)."""
    rows.write.parquet(f"{path}/per_molecule.parquet")
    for name, table in (("per_target", by_target), ("per_model", by_model)):
        table.write.option("header", True).csv(f"{path}/{name}.csv")


def write_json_buckets(df: DataFrame, path: str, key: str, bucket: str, order: list[str]) -> None:
    """One folder of gzipped JSON lines a bucket, each key once (the first by order); null columns are left out of the lines."""
    from halyard.operators import relational

    relational.first_wins(df, [key], order).repartition(bucket).write.partitionBy(bucket).option("compression", "gzip").json(path)


def write_residue_tokens(df: DataFrame, path: str, struct: str) -> None:
    """struct, residue, token sorted by struct, so that a look-up's filter skips row groups."""
    df.repartitionByRange(struct).sortWithinPartitions(struct).write.parquet(path)


def table_text(df: DataFrame, form: str, most: int = 1000) -> str:
    """A small table as markdown, csv or latex; one of more than most rows is an error, as it is for a reader."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cells = [list(df.columns)] + [["" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    if form == "markdown":
        lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in cells]
        return "\n".join([lines[0], "|" + " --- |" * len(df.columns), *lines[1:]]) + "\n"
    if form == "csv":
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
        return "".join(",".join(map(quoted, r)) + "\n" for r in cells)
    if form == "latex":
        escaped = [" & ".join("".join("\\" + x if x in "&%$#_{}" else x for x in c) for c in r) + r" \\" for r in cells]
        return "\n".join([f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}", escaped[0], r"\hline", *escaped[1:], r"\end{tabular}"]) + "\n"
    raise ValueError(f"unknown form {form}")
