"""Readers and writers of files: delimited text, JSON of several shapes, Parquet; all lazy."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cast import STRICT_TOKENS, blank_tokens


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, infer: bool = False, na_values: Sequence[str] = ()) -> DataFrame:
    """Rows of one file, a glob or several files; all columns text unless inferred; malformed rows are dropped."""
    df = spark.read.csv(path, header=True, inferSchema=infer, mode="DROPMALFORMED", multiLine=False)
    if columns:
        df = df.select(*columns)
    return df.select(*[blank_tokens(F.col(f.name), na_values).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields]) if na_values else df


def with_source(df: DataFrame, name: str = "source") -> DataFrame:
    """The stem of the file that each row comes from."""
    return df.withColumn(name, F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def usable_edges(edges: DataFrame, member: str, tokens: Sequence[str] = STRICT_TOKENS) -> DataFrame:
    """Edges whose member is neither null, blank nor a token for a missing value; the filter reaches the scan."""
    m = F.trim(F.col(member))
    return edges.where(F.col(member).isNotNull() & (m != "") & ~m.isin(list(tokens)))


def read_columnar_json(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Rows of ``{"a": {"0": x, ...}, "b": {"0": y, ...}}``: the maps are matched by their keys, column ``index``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{','.join(f'{f}:map<string,string>' for f in fields)}>").alias("j"))
    out = None
    for f in fields:
        part = whole.select(F.explode(F.col("j")[f]).alias("index", f))
        out = part if out is None else out.join(part, "index")
    return out


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def json_to_table(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Text columns (new name to field) of a JSON array or of JSON lines, told apart by the first character.

    Entries that are no objects are skipped; an error is raised if none is left.
    """
    head = spark.read.text(path, wholetext=False).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    if head["c"] == "[":
        values = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    else:
        values = spark.read.text(path).select(F.col("value").alias("v"))
    rows = values.where(F.trim("v").startswith("{")).select(*[F.get_json_object("v", f"$.{f}").alias(n) for n, f in fields.items()])
    if rows.isEmpty():
        raise ValueError(f"{path} holds no records")
    return rows


def convert_directory(spark: SparkSession, folder: str, out: str, fields: dict[str, str]) -> list[str]:
    """Every ``*.json`` and ``*.jsonl`` of a local folder as CSV below ``out``; the stems of what was written."""
    done = []
    for p in sorted(Path(folder).glob("*.json*")):
        if p.suffix in (".json", ".jsonl"):
            write_csv(json_to_table(spark, str(p), fields), f"{out}/{p.stem}")
            done.append(p.stem)
    return done


def read_labelled(spark: SparkSession, path: str, text_col: str, label_col: str | None) -> DataFrame:
    """A CSV with the required columns, else an error that names those absent."""
    df = read_csv(spark, path)
    absent = [c for c in (text_col, label_col) if c and c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    return df


def first_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first path that can be read, as Parquet or CSV by its ending."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return spark.read.parquet(p) if p.endswith(".parquet") else read_csv(spark, p)
    raise FileNotFoundError(", ".join(paths))


def table_name(name: str, taken: Sequence[str] = ()) -> str:
    """A valid table name, with a number where it is taken."""
    base = re.sub(r"\W+", "_", name).strip("_").lower() or "table"
    base = f"t_{base}" if base[0].isdigit() else base
    out, i = base, 2
    while out in taken:
        out, i = f"{base}_{i}", i + 1
    return out


def load_config(path: str) -> dict:
    """A JSON file, or the block mappings and plain scalars of a YAML file."""
    body = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(body)
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for raw in body.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            v = value.strip().strip("'\"")
            stack[-1][1][key] = int(v) if re.fullmatch(r"-?\d+", v) else v
        else:
            stack[-1][1][key] = child = {}
            stack.append((indent, child))
    return root


def config_path(config: dict, dotted: str, base: str = ".") -> str:
    node = config
    for part in dotted.split("."):
        node = node[part]
    return node if str(node).startswith("/") or "://" in str(node) else f"{base}/{node}"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One text column in the frame's order: a sorted frame's ranges become part files whose names have that order."""
    df.write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of part files in the order of their names, numbered from 1.

    A file's lines are numbered by their place in it; the files' line counts, of which there are few, carry on.
    """
    rows = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    piece = Window.partitionBy("f", "b")
    sizes = rows.groupBy("f", "b").agg(F.count("*").alias("n"))
    first = sizes.select("f", "b", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return rows.withColumn("nth", F.row_number().over(piece.orderBy("i"))).join(first, ["f", "b"]).select((F.col("first") + F.col("nth")).alias("line"), "value")


def with_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, as read from files, with a number that rises with the rows' place in them."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files that are written and read again: below the shared checkpoint folder that the session names.

    Only where none is named and all tasks run on this machine is it a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
