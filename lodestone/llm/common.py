"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of an Arrow batch that goes to a Python worker. Long documents make wide rows, so batches stay small.
BATCH_ROWS = 256
#: Bytes at which such a batch is closed before it has all its rows.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that a checkpoint folder is set.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where none is set and all tasks run
    on this machine (tests) a temporary one is made; elsewhere that is an error, as other machines would not see it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir") and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for files that executors write and others read."""
    prepare(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later reads see the same rows and partitions after any loss."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def extended(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` with further fields, given as name and type."""
    return StructType([*df.schema.fields, *(StructField(n, StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in more.items())])


def with_computed(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], **more: str) -> DataFrame:
    """``df`` with further columns (name and type), made from its Arrow batches; columns of these names are replaced.

    The batches' columns are in the frame's order without the replaced ones. They have plain names on their way to
    Python, as its interface takes no others.
    """
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in more}]
    plain = df.select(*[F.col(quoted(c)) for c in kept]).toDF(*[f"c{i}" for i in range(len(kept))])
    schema = extended(plain, **{f"m{i}": t for i, t in enumerate(more.values())})
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], names)

    return plain.mapInArrow(run, schema).toDF(*kept, *more)


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
