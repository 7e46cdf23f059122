"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned

#: Bytes that each row costs besides its text.
ROW_OVERHEAD = 8


def _cut(start: np.ndarray, size: np.ndarray, total: int, n_shards: int) -> np.ndarray:
    """The shard of the target interval that holds the middle of [start, start + size)."""
    return np.minimum((2 * start + size) * n_shards // max(1, 2 * total), n_shards - 1)


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the rows, in order of ``id_col``, at equal byte targets into ``n_shards`` contiguous shards.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot (gapless from 0 in each shard). A shard's bytes
    differ from the target by at most one row. Only narrow rows (id, size, checksum) are range-partitioned; the driver
    sees one total per partition and one count per partition and shard, from which every task derives its prefix.

    Null text: size 8, checksum 0. Null ids come first. Rows with equal ids follow each other by size and checksum;
    wholly equal rows are interchangeable, so a random key deals out a repeated id over partitions. An empty table
    gives no rows. Further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keys = [F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("text_crc32"), F.asc("salt")]
    ordered = rows.withColumn("salt", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    placed = pinned(ordered)

    totals = {
        r["pid"]: (r["size"], r["n"])
        for r in placed.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    }
    start, total, row, first_row = {}, 0, 0, {}
    for pid in sorted(totals):
        start[pid], first_row[pid] = total, row
        total, row = total + totals[pid][0], row + totals[pid][1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        pid = TaskContext.get().partitionId()
        at, n = start.get(pid, 0), first_row.get(pid, 0)
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(size)
            yield b, _cut(ends - size, size, total, n_shards), n + np.arange(len(size))
            if len(size):
                at, n = int(ends[-1]), n + len(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_shards, dtype=np.int64)
        for _, shard, _ in spread(batches):
            seen += np.bincount(shard, minlength=n_shards)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], ["shard", "n"])

    counts = np.zeros(n_shards, dtype=np.int64)
    for r in placed.mapInArrow(count, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        counts[r["shard"]] = r["n"]
    shard_first = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, shard, index in spread(batches):
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(shard.astype(np.int32)), pa.array(index - shard_first[shard])],
                [*b.schema.names, "shard", "slot"],
            )

    id_type = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(assign, f"doc_id {id_type}, size long, text_crc32 long, shard int, slot long")
