"""Near-duplicate groups from SimHash fingerprints by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, prepare

SHINGLE = 4
SEED = 42
RADIUS = 4
#: A bucket with more fingerprints than this is not compared pair by pair but indexed as one segment; see ``links``.
DENSE = 512
_BIT = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.float64)


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    start = np.cumsum(size) - size
    span = min(SHINGLE, len(words))
    end = (start + size - 1)[span - 1 :]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=False)], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BIT for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    masks = [0] + [1 << i for i in range(bits)]
    if radius == 2:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return np.array(masks, dtype=np.uint64)


def _probes(fps: DataFrame) -> DataFrame:
    """(kind, key, fp): the keys under which a fingerprint stands in the tables and under which it asks them.

    Two fingerprints that differ in at most four bits differ in at most two bits of the upper half, or in at most one
    of the lower. The upper table holds each half's ball of radius one and is asked with the same ball: two balls meet
    if the halves are within two bits. The lower table holds the halves as they are and is asked with their balls.
    Entries and questions of a key meet in one bucket.
    """
    upper, lower = _ball(32, 1) << np.uint64(32), _ball(32, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for kind, half, ball in ((0, fp & high, upper), (1, fp & low, lower)):
                key = (half[:, None] ^ ball).ravel()
                cols = [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(ball)).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "kind int, key long, fp long")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, int | None]]:
    """Columns, run starts (with the end) and head, of rows sorted by their first ``n_keys`` columns.

    A run comes in one piece, unless it is long: as soon as over ``DENSE`` of its rows have come, they are given on,
    and what follows comes with the first fingerprint of the run (the last column) as head, else None.
    """
    rest: list[np.ndarray] | None = None
    head = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:n_keys]])) + 1
        last = int(new[-1]) if len(new) else 0
        if last:
            yield [c[:last] for c in cols], np.concatenate([[0], new]), head
            head = None
        rest = [c[last:] for c in cols]
        if len(rest[0]) > DENSE + 1:  # one row stays, by which the next batch can tell whether the run goes on
            yield [c[:-1] for c in rest], np.array([0, len(rest[0]) - 1]), head
            head = int(rest[-1][0]) if head is None else head
            rest = [c[-1:] for c in rest]
    if rest is not None and len(rest[0]):
        yield rest, np.array([0, len(rest[0])]), head


def _near(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``RADIUS`` in one bucket: each fingerprint to the least of its component."""
    close = np.bitwise_count(fp[:, None] ^ fp) <= RADIUS
    label = np.arange(len(fp))
    while True:
        new = np.where(close, label, len(fp)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _links_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each bucket as (a, b); a crowded bucket gives its members as (a, null) instead."""
    for (_, _, fp), at, head in _runs(batches, 2):
        fp, size = fp.view(np.uint64), np.diff(at)
        if head is not None:
            size[0] += DENSE
        first = at[:-1][size == 2]
        two = first[np.bitwise_count(fp[first] ^ fp[first + 1]) <= RADIUS]
        left, right, crowd = [fp[two]], [fp[two + 1]], []
        for a, b, n in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > DENSE:
                crowd.append(fp[a:b])
            else:
                x, y = _near(fp[a:b])
                left.append(x)
                right.append(y)
        a, b = np.concatenate(left), np.concatenate(right)
        a, b = np.maximum(a, b), np.minimum(a, b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        if crowd:
            c = np.unique(np.concatenate(crowd))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.nulls(len(c), pa.int64())], ["a", "b"])


def _whole_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ball = _ball(64, 2)
    for b in batches:
        for fp in np.array_split(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), max(1, b.num_rows // 32)):
            key = (fp[:, None] ^ ball).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(ball)).view(np.int64))], ["key", "fp"])


def _stars(batches: Iterator[pa.RecordBatch], radius: int | None = None) -> Iterator[pa.RecordBatch]:
    """Every member of a bucket with the bucket's first; with ``radius`` their complete distances are verified."""
    for (_, fp), at, head in _runs(batches, 1):
        heads = fp[at[:-1]].copy()
        if head is not None:
            heads[0] = head
        least = np.repeat(heads, np.diff(at))
        keep = least != fp
        if radius is not None:
            keep &= np.bitwise_count(least.view(np.uint64) ^ fp.view(np.uint64)) <= radius
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(least[keep])], ["a", "b"])


def _near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _stars(batches, RADIUS)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints that connect all that lie within ``RADIUS`` bits of each other.

    Buckets gather fingerprints by table key; within a bucket complete distances are verified and a component of n
    members gives n - 1 edges. The members of a bucket of over ``DENSE`` go to an index of one segment of 64 bits, keyed
    by their balls of radius two. Two such balls meet exactly if the fingerprints are within four bits, so it is enough
    to verify each member of a key against one of them: linear in the members, in many small buckets, with no pair lost.
    """
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # before rows grow 66-fold
    buckets = _probes(spread).repartition("kind", "key").sortWithinPartitions("kind", "key")
    found = pinned(buckets.mapInArrow(_links_in_buckets, "a long, b long").distinct())
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    whole = crowded.mapInArrow(_whole_balls, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return found.where("b IS NOT NULL").union(whole.mapInArrow(_near_stars, "a long, b long")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Alternates large-star and small-star steps until the edges no longer change. Each round is kept in the shared
    checkpoint folder; the driver sees a count and a checksum. Least neighbours are kept too: both sides of a join are
    then plain shuffles, of which adaptive execution splits the partition that holds a hub.
    """
    e = pinned(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pinned(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = pinned(large)
        least = pinned(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.expr("CASE WHEN v = m THEN array(struct(u, m)) ELSE array(struct(v AS u, m)) END")).alias("x"))
        e = pinned(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (16 hex digits) and component_id, the least doc_id reachable over links of four bits or fewer.

    Equal fingerprints are one node from the start, so exact copies never meet pair by pair. Null, empty and word-less
    texts have fingerprint zero and link like any other. A null doc_id is ignored for component_id (null if a component
    has no other). Repeated rows come out as often as they went in; an empty table gives no rows; other columns are
    ignored.
    """
    marked = pinned(fingerprints(docs, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = pinned(named.groupBy("root").agg(F.min("least").alias("component_id")))  # a large one's members may then be split
    group = pinned(named.select("fp", "root").join(component, "root").select("fp", "component_id"))
    return marked.join(group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
