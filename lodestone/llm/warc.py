"""WARC archives as seekable Zstandard bundles.

A bundle holds groups of records in independent Zstandard frames, then two skippable frames: the record map (record
identifier, frame, offset inside the decompressed frame, length) and the seek table of the public seekable format
(compressed and decompressed size of each frame), which ends the file. Any Zstandard reader can decompress a bundle; a
reader that knows the footer fetches one record by reading the footer, the map and one frame (``fetch``).

Bundles are written through Spark's text writer, whose output goes to any Hadoop file system under its commit protocol,
so a lost executor leaves no half bundle. That writer ends each row with a line separator; the row lacks the bundle's
last byte (always 0x8F, part of the seek table's magic number), and the separator puts it there. File names are those
that the writer gives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, prepare

#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE = 0x184D2A5E
MAP_FRAME = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, nth: int = 0) -> str:
    """The identifier of the record of a page and payload; ``nth`` numbers rows that agree in both."""
    name = f"{page_id}:{payload_digest}" + (f":{nth}" if nth else "")
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int = 0) -> tuple[str, bytes]:
    """Identifier and bytes of a response, or of a revisit that leaves the payload out. A null url has no header."""
    own = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, own, nth),
        "WARC-Date": _DATE,
        **({} if url is None else {"WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A")}),
        "WARC-Payload-Digest": f"sha1:{own}",
        "X-Page-ID": json.dumps(page_id),
        "X-Payload-Length": len(payload),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, own)
        head["X-Refers-To-Page"] = json.dumps(refers_to)
    else:
        block += payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return head["WARC-Record-ID"], text.encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    version, *lines = data[at : body - 4].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    end = body + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end where it says")
    return head, data[body:end], end + 4


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.map: list[tuple[str, int, int, int]] = []
        self.open, self.length = [], 0

    def add(self, rid: str, data: bytes) -> None:
        self.map.append((rid, len(self.frames), self.length, len(data)))
        self.open.append(data)
        self.length += len(data)
        if self.length >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            self.frames.append(self.pack.compress(b"".join(self.open)))
            self.sizes.append(self.length)
            self.open, self.length = [], 0

    @property
    def size(self) -> int:
        return sum(map(len, self.frames))

    def finish(self) -> bytes:
        self._close()
        entries = zstandard.ZstdCompressor().compress("\n".join(f"{r}\t{f}\t{o}\t{n}" for r, f, o, n in self.map).encode())
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        table += struct.pack("<II", len(entries) + 8, 0)
        footer = table + struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", MAP_FRAME, len(entries)), entries, struct.pack("<II", SKIPPABLE, len(footer)), footer])


class BundleReader:
    """Random access to the records of a bundle, through a function that reads (position, length) of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.spans, at = read, [], 0
        count, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        for packed, _ in struct.iter_unpack("<II", read(size - 9 - 8 * count, 8 * count)):
            self.spans.append((at, packed))
            at += packed
        entries = read(*self.spans.pop())
        if struct.unpack_from("<I", entries)[0] != MAP_FRAME:
            raise ValueError("no record map")
        lines = zstandard.ZstdDecompressor().decompress(entries[8:]).decode().split("\n")
        self.map = [(r, int(f), int(o), int(n)) for r, f, o, n in (x.split("\t") for x in lines if x)]

    @classmethod
    def of_bytes(cls, data: bytes) -> BundleReader:
        return cls(lambda at, n: data[at : at + n], len(data))

    @classmethod
    def of_file(cls, spark: SparkSession, path: str) -> BundleReader:
        """Of a file in any Hadoop file system; only the ranges asked for are read."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf)

        def read(position: int, length: int) -> bytes:
            stream = files.open(at)
            try:
                stream.seek(position)
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
            finally:
                stream.close()

        return cls(read, files.getFileStatus(at).getLen())

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(*self.spans[i]))

    def records(self, wanted: set[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and block of all records, or of those with the wanted identifiers; only their frames are opened."""
        at, raw = None, b""
        for rid, f, o, _ in self.map:
            if wanted is None or rid in wanted:
                if f != at:
                    at, raw = f, self.frame(f)
                head, block, _ = parse(raw, o)
                if head["WARC-Record-ID"] != rid:
                    raise ValueError(f"the map leads from {rid} to {head['WARC-Record-ID']}")
                yield head, block


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, bundle_bytes: int = BUNDLE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write every row as a record with an identifier of its own into bundles below ``path``.

    Of the rows whose payloads are equal and of ``min_payload`` bytes at least, those with the smallest id are
    responses and the others revisit them; smaller payloads are all responses. Null payloads count as empty, null ids
    as larger than any other. Repeated rows are written as often as they occur; those that agree in id and payload are
    numbered. Which id a digest refers to is found from narrow rows (digest, id), of which adaptive execution may split
    a common digest; the payloads move once, dealt by id and digest. An empty table makes an archive without records.
    Other columns are ignored, whatever their names.
    """
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha1"), F.length(body).alias("bytes"))
    rows = rows.withColumn("key", F.concat("sha1", F.coalesce(F.concat(F.lit(":"), F.col("id").cast("string")), F.lit(""))))
    ids = rows.where(F.col("bytes") >= min_payload).select("id", "sha1", "key")
    first = ids.groupBy("sha1").agg(F.min("id").alias("first"), F.max(F.coalesce("id", F.lit(2**63 - 1))).alias("last")).where("first IS NOT NULL AND first < last").select("sha1", "first")
    later = ids.join(pinned(first), "sha1").where("id IS NULL OR id > first").select("key", F.col("first").alias("refers_to")).distinct()
    # a merge join leaves equal keys in one task, where the window numbers them as they come
    told = rows.join(later.hint("merge"), "key", "left").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = BundleWriter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.finish()[:-1]], pa.binary())], ["bundle"])
        for b in batches:
            for i, url, payload, refers, nth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w.add(*record(i, url, payload, refers, refers is not None, nth))
                if w.size >= bundle_bytes:
                    yield out()
                    w = BundleWriter()
        if w.map:
            yield out()

    end = chr(SEEK_MAGIC >> 24)
    files = told.select("id", "url", "body", "refers_to", "nth").mapInArrow(bundle, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def read_archive(spark: SparkSession, path: str, wanted: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The records of all bundles below ``path``, or those whose record_id is in ``wanted``.

    Columns: record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload (null for revisits).
    A response's digest is computed anew and must equal its header. Wanted records are looked up in ``index`` (that of
    ``archive_index``, which should be kept as a table, or else is made), and only the bundles that hold them are read;
    the driver sees the paths of these. For a few records ``fetch`` reads less.
    """
    prepare(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column("ids")[k].as_py() if "ids" in b.schema.names else None
                out = []
                for head, block in BundleReader.of_bytes(b.column("content")[k].as_py()).records(None if ids is None else set(ids)):
                    kind, own = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    if payload is not None and digest(payload) != own:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
                    out.append({
                        "record_id": head["WARC-Record-ID"], "record_type": kind, "page_id": json.loads(head["X-Page-ID"]), "url": head.get("WARC-Target-URI"),
                        "payload_bytes": len(payload) if payload is not None else int(head["X-Payload-Length"]), "payload_digest": own,
                        "refers_to": json.loads(head.get("X-Refers-To-Page", "null")), "payload": payload,
                    })
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    fields = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    if wanted is None:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, fields)
    index = archive_index(spark, path) if index is None else index
    ids = pinned(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").groupBy("path").agg(F.collect_list("record_id").alias("ids")))
    paths = [r["path"] for r in ids.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], fields)
    return spark.read.format("binaryFile").load(paths).join(ids, "path").select("content", "ids").mapInArrow(rows, fields)


def fetch(spark: SparkSession, index: DataFrame, record_ids: Sequence[str]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of a few records: of each bundle that holds one, the footer, the map and the records' frames are read."""
    for r in index.where(F.col("record_id").isin(list(record_ids))).groupBy("path").agg(F.collect_set("record_id").alias("ids")).orderBy("path").collect():
        yield from BundleReader.of_file(spark, r["path"]).records(set(r["ids"]))


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """record_id, path, frame, offset (inside the decompressed frame) and length of every record."""
    prepare(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = BundleReader.of_bytes(data).map
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in m], pa.string()), pa.array([p] * len(m), pa.string()), *(pa.array([r[j] for r in m], pa.int64()) for j in (1, 2, 3))], ["record_id", "path", "frame", "offset", "length"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "record_id string, path string, frame long, offset long, length long")
