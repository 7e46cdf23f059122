import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import warc


def brute(rows, least=0):
    def key(i):
        return 2**63 if i is None else i

    first = {}
    for i, _, p in rows:
        b = (p or "").encode()
        if len(b) >= least:
            first[b] = min(key(i), first.get(b, 2**63))
    out = []
    for i, _, p in rows:
        b = (p or "").encode()
        refers = first[b] if len(b) >= least and key(i) > first[b] else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def rows(n=300):
    rng = random.Random(2)
    out = [(i, f"http://h/{i}", "é<p>" + str(rng.randrange(90)) * rng.randrange(1, 900)) for i in range(n)]
    return out + [(900, None, None), (901, "u\r\nv: w", ""), (None, "n", "x\r\n\r\nWARC/1.1"), (None, "n", "x\r\n\r\nWARC/1.1"), (5, "http://h/5", out[5][2]), (902, "big", "y" * 2_000_000)]


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, tmp_path, least):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, first string").repartition(4)
    path = str(tmp_path / "w")
    warc.write_archive(df, path, min_payload=least, bundle_bytes=20_000)
    back = warc.read_archive(spark, path)
    got = [tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == brute(data, least)
    ids = [r["record_id"] for r in back.collect()]
    assert len(set(ids)) == len(ids) == len(data)
    responses = {r["record_id"] for r in back.where("record_type = 'response'").collect()}
    assert all(warc.record_id(r["refers_to"], r["payload_digest"]) in responses for r in back.where("refers_to IS NOT NULL").collect())
    assert {r["page_id"]: r["url"] for r in back.where("page_id >= 900").collect()} == {900: None, 901: "u%0D%0Av: w", 902: "big"}
    payloads = {(r["page_id"], bytes(r["payload"]).decode()) for r in back.where("record_type = 'response'").collect()}
    assert payloads <= {(i, p or "") for i, _, p in data}


def test_one_record_by_its_identifier(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame(rows(), "page_id long, url string, html string"), path)
    index = warc.archive_index(spark, path)
    assert index.count() == len(rows()) and index.agg(F.max("frame")).first()[0] > 0
    wanted = spark.createDataFrame([(warc.record_id(902, warc.digest(b"y" * 2_000_000)),)], "record_id string")
    for known in (None, index):
        found = warc.read_archive(spark, path, wanted, known).collect()
        assert [(r["page_id"], r["payload_bytes"]) for r in found] == [(902, 2_000_000)]
    assert warc.read_archive(spark, path, wanted.limit(0)).count() == 0
    ((head, block),) = warc.fetch(spark, index, [wanted.first()["record_id"]])
    assert head["X-Page-ID"] == "902" and block.endswith(b"y" * 1000)


def test_fetching_reads_the_footer_and_one_frame(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "w")
    pages = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh") for _ in range(20_000))) for i in range(120)]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    file = max((tmp_path / "w").glob("part-*"), key=lambda p: p.stat().st_size)
    reader = warc.BundleReader.of_file(spark, f"file://{file}")
    inner, spent = reader.read, []
    reader.read = lambda at, n: spent.append(n) or inner(at, n)
    rid = reader.map[len(reader.map) // 2][0]
    ((head, block),) = reader.records({rid})
    own = dict((i, p) for i, _, p in pages)[int(head["X-Page-ID"])]
    assert head["WARC-Record-ID"] == rid and block.endswith(own.encode())
    assert len(reader.spans) > 1 and sum(spent) < 0.7 * file.stat().st_size


def test_any_reader_can_decompress_a_bundle(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame(rows(20), "page_id long, url string, html string").coalesce(1), path)
    n = 0
    for file in (tmp_path / "w").glob("part-*"):
        with zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True) as r:
            n += r.read().count(b"WARC/1.1\r\nWARC-Type")
    assert n == 26


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0
