"""The queries over the given tables: against SQL, and against brute force where SQL cannot say it."""

import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    res = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(res.fetchall())


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op3_byte_shards(spark, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d["doc_id"], len(d["text"].encode()) + 8, zlib.crc32(d["text"].encode())) for d in docs)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    mean, most = sum(r["size"] for r in got) / 24, max(r["size"] for r in got)
    assert all(abs(sum(n for _, n in v) - mean) <= most for v in by.values())


def test_quality_and_language_on_held_out_rows(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    q = [r for r in queries.op4_ftrl_quality(spark, SF).collect() if r["doc_id"] in quality]
    held = [r for r in q if r["held_out"]]
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.8 * len(held)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.op10_language_mixture(spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
