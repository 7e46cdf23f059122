import zlib

from lodestone.llm.sharding import shard_by_bytes


def brute(rows, n):
    rows = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is not None, r))
    total, at, out, slots = sum(r[1] for r in rows), 0, [], {}
    for r in rows:
        s = min((2 * at + r[1]) * n // (2 * total), n - 1)
        out.append((*r, s, slots.setdefault(s, 0)))
        slots[s] += 1
        at += r[1]
    return sorted(out, key=str)


def test_agrees_with_brute_force(spark):
    rows = [(i * 7 % 501, "é" * (i % 90)) for i in range(501)] + [(None, None), (3, ""), (3, ""), (3, "x" * 5000), (None, "y")] + [(9, "same")] * 300
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int").repartition(5)
    for n in (1, 24, 2000):
        assert sorted((tuple(r) for r in shard_by_bytes(df, n).collect()), key=str) == brute(rows, n)


def test_balance_and_empty(spark):
    df = spark.range(5000).selectExpr("id doc_id", "repeat('a', cast(id % 50 as int)) text")
    sizes = [r[1] for r in shard_by_bytes(df, 24).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 58
    assert shard_by_bytes(df.limit(0), 24).count() == 0
