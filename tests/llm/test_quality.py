import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import quality


def corpus(spark, n=600):
    rows = []
    for i in range(n):
        good = " ".join(f"Word{(i * j) % 97} of the" for j in range(1, 40)) + "."
        rows.append((i, good if i % 4 else good.upper().replace(" ", "!! "), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)] + [(None, 1), (3, None), (10**9, 1), (4, 7)], "doc_id long, quality int")
    return docs, labels


def test_learns_and_ranks_held_out_documents(spark):
    docs, labels = corpus(spark)
    w = quality.train(docs, quality.learn_rows(labels), rows=300)
    got = quality.score(docs, w).where(quality.held_out()).collect()
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in got)


def test_training_is_repeatable_and_never_sees_held_out_labels(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) AS quality")
    a, b = (quality.train(docs.repartition(n), quality.learn_rows(x), rows=100) for n, x in ((1, labels), (3, flipped)))
    assert (a == b).all() and np.abs(a).max() > 0


def test_null_empty_and_long_texts(spark):
    docs, labels = corpus(spark, 100)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (3, "w " * 200000), (3, "x" * 600000)], "doc_id long, text string")
    got = [r["score"] for r in quality.score(odd, quality.train(docs, labels)).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for s in got)
    assert (quality.train(docs, labels.limit(0)) == 0).all() and (quality.train(docs.limit(0), labels) == 0).all()
    assert quality.score(docs.limit(0), np.zeros((1 << quality.BITS) + 1)).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["One two  two\nthree", "", None, "One", "b " * 300000, "two two", "é " * 10]
    alone = [quality.sparse_rows(pa.array([t], pa.string()))[0] for t in texts]
    for (i, x), (j, y) in zip(alone, quality.sparse_rows(pa.array(texts, pa.string())), strict=True):
        assert i.tolist() == j.tolist() and x.tolist() == y.tolist()


def test_score_is_a_sparse_dot_product(spark):
    docs, labels = corpus(spark, 100)
    w = quality.train(docs, labels)
    rows = quality.score(docs, w).collect()
    for r, (i, x) in zip(rows, quality.sparse_rows(pa.array([r["text"] for r in rows])), strict=True):
        assert abs(quality.sigmoid(w[-1] + x @ w[i].astype(float)) - r["score"]) < 1e-9


def test_training_agrees_with_plain_python(spark):
    """The update of each coordinate, spelled out: adaptive rates, lazy weights, both penalties."""
    docs, labels = corpus(spark, 60)
    w = quality.train(docs, labels, rows=40)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").selectExpr("doc_id", "quality", "xxhash64(cast(doc_id as string)) AS o").orderBy("o", "doc_id", "quality").limit(40).collect()
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.02:
            return 0.0
        return ((0.02 if z[i] > 0 else -0.02) - z[i]) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.1)

    for _ in range(quality.EPOCHS):
        for r in order:
            if r["doc_id"] not in text:
                continue
            (i, x), = quality.sparse_rows(pa.array([text[r["doc_id"]]]))
            row = {**dict(zip(i.tolist(), x.astype("<f4").tolist(), strict=True)), 1 << quality.BITS: 1.0}
            now = {j: weight(j) for j in row}
            p = 1 / (1 + math.exp(-sum(now[j] * v for j, v in row.items())))
            for j, v in row.items():
                g = (p - r["quality"]) * v
                before = n.get(j, 0.0)
                z[j] = z.get(j, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / 0.3 * now[j]
                n[j] = before + g * g
    want = np.zeros((1 << quality.BITS) + 1)
    for j in z:
        want[j] = weight(j)
    assert np.allclose(w, want, atol=1e-4) and np.count_nonzero(want) > 20


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs, labels = corpus(spark, 60)
    first = labels.where("quality IN (0, 1) AND doc_id < 60").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).first()
    monkeypatch.setattr(quality, "TRAIN_BYTES", 10)
    one = quality.train(docs, labels)
    assert (one == quality.train(docs.where(F.col("doc_id") == first["doc_id"]), labels)).all() and np.abs(one).max() > 0


def test_any_column_name_passes_through(spark):
    df = spark.createDataFrame([(1, "one two", 5)], "doc_id long, text string, `a``b c` int")
    (r,) = quality.score(df, np.zeros((1 << quality.BITS) + 1)).collect()
    assert r["a`b c"] == 5 and r["score"] == 0.5
