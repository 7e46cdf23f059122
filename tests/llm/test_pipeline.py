import random

import corpus_pipeline
from lodestone.llm import queries


def tables(spark, tmp_path, extra=()):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        body = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 200)))
        rows.append((i, body if i % 5 else body.upper().replace(" ", "!! "), "en", "s", 1))
    rows += [(1000 + i, rows[i + 1][1], "en", "s", 1) for i in range(0, 4)] + [(2000, "too short", "en", "s", 1), (2001, None, None, None, None), (None, "w1 " * 3, "en", "s", 1), rows[1], *extra]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages_keep_the_columns_and_what_is_good(spark, tmp_path):
    docs = tables(spark, tmp_path)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids) == [i for i in range(160) if i % 5]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in packed.where("piece = 0").collect()) == sorted(ids)


def test_clashing_columns_pass_through(spark, tmp_path):
    docs = tables(spark, tmp_path).selectExpr("*", "1 AS _quality", "2 AS _nth", "3 AS n_words", "4 AS fp", "5 AS kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {(1, 2, 3, 4, 5)}, name


def test_rows_are_told_by_id_and_text(spark):
    """Different texts under one id are judged apart; copies go whatever their ids; one of equal rows stays."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(4))
    rows = [(5, a, "x"), (5, b, "y"), (7, c, "z"), (9, a, "later copy"), (None, c, "copy without id"), (None, d, "n"), (None, d, "n"), (7, c, "z"), (8, None, "e"), (8, "", "e"), (None, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a``b` string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(5, a), (5, b), (7, c), (0, d), (8, "")])
    assert corpus_pipeline.near_duplicates(spark, df.where("doc_id = 5"), "").count() == 2


def test_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path / "full")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))
