"""Files, stages, reports, the stream and the plans of queries."""

import contextlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import report
from lodestone.plans import registry, stages
from lodestone.plans import tables as t
from lodestone.sources import files
from lodestone.streaming import cleaning as stream

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_csv_shards_tokens_and_provenance(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"train-{i}.csv").write_text(f"k,v,w\ntt{i},\\N,x\ntt{i}0,5,y\n")
    df = files.read_csv(spark, str(tmp_path / "train-*.csv"), columns=["k", "v"], na_values=(r"\N",))
    assert sorted((r["k"], r["v"]) for r in df.collect()) == [("tt1", None), ("tt10", "5"), ("tt2", None), ("tt20", "5")]
    assert {r["source"] for r in files.with_source(files.read_csv(spark, str(tmp_path))).collect()} == {"train-1", "train-2"}
    assert dict(files.read_csv(spark, str(tmp_path / "train-1.csv"), infer=True).dtypes)["v"] == "string"


def test_json_shapes(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"movie": {"0": "tt1", "1": "tt2"}, "director": {"0": "nm1", "1": "nm2"}}')
    assert sorted((r["index"], r["movie"], r["director"]) for r in files.read_columnar_json(spark, str(tmp_path / "c.json"), ["movie", "director"]).collect()) == [("0", "tt1", "nm1"), ("1", "tt2", "nm2")]
    (tmp_path / "a.json").write_text('[{"t": "x", "l": 1}, 5, {"t": "y"}]')
    (tmp_path / "b.jsonl").write_text('{"t": "x", "l": 1}\n[1]\n{"t": "y"}\n')
    for n in ("a.json", "b.jsonl"):
        assert sorted((r["text"], r["label"]) for r in files.json_to_table(spark, str(tmp_path / n), {"text": "t", "label": "l"}).collect()) == [("x", "1"), ("y", None)]
    assert files.read_json_array(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "d.jsonl").write_text("[1]\n")
    with pytest.raises(ValueError, match="no records"):
        files.json_to_table(spark, str(tmp_path / "d.jsonl"), {"text": "t"})
    (tmp_path / "d.jsonl").unlink()
    (tmp_path / "c.json").unlink()
    assert files.convert_directory(spark, str(tmp_path), str(tmp_path / "out"), {"text": "t"}) == ["a", "b"]


def test_loaders_config_and_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="label"):
        files.read_labelled(spark, str(tmp_path / "x.csv"), "a", "label")
    assert files.first_existing(spark, [str(tmp_path / "no.parquet"), str(tmp_path / "x.csv")]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no.parquet")])
    (tmp_path / "c.yaml").write_text("data:\n  raw: in/x.csv  # a path\n  n: 3\nname: 'q'\n")
    c = files.load_config(str(tmp_path / "c.yaml"))
    assert c == {"data": {"raw": "in/x.csv", "n": 3}, "name": "q"} and files.config_path(c, "data.raw", "/b") == "/b/in/x.csv"
    assert files.table_name("9 a-b", ["t_9_a_b"]) == "t_9_a_b_2"


def test_stage_choice():
    assert stages.choose() == list(stages.STAGES) and stages.choose(start="models") == ["models", "report"]
    assert stages.choose(stages=["models", "cleaning"]) == ["cleaning", "models"] and stages.choose(only="features") == ["features"]
    with pytest.raises(ValueError, match="one of"):
        stages.choose(start="models", only="features")
    with pytest.raises(ValueError, match="unknown"):
        stages.choose(only="nope")


@needs_tables
def test_stages_run_from_tables_to_predictions(spark, tmp_path):
    out = str(tmp_path)
    timings = stages.run(spark, SF, out, stages.choose(), enriched=True)
    assert [n for n, _ in timings] == ["cleaning", "enrichment", "features", "models", "report"]
    n = t.movies(spark, SF).where("split = 'test'").count()
    lines = [r["value"] for r in spark.read.text(f"{out}/predictions").collect()]
    assert len(lines) == n and set(lines) <= {"True", "False"}
    assert spark.read.parquet(f"{out}/enrichment/recovery").count() == 3 and spark.read.parquet(f"{out}/report").where("check LIKE 'drift%'").count() > 0
    assert spark.read.json(f"{out}/metrics").where("chosen").count() == 1
    with pytest.raises(ValueError, match="follows"):
        stages.run(spark, SF, out, ["models"], enriched=True)


@needs_tables
def test_audit_of_files(spark):
    r = stages.audit_files(spark, [f"{SF}/customer.parquet", f"{SF}/supplier.parquet"])
    assert "key candidates" in r.text() and "## columns" in r.markdown() and "<h2>schema" in r.html("x")
    assert r.frame(spark).where("table = 'customer' AND metric = 'rows'").first()["value"] == "150"


def test_bars(spark):
    r = report.Report()
    r.add_bars("a < b", spark.createDataFrame([(2, 4), (1, None), (3, -1)], "x int, n int"), "x", "n")
    page = r.html("t")
    assert page.count("<rect") == 3 and "a &lt; b" in page and page.index(">1<") < page.index(">2<")
    with pytest.raises(ValueError, match="bars"):
        r.add_bars("many", spark.range(101).selectExpr("id", "id AS n"), "id", "n")


def test_more_rows_than_a_report_holds_are_an_error(spark):
    with pytest.raises(ValueError, match="too many"):
        report.Report().add_frame("t", "c", spark.range(11), "id", most=10)


def test_report_rows(spark):
    r = report.Report()
    r.add("t", "c", "nulls", n=3, pct=1.5)
    assert r.frame(spark).count() == 2 and r.text() == "== nulls ==\n  t.c: n=3, pct=1.5\n"


def test_stream_cleaning(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("tt1", "5", "Thé end"), ("tt2", r"\N", "x")], "k string, a string, title string").write.parquet(str(src))
    s = spark.readStream.schema("k string, a string, title string").parquet(str(src))
    q = stream.write(stream.cleaned(s, {"a": "int"}, id_cols=("k",)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted((r["k"], r["a"], r["title"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("tt1", 5, "The end"), ("tt2", None, "x")]


@needs_tables
@pytest.mark.parametrize("name", ["cln_flagship", "cln_wide_join", "fea_oof_entity", "cln_text_normalize", "aud_column_profile"])
def test_plans_stay_in_the_jvm_and_prune(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()[name](spark, SF).explain()
    plan = out.getvalue()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    if name == "cln_flagship":
        assert "o_clerk" not in plan and "l_extendedprice" not in plan


@needs_tables
def test_filters_reach_the_scan(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        t.read(spark, SF, "orders").where(F.col("o_orderkey") > 5).select("o_orderkey").explain()
    assert "GreaterThan(o_orderkey,5)" in out.getvalue()
