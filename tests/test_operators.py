"""Operators on small frames whose results are known by hand."""

import hashlib
import json
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import cast, text
from lodestone.operators import audit, clean, features, impute, models, quality, relate, stats
from lodestone.operators.contracts import TableContract, enforce, match, violations


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("2.5", 3), ("3.5", 4), ("-2.5", -3), ("x", None), ("3658.0", 3658), (" 12 ", 12), ("1e3", 1000), ("1e12", None), ("", None), (None, None)])
def test_safe_int(spark, raw, want):
    assert one(spark, cast.safe_int, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Gớné", "Gone"), ("Thé  World!", "The World"), ("", None), (None, None), ("ß", None), ("a­b-c", "ab c")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize, raw) == want


def test_keys_and_fold(spark):
    assert one(spark, text.fingerprint, "World the") == one(spark, text.fingerprint, "The, world") == "the world"
    assert one(spark, text.fingerprint_unicode, "É, b a") == "a b e"
    assert one(spark, text.canonical_key, " Ab,  C9! ") == "ab c9" and one(spark, text.title_key, "Ab--C") == "ab c"
    for t in ("ﬁé漢", "ﬁlm ™ Ａ ½", "№ ⅓ ㎏…", "\U0001d400\U0001f100", "x\u0301", "\u3000\xa0", "plain", "", "İKß", "①②⑩㍿"):
        assert one(spark, text.fold, t) == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), t
    assert one(spark, text.has_non_ascii, "é") is True
    assert one(spark, text.fingerprint, "Semi-final") == one(spark, text.fingerprint_unicode, "semi-final") == "final semi"
    assert one(spark, text.fingerprint, None) == one(spark, text.fingerprint_unicode, None) == ""
    assert one(spark, text.fingerprint_unicode, "a™b ½x") == "12x a b" and one(spark, text.fingerprint, "a™b ½x") == "12x atmb"
    assert one(spark, text.word_count, "  a b\tc ") == 3 and one(spark, text.word_count, "") == 0


@pytest.mark.parametrize(("raw", "bits"), [("aaaa", 0.0), ("ab", 1.0), (r"\N", 1.0), ("", 0.0), (None, None)])
def test_entropy(spark, raw, bits):
    assert one(spark, text.entropy, raw) == bits


def test_numbers_in_text(spark):
    assert one(spark, cast.money, "$1,234") == 1234.0 and one(spark, cast.money, "") is None and one(spark, cast.leading_number, "120 min") == 120.0
    assert one(spark, lambda c: cast.tokens_of(c, {"sci-fi": "science"}), "Drama, sci-fi,,drama") == ["drama", "science"]
    assert one(spark, cast.blank_tokens, r" \N ") is None and one(spark, lambda c: cast.blank_tokens(c, cast.WIDE_TOKENS), "N/A") is None


def test_contracts(spark):
    c = TableContract("train", ("k",), {"k": r"^tt\d+$"})
    assert match([c], "train_clean") is c and match([c], "trainx") is None
    bad = spark.createDataFrame([("tt1",), ("tt1",), ("x",), (None,)], "k string")
    assert {r["check"]: r["n"] for r in violations(bad, c).collect()} == {"format:k": 1, "unique:k": 1}
    with pytest.raises(ValueError, match="format:k"):
        enforce(bad, c)
    assert enforce(bad.where("k = 'tt1'").distinct(), c).count() == 1
    with pytest.raises(ValueError, match="null:v"):
        clean.gate(spark.createDataFrame([("tt1", None)], "k string, v int"), c, ["v"])


def test_cleaning_run(spark):
    raw = spark.createDataFrame([("tt1", "12.0", "True", "Thé, End", "x"), ("tt2", r"\N", "false", r"\\N", "y"), ("tt2", "9", "true", "b", "z")], "k string, a string, b string, t string, gone string")
    c = TableContract("t", ("k",), {"k": r"^tt\d+$"}, ("gone",))
    types = clean.infer_schema(clean.replace_missing(raw, drop=c.drop_cols), ["a", "b", "t"])
    assert types == {"a": "int", "b": "boolean", "t": "string"}
    rows = clean.run(raw, c, types).orderBy("k").collect()
    assert [(r["k"], r["a"], r["b"], r["t"]) for r in rows] == [("tt1", 12, True, "The End"), ("tt2", 9, True, "b")]
    assert rows[0]["__fp_t"] == "end the" and clean.export_columns(clean.run(raw, c, types)).columns == ["k", "a", "b", "t"]
    assert clean.guess_key(raw.select("gone", "k").where("gone <> 'z'")) == "k" and clean.detect_key(raw, ["nope", "k"]) == "k"


def test_quantiles(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10)], "v double")
    r = audit.robust_statistics(v, "v").first()
    assert (r["p25"], r["p50"], r["mad"], r["std"]) == (1.75, 3.0, 1.5, 3.4911)
    assert audit.rank_trimmed_mean(v, "v").first()["trimmed_mean"] == 3.0
    assert quality.iqr_fence(v, "v").first()["fence"] == 11.13
    assert stats.five_numbers(v, "v").first()["skew"] == 0.8483


def test_auc_ties_and_psi(spark):
    d = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1)], "s double, y int")
    assert stats.auc(d, "s", "y").first()["auc"] == 0.75
    v = spark.range(200).selectExpr("cast(id as double) v")
    assert stats.psi_quantile(v, v, "v").first()["psi"] == 0.0 and stats.psi_unique(v, v, "v").first()["psi"] == 0.0
    assert stats.psi_unique(v.selectExpr("1.0D v"), v, "v").first()["psi"] is None
    assert stats.psi_quantile(v, v.selectExpr("v + 150 v"), "v").first()["psi"] > 0.25


def test_feature_scores_read_their_measures_once(spark):
    """Neither rule joins its rows with themselves: all measures of all features would be computed again each time."""
    x = spark.range(5).selectExpr("cast(id as string) feature", "0.4 + id / 20 auc", "id / 10.0D mi", "id / 10.0D abs_spearman", "0.1D psi", "0.0D missing_rate", "id / 1000.0D - 0.001D permutation", "id * 1.0D gain")
    r = features.diagnostic_status(features.goodness(x).join(x.select("feature", "permutation", "gain"), "feature"))
    assert r._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    assert [tuple(y) for y in r.orderBy("feature").collect()] == [("0", 0.235, "drop_candidate"), ("1", 0.365, "drop_candidate"), ("2", 0.6, "keep"), ("3", 0.8, "keep"), ("4", 1.0, "keep")]


def test_measures_of_all_columns_agree_with_each_alone(spark):
    """With ties, nulls, a column without values, a constant one, and rows of the other frame outside the edges."""
    d = spark.range(300).selectExpr("cast(id % 37 as double) f1", "if(id % 7 = 0, null, id * id) f2", "cast(null as double) f3", "1.5D f4", "if(id % 11 = 0, null, cast(id % 3 = 0 OR id > 250 as int)) y")
    train, other = d.limit(200), d.where("f1 > 5 OR f2 > 60000")
    got = {r["feature"]: r for r in stats.label_measures(train, other, ["f1", "f2", "f3", "f4"], "y").collect()}
    for c in ("f1", "f2", "f3", "f4"):
        rho = None if c in ("f3", "f4") else stats.spearman(other, c, "y").first()["rho"]  # alone, it stops at a constant
        want = (stats.auc(other, c, "y").first()["auc_reflected"], stats.mutual_information(train, c, "y").first()["mi"], rho if rho is None else abs(rho), stats.psi_unique(train, other, c).first()["psi"], train.where(f"{c} IS NULL").count() / 200)
        assert [x if x is None else pytest.approx(x, abs=1e-9) for x in want] == list(got[c])[1:], c


def test_two_samples(spark):
    d = spark.createDataFrame([(float(i), i < 5) for i in range(10)], "v double, f boolean")
    r = stats.two_sample(d, "v", F.col("f")).first()
    assert (r["ks"], r["w1"], r["n1"], r["n0"]) == (1.0, 5.0, 5, 5)


def test_oof_never_uses_the_own_fold(spark):
    y = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "k int, y int, fold int")
    e = spark.createDataFrame([(i, j) for i in range(11) for j in (i % 4, 9)], "k int, s int")
    before = {r["k"]: r["encoded"] for r in features.oof_encode(y, e, "k", "s", "y").collect()}
    labels = {i: (i % 2, i % 3) for i in range(12)}
    gm = 0.5

    def refit(k):
        own = {j for i, j in [(i, j) for i in range(11) for j in (i % 4, 9)] if i == k}
        if not own:
            return gm
        rates = []
        for s in own:
            seen = [labels[i][0] for i in range(11) if s in (i % 4, 9) and labels[i][1] != labels[k][1]]
            rates.append((sum(seen) + 20 * gm) / (len(seen) + 20))
        return sum(rates) / len(rates)

    assert all(math.isclose(before[k], refit(k), abs_tol=1e-6) for k in range(12))


def test_fitted_parameters_come_from_training_rows(spark):
    train = spark.createDataFrame([(float(i), None if i % 5 == 0 else 2.0 * i) for i in range(100)], "a double, b double")
    other = spark.createDataFrame([(1e9, None), (None, 5.0)], "a double, b double")
    cap = features.QuantileCap.fit(train, ["a"])
    assert cap.transform(other).first()["a"] == pytest.approx(98.01)
    imp = impute.ChainedImputer.fit(train, ["a", "b"])
    done = imp.transform(train).collect()
    assert all(r["b"] == pytest.approx(2 * r["a"], abs=1.5) for r in done)
    seen = [(r["a"], r["b"]) for r in train.collect() if r["b"] is not None]
    assert seen == [(r["a"], r["b"]) for r in done if int(r["a"]) % 5]
    assert impute.ConstantFill.fit(train, ["b"]).transform(other).collect()[0]["b"] == 100.0
    plan = features.FeaturePlan.fit(train, [features.FeatureRule("a", action="drop"), features.FeatureRule("b", fill="mean")])
    assert plan.transform(other).columns == ["b"] and json.dumps(plan.fills)


def test_joins_do_not_multiply(spark):
    e = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 9)], "k int, s int")
    p = spark.createDataFrame([(5, 10.0, "x"), (6, 20.0, "y")], "s int, birth double, job string")
    agg = clean.person_aggregate(e, p, "k", "s", "dir", "birth", "job")
    rows = {r["k"]: r for r in clean.wide_join(spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k", aggregates=[agg]).collect()}
    assert len(rows) == 3 and (rows[1]["dir_count"], rows[1]["dir_avg_birth"], rows[1]["dir_jobs"], rows[3]["dir_count"]) == (2, 15.0, "x,y", 0)
    assert quality.fanout(e, "k").first()["status"] == "fail"
    assert {r["only_first"] for r in relate.pair_difference(e, e).collect()} == {0}


def test_models_learn(spark):
    d = spark.range(400).selectExpr("id k", "cast(id % 20 as double) a", "cast(id % 7 as double) b", "cast(id % 20 > 9 as int) y")
    (x,) = models.scaled(d, [d], ["a", "b"])
    m = models.logistic(400).fit(x)
    assert models.evaluate(models.probability(m, x)).first()["auc"] > 0.99
    drop = {r["feature"]: r["auc_drop"] for r in models.permutation_importance(m, lambda df: models.scaled(d, [df], ["a", "b"])[0], d, "k", ["a", "b"]).collect()}
    assert drop["a"] > 0.2 and abs(drop["b"]) < 0.1
    assert [r["value"] for r in models.predictions(models.probability(m, x), "k").limit(2).collect()] == ["False", "False"]
    assert models.grid(a=(1, 2), b=("x",)) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def test_folds_are_round_robin_in_the_order_of_the_hash(spark):
    rows = [(i, i % 3 if i % 7 else None) for i in range(500)]
    got = {r["k"]: r["fold"] for r in features.stratified_folds(spark.createDataFrame(rows, "k long, y int"), "k", "y").collect()}
    for label in (0, 1, 2, None):
        own = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, y in rows if y == label)
        assert [got[k] for _, k in own] == [(i + 1) % 5 for i in range(len(own))]
