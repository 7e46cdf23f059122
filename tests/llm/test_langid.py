import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import langid

WORDS = {"aa": ["the", "of", "thing", "shore", "ed"], "bb": ["le", "aux", "ment", "réau", "qui"], "cc": ["ung", "schein", "der", "über", "ich"]}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := "aabbcc"[i % 3 * 2 :][:2], 60), lang) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = langid.train(docs.where(~langid.held_out()), rows=30)
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.identify(docs, model).where(langid.held_out()).collect()
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"] == r["lang_pred"] and 0.9 < r["score"] <= 1 for r in got)


def test_mixtures_give_proportions(spark):
    docs = corpus(spark)
    model = langid.train(docs)
    rng = random.Random(2)
    mixed = text(rng, "aa", 300) + " " + text(rng, "bb", 100)
    (r,) = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert r["lang_pred"] == "aa" and 0.6 < r["score"] < 0.85
    assert [x["lang"] for x in r["languages"]] == ["aa", "bb"] and abs(sum(x["share"] for x in r["languages"]) - 1) < 1e-6


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(0)
    like, count = rng.dirichlet(np.ones(50), 3).T, rng.integers(1, 9, 50).astype(float)
    totals = [langid.proportions(count, like, np.full(3, 1 / 3), r)[1] for r in range(8)]
    assert all(b >= a - 1e-9 for a, b in zip(totals, totals[1:], strict=False))


def test_nulls_empty_and_odd_texts(spark):
    docs = corpus(spark)
    model = langid.train(docs.union(spark.createDataFrame([(1000, None, "zz"), (1001, "x", None), (None, "x", "yy")], docs.schema)))
    assert model.langs == ["aa", "bb", "cc"]
    rows = [(1, None, "p"), (2, "", "p"), (3, "12 34 !", "p"), (4, "é", "p"), (None, "the thing", "p"), (6, "the " * 200000, "p"), (6, "a", "p")]
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "aa"), (None, "aa")} <= got and len(got) <= 7
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_inference_agrees_with_plain_python():
    """Trigram likelihoods, mixture weights and the penalised choice of the set, spelled out without arrays."""
    rng = random.Random(5)
    docs = {lang: [text(rng, lang, 50) for _ in range(12)] for lang in WORDS}
    counts = {lang: {} for lang in WORDS}
    for lang, texts in docs.items():
        for t in texts:
            for g in langid.grams(np.frombuffer(t.encode(), dtype=np.uint8)).tolist():
                counts[lang][g] = counts[lang].get(g, 0) + 1
    size = 1 << langid.BITS
    like = {x: {g: (c.get(g, 0) + 0.05) / (sum(c.values()) + 0.05 * size) for g in range(size)} for x, c in counts.items()}
    model = langid.Model(sorted(WORDS), np.array([[like[x][g] for x in sorted(WORDS)] for g in range(size)]))

    def em(count, langs, start):
        w = dict(zip(langs, start, strict=True))
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for g, n in count.items():
                total = sum(w[x] * like[x][g] for x in langs)
                for x in langs:
                    new[x] += n * w[x] * like[x][g] / total
            w = {x: v / sum(count.values()) for x, v in new.items()}
        return w, sum(n * math.log(sum(w[x] * like[x][g] for x in langs)) for g, n in count.items())

    def brute(t):
        count = {}
        for g in langid.grams(np.frombuffer(t.encode(), dtype=np.uint8)).tolist():
            count[g] = count.get(g, 0) + 1
        langs = sorted(WORDS)
        share, _ = em(count, langs, [1 / 3] * 3)
        order = sorted(langs, key=lambda x: -share[x])
        alone = {x: sum(n * math.log(like[x][g]) for g, n in count.items()) for x in langs}
        one = max(langs, key=alone.__getitem__)
        chosen, best = {one: 1.0}, alone[one]
        price = langid.PENALTY * math.log(sum(count.values()) + 1)
        for k in (2, 3):
            if share[order[k - 1]] < langid.LEAST_SHARE:
                break
            some = [share[x] for x in order[:k]]
            w, total = em(count, order[:k], [x / sum(some) for x in some])
            if total - best <= price * (k - len(chosen)):
                break
            chosen, best = w, total
        return chosen

    for mix in ({"aa": 30}, {"aa": 60, "bb": 40}, {"aa": 50, "bb": 40, "cc": 45}, {"cc": 1}, {"bb": 90, "cc": 6}):
        t = " ".join(text(rng, lang, n) for lang, n in mix.items())
        found, weights = langid.infer(np.frombuffer(t.encode(), dtype=np.uint8), model)
        want = brute(t)
        assert {model.langs[k] for k in found} == set(want)
        assert all(abs(want[model.langs[k]] - w) < 1e-6 for k, w in zip(found, weights, strict=True)) and sorted(weights)[::-1] == list(weights)


def test_a_common_language_is_cut_to_the_least_hashes(spark):
    """The sample is that of a full ranking, though only low hashes are ranked."""
    docs = corpus(spark, 3000).withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "rare").otherwise("common"))
    rows = docs.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text").collect()
    counts = {}
    for lang in ("rare", "common"):
        for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["h"])[:20]:
            counts[lang] = counts.get(lang, 0) + np.bincount(langid.grams(np.frombuffer(r["text"].encode(), dtype=np.uint8)), minlength=1 << langid.BITS)
    model = langid.train(docs, rows=20)
    for k, lang in enumerate(model.langs):
        c = counts[lang] + 0.05
        assert np.allclose(model.likelihood[:, k], c / c.sum(), rtol=1e-12)
