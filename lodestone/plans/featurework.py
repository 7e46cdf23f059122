"""Features, target encoding and distribution statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, impute, models, quality, stats
from . import tables as t
from .registry import query
from .tables import EDGES, MOVIES, with_sql


@query(r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS len, CAST(len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count,
CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS has_digit, CASE WHEN contains(text, ':') THEN 1 ELSE 0 END AS has_colon, CASE WHEN contains(text, '?') THEN 1 ELSE 0 END AS has_question,
round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS upper_ratio FROM documents""")
def fea_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    return docs.select("doc_id", *[c.alias(n) for n, c in features.lexical(F.col("text")).items()])


@query(with_sql(MOVIES) + "SELECT k, CASE WHEN yr IS NULL THEN 1 ELSE 0 END AS yr_missing, CASE WHEN yr IS NOT NULL AND k % 4 <> 0 THEN greatest(2000 - yr, 0) ELSE 0 END AS span FROM movies")
def fea_flags_span(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("k") % 4 != 0, F.lit(2000))
    return t.movies(spark, d).select("k", features.missing_flag(F.col("yr")).alias("yr_missing"), features.year_span(F.col("yr"), end).alias("span"))


@query(with_sql(MOVIES, EDGES) + """, a AS (SELECT k, count(s) AS n, count(DISTINCT s) AS u FROM pe GROUP BY k), sh AS (SELECT DISTINCT pe.k FROM pe JOIN wp ON pe.k = wp.k AND pe.s = wp.p)
SELECT movies.k, CAST(coalesce(n, 0) AS BIGINT) AS num_people, CAST(coalesce(u, 0) AS BIGINT) AS num_unique_people, CASE WHEN sh.k IS NULL THEN 0 ELSE 1 END AS is_shared FROM movies LEFT JOIN a ON a.k = movies.k LEFT JOIN sh ON sh.k = movies.k""")
def fea_counts_auteur(spark: SparkSession, d: str) -> DataFrame:
    e, p = t.people_edges(spark, d), t.part_edges(spark, d)
    out = features.edge_counts(t.movies(spark, d).select("k"), e, "k", "s", "people")
    return out.join(features.shared_member(e, p, "k", "s", "p"), "k", "left").na.fill(0, ["is_shared"])


@query(with_sql(MOVIES) + "SELECT cust, CAST(count(*) AS BIGINT) AS group_size, CAST(count(DISTINCT yr) AS BIGINT) AS unique_years, CASE WHEN count(DISTINCT yr) > 1 THEN 1 ELSE 0 END AS conflicting_years FROM movies WHERE split = 'train' GROUP BY cust")
def fea_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return features.group_statistics(t.movies(spark, d).where("split = 'train'"), "cust", "yr")


_FOLDS = """, f AS (SELECT k, y, cust, CAST(row_number() OVER (PARTITION BY y ORDER BY md5(CAST(k AS VARCHAR)), k) % 5 AS INTEGER) AS fold FROM movies WHERE split = 'train'), g AS (SELECT avg(CAST(y AS DOUBLE)) AS gm FROM f)"""


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return features.stratified_folds(t.movies(spark, d).where("split = 'train'"), "k", "y")


@query(with_sql(MOVIES) + _FOLDS + "SELECT k, y, fold FROM f")
def fea_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d).select("k", "y", "fold")


def _oof(edges: str, entity: str) -> str:
    return f""", e AS (SELECT DISTINCT k, {entity} AS e FROM {edges}), ey AS (SELECT e.k, e, y, fold FROM e JOIN f ON e.k = f.k), tot AS (SELECT e, sum(y) AS s, count(*) AS c FROM ey GROUP BY e), tf AS (SELECT e, fold, sum(y) AS s, count(*) AS c FROM ey GROUP BY e, fold),
    r AS (SELECT ey.k, avg((tot.s - tf.s + 20 * gm) / (tot.c - tf.c + 20)) AS r FROM ey JOIN tot ON ey.e = tot.e JOIN tf ON tf.e = ey.e AND tf.fold = ey.fold CROSS JOIN g GROUP BY ey.k)
    SELECT f.k, round(coalesce(r, gm), 6) AS encoded FROM f CROSS JOIN g LEFT JOIN r ON r.k = f.k"""


@query(with_sql(MOVIES, EDGES) + _FOLDS + _oof("pe", "s"))
def fea_oof_entity(spark: SparkSession, d: str) -> DataFrame:
    return features.oof_encode(_folds(spark, d), t.people_edges(spark, d), "k", "s", "y")


@query(with_sql(MOVIES, EDGES) + _FOLDS + _oof("f", "cust"))
def fea_oof_group(spark: SparkSession, d: str) -> DataFrame:
    f = _folds(spark, d)
    return features.oof_encode(f, f.select("k", "cust"), "k", "cust", "y")


@query(with_sql(MOVIES, EDGES) + """, g AS (SELECT avg(CAST(y AS DOUBLE)) AS gm FROM movies WHERE split = 'train'), r AS (SELECT s, (sum(y) + 20 * max(gm)) / (count(*) + 20) AS rate FROM (SELECT DISTINCT k, s FROM pe) JOIN movies USING (k) CROSS JOIN g WHERE split = 'train' GROUP BY s),
x AS (SELECT e.k, avg(coalesce(rate, gm)) AS rate FROM (SELECT DISTINCT k, s FROM pe) e JOIN movies USING (k) LEFT JOIN r ON r.s = e.s CROSS JOIN g WHERE split <> 'train' GROUP BY e.k)
SELECT movies.k, round(coalesce(rate, gm), 6) AS encoded FROM movies CROSS JOIN g LEFT JOIN x ON x.k = movies.k WHERE split <> 'train'""")
def fea_apply_lookup(spark: SparkSession, d: str) -> DataFrame:
    m, e = t.movies(spark, d), t.people_edges(spark, d)
    train = m.where("split = 'train'")
    rates = features.fit_rates(train, e, "k", "s", "y")
    return features.apply_rates(m.where("split <> 'train'"), e, rates, train.agg(F.avg(F.col("y").cast("double")).alias("gm")), "k", "s")


@query(with_sql(MOVIES, EDGES) + """, r AS (SELECT s, avg(CAST(y AS DOUBLE)) AS rate, count(DISTINCT pe.k) AS n FROM pe JOIN movies ON pe.k = movies.k WHERE split = 'train' GROUP BY s),
p AS (SELECT k, round(avg(rate), 6) AS avg_rate, round(max(rate), 6) AS max_rate, sum(n) AS experience, count(*) AS n_people FROM (SELECT DISTINCT k, s FROM pe) e JOIN r USING (s) GROUP BY k)
SELECT movies.k, coalesce(avg_rate, 0.5) AS avg_rate, coalesce(max_rate, 0.5) AS max_rate, CAST(coalesce(experience, 0) AS BIGINT) AS experience, CAST(coalesce(n_people, 0) AS BIGINT) AS n_people FROM movies LEFT JOIN p ON p.k = movies.k""")
def fea_person_history(spark: SparkSession, d: str) -> DataFrame:
    m, e = t.movies(spark, d), t.people_edges(spark, d)
    rates = quality.success_rate(e, m.where("split = 'train'"), "k", "s", "y")
    return features.person_history(m.select("k"), e, rates, "k", "s", "rate", "n_keys")


@query(with_sql(MOVIES) + """, q AS (SELECT quantile_cont(votes, 0.01) AS a, quantile_cont(votes, 0.99) AS b FROM movies WHERE split = 'train') SELECT k, round(greatest(least(votes, b), a), 4) AS votes_capped FROM movies, q""")
def fea_quantile_cap(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    cap = features.QuantileCap.fit(m.where("split = 'train'"), ["votes"])
    return cap.transform(m, "_capped").select("k", F.round("votes_capped", 4).alias("votes_capped"))


@query(with_sql(MOVIES) + """, z AS (SELECT k, split, CAST(yr AS DOUBLE) AS yr, CASE WHEN k % 7 <> 0 THEN votes END AS votes, CASE WHEN k % 9 <> 0 THEN 1.0::DOUBLE END AS cnt FROM movies),
q AS (SELECT quantile_cont(votes, 0.01) AS a, quantile_cont(votes, 0.99) AS b FROM z WHERE split = 'train'), c AS (SELECT k, split, yr, CASE WHEN votes IS NOT NULL THEN greatest(least(votes, b), a) END AS votes, cnt FROM z, q),
m AS (SELECT quantile_cont(yr, 0.5) AS yr, avg(votes) AS votes FROM c WHERE split = 'train')
SELECT c.k, coalesce(c.yr, m.yr) AS yr, round(coalesce(c.votes, m.votes), 4) AS votes, coalesce(cnt, 0) AS cnt FROM c, m""")
def fea_registry_impute(spark: SparkSession, d: str) -> DataFrame:
    z = t.movies(spark, d).select("k", "split", "status", F.col("yr").cast("double").alias("yr"), F.when(F.col("k") % 7 != 0, F.col("votes")).alias("votes"), F.when(F.col("k") % 9 != 0, F.lit(1.0)).alias("cnt"))
    rules = [features.FeatureRule("yr", fill="median"), features.FeatureRule("votes", fill="mean", cap=True), features.FeatureRule("cnt", fill="zero"), features.FeatureRule("status", action="drop")]
    out = features.FeaturePlan.fit(z.where("split = 'train'"), rules).transform(z)
    return out.select("k", "yr", F.round("votes", 4).alias("votes"), "cnt")


@query(with_sql(EDGES) + "SELECT k, string_agg(x, ' ' ORDER BY x) AS bag FROM (SELECT DISTINCT k, 'person_' || CAST(s AS VARCHAR) AS x FROM pe UNION ALL SELECT DISTINCT k, 'part_' || CAST(p AS VARCHAR) FROM wp) GROUP BY k")
def fea_token_bag(spark: SparkSession, d: str) -> DataFrame:
    return features.token_bag([(t.people_edges(spark, d), "s", "person"), (t.part_edges(spark, d), "p", "part")], "k")


def _tfidf(most: int) -> str:
    return rf"""WITH d AS (SELECT p_partkey AS k, lower(p_name || ' ' || p_brand || ' ' || p_type) AS x, p_size % 2 AS y FROM part), w AS (SELECT k, regexp_extract_all(x, '(\w\w+)', 1) AS w FROM d),
tm AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT k, term, count(*) AS tf FROM tm GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {most}), n AS (SELECT count(*) AS n FROM d),
raw AS (SELECT k, tf.term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN v ON tf.term = v.term, n), nm AS (SELECT k, sqrt(sum(w * w)) AS nm FROM raw GROUP BY k), u AS (SELECT raw.k, term, w / nm AS w FROM raw JOIN nm ON raw.k = nm.k)"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("x"), (F.col("p_size") % 2).alias("y"))


@query(_tfidf(5000) + " SELECT k, term, round(w, 6) AS w FROM u")
def fea_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return features.tfidf(_titles(spark, d), "k", "x", 5000).withColumn("w", F.round("w", 6))


_CENTROID = """, c AS (SELECT y, term, sum(w) AS s FROM u JOIN d ON u.k = d.k GROUP BY y, term), cn AS (SELECT y, sqrt(sum(s * s)) AS nm FROM c GROUP BY y), cs AS (SELECT u.k, c.y, sum(w * s) / max(nm) AS cos FROM u JOIN c ON u.term = c.term JOIN cn ON cn.y = c.y GROUP BY u.k, c.y)
SELECT d.k, round(coalesce(a.cos, 0), 6) AS sim_1, round(coalesce(b.cos, 0), 6) AS sim_0, round(coalesce(a.cos, 0) - coalesce(b.cos, 0), 6) AS margin FROM d LEFT JOIN cs a ON a.k = d.k AND a.y = 1 LEFT JOIN cs b ON b.k = d.k AND b.y = 0"""


@query(_tfidf(5000) + _CENTROID)
def fea_tfidf_centroid(spark: SparkSession, d: str) -> DataFrame:
    x = _titles(spark, d)
    return features.centroid_similarity(features.tfidf(x, "k", "x", 5000), x, x, "k", "y")


_CENTROID_OOF = """, f AS (SELECT k, y, k % 3 AS fold FROM d), sf AS (SELECT y, fold, term, sum(w) AS s FROM u JOIN f ON u.k = f.k GROUP BY ALL), tt AS (SELECT y, term, sum(s) AS t FROM sf GROUP BY ALL),
c AS (SELECT tt.y, tt.term, z.fold, tt.t - coalesce(sf.s, 0) AS s FROM tt CROSS JOIN (SELECT DISTINCT fold FROM f) z LEFT JOIN sf ON sf.y = tt.y AND sf.term = tt.term AND sf.fold = z.fold), cn AS (SELECT y, fold, sqrt(sum(s * s)) AS nm FROM c GROUP BY ALL),
cs AS (SELECT u.k, c.y, sum(w * s) / max(nm) AS cos FROM u JOIN f ON f.k = u.k JOIN c ON u.term = c.term AND c.fold = f.fold JOIN cn ON cn.y = c.y AND cn.fold = c.fold GROUP BY u.k, c.y)
SELECT f.k, round(coalesce(a.cos, 0), 6) AS sim_1, round(coalesce(b.cos, 0), 6) AS sim_0, round(coalesce(a.cos, 0) - coalesce(b.cos, 0), 6) AS margin FROM f LEFT JOIN cs a ON a.k = f.k AND a.y = 1 LEFT JOIN cs b ON b.k = f.k AND b.y = 0"""


@query(_tfidf(800) + _CENTROID_OOF)
def fea_tfidf_centroid_oof(spark: SparkSession, d: str) -> DataFrame:
    x = _titles(spark, d).withColumn("fold", (F.col("k") % 3).cast("int"))
    return features.centroid_similarity(features.tfidf(x, "k", "x", 800), x, x, "k", "y", "fold")


def _psi_a(c: str, other: str) -> str:
    return f"""psi_{c}_{other} AS (WITH e AS (SELECT quantile_cont({c}::DOUBLE, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS i, min({c})::DOUBLE - 1e-6 AS lo, max({c})::DOUBLE + 1e-6 AS hi FROM movies WHERE split = 'train'), g AS (SELECT unnest(range(10)) AS b),
    a AS (SELECT len(list_filter(i, lambda x: x <= {c})) AS b, count(*) AS n FROM movies, e WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1), o AS (SELECT len(list_filter(i, lambda x: x <= {c})) AS b, count(*) AS n FROM movies, e WHERE split = '{other}' AND {c} BETWEEN lo AND hi GROUP BY 1),
    z AS (SELECT coalesce(a.n::DOUBLE, 0.5) AS p, coalesce(o.n::DOUBLE, 0.5) AS q FROM g LEFT JOIN a ON a.b = g.b LEFT JOIN o ON o.b = g.b), s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM z) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s)"""


@query(with_sql(MOVIES, _psi_a("votes", "val")) + "SELECT psi FROM psi_votes_val")
def sta_psi_a(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return stats.psi_quantile(m.where("split = 'train'"), m.where("split = 'val'"), "votes")


@query(with_sql(MOVIES) + """, e AS (SELECT list_sort(list_distinct(quantile_cont(yr::DOUBLE, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e FROM movies WHERE split = 'train'),
b AS (SELECT split, greatest(len(list_filter(e, lambda x: x < yr)), 1) AS b FROM movies, e WHERE yr BETWEEN e[1] AND e[len(e)] AND split IN ('train', 'test')), c AS (SELECT split, b, count(*) / sum(count(*)) OVER (PARTITION BY split) AS s FROM b GROUP BY split, b),
z AS (SELECT greatest(coalesce(p.s, 1e-6), 1e-6) AS p, greatest(coalesce(q.s, 1e-6), 1e-6) AS q FROM (SELECT * FROM c WHERE split = 'train') p FULL OUTER JOIN (SELECT * FROM c WHERE split = 'test') q ON p.b = q.b)
SELECT CASE WHEN (SELECT len(e) FROM e) >= 3 THEN round(sum((q - p) * ln(q / p)), 6) END AS psi FROM z""")
def sta_psi_b(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return stats.psi_unique(m.where("split = 'train'"), m.where("split = 'test'"), "yr")


def _steps(value: str, flag: str, src: str) -> str:
    return f"""v AS (SELECT {value}::DOUBLE AS v, count(CASE WHEN {flag} THEN 1 END) AS c1, count(CASE WHEN NOT ({flag}) THEN 1 END) AS c0 FROM {src} WHERE {value} IS NOT NULL GROUP BY 1),
    s AS (SELECT sum(c1) OVER w / CAST(sum(c1) OVER () AS DOUBLE) - sum(c0) OVER w / CAST(sum(c0) OVER () AS DOUBLE) AS gap, lead(v) OVER (ORDER BY v) - v AS dv FROM v WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""


@query(with_sql(MOVIES, _steps("votes", "y = 1", "movies")) + "SELECT round(max(abs(gap)), 6) AS ks, round(sum(abs(gap) * dv), 4) AS w1, (SELECT CAST(sum(c1) AS BIGINT) FROM v) AS n1, (SELECT CAST(sum(c0) AS BIGINT) FROM v) AS n0 FROM s")
def sta_ks_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    r = stats.two_sample(t.movies(spark, d), "votes", F.col("y") == 1)
    return r.withColumns({"ks": F.round("ks", 6), "w1": F.round("w1", 4)})


@query(with_sql(MOVIES) + """, r AS (SELECT y, rank() OVER (ORDER BY yr) + (count(*) OVER (PARTITION BY yr) - 1) / 2.0 AS r FROM movies WHERE yr IS NOT NULL), z AS (SELECT sum(CASE WHEN y = 1 THEN r END)::DOUBLE AS r1, sum(y) AS n1, count(*) - sum(y) AS n0 FROM r), a AS (SELECT (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS a, n1, n0 FROM z)
SELECT round(a, 6) AS auc, round(greatest(a, 1 - a), 6) AS auc_reflected, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0 FROM a""")
def sta_auc(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(t.movies(spark, d), "yr", "y").withColumns({"auc": F.round("auc", 6), "auc_reflected": F.round("auc_reflected", 6)})


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r""")
def sta_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(t.lines(spark, d), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("SELECT p_partkey AS k, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM part")
def sta_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_pct(t.read(spark, d, "part"), "p_size", "pct").select(F.col("p_partkey").alias("k"), F.round("pct", 6).alias("pct"))


def _corr(src: str, name: str) -> str:
    return f"{name} AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM {src})"


@query("WITH z AS (SELECT l_orderkey, l_extendedprice, l_discount, CASE WHEN l_orderkey % 5 = 0 THEN 25.0 ELSE l_quantity END AS l_quantity FROM lineitem), " + _corr("lineitem", "p") + ", " + _corr("z", "q") + """
SELECT round(greatest(abs(q.a - p.a), abs(q.b - p.b), abs(q.c - p.c)), 6) AS max_change, round(sqrt(2 * ((q.a - p.a) ** 2 + (q.b - p.b) ** 2 + (q.c - p.c) ** 2)), 6) AS frobenius FROM p, q""")
def sta_corr_frobenius(spark: SparkSession, d: str) -> DataFrame:
    x = t.lines(spark, d)
    z = x.withColumn("l_quantity", F.when(F.col("l_orderkey") % 5 == 0, 25.0).otherwise(F.col("l_quantity")))
    return stats.correlation_shift(x, z, ("l_quantity", "l_extendedprice", "l_discount"))


@query("WITH z AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(a, b), 6) AS r FROM z UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(a, c), 6) FROM z UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(b, c), 6) FROM z")
def sta_correlations(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(t.lines(spark, d), ("l_quantity", "l_extendedprice", "l_discount")).withColumn("r", F.round("r", 6))


@query(with_sql(MOVIES) + """, e AS (SELECT quantile_cont(votes, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS i FROM movies), c AS (SELECT len(list_filter(i, lambda x: x <= votes)) AS b, y, count(*) AS c FROM movies, e GROUP BY 1, 2),
m AS (SELECT c::DOUBLE AS c, sum(c) OVER (PARTITION BY b) AS cb, sum(c) OVER (PARTITION BY y) AS cy, sum(c) OVER () AS n FROM c) SELECT round(sum(c / n * ln(c * n / (cb * cy))), 6) AS mi FROM m""")
def sta_mi_binned(spark: SparkSession, d: str) -> DataFrame:
    return stats.mutual_information(t.movies(spark, d), "votes", "y")


_SCORED = ", sc AS (SELECT y, votes / 500000 AS p FROM movies)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return t.movies(spark, d).select("k", "y", (F.col("votes") / 500000).alias("p"))


@query(with_sql(MOVIES) + _SCORED + """, x AS (SELECT i AS step, CAST(sum(CASE WHEN floor(p * 20) >= i THEN y ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN floor(p * 20) >= i THEN 1 - y ELSE 0 END) AS BIGINT) AS fp, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM sc, range(21) r(i) GROUP BY i)
SELECT step / 20.0::DOUBLE AS threshold, tp, fp, pos - tp AS fn, neg - fp AS tn, round((tp + neg - fp) / CAST(pos + neg AS DOUBLE), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision, round(tp / CAST(pos AS DOUBLE), 6) AS sensitivity, round((neg - fp) / CAST(neg AS DOUBLE), 6) AS specificity,
round(2 * tp / CAST(2 * tp + fp + pos - tp AS DOUBLE), 6) AS f1, round(tp / CAST(pos AS DOUBLE) + (neg - fp) / CAST(neg AS DOUBLE) - 1, 6) AS youden FROM x""")
def sta_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return stats.threshold_sweep(_scored(spark, d), "p", "y")


@query(with_sql(MOVIES) + _SCORED + "SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_score, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM sc GROUP BY 1")
def sta_calibration(spark: SparkSession, d: str) -> DataFrame:
    return stats.calibration(_scored(spark, d), "p", "y")


def _drift(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'val' AS against, psi, (SELECT round(max(abs(gap)), 6) FROM s_{c}) AS ks, (SELECT round(avg({c}), 4) FROM movies WHERE split = 'train') AS mean_train, (SELECT round(avg({c}), 4) FROM movies WHERE split = 'val') AS mean_other, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate_shift' ELSE 'high_shift' END AS status FROM psi_{c}_val"""


def _named_steps(c: str) -> str:
    return _steps(c, "split = 'train'", "movies_tv").replace("v AS (SELECT", f"v_{c} AS (SELECT", 1).replace("s AS (SELECT sum", f"s_{c} AS (SELECT sum", 1).replace("FROM v WINDOW", f"FROM v_{c} WINDOW")


@query(with_sql(MOVIES, "movies_tv AS (SELECT * FROM movies WHERE split <> 'test')", _psi_a("votes", "val"), _psi_a("yr", "val"), _named_steps("votes"), _named_steps("yr")) + _drift("votes") + " UNION ALL " + _drift("yr"))
def sta_drift_table(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return stats.drift_table(m.where("split = 'train'"), m.where("split = 'val'"), ("votes", "yr"), "val")


@query(with_sql(MOVIES) + """, z AS (SELECT priority, votes AS v, k % 10 = 3 AS f FROM movies), c AS (SELECT priority, v, count(CASE WHEN f THEN 1 END) AS c1, count(CASE WHEN NOT f THEN 1 END) AS c0 FROM z GROUP BY priority, v),
s AS (SELECT priority, abs(sum(c1) OVER w / CAST(sum(c1) OVER p AS DOUBLE) - sum(c0) OVER w / CAST(sum(c0) OVER p AS DOUBLE)) AS gap, lead(v) OVER (PARTITION BY priority ORDER BY v) - v AS dv, sum(c1) OVER p AS n1, sum(c0) OVER p AS n0 FROM c WINDOW w AS (PARTITION BY priority ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY priority)),
r AS (SELECT priority, max(n0)::DOUBLE AS n0, max(n1)::DOUBLE AS n1, max(gap) AS ks, sum(gap * dv) AS w1 FROM s GROUP BY priority HAVING max(n0) >= 5 AND max(n1) >= 2), x AS (SELECT *, (sqrt(n1 * n0 / (n1 + n0)) + 0.12 + 0.11 / sqrt(n1 * n0 / (n1 + n0))) * ks AS x FROM r),
p AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (SELECT sum(CASE WHEN i % 2 = 1 THEN CAST(2 AS DOUBLE) ELSE CAST(-2 AS DOUBLE) END * exp(-2 * CAST(i * i AS DOUBLE) * x * x)) FROM range(1, 41) q(i)))) END::DOUBLE AS p FROM x)
SELECT priority, CAST(n0 AS BIGINT) AS n_observed, CAST(n1 AS BIGINT) AS n_imputed, round(ks, 6) AS ks, round(w1, 4) AS w1, round(p, 6) AS p_value, CASE WHEN p >= 0.05 THEN 'plausible' ELSE 'suspicious' END AS status FROM p""")
def sta_conditional_shift(spark: SparkSession, d: str) -> DataFrame:
    return stats.shift_table(t.movies(spark, d), "votes", F.col("k") % 10 == 3, ["priority"])


@query("SELECT p_partkey AS k, CAST(round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS DOUBLE) AS p_size FROM part")
def sca_population(spark: SparkSession, d: str) -> DataFrame:
    p = t.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("p_size"))
    return models.scale_population(p, p, ["p_size"]).withColumn("p_size", F.round("p_size", 6))


@query("SELECT p_partkey AS k, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS a, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS b FROM part")
def sca_sample(spark: SparkSession, d: str) -> DataFrame:
    p = t.read(spark, d, "part")
    (s,) = models.scaled(p, [p], ["p_size", "p_retailprice"])
    return models.flatten(s.select(F.col("p_partkey").alias("k"), "features"), "features", ["a", "b"]).select("k", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(with_sql(MOVIES) + ", m AS (SELECT quantile_cont(yr::DOUBLE, 0.5) AS yr FROM movies WHERE split = 'train') SELECT k, coalesce(movies.yr::DOUBLE, m.yr) AS yr FROM movies, m")
def imp_median(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return impute.ConstantFill.fit(m.where("split = 'train'"), ["yr"]).transform(m).select("k", "yr")
