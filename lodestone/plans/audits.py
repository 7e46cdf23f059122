"""Audits without a declared schema, and queries over many-to-many edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, features, quality, relate, stats
from ..sources.files import usable_edges
from . import tables as t
from .registry import query
from .tables import DIRTY, EDGES, MOVIES, NOTED, with_sql


def _profile(c: str, src: str) -> str:
    s = f"CAST({c} AS VARCHAR)"
    return f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
        CAST(count(try_cast(trim({s}) AS DOUBLE)) AS BIGINT) AS n_numeric, CAST(count(CASE WHEN regexp_matches({s}, '^[a-zA-Z]{{1,4}}[0-9]+$') THEN 1 END) AS BIGINT) AS n_id_like FROM {src}"""


@query(with_sql(MOVIES) + ", x AS (" + " UNION ALL ".join(_profile(c, "movies") for c in ("k", "yr", "priority", "price_text")) + """)
SELECT *, CASE WHEN n = n_null THEN 'empty' WHEN n_numeric > 0.5 * (n - n_null) THEN 'numeric' WHEN n_distinct > 0.9 * (n - n_null) AND n_id_like > 0.8 * (n - n_null) THEN 'id' ELSE 'text' END AS kind FROM x""")
def aud_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return audit.profile(t.movies(spark, d), ("k", "yr", "priority", "price_text"))


@query("""SELECT 'price_text' AS "column", 'string' AS declared, 'numeric' AS kind""")
def aud_dtype_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return audit.dtype_conflicts(t.movies(spark, d), ("k", "priority", "price_text"))


def _candidate(c: str, src: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, min(regexp_extract(CAST({c} AS VARCHAR), '^([a-zA-Z]+)', 1)) AS prefix,
        round(count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE), 6) AS uniqueness FROM {src} HAVING count({c}) > 10 AND count(DISTINCT {c}) >= 0.999 * count({c})"""


@query(" UNION ALL ".join(_candidate(c, "customer") for c in ("c_custkey", "c_name", "c_nationkey")))
def aud_key_candidates(spark: SparkSession, d: str) -> DataFrame:
    return audit.key_candidates(t.read(spark, d, "customer"), ("c_custkey", "c_name", "c_nationkey"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer), n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both)
SELECT *, round(100.0 * n_both / least(n_a, n_b), 4) AS pct_of_smaller FROM n""")
def aud_key_overlap(spark: SparkSession, d: str) -> DataFrame:
    return audit.key_overlap(t.read(spark, d, "orders"), t.read(spark, d, "customer"), "o_custkey", "c_custkey")


_ENTROPY = r""", c AS (SELECT price_text AS value, count(*) AS n FROM movies WHERE price_text IS NOT NULL GROUP BY 1), tot AS (SELECT sum(n) AS total FROM c),
ch AS (SELECT value, x, count(*) AS m, length(value) AS len FROM (SELECT value, unnest(string_split(value, '')) AS x FROM c WHERE n >= 10 AND value <> '') GROUP BY ALL),
h AS (SELECT value, -sum(m / CAST(len AS DOUBLE) * log2(m / CAST(len AS DOUBLE))) AS bits FROM ch GROUP BY value)
SELECT c.value, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / total, 6) AS share, abs(round(coalesce(bits, 0), 6)) AS bits FROM c CROSS JOIN tot LEFT JOIN h ON c.value = h.value
WHERE n >= 10 AND length(c.value) <= 10 AND n >= 0.01 * total AND coalesce(bits, 0) <= 1.5 AND try_cast(c.value AS DOUBLE) IS NULL"""


@query(with_sql(MOVIES) + _ENTROPY)
def aud_entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    return audit.entropy_tokens(t.movies(spark, d), "price_text")


@query("""WITH ch AS (SELECT doc_id, text, x, count(*) AS m, length(text) AS len FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS x FROM documents) GROUP BY ALL)
SELECT doc_id, abs(round(-sum(m / CAST(len AS DOUBLE) * log2(m / CAST(len AS DOUBLE))), 6)) AS bits FROM ch GROUP BY doc_id""")
def aud_char_entropy(spark: SparkSession, d: str) -> DataFrame:
    return t.documents(spark, d).select("doc_id", F.round(text.entropy(F.col("text")), 6).alias("bits"))


@query(with_sql(NOTED) + f""", u AS (SELECT text AS t, {t.norm_sql('text')} AS u FROM noted)
SELECT CAST(count(CASE WHEN t <> u THEN 1 END) AS BIGINT) AS n_changed, CAST(count(DISTINCT t) AS BIGINT) AS n_distinct, CAST(count(DISTINCT u) AS BIGINT) AS n_distinct_normalised, CAST(min(length(t)) AS BIGINT) AS shortest, CAST(max(length(t)) AS BIGINT) AS longest FROM u""")
def aud_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return audit.normalisation(t.noted_documents(spark, d), "text")


@query(with_sql(MOVIES) + """, q AS (SELECT quantile_cont(votes, 0.25) AS p25, quantile_cont(votes, 0.5) AS p50, quantile_cont(votes, 0.75) AS p75, avg(votes) AS mean, stddev_pop(votes) AS std, mad(votes) AS mad FROM movies)
SELECT CAST(count(*) AS BIGINT) AS n, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(mean, 4) AS mean, round(std, 4) AS std, round(mad, 4) AS mad,
CAST(count(CASE WHEN votes < p25 - 0.2 * (p75 - p25) OR votes > p75 + 0.2 * (p75 - p25) THEN 1 END) AS BIGINT) AS n_iqr, CAST(count(CASE WHEN abs(votes - p50) > 1.5 * mad THEN 1 END) AS BIGINT) AS n_mad FROM movies, q GROUP BY p25, p50, p75, mean, std, mad""")
def aud_mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return audit.robust_statistics(t.movies(spark, d), "votes", 0.2, 1.5)


_TRIM = " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, round(avg(votes), 4) AS trimmed_mean FROM movies WHERE votes BETWEEN (SELECT quantile_cont(votes, {a}) FROM movies) AND (SELECT quantile_cont(votes, {1 - a}) FROM movies)" for a in (0.05, 0.1, 0.25))


@query(with_sql(MOVIES) + _TRIM)
def aud_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return audit.trimmed_means(t.movies(spark, d), "votes")


@query("""WITH r AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS i, count(*) OVER () AS n FROM lineitem)
SELECT round(avg(v), 4) AS trimmed_mean, CAST(count(*) AS BIGINT) AS n_kept FROM r WHERE i > greatest(ceil(n * 0.05), 1) AND i <= n - greatest(ceil(n * 0.05), 1)""")
def aud_rank_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    r = audit.rank_trimmed_mean(t.lines(spark, d), "l_quantity", 0.05)
    return r.withColumn("n_kept", F.col("n_kept").cast("long"))


@query(with_sql(MOVIES) + ", m AS (SELECT median(votes) AS m FROM movies) SELECT k, votes, round(abs(votes - m), 4) AS distance FROM movies, m ORDER BY distance DESC, votes, k LIMIT 5")
def aud_extreme_values(spark: SparkSession, d: str) -> DataFrame:
    return audit.extreme_values(t.movies(spark, d), "votes", "k")


_FP_U = t.tokens_sql(t.fold_sql(r"regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', ' ', 'g')"))


@query(with_sql(NOTED) + f""", d AS (SELECT text FROM noted UNION ALL SELECT lang || ' ' || source FROM documents UNION ALL SELECT source || '-' || lang FROM documents)
SELECT fp, CAST(count(DISTINCT text) AS BIGINT) AS n_variants, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT text, {_FP_U} AS fp FROM d) WHERE fp <> '' GROUP BY fp HAVING count(DISTINCT text) > 1""")
def aud_fingerprint_collisions(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    made = docs.select(F.concat_ws(" ", "lang", "source").alias("text")).union(docs.select(F.concat("source", F.lit("-"), "lang")))
    return audit.fingerprint_collisions(t.noted_documents(spark, d).select("text").union(made), "text")


@query("""WITH g AS (SELECT count(*) AS c FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate HAVING count(*) > 1)
SELECT CAST(count(*) AS BIGINT) AS n_groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_surplus FROM g""")
def aud_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    x = t.lines(spark, d)
    return audit.exact_duplicates(x.union(x.where("l_returnflag = 'R'")))


@query(with_sql(MOVIES) + r""", z AS (SELECT CASE WHEN yr IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS a, CASE WHEN price_text IN ('\N', '') THEN 1.0 ELSE 0.0 END::DOUBLE AS b, CASE WHEN k % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS c FROM movies)
SELECT 'yr' AS a, 'price' AS b, round(corr(a, b), 6) AS r FROM z UNION ALL SELECT 'yr', 'votes', round(corr(a, c), 6) FROM z UNION ALL SELECT 'price', 'votes', round(corr(b, c), 6) FROM z""")
def aud_mcar_corr(spark: SparkSession, d: str) -> DataFrame:
    z = t.movies(spark, d).select("yr", F.when(~F.col("price_text").isin(r"\N", ""), F.col("price_text")).alias("price"), F.when(F.col("k") % 4 != 1, F.col("votes")).alias("votes"))
    return audit.indicator_correlation(z, ("yr", "price", "votes"))


@query("""WITH p AS (SELECT p_type AS a, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS b FROM part), n AS (SELECT (SELECT count(DISTINCT a) FROM p) AS n_a, (SELECT count(DISTINCT b) FROM p) AS n_b, (SELECT count(*) FROM (SELECT a FROM p INTERSECT SELECT b FROM p)) AS n_both)
SELECT CAST(count(CASE WHEN a = b THEN 1 END) AS BIGINT) AS n_equal, max(n_a) AS n_a, max(n_b) AS n_b, max(n_both) AS n_both, round(100.0 * max(n_both) / least(max(n_a), max(n_b)), 4) AS pct_of_smaller, round(100.0 * count(CASE WHEN a = b THEN 1 END) / count(*), 4) AS equal_pct FROM p, n""")
def aud_pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = t.read(spark, d, "part").select(F.col("p_type").alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("b"))
    return audit.pair_statistics(p, "a", "b")


@query(with_sql(MOVIES) + """SELECT 'early' AS rule, CAST(count(CASE WHEN yr < 1996 THEN 1 END) AS BIGINT) AS n, CASE WHEN count(CASE WHEN yr < 1996 THEN 1 END) = 0 THEN 'PASS' ELSE 'WARN' END AS status FROM movies UNION ALL SELECT 'negative', CAST(count(CASE WHEN votes < 0 THEN 1 END) AS BIGINT), CASE WHEN count(CASE WHEN votes < 0 THEN 1 END) = 0 THEN 'PASS' ELSE 'WARN' END FROM movies""")
def aud_suspicious_rules(spark: SparkSession, d: str) -> DataFrame:
    return audit.suspicious(t.movies(spark, d), {"early": "yr < 1996", "negative": "votes < 0"})


@query(with_sql(MOVIES) + """SELECT 'y' AS "column", CAST(count(DISTINCT y) AS BIGINT) AS n_distinct FROM movies""")
def aud_label_columns(spark: SparkSession, d: str) -> DataFrame:
    return audit.label_columns(t.movies(spark, d), ("y", "split", "status"))


@query(with_sql(MOVIES) + """, z AS (SELECT price_text AS p, try_cast(price_text AS DOUBLE) AS q FROM movies)
SELECT 'price_text' AS "column", CAST(count(p) AS BIGINT) AS n_raw, CAST(count(DISTINCT p) AS BIGINT) AS n_distinct_raw, CAST(count(q) AS BIGINT) AS n_clean, CAST(count(DISTINCT q) AS BIGINT) AS n_distinct_clean, CAST(count(p) - count(q) AS BIGINT) AS n_lost FROM z""")
def aud_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return audit.parse_errors(m, m.select(F.col("price_text").try_cast("double").alias("price_text")), ("price_text",))


@query(with_sql(MOVIES) + """SELECT yr IS NULL AS missing, CAST(count(*) AS BIGINT) AS n, round(avg(votes), 4) AS mean_votes, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM movies GROUP BY 1""")
def agg_by_indicator(spark: SparkSession, d: str) -> DataFrame:
    return t.movies(spark, d).groupBy(F.col("yr").isNull().alias("missing")).agg(F.count("*").alias("n"), F.round(F.avg("votes"), 4).alias("mean_votes"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))


@query("SELECT CAST(least(greatest(floor((l_quantity - 5) / 5) + 1, 0), 9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def agg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(t.lines(spark, d), "l_quantity", 5, 45, 8)


@query("""WITH m AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(avg(pow((l_extendedprice - mu) / sd, 3)), 4) AS skew, min(l_extendedprice) AS least,
round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, max(l_extendedprice) AS most FROM lineitem, m""")
def agg_five_numbers(spark: SparkSession, d: str) -> DataFrame:
    return stats.five_numbers(t.lines(spark, d), "l_extendedprice")


@query("SELECT l_returnflag, mode(l_linestatus ORDER BY l_linestatus) AS status, round(median(l_quantity), 4) AS median_quantity FROM lineitem GROUP BY l_returnflag")
def agg_mode_median(spark: SparkSession, d: str) -> DataFrame:
    return t.lines(spark, d).groupBy("l_returnflag").agg(F.mode("l_linestatus", deterministic=True).alias("status"), F.round(F.median("l_quantity"), 4).alias("median_quantity"))


@query(with_sql(MOVIES) + """SELECT CAST(count(DISTINCT cust) AS BIGINT) AS n_groups, max(n) AS largest, round(avg(m), 4) AS mean_of_means, max(m) AS best FROM (SELECT cust, count(*) AS n, round(avg(votes), 4) AS m FROM movies GROUP BY cust)""")
def agg_two_level(spark: SparkSession, d: str) -> DataFrame:
    g = t.movies(spark, d).groupBy("cust").agg(F.count("*").alias("n"), F.round(F.avg("votes"), 4).alias("m"))
    return g.agg(F.count("cust").alias("n_groups"), F.max("n").alias("largest"), F.round(F.avg("m"), 4).alias("mean_of_means"), F.max("m").alias("best"))


@query(with_sql(MOVIES, EDGES) + """, r AS (SELECT DISTINCT k FROM movies WHERE split <> 'train')
SELECT CAST(count(DISTINCT CASE WHEN r.k IS NULL THEN pe.k END) AS BIGINT) AS orphan_keys, CAST(count(*) - count(r.k) AS BIGINT) AS orphan_edges, round(100.0 * count(r.k) / count(*), 4) AS match_pct FROM pe LEFT JOIN r ON pe.k = r.k""")
def m2m_orphans(spark: SparkSession, d: str) -> DataFrame:
    return quality.orphans(t.people_edges(spark, d), t.movies(spark, d).where("split <> 'train'"), "k")


@query(with_sql(EDGES) + "SELECT k, CAST(count(DISTINCT s) AS BIGINT) AS n_members, array_to_string(list_sort(list(DISTINCT s)), ',') AS members FROM pe GROUP BY k ORDER BY n_members DESC, k LIMIT 10")
def m2m_members_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return relate.members(t.people_edges(spark, d), "k", "s", 10)


@query(with_sql(EDGES) + "SELECT s, CAST(count(DISTINCT k) AS BIGINT) AS n_keys FROM pe GROUP BY s ORDER BY n_keys DESC, s LIMIT 10")
def m2m_prolific(spark: SparkSession, d: str) -> DataFrame:
    return relate.prolific(t.people_edges(spark, d), "k", "s")


@query(with_sql(MOVIES, EDGES) + "SELECT k, CAST(count(DISTINCT s) AS BIGINT) AS n_members, array_to_string(list_sort(list(DISTINCT s)), ',') AS members FROM pe JOIN movies USING (k) WHERE y = 1 GROUP BY k ORDER BY n_members DESC, k LIMIT 10")
def m2m_collab(spark: SparkSession, d: str) -> DataFrame:
    return relate.members(t.people_edges(spark, d).join(t.movies(spark, d).where("y = 1").select("k"), "k"), "k", "s", 10)


@query(with_sql(EDGES) + """, a AS (SELECT k, array_to_string(list_sort(list(DISTINCT s)), ',') AS s_list FROM pe GROUP BY k), b AS (SELECT o_custkey AS k, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS p_list FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, s_list, p_list FROM a FULL OUTER JOIN b ON a.k = b.k""")
def m2m_id_lists(spark: SparkSession, d: str) -> DataFrame:
    bought = t.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"))
    return relate.id_lists(t.people_edges(spark, d), bought, "k", "s", "p")


@query(with_sql(EDGES) + """, a AS (SELECT DISTINCT k FROM pe), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_first, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_second, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS "both" """)
def m2m_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    return relate.pair_difference(t.people_edges(spark, d).select("k"), t.read(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query(with_sql(MOVIES, EDGES) + """, c AS (SELECT k, count(*) AS c FROM pe GROUP BY k)
SELECT CAST(count(c) AS BIGINT) AS n_with, CAST(count(*) - count(c) AS BIGINT) AS n_without, round(100.0 * count(c) / count(*), 4) AS pct_with, round(avg(CAST(c AS DOUBLE)), 6) AS mean_edges, max(c) AS most_edges FROM movies LEFT JOIN c USING (k)""")
def m2m_coverage(spark: SparkSession, d: str) -> DataFrame:
    return relate.coverage(t.movies(spark, d), t.people_edges(spark, d), "k")


@query(with_sql(MOVIES, EDGES) + """, e AS (SELECT DISTINCT k, s FROM pe), r AS (SELECT s, avg(CAST(y AS DOUBLE)) AS rate FROM e JOIN movies USING (k) GROUP BY s)
SELECT k, round(avg(rate), 6) AS avg_rate, round(max(rate), 6) AS max_rate, CAST(count(*) AS BIGINT) AS n_members FROM e JOIN r USING (s) GROUP BY k""")
def m2m_two_hop_rate(spark: SparkSession, d: str) -> DataFrame:
    return relate.two_hop(t.people_edges(spark, d), t.movies(spark, d), "k", "s", "y")


@query("SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def src_json_extract(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("v"))


@query("SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 2")
def src_json_map_explode(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy("key", "value").agg(F.count("*").alias("n"))


@query(with_sql(DIRTY) + r"SELECT k, person FROM dirty WHERE person <> '\N' AND trim(person) <> ''")
def src_filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    return usable_edges(t.dirty_people(spark, d), "person")


@query("SELECT o_orderkey AS k, o_orderstatus AS label FROM orders WHERE o_orderkey % 10 < 8 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 10 >= 8")
def set_union_missing(spark: SparkSession, d: str) -> DataFrame:
    o = t.read(spark, d, "orders")
    return quality.union_all([o.where("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("label")), o.where("o_orderkey % 10 >= 8").select(F.col("o_orderkey").alias("k"))])


@query("SELECT l_suppkey AS s, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM lineitem GROUP BY l_suppkey")
def win_group_share(spark: SparkSession, d: str) -> DataFrame:
    c = t.lines(spark, d).groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("s", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query("SELECT p_partkey AS k, CAST(count(*) OVER (PARTITION BY p_name) AS BIGINT) AS group_size, CAST(count(*) OVER (PARTITION BY p_name) > 1 AS BOOLEAN) AS repeated FROM part")
def win_group_size(spark: SparkSession, d: str) -> DataFrame:
    p = t.read(spark, d, "part")
    n = p.groupBy("p_name").agg(F.count("*").alias("group_size"))
    return p.join(n, "p_name").select(F.col("p_partkey").alias("k"), "group_size", (F.col("group_size") > 1).alias("repeated"))


@query(with_sql(MOVIES) + "SELECT k, split, votes FROM movies ORDER BY split DESC, votes, k LIMIT 20")
def ord_mixed_topk(spark: SparkSession, d: str) -> DataFrame:
    return t.movies(spark, d).select("k", "split", "votes").orderBy(F.desc("split"), F.asc_nulls_last("votes"), "k").limit(20)


@query("SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 1 ELSE 0 END AS single, CAST(count(*) AS BIGINT) AS num_people, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS num_unique_people FROM lineitem GROUP BY 1")
def m2m_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    e = t.people_edges(spark, d)
    return features.edge_counts(e.select("k").distinct(), e, "k", "s", "people").withColumn("single", (F.col("num_unique_people") == 1).cast("int"))
