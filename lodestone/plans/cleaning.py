"""Cleaning, detectors and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cast, text
from ..operators import audit, clean, quality
from ..operators.contracts import TableContract, violations
from . import tables as t
from .registry import query
from .tables import DIRTY, EDGES, MOVIES, NOTED, PEOPLE, fingerprint_sql, norm_sql, with_sql


@query(with_sql(MOVIES, EDGES) + r"""
, n AS (SELECT k, count(DISTINCT s) AS c FROM pe GROUP BY k)
SELECT yr, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_hits, round(100.0 * sum(y) / count(*), 4) AS hit_pct,
       CAST(count(CASE WHEN lower(trim(price_text)) NOT IN ('\n', '') THEN 1 END) AS BIGINT) AS n_priced,
       round(avg(CAST(coalesce(c, 0) AS DOUBLE)), 4) AS mean_people
FROM movies LEFT JOIN n USING (k) GROUP BY yr, split""")
def cln_flagship(spark: SparkSession, d: str) -> DataFrame:
    m = clean.replace_missing(t.movies(spark, d), (r"\N", ""))
    n = t.people_edges(spark, d).groupBy("k").agg(F.count_distinct("s").alias("c"))
    return m.join(n, "k", "left").groupBy("yr", "split").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_hits"), quality.share(F.sum("y"), F.count("*")).alias("hit_pct"), F.count("price_text").alias("n_priced"),
        F.round(F.avg(F.coalesce("c", F.lit(0)).cast("double")), 4).alias("mean_people"),
    )


@query(with_sql(MOVIES) + r"SELECT k, CASE WHEN lower(trim(price_text)) IN ('\n', '\\n') THEN NULL ELSE price_text END AS price_text FROM movies")
def cln_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return clean.replace_missing(t.movies(spark, d).select("k", "price_text"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return m.select(F.col("k").cast("string").alias("a"), "price_text", F.when(F.col("y") == 1, "True").otherwise("False").alias("flag"), "priority")


_RAW = ", raw AS (SELECT CAST(k AS VARCHAR) AS a, price_text, CASE WHEN y = 1 THEN 'True' ELSE 'False' END AS flag, priority FROM movies)"


def _probe(c: str) -> str:
    x = f"try_cast(trim({c}) AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, CAST(count({x}) AS BIGINT) AS n_numeric, CAST(count(CASE WHEN {x} = floor({x}) THEN 1 END) AS BIGINT) AS n_whole,
        CAST(count(CASE WHEN lower(trim({c})) IN ('true', 'false') THEN 1 END) AS BIGINT) AS n_boolean FROM raw"""


@query(with_sql(MOVIES) + _RAW + ", p AS (" + " UNION ALL ".join(map(_probe, ("a", "price_text", "flag", "priority"))) + """)
SELECT *, CASE WHEN n = 0 THEN 'string' WHEN n_boolean > 0.95 * n THEN 'boolean' WHEN n_numeric < 0.5 * n THEN 'string' WHEN n_whole > 0.9 * n_numeric THEN 'int' ELSE 'double' END AS type FROM p""")
def cln_dtype_probe(spark: SparkSession, d: str) -> DataFrame:
    return clean.probe_types(_raw(spark, d))


@query(with_sql(MOVIES) + "SELECT k, CAST(round(try_cast(trim(price_text) AS DOUBLE)) AS INTEGER) AS price FROM movies")
def cln_safe_int(spark: SparkSession, d: str) -> DataFrame:
    return t.movies(spark, d).select("k", cast.safe_int(F.col("price_text")).alias("price"))


@query(with_sql(MOVIES) + _RAW + "SELECT CAST(a AS BIGINT) AS k, try_cast(flag AS BOOLEAN) AS flag, try_cast(price_text AS DOUBLE) AS price FROM raw")
def cln_apply_schema(spark: SparkSession, d: str) -> DataFrame:
    r = clean.apply_schema(_raw(spark, d), {"flag": "boolean", "price_text": "double"})
    return r.select(F.col("a").cast("long").alias("k"), "flag", F.col("price_text").alias("price"))


@query(with_sql(NOTED) + f"SELECT doc_id, nullif({norm_sql('text')}, '') AS norm FROM noted")
def cln_text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return t.noted_documents(spark, d).select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(with_sql(NOTED) + f"SELECT doc_id, {fingerprint_sql('text')} AS fp FROM noted")
def cln_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return t.noted_documents(spark, d).select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS canonical, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title_key, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii FROM documents")
def cln_canonical_key(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return t.documents(spark, d).select("doc_id", text.canonical_key(c).alias("canonical"), text.title_key(c).alias("title_key"), text.has_non_ascii(c).alias("non_ascii"))


_ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} ASC NULLS LAST' for c in _ALL.split(', '))}) AS nth FROM lineitem) WHERE nth = 1")
def cln_dedup_rownumber(spark: SparkSession, d: str) -> DataFrame:
    return clean.deduplicate(t.lines(spark, d), ("l_orderkey", "l_linenumber"))


@query(with_sql(DIRTY) + r"""SELECT 'format:k' AS "check", CAST(0 AS BIGINT) AS n UNION ALL
SELECT 'format:person', CAST(count(CASE WHEN NOT regexp_matches(person, '^nm\d+$') THEN 1 END) AS BIGINT) FROM dirty UNION ALL
SELECT 'unique:k,person', CAST(count(*) AS BIGINT) FROM (SELECT k, person FROM dirty GROUP BY k, person HAVING count(*) > 1)""")
def cln_schema_validate(spark: SparkSession, d: str) -> DataFrame:
    return violations(t.dirty_people(spark, d), TableContract("edges", ("k", "person"), {"k": r"^\d+$", "person": r"^nm\d+$"}))


@query(with_sql(MOVIES, EDGES, PEOPLE) + """
, agg AS (SELECT k, count(s) AS dir_count, string_agg(CAST(s AS VARCHAR), ',' ORDER BY CAST(s AS VARCHAR)) AS dir_ids, avg(birth) AS a, min(birth) AS dir_min_birth, list(DISTINCT job) AS jobs
    FROM (SELECT DISTINCT k, s FROM pe) LEFT JOIN people USING (s) GROUP BY k)
SELECT k, c_mktsegment AS segment, CAST(coalesce(dir_count, 0) AS BIGINT) AS dir_count, dir_ids, round(a, 6) AS dir_avg_birth, dir_min_birth, array_to_string(list_sort(jobs), ',') AS dir_jobs
FROM movies LEFT JOIN agg USING (k) LEFT JOIN customer ON cust = c_custkey""")
def cln_wide_join(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    agg = clean.person_aggregate(t.people_edges(spark, d), t.people(spark, d), "k", "s", "dir", "birth", "job")
    side = m.select("k", "cust").join(t.read(spark, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment")), "cust", "left")
    w = clean.wide_join(m.select("k"), "k", [(side, ("segment",))], [agg])
    return w.withColumn("dir_avg_birth", F.round("dir_avg_birth", 6))


@query(with_sql(MOVIES) + "SELECT k, round(ln(1 + votes), 6) AS votes_log1p FROM movies")
def cln_log1p(spark: SparkSession, d: str) -> DataFrame:
    return clean.log_scale(t.movies(spark, d).select("k", "votes"), "votes").withColumn("votes_log1p", F.round("votes_log1p", 6))


@query(with_sql(MOVIES) + """SELECT 'yr' AS "column", CAST(count(*) - count(yr) AS BIGINT) AS n_null FROM movies UNION ALL SELECT 'votes', CAST(count(*) - count(votes) AS BIGINT) FROM movies""")
def cln_residual_nulls(spark: SparkSession, d: str) -> DataFrame:
    return clean.residual_nulls(t.movies(spark, d), ("yr", "votes"))


@query(with_sql(MOVIES) + r"""SELECT 'price_text' AS "column", CAST(count(CASE WHEN trim(price_text) = '\N' THEN 1 END) AS BIGINT) AS n, round(100.0 * count(CASE WHEN trim(price_text) = '\N' THEN 1 END) / count(*), 4) AS pct FROM movies
UNION ALL SELECT 'priority', CAST(count(CASE WHEN trim(priority) = '\N' THEN 1 END) AS BIGINT), round(100.0 * count(CASE WHEN trim(priority) = '\N' THEN 1 END) / count(*), 4) FROM movies""")
def dq_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.token_counts(t.movies(spark, d), ("price_text", "priority"))


@query(with_sql(MOVIES) + """SELECT 'yr' AS "column", CAST(count(*) - count(yr) AS BIGINT) AS n, round(100.0 * (count(*) - count(yr)) / count(*), 4) AS pct FROM movies""")
def dq_null_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_counts(t.movies(spark, d), ("yr", "votes", "y"))


@query(with_sql(DIRTY) + r"SELECT CAST(count(CASE WHEN NOT regexp_matches(person, '^nm\d+$') THEN 1 END) AS BIGINT) AS n_malformed, CAST(count(*) AS BIGINT) AS n FROM dirty")
def dq_key_format(spark: SparkSession, d: str) -> DataFrame:
    return quality.malformed_keys(t.dirty_people(spark, d), "person", r"^nm\d+$")


@query(with_sql(MOVIES) + """, c AS (SELECT cust, max(CASE WHEN split='train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split='val' THEN 1 ELSE 0 END) AS b, max(CASE WHEN split='test' THEN 1 ELSE 0 END) AS c FROM movies GROUP BY cust)
SELECT 'train-val' AS pair, CAST(sum(a * b) AS BIGINT) AS n_shared FROM c UNION ALL SELECT 'train-test', CAST(sum(a * c) AS BIGINT) FROM c UNION ALL SELECT 'val-test', CAST(sum(b * c) AS BIGINT) FROM c""")
def dq_split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return quality.split_leakage(t.movies(spark, d), "cust", "split", t.SPLITS)


@query("SELECT CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) AS n_duplicates FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0)")
def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    o = t.read(spark, d, "orders").select("o_orderkey")
    return quality.duplicate_count(o.union(o.where("o_orderkey % 50 = 0")), "o_orderkey")


@query(with_sql(MOVIES) + """, q AS (SELECT quantile_cont(votes, 0.25) AS q1, quantile_cont(votes, 0.75) AS q3 FROM movies WHERE split = 'train'), f AS (SELECT q1, q3, round(q3 + 0.1 * (q3 - q1), 2) AS fence FROM q)
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, fence, CAST(count(CASE WHEN votes > fence THEN 1 END) AS BIGINT) AS n_above, CAST(count(votes) AS BIGINT) AS n FROM movies, f WHERE split = 'train' GROUP BY ALL""")
def dq_iqr_fence(spark: SparkSession, d: str) -> DataFrame:
    r = quality.iqr_fence(t.movies(spark, d).where("split = 'train'"), "votes", 0.1)
    return r.withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)})


@query(with_sql(MOVIES, EDGES) + """, tr AS (SELECT DISTINCT k, 1 AS known FROM movies WHERE split = 'train')
SELECT CAST(count(DISTINCT CASE WHEN known IS NULL THEN pe.k END) AS BIGINT) AS orphan_keys, CAST(count(*) - count(known) AS BIGINT) AS orphan_edges, round(100.0 * count(known) / count(*), 4) AS match_pct FROM pe LEFT JOIN tr ON pe.k = tr.k""")
def dq_ref_integrity(spark: SparkSession, d: str) -> DataFrame:
    return quality.orphans(t.people_edges(spark, d), t.movies(spark, d).where("split = 'train'"), "k")


@query(with_sql(DIRTY) + r"SELECT person, CAST(count(*) AS BIGINT) AS n FROM dirty WHERE NOT regexp_matches(person, '^nm\d+$') GROUP BY person")
def dq_bad_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.bad_ids(t.dirty_people(spark, d), "person", r"^nm\d+$")


@query(with_sql(MOVIES) + "SELECT y, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM movies WHERE split = 'train' GROUP BY y")
def dq_label_balance(spark: SparkSession, d: str) -> DataFrame:
    return quality.label_balance(t.movies(spark, d).where("split = 'train'"), "y")


@query(with_sql(MOVIES) + r"""SELECT 'yr' AS "column", yr IS NULL AS is_missing, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS label_rate FROM movies GROUP BY ALL
UNION ALL SELECT 'price', nullif(price_text, '') = '\N', CAST(count(*) AS BIGINT), round(avg(CAST(y AS DOUBLE)), 6) FROM movies GROUP BY ALL""")
def dq_missing_mechanism(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_mechanism(t.movies(spark, d), {"yr": F.col("yr").isNull(), "price": F.nullif(F.col("price_text"), F.lit("")) == r"\N"}, "y")


_RANGE = """SELECT 'yr' AS "column", CAST(count(CASE WHEN NOT yr BETWEEN 1996 AND 2000 THEN 1 END) AS BIGINT) AS n_out, CAST(count(yr) AS BIGINT) AS n, CAST(min(yr) AS DOUBLE) AS least, CAST(max(yr) AS DOUBLE) AS most FROM movies
UNION ALL SELECT 'votes', CAST(count(CASE WHEN NOT votes BETWEEN 0 AND 499000 THEN 1 END) AS BIGINT), CAST(count(votes) AS BIGINT), min(votes), max(votes) FROM movies"""
_BOUNDS = {"yr": (1996, 2000), "votes": (0, 499000)}


@query(with_sql(MOVIES) + _RANGE)
def dq_ranges(spark: SparkSession, d: str) -> DataFrame:
    return quality.out_of_range(t.movies(spark, d), _BOUNDS)


@query(with_sql(NOTED) + f"""SELECT 'text' AS "column", CAST(count(CASE WHEN {norm_sql('text')} <> text THEN 1 END) AS BIGINT) AS n_changed, CAST(count(text) AS BIGINT) AS n, round(100.0 * count(CASE WHEN {norm_sql('text')} <> text THEN 1 END) / count(text), 4) AS pct FROM noted
UNION ALL SELECT 'source', CAST(count(CASE WHEN {norm_sql('source')} <> source THEN 1 END) AS BIGINT), CAST(count(source) AS BIGINT), round(100.0 * count(CASE WHEN {norm_sql('source')} <> source THEN 1 END) / count(source), 4) FROM noted""")
def dq_text_corruption(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_corruption(t.noted_documents(spark, d), ("text", "source"))


@query(with_sql(MOVIES) + r"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN price IS NULL THEN 1 END) AS BIGINT) AS n_null, CAST(count(CASE WHEN price < 0 THEN 1 END) AS BIGINT) AS n_negative, CAST(count(*) - count(DISTINCT k) AS BIGINT) AS n_duplicates
FROM (SELECT k, try_cast(trim(nullif(nullif(price_text, '\N'), '')) AS DOUBLE) AS price FROM movies)""")
def dq_post_fix(spark: SparkSession, d: str) -> DataFrame:
    m = clean.replace_missing(t.movies(spark, d).select("k", "price_text"), (r"\N", "")).select("k", cast.safe_double(F.col("price_text")).alias("price"))
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("price").isNull()).alias("n_null"), F.count_if(F.col("price") < 0).alias("n_negative"), (F.count("*") - F.count_distinct("k")).alias("n_duplicates"))


@query(with_sql(MOVIES) + """, q AS (SELECT quantile_cont(votes, 0.25) AS q1, quantile_cont(votes, 0.75) AS q3 FROM movies WHERE split = 'train'), f AS (SELECT round(q3 + 0.1 * (q3 - q1), 2) AS fence FROM q)
SELECT k, split, round(CASE WHEN votes > fence THEN fence ELSE votes END, 4) AS votes FROM movies, f""")
def fix_iqr_cap(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d).select("k", "split", "votes")
    fence = quality.fitted_fence(m.where("split = 'train'"), "votes", 0.1)
    return quality.cap(m, "votes", fence).withColumn("votes", F.round("votes", 4))


@query(with_sql(MOVIES, DIRTY) + r"SELECT person, round(avg(CAST(y AS DOUBLE)), 6) AS rate, CAST(count(DISTINCT dirty.k) AS BIGINT) AS n_keys FROM dirty JOIN movies ON dirty.k = movies.k WHERE split = 'train' AND person <> '\N' GROUP BY person")
def fix_success_rate(spark: SparkSession, d: str) -> DataFrame:
    e = t.dirty_people(spark, d).where(F.col("person") != r"\N")
    return quality.success_rate(e, t.movies(spark, d).where("split = 'train'"), "k", "person", "y").withColumn("rate", F.round("rate", 6))


@query(f"SELECT doc_id, coalesce(nullif({norm_sql('a')}, ''), {norm_sql('lang')}) AS title FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS a FROM documents)")
def fix_coalesce_text(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d).withColumn("a", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    return docs.select("doc_id", clean.coalesce_text(F.col("a"), F.col("lang")).alias("title"))


@query(with_sql(MOVIES) + """, x AS (""" + _RANGE + """) SELECT "column", n_out, n, CASE WHEN n_out = 0 THEN 'ok' WHEN n_out <= 0.01 * n THEN 'warn' ELSE 'fail' END AS status FROM x""")
def chk_domain_bounds(spark: SparkSession, d: str) -> DataFrame:
    return quality.domain_bounds(t.movies(spark, d), _BOUNDS)


@query("""WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), x AS (
SELECT 'quality' AS "column", CAST(count(quality) AS BIGINT) AS n, round(100.0 * count(quality) / count(*), 4) AS pct FROM j UNION ALL SELECT 'doc_id', CAST(count(doc_id) AS BIGINT), round(100.0 * count(doc_id) / count(*), 4) FROM j)
SELECT *, CASE WHEN pct >= 90 THEN 'ok' WHEN pct >= 70 THEN 'warn' ELSE 'fail' END AS status FROM x""")
def chk_join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(t.documents(spark, d).select("doc_id").join(t.read(spark, d, "labels"), "doc_id", "left"), ("quality", "doc_id"))


@query(with_sql(MOVIES) + r""", z AS (SELECT split, yr, nullif(nullif(price_text, '\N'), '') AS price FROM movies), r AS (SELECT split, 'yr' AS "column", avg(CASE WHEN yr IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM z GROUP BY split UNION ALL SELECT split, 'price', avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) FROM z GROUP BY split),
b AS (SELECT "column", rate AS ref FROM r WHERE split = 'train')
SELECT split, r."column", round(rate, 6) AS rate, round(100 * (rate - ref), 4) AS gap_pp, CASE WHEN abs(round(100 * (rate - ref), 4)) <= 5 THEN 'ok' ELSE 'warn' END AS status FROM r JOIN b ON r."column" = b."column" """)
def chk_missing_drift(spark: SparkSession, d: str) -> DataFrame:
    z = clean.replace_missing(t.movies(spark, d).select("split", "yr", F.col("price_text").alias("price")), (r"\N", ""))
    return quality.missing_drift(z, ("yr", "price"), "split")


@query(with_sql(MOVIES, EDGES) + """SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT k) AS BIGINT) AS n_keys, CAST(count(*) - count(DISTINCT k) AS BIGINT) AS surplus,
CASE WHEN count(*) = count(DISTINCT k) THEN 'ok' WHEN count(*) - count(DISTINCT k) < 0.01 * count(*) THEN 'warn' ELSE 'fail' END AS status FROM (SELECT m.k, m.split FROM movies m LEFT JOIN (SELECT DISTINCT k, s FROM pe) e ON m.k = e.k) GROUP BY split""")
def chk_fanout(spark: SparkSession, d: str) -> DataFrame:
    e = t.people_edges(spark, d).distinct()
    return quality.fanout(t.movies(spark, d).join(e, "k", "left"), "k", "split")


@query(with_sql(MOVIES) + """SELECT split, CAST(count(*) AS BIGINT) AS raw_rows, CAST(count(CASE WHEN k % 50 <> 0 THEN 1 END) AS BIGINT) AS clean_rows, CAST(count(CASE WHEN k % 50 = 0 THEN 1 END) AS BIGINT) AS dropped, CAST(count(*) - count(yr) AS BIGINT) AS filled_yr FROM movies GROUP BY split""")
def chk_row_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    return quality.reconciliation(m, m.where("k % 50 <> 0").na.fill(1998, ["yr"]), "split", {"yr": F.col("yr").isNull()})


@query(with_sql(MOVIES) + """, q AS (SELECT quantile_cont(votes, 0.25) AS a, quantile_cont(votes, 0.75) AS b FROM movies)
SELECT CAST(count(CASE WHEN votes > b + 0.3 * (b - a) OR votes < a - 0.3 * (b - a) THEN 1 END) AS BIGINT) AS n_outliers, CAST(count(*) AS BIGINT) AS n FROM movies, q""")
def chk_outliers(spark: SparkSession, d: str) -> DataFrame:
    m = t.movies(spark, d)
    q = m.agg(F.percentile("votes", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    a, b = F.col("q")[0], F.col("q")[1]
    return m.crossJoin(F.broadcast(q)).agg(F.count_if((F.col("votes") > b + 0.3 * (b - a)) | (F.col("votes") < a - 0.3 * (b - a))).alias("n_outliers"), F.count("*").alias("n"))


@query("""SELECT 'runtime' AS "column", 'missing' AS finding UNION ALL SELECT 'c_acctbal', 'unexpected'""")
def dq_expected_columns(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_columns(t.read(spark, d, "customer"), ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "runtime"))


@query(r"""WITH v AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1), ch AS (SELECT value, x, count(*) AS m, length(value) AS len FROM (SELECT value, unnest(string_split(value, '')) AS x FROM v) GROUP BY ALL), h AS (SELECT value, -sum(m / CAST(len AS DOUBLE) * log2(m / CAST(len AS DOUBLE))) AS bits FROM ch GROUP BY value)
SELECT v.value, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM v), 6) AS share, round(bits, 6) AS bits FROM v JOIN h ON h.value = v.value WHERE length(v.value) <= 5 AND bits <= 2.3 AND n >= 50 AND CAST(n AS DOUBLE) / (SELECT sum(n) FROM v) >= 0.05""")
def aud_entropy_variant(spark: SparkSession, d: str) -> DataFrame:
    return audit.entropy_tokens(t.read(spark, d, "events"), "event_type", least_count=50, least_share=0.05, most_bits=2.3, longest=5)
