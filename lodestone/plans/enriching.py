"""Enrichment of parts from a catalog with text fields, built from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich
from . import tables as t
from .registry import query

NUMBERS = ("year", "minutes", "gross")
FIELDS = {"yr": "year", "mins": "minutes", "votes": "gross"}


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts with planted gaps."""
    k = F.col("p_partkey")
    return t.read(spark, d, "part").select(
        k.alias("k"), F.col("p_name").alias("title"), F.when(k % 7 != 0, 1995 + F.col("p_size") % 8).cast("double").alias("yr"), F.when(k % 6 != 0, F.col("p_size")).cast("double").alias("mins"),
        F.when(k % 9 != 0, F.col("p_retailprice")).alias("votes"), F.col("p_brand").alias("kind"), (F.lower("p_type")).alias("genres"),
    )


def raw_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows as text: money with signs, minutes with a unit, tags in one field; a fifth of the parts is absent."""
    p = t.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    x = F.floor("l_extendedprice").cast("long")
    money = F.when(x >= 1000, F.concat(F.lit("$"), F.floor(x / 1000).cast("string"), F.lit(","), F.lpad((x % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("$"), x.cast("string")))
    return t.lines(spark, d).where("l_partkey % 5 <> 0").join(p, "l_partkey").select(
        F.col("l_partkey").alias("k"), F.when(F.col("l_suppkey") % 3 == 0, F.upper("p_name")).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name")).alias("name"), money.alias("gross"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" min")).alias("minutes"), F.year("l_shipdate").cast("string").alias("year"), F.concat("p_type", F.lit(", "), "l_returnflag").alias("tags"),
        F.concat(F.lit("File"), (F.col("l_suppkey") % 4).cast("string")).alias("source"),
    )


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return enrich.load_catalog(raw_catalog(spark, d), "k", "name", {"gross": "money", "minutes": "leading", "year": "double"}, "tags", "source", {"r": "returned"})


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = _catalog(spark, d)
    tokens = enrich.token_long(c, "k")
    agg = enrich.entity_aggregate(c, tokens, "k", "name", NUMBERS)
    return c, tokens, agg, enrich.centers(tokens, agg, "k", NUMBERS, ("gross",))


def filled(spark: SparkSession, d: str) -> DataFrame:
    _, tokens, agg, mid = parts(spark, d)
    return enrich.fill_cascade(entities(spark, d), enrich.row_centers(agg, tokens, mid, "k", NUMBERS), "k", FIELDS)


ENT = "ent AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN 1995 + p_size % 8 END::DOUBLE AS yr, CASE WHEN p_partkey % 6 <> 0 THEN p_size END::DOUBLE AS mins, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS votes, p_brand AS kind, lower(p_type) AS genres FROM part)"
CAT = """cat AS (SELECT l_partkey AS k, CASE WHEN l_suppkey % 3 = 0 THEN upper(p_name) WHEN l_suppkey % 3 = 1 THEN 'The ' || p_name ELSE p_name END AS name, floor(l_extendedprice)::DOUBLE AS gross, floor(l_quantity)::DOUBLE AS minutes, year(l_shipdate)::DOUBLE AS year,
    list_sort([lower(p_type), CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE lower(l_returnflag) END]) AS tags, 'File' || CAST(l_suppkey % 4 AS VARCHAR) AS source FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 <> 0),
cat2 AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM cat)"""
TOK = "tok AS (SELECT DISTINCT k, unnest(list_append(tags, lower(source))) AS token FROM cat2)"
AGG = """ag AS (SELECT k, count(*) AS external_rows, count(DISTINCT source) AS n_sources, count(DISTINCT title_key) AS n_titles, min(name) AS title_external, quantile_cont(year, 0.5) AS year_direct, quantile_cont(minutes, 0.5) AS minutes_direct, quantile_cont(gross, 0.5) AS gross_direct,
    count(DISTINCT year) AS n_year, count(DISTINCT minutes) AS n_minutes, count(DISTINCT gross) AS n_gross FROM cat2 GROUP BY k),
agg AS (SELECT ag.*, trim(regexp_replace(lower(title_external), '[^a-z0-9]+', ' ', 'g')) AS title_key_external, n_tokens, labels FROM ag JOIN (SELECT k, count(*) AS n_tokens, string_agg(token, '|' ORDER BY token) AS labels FROM tok GROUP BY k) USING (k))"""
MID = """mid AS (SELECT token, count(DISTINCT k) AS n_entities, quantile_cont(year_direct, 0.5) AS median_year, quantile_cont(minutes_direct, 0.5) AS median_minutes, exp(quantile_cont(ln(1 + gross_direct), 0.5)) - 1 AS median_gross,
    quantile_cont(year_direct, 0.75) - quantile_cont(year_direct, 0.25) AS iqr_year, quantile_cont(minutes_direct, 0.75) - quantile_cont(minutes_direct, 0.25) AS iqr_minutes, quantile_cont(ln(1 + gross_direct), 0.75) - quantile_cont(ln(1 + gross_direct), 0.25) AS iqr_gross FROM tok JOIN agg USING (k) GROUP BY token)"""
FIL = """rc AS (SELECT k, quantile_cont(median_year, 0.5) AS year_center, quantile_cont(median_minutes, 0.5) AS minutes_center, quantile_cont(median_gross, 0.5) AS gross_center FROM tok JOIN mid USING (token) GROUP BY k),
fil AS (SELECT ent.*, agg.* EXCLUDE (k), year_center, minutes_center, gross_center, CASE WHEN external_rows IS NULL THEN 0 ELSE 1 END AS matched FROM ent LEFT JOIN agg USING (k) LEFT JOIN rc USING (k))"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


@query(_with(CAT) + "SELECT k, name, title_key, gross, minutes, year, array_to_string(tags, ',') AS tags, source FROM cat2")
def enr_load(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).withColumn("tags", F.array_join("tags", ","))


@query(_with(CAT) + "SELECT source, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT k) AS BIGINT) AS n_keys, round(100.0 * (count(*) - count(gross)) / count(*), 4) AS gross_missing_pct FROM cat2 GROUP BY source")
def enr_file_profile(spark: SparkSession, d: str) -> DataFrame:
    return enrich.file_profile(_catalog(spark, d), "k", ("gross",))


@query(_with(CAT, TOK) + "SELECT k, token FROM tok")
def enr_token_long(spark: SparkSession, d: str) -> DataFrame:
    return enrich.token_long(_catalog(spark, d), "k")


@query(_with(CAT, TOK, AGG) + "SELECT k, CAST(external_rows AS BIGINT) AS external_rows, n_sources, n_titles, round(year_direct, 4) AS year_direct, round(minutes_direct, 4) AS minutes_direct, round(gross_direct, 4) AS gross_direct, n_year, n_minutes, n_gross, n_tokens, labels, title_external, title_key_external FROM agg")
def enr_entity_agg(spark: SparkSession, d: str) -> DataFrame:
    a = parts(spark, d)[2]
    return a.withColumns({f"{c}_direct": F.round(f"{c}_direct", 4) for c in NUMBERS})


@query(_with(CAT, TOK, AGG, MID) + "SELECT token, n_entities, round(median_year, 4) AS median_year, round(median_minutes, 4) AS median_minutes, round(median_gross, 4) AS median_gross, round(iqr_year, 4) AS iqr_year, round(iqr_minutes, 4) AS iqr_minutes, round(iqr_gross, 6) AS iqr_gross FROM mid")
def enr_centers(spark: SparkSession, d: str) -> DataFrame:
    m = parts(spark, d)[3]
    return m.select("token", "n_entities", *[F.round(c, 6 if c == "iqr_gross" else 4).alias(c) for c in m.columns[2:]])


@query(_with(ENT, CAT, TOK, AGG) + """, e AS (SELECT ent.k, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, round(yr) AS y, round(mins) AS m, agg.k AS hit FROM ent LEFT JOIN agg ON agg.k = ent.k), x AS (SELECT k, title_key_external AS t, round(year_direct) AS y, round(minutes_direct) AS m FROM agg),
f1 AS (SELECT e.k, count(DISTINCT x.k) AS c FROM e JOIN x ON e.t = x.t AND e.y = x.y WHERE hit IS NULL GROUP BY e.k), f2 AS (SELECT e.k, count(DISTINCT x.k) AS c FROM e JOIN x ON e.t = x.t AND e.y = x.y AND e.m = x.m WHERE hit IS NULL GROUP BY e.k), n AS (SELECT count(*) AS n FROM ent)
SELECT 'direct' AS strategy, CAST(count(hit) AS BIGINT) AS matched, CAST(0 AS BIGINT) AS ambiguous, round(100.0 * count(hit) / count(*), 4) AS coverage_pct, 'use' AS decision FROM e
UNION ALL SELECT 'title_year', CAST(count(*) AS BIGINT), CAST(count(CASE WHEN c > 1 THEN 1 END) AS BIGINT), round(100.0 * count(*) / (SELECT n FROM n), 4), 'reject' FROM f1 UNION ALL SELECT 'title_year_minutes', CAST(count(*) AS BIGINT), CAST(count(CASE WHEN c > 1 THEN 1 END) AS BIGINT), round(100.0 * count(*) / (SELECT n FROM n), 4), 'reject' FROM f2""")
def enr_join_strategies(spark: SparkSession, d: str) -> DataFrame:
    return enrich.join_strategies(entities(spark, d), parts(spark, d)[2], "k", "title", "yr", "mins", "year_direct", "minutes_direct")


_F = _with(ENT, CAT, TOK, AGG, MID, FIL)


@query(_F + """SELECT k, matched, round(coalesce(year_direct, year_center), 4) AS fill_yr, round(coalesce(minutes_direct, minutes_center), 4) AS fill_mins, round(coalesce(gross_direct, gross_center), 4) AS fill_votes,
CASE WHEN year_direct IS NOT NULL THEN 'direct' WHEN year_center IS NOT NULL THEN 'center' ELSE 'none' END AS fill_yr_source, round(year_center, 4) AS year_center, round(gross_center, 4) AS gross_center FROM fil""")
def enr_fill_cascade(spark: SparkSession, d: str) -> DataFrame:
    f = filled(spark, d)
    return f.select("k", "matched", *[F.round(f"fill_{c}", 4).alias(f"fill_{c}") for c in FIELDS], "fill_yr_source", F.round("year_center", 4).alias("year_center"), F.round("gross_center", 4).alias("gross_center"))


_TOL = {"yr": 2.0, "mins": 10.0, "votes": 0.9}


def _align(own: str, ext: str) -> str:
    near = f"abs({own} - {ext}_direct) / greatest({own}, {ext}_direct)" if own == "votes" else f"abs({own} - {ext}_direct)"
    b = f"FROM fil WHERE {own} IS NOT NULL AND {ext}_direct IS NOT NULL"
    return f"SELECT '{own}' AS field, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(CASE WHEN {own} = {ext}_direct THEN 1 END) / count(*), 4) AS exact_pct, round(100.0 * count(CASE WHEN {near} <= {_TOL[own]} THEN 1 END) / count(*), 4) AS near_pct, round(quantile_cont(abs({own} - {ext}_direct), 0.5), 3) AS median_diff, round(corr({own}, {ext}_direct), 4) AS r {b}"


@query(_F + " UNION ALL ".join(_align(o, e) for o, e in FIELDS.items()))
def enr_alignment(spark: SparkSession, d: str) -> DataFrame:
    return enrich.alignment(filled(spark, d), FIELDS, _TOL, ("votes",))


def _recover(own: str, ext: str) -> str:
    e = f"({ext}_direct IS NOT NULL OR {ext}_center IS NOT NULL)"
    return f"SELECT '{own}' AS field, CAST(count(*) AS BIGINT) AS n_missing, CAST(count({ext}_direct) AS BIGINT) AS n_direct, CAST(count({ext}_center) AS BIGINT) AS n_center, CAST(count(CASE WHEN {e} THEN 1 END) AS BIGINT) AS n_either, round(100.0 * count(CASE WHEN {e} THEN 1 END) / count(*), 4) AS either_pct FROM fil WHERE {own} IS NULL"


@query(_F + " UNION ALL ".join(_recover(o, e) for o, e in FIELDS.items()))
def enr_recovery(spark: SparkSession, d: str) -> DataFrame:
    return enrich.recovery(filled(spark, d), FIELDS)


@query(_F + """SELECT k, yr, round(coalesce(year_direct, year_center), 4) AS fill_yr, CASE WHEN year_direct IS NOT NULL THEN 'direct' WHEN year_center IS NOT NULL THEN 'center' ELSE 'none' END AS fill_yr_source, mins, round(coalesce(minutes_direct, minutes_center), 4) AS fill_mins, CASE WHEN minutes_direct IS NOT NULL THEN 'direct' WHEN minutes_center IS NOT NULL THEN 'center' ELSE 'none' END AS fill_mins_source
FROM fil WHERE (yr IS NULL OR mins IS NULL) AND (year_direct IS NOT NULL OR year_center IS NOT NULL OR minutes_direct IS NOT NULL OR minutes_center IS NOT NULL)""")
def enr_fill_candidates(spark: SparkSession, d: str) -> DataFrame:
    return enrich.fill_candidates(filled(spark, d), "k", ("yr", "mins")).withColumns({"fill_yr": F.round("fill_yr", 4), "fill_mins": F.round("fill_mins", 4)})


@query(_with(CAT, TOK) + "SELECT token, CAST(count(DISTINCT k) AS BIGINT) AS n_entities FROM tok WHERE k IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY token")
def enr_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return enrich.top_tokens(enrich.token_long(_catalog(spark, d), "k"), "k", t.read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")))


_CONF = {"entities": "count(*)", "catalog_rows": "sum(external_rows)", "many_sources": "count(CASE WHEN n_sources > 1 THEN 1 END)", "many_titles": "count(CASE WHEN n_titles > 1 THEN 1 END)", "many_tokens": "count(CASE WHEN n_tokens > 1 THEN 1 END)"} | {f"many_{c}": f"count(CASE WHEN n_{c} > 1 THEN 1 END)" for c in NUMBERS}


@query(_with(CAT, TOK, AGG) + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS BIGINT) AS value FROM agg" for k, v in _CONF.items()))
def enr_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return enrich.conflicts(parts(spark, d)[2], NUMBERS)


@query(_F + """, g AS (SELECT matched, 'decade' AS group_type, CAST(CAST(floor(yr / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS group_value FROM fil UNION ALL SELECT matched, 'kind', kind FROM fil), c AS (SELECT group_type, group_value, CAST(count(*) AS BIGINT) AS total, CAST(sum(matched) AS BIGINT) AS n_matched, round(100.0 * sum(matched) / count(*), 4) AS coverage_pct FROM g WHERE group_value IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN coverage_pct >= 80 THEN 'ok' WHEN coverage_pct >= 50 THEN 'warn' ELSE 'low' END AS status FROM c""")
def enr_subgroup(spark: SparkSession, d: str) -> DataFrame:
    return enrich.subgroup_coverage(filled(spark, d), "yr", "kind")


@query(_F + """SELECT CAST(count(*) AS BIGINT) AS n_matched, CAST(count(CASE WHEN yr IS NOT NULL AND year_direct IS NOT NULL THEN 1 END) AS BIGINT) AS yr_comparable, round(100.0 * count(CASE WHEN abs(yr - year_direct) <= 2 THEN 1 END) / count(CASE WHEN yr IS NOT NULL AND year_direct IS NOT NULL THEN 1 END), 4) AS yr_ok_pct,
CAST(count(CASE WHEN mins IS NOT NULL AND minutes_direct IS NOT NULL THEN 1 END) AS BIGINT) AS mins_comparable, round(100.0 * count(CASE WHEN abs(mins - minutes_direct) <= 15 THEN 1 END) / count(CASE WHEN mins IS NOT NULL AND minutes_direct IS NOT NULL THEN 1 END), 4) AS mins_ok_pct,
CAST(count(CASE WHEN abs(yr - year_direct) > 2 AND abs(mins - minutes_direct) > 15 THEN 1 END) AS BIGINT) AS n_suspicious, round(100.0 * (count(*) - count(CASE WHEN abs(yr - year_direct) > 2 AND abs(mins - minutes_direct) > 15 THEN 1 END)) / count(*), 4) AS precision_floor_pct FROM fil WHERE matched = 1""")
def enr_precision(spark: SparkSession, d: str) -> DataFrame:
    return enrich.join_precision(filled(spark, d), {"yr": "year", "mins": "minutes"}, {"yr": 2.0, "mins": 15.0})


@query(_F + """, x AS (SELECT 'year_gap' AS "check", CAST(count(CASE WHEN abs(yr - year_direct) > 5 THEN 1 END) AS BIGINT) AS n_flagged, CAST(count(CASE WHEN yr IS NOT NULL AND year_direct IS NOT NULL THEN 1 END) AS BIGINT) AS total FROM fil
UNION ALL SELECT 'short', CAST(count(CASE WHEN matched = 1 AND mins < 5 AND NOT regexp_matches(labels, '\\b(small|returned)\\b') THEN 1 END) AS BIGINT), CAST(count(CASE WHEN matched = 1 THEN 1 END) AS BIGINT) FROM fil
UNION ALL SELECT 'no_shared_label', CAST(count(CASE WHEN matched = 1 AND NOT list_contains(string_split(labels, '|'), genres) THEN 1 END) AS BIGINT), CAST(count(CASE WHEN matched = 1 THEN 1 END) AS BIGINT) FROM fil)
SELECT *, coalesce(round(100.0 * n_flagged / nullif(total, 0), 4), 0) AS flag_pct, CASE WHEN n_flagged > 0 THEN 'warn' ELSE 'ok' END AS severity FROM x""".replace("\\\\b", "\\b"))
def enr_consistency(spark: SparkSession, d: str) -> DataFrame:
    c, m = F.col, F.col("matched") == 1
    checks = {
        "year_gap": (c("yr").isNotNull() & c("year_direct").isNotNull(), F.abs(c("yr") - c("year_direct")) > 5),
        "short": (m, (c("mins") < 5) & ~c("labels").rlike(r"\b(small|returned)\b")),
        "no_shared_label": (m, ~enrich.shares_token(F.array_join(F.filter(F.split("labels", r"\|"), lambda x: F.length(x) > 1), "|"), c("genres"))),
    }
    return enrich.consistency(filled(spark, d), checks)


def _delta(own: str, fill: str, limit: float) -> str:
    dd = f"abs({own} - {fill})"
    return f"SELECT '{own}' AS field, CAST(count({fill}) AS BIGINT) AS n_fill, CAST(count({dd}) AS BIGINT) AS n, CAST(count(CASE WHEN {dd} > {limit} THEN 1 END) AS BIGINT) AS n_material, round(100.0 * count(CASE WHEN {dd} > {limit} THEN 1 END) / count({dd}), 4) AS material_pct, round(quantile_cont({dd}, 0.5), 3) AS median_delta, round(quantile_cont({dd}, 0.9), 3) AS p90_delta FROM fil"


@query(_F + _delta("yr", "coalesce(year_direct, year_center)", 2.0) + " UNION ALL " + _delta("mins", "coalesce(minutes_direct, minutes_center)", 10.0))
def enr_delta(spark: SparkSession, d: str) -> DataFrame:
    return enrich.delta_impact(filled(spark, d), {"yr": F.col("fill_yr"), "mins": F.col("fill_mins")}, {"yr": 2.0, "mins": 10.0})


@query("""SELECT 's_suppkey' AS "column", 'bigint' AS dtype, CAST(count(s_suppkey) AS BIGINT) AS n, round(100.0 * (count(*) - count(s_suppkey)) / count(*), 4) AS missing_pct, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS n_distinct FROM supplier
UNION ALL SELECT 's_nationkey', 'int', CAST(count(s_nationkey) AS BIGINT), round(100.0 * (count(*) - count(s_nationkey)) / count(*), 4), CAST(count(DISTINCT s_nationkey) AS BIGINT) FROM supplier""")
def enr_schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return enrich.schema_profile(t.read(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
