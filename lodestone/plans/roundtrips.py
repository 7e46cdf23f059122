"""Files written and read back, names for SQL, summaries of a cleaning run, and the rules that choose features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, models, quality, stats
from ..sources import catalog, files
from . import learning
from . import tables as t
from .registry import query
from .tables import EDGES, MOVIES, with_sql


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def src_csv_glob(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV in two folders and read back through a glob, all columns text."""
    path = files.scratch(spark, "csv")
    c = t.read(spark, d, "customer")
    files.write_csv(c.where("c_acctbal < 0"), f"{path}/low")
    files.write_csv(c.where("c_acctbal >= 0"), f"{path}/high")
    return files.read_csv(spark, f"{path}/*", ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS index, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def src_columnar_json(spark: SparkSession, d: str) -> DataFrame:
    """Nations as one JSON object of two maps, written, read back and matched by their keys."""
    path = files.scratch(spark, "columnar")
    key = F.col("n_nationkey").cast("string")
    whole = t.read(spark, d, "nation").agg(*[F.map_from_entries(F.collect_list(F.struct(key, F.col(c).cast("string")))).alias(c) for c in ("n_name", "n_regionkey")])
    whole.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
    return files.read_columnar_json(spark, path, ["n_name", "n_regionkey"])


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events")
def src_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "lines")
    t.read(spark, d, "events").select("event_id", "event_type").write.json(path)
    return files.json_to_table(spark, path, {"id": "event_id", "kind": "event_type"})


@query("SELECT p_partkey, p_name, p_size FROM part")
def snk_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "part") + ".parquet"
    files.write_parquet(t.read(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return files.first_existing(spark, [f"{path}-absent.parquet", path])


@query(with_sql(MOVIES) + "SELECT CAST(row_number() OVER (ORDER BY k DESC) AS BIGINT) AS line, CASE WHEN votes >= 250000 THEN 'True' ELSE 'False' END AS value FROM movies WHERE split = 'test'")
def snk_prediction_order(spark: SparkSession, d: str) -> DataFrame:
    """Prediction lines in the order of the file that asked for them (here by falling key), whatever order they were made in."""
    asked = files.scratch(spark, "asked")
    m = t.movies(spark, d).where("split = 'test'")
    files.write_csv(m.select("k").orderBy(F.desc("k")), asked)
    lines = files.with_order(files.read_csv(spark, asked).select(F.col("k").cast("long").alias("k")), "seq")
    scored = m.select("k", (F.col("votes") / 500000).alias("p")).orderBy("votes")
    out = files.scratch(spark, "predicted")
    files.write_lines(models.predictions(lines.join(scored, "k"), "seq"), out)
    return files.numbered_lines(spark, out)


@query(with_sql(MOVIES) + "SELECT split, CAST(count(*) AS BIGINT) AS n FROM movies GROUP BY split")
def ddl_view(spark: SparkSession, d: str) -> DataFrame:
    name = catalog.view(t.movies(spark, d), "all movies")
    return spark.sql(f"SELECT split, count(*) AS n FROM {name} GROUP BY split")


@query(with_sql(MOVIES, t.DIRTY) + r""", c AS (SELECT * FROM movies WHERE k % 50 <> 0), e AS (SELECT * FROM dirty WHERE person <> '\N'), b AS (SELECT quantile_cont(votes, 0.01) AS lo, quantile_cont(votes, 0.99) AS hi FROM c WHERE split = 'train'),
g AS (SELECT lower(trim(priority)) AS canon, count(DISTINCT priority) AS n FROM movies WHERE split = 'train' GROUP BY 1)
SELECT 'raw_rows' AS metric, CAST((SELECT count(*) FROM movies) AS DOUBLE) AS value UNION ALL SELECT 'clean_rows', (SELECT count(*) FROM c) UNION ALL SELECT 'duplicate_keys', (SELECT count(*) - count(DISTINCT k) FROM movies)
UNION ALL SELECT 'missing_tokens', (SELECT count(*) FROM movies WHERE trim(price_text) IN ('\N', '')) UNION ALL SELECT 'raw_edges', (SELECT count(*) FROM dirty) UNION ALL SELECT 'clean_edges', (SELECT count(*) FROM e)
UNION ALL SELECT 'unknown_members', (SELECT count(*) FROM dirty WHERE person = '\N') UNION ALL SELECT 'edges_removed', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM e) UNION ALL SELECT 'variant_groups', (SELECT count(*) FROM g WHERE n > 1)
UNION ALL SELECT 'cap_low', (SELECT round(lo, 4) FROM b) UNION ALL SELECT 'cap_high', (SELECT round(hi, 4) FROM b)""")
def aud_cleaning_summary(spark: SparkSession, d: str) -> DataFrame:
    m, dirty = t.movies(spark, d), t.dirty_people(spark, d)
    clean = m.where("k % 50 <> 0")
    return quality.cleaning_summary(m, clean, dirty, files.usable_edges(dirty, "person"), "k", "person", "price_text", F.lower(F.trim("priority")), "priority", "votes", F.col("split") == "train")


@query(with_sql(MOVIES, EDGES) + ", i AS (SELECT DISTINCT k, CAST(s AS VARCHAR) AS entity FROM pe JOIN movies USING (k) WHERE split <> 'test') SELECT k, entity FROM i UNION ALL SELECT k, 'synthetic_' || CAST(k AS VARCHAR) FROM movies WHERE split <> 'test' AND k NOT IN (SELECT k FROM i) AND y = 1")
def fea_fallback_index(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each title from its edges; where there are none, one of its own if it is counted to have any."""
    m = t.movies(spark, d).where("split <> 'test'")
    return features.entity_index(m.select("k", F.col("y").alias("n")), "k", "n", t.people_edges(spark, d).select("k", F.col("s").alias("entity")), "entity")


def _shift_sql(c: str) -> str:
    return f""", o AS (SELECT {c}::DOUBLE AS v, k % 10 = 3 AS f FROM movies WHERE {c} IS NOT NULL), e AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS i, min(v) - 1e-6 AS lo, max(v) + 1e-6 AS hi FROM o WHERE NOT f),
    bn AS (SELECT f, len(list_filter(i, lambda x: x <= v)) AS b, count(*) AS n FROM o, e WHERE v BETWEEN lo AND hi GROUP BY ALL), z AS (SELECT coalesce(a.n::DOUBLE, 0.5) AS p, coalesce(q.n::DOUBLE, 0.5) AS q FROM range(10) g(b) LEFT JOIN (SELECT * FROM bn WHERE NOT f) a ON a.b = g.b LEFT JOIN (SELECT * FROM bn WHERE f) q ON q.b = g.b),
    sh AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM z), ps AS (SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM sh),
    cv AS (SELECT v, count(CASE WHEN f THEN 1 END) AS c1, count(CASE WHEN NOT f THEN 1 END) AS c0 FROM o GROUP BY v), st AS (SELECT abs(sum(c1) OVER w / CAST(sum(c1) OVER () AS DOUBLE) - sum(c0) OVER w / CAST(sum(c0) OVER () AS DOUBLE)) AS gap, lead(v) OVER (ORDER BY v) - v AS dv FROM cv WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
    SELECT '{c}' AS "column", CAST(count(CASE WHEN NOT f THEN 1 END) AS BIGINT) AS n_observed, CAST(count(CASE WHEN f THEN 1 END) AS BIGINT) AS n_imputed, round(100.0 * count(CASE WHEN f THEN 1 END) / count(*), 4) AS imputed_pct, (SELECT round(max(gap), 4) FROM st) AS ks, (SELECT round(sum(gap * dv), 4) FROM st) AS wasserstein, (SELECT psi FROM ps) AS psi,
    round(avg(CASE WHEN NOT f THEN v END), 3) AS obs_mean, round(avg(CASE WHEN f THEN v END), 3) AS imp_mean, round(stddev_pop(CASE WHEN NOT f THEN v END), 3) AS obs_std, round(stddev_pop(CASE WHEN f THEN v END), 3) AS imp_std, (SELECT CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate_shift' ELSE 'high_shift' END FROM ps) AS status FROM o"""


@query(with_sql(MOVIES) + _shift_sql("votes"))
def sta_distribution_shift(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution_shift(t.movies(spark, d), "votes", F.col("k") % 10 == 3)


@query(with_sql(MOVIES) + learning.STATUS_SQL + ", x AS (SELECT feature, score, status FROM ds), k AS (SELECT count(*) AS n FROM x WHERE status = 'keep') SELECT feature FROM (SELECT feature, status, row_number() OVER (ORDER BY score DESC, feature) AS r FROM x), k WHERE CASE WHEN n >= 8 THEN status = 'keep' ELSE r <= 3 END")
def fea_reduced_set(spark: SparkSession, d: str) -> DataFrame:
    """The kept features if there are eight at least, else the best (here three of the few) by score."""
    return features.reduced_set(learning.fea_diagnostic_status(spark, d), least=8, best=3)
