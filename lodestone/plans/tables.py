"""The roles of a title catalog played by the given tables, with planted dirt; each as a frame and as SQL.

Orders stand for titles (key k), their line items for edges to people (s) and to parts (p), suppliers for people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: str) -> F.Column:
    m = F.pmod(F.col(key), F.lit(10))
    return F.when(m < 8, "train").when(m == 8, "val").otherwise("test")


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("votes"),
        F.when(k % 10 != 3, F.year("o_orderdate")).alias("yr"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        split_of("o_orderkey").alias("split"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.when(k % 11 == 0, r"\N").when(k % 13 == 0, "").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price_text"),
    )


MOVIES = r"""movies AS (
    SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice AS votes,
           CASE WHEN o_orderkey % 10 <> 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS yr,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
           CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split,
           o_orderpriority AS priority, o_orderstatus AS status,
           CASE WHEN o_orderkey % 11 = 0 THEN '\N' WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price_text
    FROM orders)"""


def people_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))


EDGES = "pe AS (SELECT l_orderkey AS k, l_suppkey AS s FROM lineitem), wp AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem)"


def dirty_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ids are text, one in seventeen suppliers disguised as missing."""
    s = F.col("s")
    return people_edges(spark, sf_dir).select("k", F.when(s % 17 == 0, r"\N").otherwise(F.concat(F.lit("nm"), s.cast("string"))).alias("person"))


DIRTY = r"dirty AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 17 = 0 THEN '\N' ELSE 'nm' || CAST(l_suppkey AS VARCHAR) END AS person FROM lineitem)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    s = read(spark, sf_dir, "supplier")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("birth"), F.col("n_name").alias("job"))


PEOPLE = "people AS (SELECT s_suppkey AS s, s_acctbal AS birth, n_name AS job FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


#: Texts with letters beyond the tables' alphabet: ligatures, full width, fractions, hyphens, other scripts.
NOTES = ((-1, "The semi-final: \ufb01lm \u2122 \uff21 \u00bd \u21167"), (-2, "Stra\u00dfe na\u00efve\u2014caf\u00e9\u2026 \ufb00"), (-3, "final semi"), (-4, "semi-final"), (-5, "\u65e5\u672c \u0130 \u212a"), (-6, "\u2460\u3000e\u0301x"))


def noted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and the notes."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return docs.unionByName(spark.createDataFrame([(i, x, "en", "note") for i, x in NOTES], docs.schema))


NOTED = "noted AS (SELECT doc_id, text, lang, source FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}', 'en', 'note')" for i, x in NOTES) + ") v(doc_id, text, lang, source))"


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


#: What the notes' letters decompose to beyond their accents.
_PARTS = {"\ufb01": "fi", "\u2122": "TM", "\uff21": "A", "\uff41": "a", "\u00bd": "12", "\u2116": "No", "\u2026": "...", "\ufb00": "ff", "\u212a": "K", "\u2460": "1", "\u3000": " "}


def fold_sql(c: str) -> str:
    """The ASCII part of the compatibility decomposition of the tables' and the notes' letters."""
    for a, b in _PARTS.items():
        c = f"replace({c}, '{a}', '{b}')"
    return rf"regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')"


def norm_sql(c: str) -> str:
    """The steps of text normalisation around a column."""
    return rf"trim(regexp_replace(regexp_replace({fold_sql(c)}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    """Sorted distinct blank-separated words."""
    return rf"array_to_string(list_sort(list_distinct(list_filter(string_split_regex({c}, '\s+'), lambda x: x <> ''))), ' ')"


def fingerprint_sql(c: str) -> str:
    return tokens_sql(rf"regexp_replace(lower({fold_sql(c)}), '[^\w\s]', ' ', 'g')")
