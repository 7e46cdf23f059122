"""Queries over many-to-many edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import share


def members(edges: DataFrame, key: str, member: str, n: int | None = None) -> DataFrame:
    """Per key the number of distinct members and their sorted list; the ``n`` keys with most, if given."""
    out = edges.groupBy(key).agg(F.count_distinct(member).alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_set(member)), lambda x: x.cast("string")), ",").alias("members"))
    return out.orderBy(F.desc("n_members"), F.asc(key)).limit(n) if n else out


def prolific(edges: DataFrame, key: str, member: str, n: int = 10) -> DataFrame:
    return edges.groupBy(member).agg(F.count_distinct(key).alias("n_keys")).orderBy(F.desc("n_keys"), F.asc(member)).limit(n)


def id_lists(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Sorted distinct lists of both edge types per key. Each side is reduced before the join, so neither multiplies the other."""
    def side(e: DataFrame, c: str) -> DataFrame:
        return e.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",").alias(f"{c}_list"))

    return side(left, a).join(side(right, b), key, "full_outer")


def coverage(entities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Entities with and without an edge, and the mean and largest number of edges."""
    per = edges.groupBy(key).agg(F.count("*").alias("c"))
    return entities.select(key).join(per, key, "left").agg(
        F.count("c").alias("n_with"), F.count_if(F.col("c").isNull()).alias("n_without"), share(F.count("c"), F.count("*")).alias("pct_with"),
        F.round(F.avg("c"), 6).alias("mean_edges"), F.max("c").alias("most_edges"),
    )


def two_hop(edges: DataFrame, labels: DataFrame, key: str, member: str, label: str) -> DataFrame:
    """Per key the mean and highest label rate of its members."""
    e = edges.select(key, member).distinct()
    rate = e.join(labels.select(key, label), key).groupBy(member).agg(F.avg(F.col(label).cast("double")).alias("rate"))
    return e.join(rate, member).groupBy(key).agg(F.round(F.avg("rate"), 6).alias("avg_rate"), F.round(F.max("rate"), 6).alias("max_rate"), F.count("*").alias("n_members"))


def pair_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of two tables with like columns: only in the first, only in the second, in both."""
    cols = a.columns
    x, y = a.distinct().withColumn("_a", F.lit(1)), b.select(*cols).distinct().withColumn("_b", F.lit(1))
    return x.join(y, cols, "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both")
    )
