"""Audits that need no declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cast, text
from .quality import melt, share

_ID = r"^[a-zA-Z]{1,4}\d+$"


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, distinct values, numeric and id-like shares of each column, and its class, from one aggregation.

    numeric: over half of the values cast to a number. id: over 90 % distinct and over 80 % id-like. Else text.
    """
    s = {c: F.col(c).cast("string") for c in columns}
    out = melt(df, "column", {
        c: {"n": F.count("*"), "n_null": F.count_if(F.col(c).isNull()), "n_distinct": F.count_distinct(c), "n_numeric": F.count(cast.safe_double(x)), "n_id_like": F.count_if(x.rlike(_ID))}
        for c, x in s.items()
    })
    filled = F.col("n") - F.col("n_null")
    kind = F.when(F.col("n_numeric") > 0.5 * filled, "numeric").when((F.col("n_distinct") > 0.9 * filled) & (F.col("n_id_like") > 0.8 * filled), "id").otherwise("text")
    return out.withColumn("kind", F.when(filled == 0, "empty").otherwise(kind))


def dtype_conflicts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns whose declared type does not match the class of their content."""
    declared = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, declared[c])])
    rows = profile(df, columns).select("column", names[F.col("column")].alias("declared"), "kind")
    return rows.where(((F.col("declared") == "string") & (F.col("kind") == "numeric")) | ((F.col("declared") != "string") & (F.col("kind") == "text")))


def key_candidates(df: DataFrame, columns: Sequence[str], least: float = 0.999) -> DataFrame:
    """Columns with over ten values of which nearly all differ, and the letters that their values start with."""
    s = {c: F.col(c).cast("string") for c in columns}
    out = melt(df, "column", {c: {"n": F.count(c), "n_distinct": F.count_distinct(c), "prefix": F.min(F.regexp_extract(x, r"^([a-zA-Z]+)", 1))} for c, x in s.items()})
    unique = F.round(F.try_divide(F.col("n_distinct"), F.col("n")), 6)
    return out.withColumn("uniqueness", unique).where((F.col("n") > 10) & (unique >= least))


def key_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Distinct keys on both sides, in common, and the common share of the smaller side."""
    x = a.select(F.col(key_a).alias("k")).where("k IS NOT NULL").distinct().withColumn("a", F.lit(1))
    y = b.select(F.col(key_b).alias("k")).where("k IS NOT NULL").distinct().withColumn("b", F.lit(1))
    n = x.join(y, "k", "full_outer").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    return n.withColumn("pct_of_smaller", share(F.col("n_both"), F.least("n_a", "n_b")))


def entropy_tokens(df: DataFrame, column: str, least_count: int = 10, least_share: float = 0.01, most_bits: float = 1.5, longest: int = 10, most_share: float = 1.0) -> DataFrame:
    """Frequent, short, low-entropy, non-numeric values: what a missing value may be disguised as.

    The thresholds make the variants of the detector. Values are counted first; entropy is taken of distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.where((F.col("n") >= least_count) & (F.length("value") <= longest)).crossJoin(F.broadcast(total))
    out = out.withColumn("share", F.round(F.col("n") / F.col("total"), 6)).withColumn("bits", F.round(text.entropy(F.col("value")), 6))
    return out.where((F.col("share") >= least_share) & (F.col("share") <= most_share) & (F.col("bits") <= most_bits) & cast.safe_double(F.col("value")).isNull()).select("value", "n", "share", "bits")


def normalisation(df: DataFrame, column: str) -> DataFrame:
    """Texts changed by normalisation, distinct before and after, shortest and longest."""
    t = df.select(F.col(column).alias("t"), text.normalize_keep_empty(F.col(column)).alias("u"))
    return t.agg(
        F.count_if(F.col("t") != F.col("u")).alias("n_changed"), F.count_distinct("t").alias("n_distinct"), F.count_distinct("u").alias("n_distinct_normalised"),
        F.min(F.length("t")).cast("long").alias("shortest"), F.max(F.length("t")).cast("long").alias("longest"),
    )


def robust_statistics(df: DataFrame, column: str, iqr_k: float = 1.5, mad_k: float = 3.0) -> DataFrame:
    """Quartiles, MAD, both fences and what lies outside, mean and population deviation.

    Medians are exact; the one-row summary joins back to the column, so nothing gathers in a single task.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    q = v.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    q = q.select(F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "mean", "std")
    mad = v.crossJoin(F.broadcast(q)).agg(F.median(F.abs(F.col("v") - F.col("p50"))).alias("mad"))
    s = q.crossJoin(mad)
    iqr = F.col("p75") - F.col("p25")
    out = v.crossJoin(F.broadcast(s)).groupBy(*s.columns).agg(
        F.count("*").alias("n"),
        F.count_if((F.col("v") < F.col("p25") - iqr_k * iqr) | (F.col("v") > F.col("p75") + iqr_k * iqr)).alias("n_iqr"),
        F.count_if(F.abs(F.col("v") - F.col("p50")) > mad_k * F.col("mad")).alias("n_mad"),
    )
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "mean", "std", "mad")], "n_iqr", "n_mad")


def trimmed_means(df: DataFrame, column: str, shares: Sequence[float] = (0.05, 0.10, 0.25)) -> DataFrame:
    """Means of what lies between the quantiles alpha and 1 - alpha."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    points = [p for a in shares for p in (a, 1 - a)]
    q = v.agg(F.percentile("v", F.array(*[F.lit(p) for p in points])).alias("q"))
    inside = [F.avg(F.when(F.col("v").between(F.col("q")[2 * i], F.col("q")[2 * i + 1]), F.col("v"))) for i in range(len(shares))]
    rows = F.array(*[F.struct(F.lit(a).alias("alpha"), F.round(m, 4).alias("trimmed_mean")) for a, m in zip(shares, inside, strict=True)])
    return v.crossJoin(F.broadcast(q)).agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def rank_trimmed_mean(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Mean without the ceil(n * alpha) (one at least) smallest and largest values.

    Equal values are interchangeable, so ranks come from counts by value: the global order runs over distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n")).withColumn("cut", F.greatest(F.ceil(F.col("n") * alpha), F.lit(1)))
    below = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    r = counts.withColumn("upto", below).crossJoin(F.broadcast(total))
    kept = F.greatest(F.least(F.col("upto"), F.col("n") - F.col("cut")) - F.greatest(F.col("upto") - F.col("c"), F.col("cut")), F.lit(0))
    return r.agg(F.round(F.try_divide(F.sum(kept * F.col("v")), F.sum(kept)), 4).alias("trimmed_mean"), F.sum(kept).alias("n_kept"))


def extreme_values(df: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` values furthest from the median."""
    m = df.agg(F.median(column).alias("m"))
    d = df.select(key, column).crossJoin(F.broadcast(m)).withColumn("distance", F.round(F.abs(F.col(column) - F.col("m")), 4))
    return d.orderBy(F.desc("distance"), F.asc(column), F.asc(key)).limit(n).select(key, column, "distance")


def fingerprint_collisions(df: DataFrame, column: str) -> DataFrame:
    """Fingerprints shared by different texts: how many variants and rows."""
    t = df.where(F.col(column).isNotNull()).select(F.col(column).alias("t"), text.fingerprint_unicode(F.col(column)).alias("fp")).where("fp <> ''")
    return t.groupBy("fp").agg(F.count_distinct("t").alias("n_variants"), F.count("*").alias("n_rows")).where("n_variants > 1")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Groups of rows that agree in every column, and the rows beyond the first of each."""
    g = df.groupBy(*df.columns).agg(F.count("*").alias("_c")).where("_c > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_surplus"))


def indicator_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation between the missing flags of each pair of columns."""
    flag = {c: F.col(c).isNull().cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(flag[a], flag[b]), 6).alias("r")) for a, b in pairs]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def pair_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """Same-row equality of two text columns, and the overlap of their distinct values."""
    same = df.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("n_equal"))
    both = key_overlap(df, df, a, b)
    return same.crossJoin(both).withColumn("equal_pct", share(F.col("n_equal"), F.col("n"))).drop("n")


def suspicious(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows each SQL condition holds for, with PASS or WARN."""
    out = melt(df, "rule", {n: {"n": F.count_if(F.expr(c))} for n, c in rules.items()})
    return out.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("WARN"))


def label_columns(df: DataFrame, columns: Sequence[str], names: Sequence[str] = ("label", "target", "class", "y")) -> DataFrame:
    """Columns that may hold a label, by name or by having two values."""
    out = melt(df, "column", {c: {"n_distinct": F.count_distinct(c)} for c in columns})
    return out.where(F.lower("column").isin(list(names)) | (F.col("n_distinct") == 2))


def parse_errors(raw: DataFrame, clean: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of the raw table that the clean table's type could not hold; one aggregation for each table."""
    a = melt(raw, "column", {c: {"n_raw": F.count(c), "n_distinct_raw": F.count_distinct(c)} for c in columns})
    b = melt(clean, "column", {c: {"n_clean": F.count(c), "n_distinct_clean": F.count_distinct(c)} for c in columns})
    return a.join(b, "column").withColumn("n_lost", F.col("n_raw") - F.col("n_clean"))
