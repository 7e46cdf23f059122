"""Data-quality detectors. Every detector returns a small DataFrame; none collects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def melt(df: DataFrame, name: str, values: dict[str, dict[str, Column]]) -> DataFrame:
    """A row per entry of ``values``: its key under ``name`` and its aggregates, all from one pass."""
    rows = [F.struct(F.lit(k).alias(name), *[c.alias(n) for n, c in v.items()]) for k, v in values.items()]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def share(n: Column, total: Column) -> Column:
    return F.round(F.try_divide(100.0 * n, total), 4)


def missing_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    rows = [(c, "missing") for c in expected if c not in have] + [(c, "unexpected") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, finding string")


def token_counts(df: DataFrame, columns: Sequence[str], token: str = r"\N") -> DataFrame:
    hit = {c: F.count_if(F.trim(F.col(c)) == token) for c in columns}
    return melt(df, "column", {c: {"n": n, "pct": share(n, F.count("*"))} for c, n in hit.items()})


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    hit = {c: F.count_if(F.col(c).isNull()) for c in columns}
    return melt(df, "column", {c: {"n": n, "pct": share(n, F.count("*"))} for c, n in hit.items()}).where("n > 0")


def malformed_keys(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).cast("string").rlike(pattern)).alias("n_malformed"), F.count("*").alias("n"))


def split_leakage(df: DataFrame, key: str, split: str, names: Sequence[str]) -> DataFrame:
    """For each pair of splits the number of keys in both; one aggregation by key, whatever the number of pairs."""
    seen = df.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in names])
    both = {f"{a}-{b}": F.count_if((F.col(a) == 1) & (F.col(b) == 1)) for a, b in combinations(names, 2)}
    return melt(seen, "pair", {k: {"n_shared": n} for k, n in both.items()})


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def iqr_fence(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Quartiles, the upper fence and the rows above it."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q = q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("fence", F.round(F.col("q3") + k * (F.col("q3") - F.col("q1")), 2))
    return (
        df.select(column).crossJoin(F.broadcast(q)).groupBy("q1", "q3", "fence")
        .agg(F.count_if(F.col(column) > F.col("fence")).alias("n_above"), F.count(column).alias("n"))
    )


def orphans(edges: DataFrame, entities: DataFrame, key: str, entity_key: str | None = None) -> DataFrame:
    """Distinct keys of the edges that no entity has, edges concerned, and the share of edges that match."""
    known = entities.select(F.col(entity_key or key).alias(key), F.lit(1).alias("_known")).distinct()
    return edges.join(known, key, "left").agg(
        F.count_distinct(F.when(F.col("_known").isNull(), F.col(key))).alias("orphan_keys"),
        F.count_if(F.col("_known").isNull()).alias("orphan_edges"),
        share(F.count("_known"), F.count("*")).alias("match_pct"),
    )


def bad_ids(df: DataFrame, column: str, pattern: str) -> DataFrame:
    bad = df.where(F.col(column).isNull() | ~F.col(column).rlike(pattern))
    return bad.groupBy(column).agg(F.count("*").alias("n"))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", share(F.col("n"), F.col("total")).alias("pct"))


def missing_mechanism(df: DataFrame, columns: dict[str, Column], label: str) -> DataFrame:
    """Label rate by a three-valued missing flag of each column: true, false, or null where the flag is unknown."""
    flags = F.array(*[F.struct(F.lit(n).alias("column"), c.alias("is_missing")) for n, c in columns.items()])
    return df.select(label, F.explode(flags).alias("x")).groupBy("x.column", "x.is_missing").agg(F.count("*").alias("n"), F.round(F.avg(F.col(label).cast("double")), 6).alias("label_rate"))


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    hit = {c: F.count_if(~F.col(c).between(a, b)) for c, (a, b) in bounds.items()}
    return melt(df, "column", {c: {"n_out": n, "n": F.count(c), "least": F.min(F.col(c).cast("double")), "most": F.max(F.col(c).cast("double"))} for c, n in hit.items()})


def text_corruption(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many texts normalisation would change."""
    hit = {c: F.count_if(text.normalize_keep_empty(F.col(c)) != F.col(c)) for c in columns}
    return melt(df, "column", {c: {"n_changed": n, "n": F.count(c), "pct": share(n, F.count(c))} for c, n in hit.items()})


def fitted_fence(train: DataFrame, column: str, k: float = 1.5) -> float:
    """The upper fence of the training rows; other splits are capped at the same value."""
    return iqr_fence(train, column, k).first()["fence"]


def cap(df: DataFrame, column: str, upper: float) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) > upper, F.lit(upper)).otherwise(F.col(column)))


def success_rate(edges: DataFrame, labels: DataFrame, key: str, entity: str, label: str) -> DataFrame:
    """Per entity the mean label over its edges and the number of distinct keys."""
    return edges.join(labels.select(key, label), key).groupBy(entity).agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count_distinct(key).alias("n_keys"))


def domain_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``out_of_range`` with a status: ok, warn up to 1 %, fail beyond."""
    bad = F.col("n_out")
    return out_of_range(df, bounds).select("column", "n_out", "n", F.when(bad == 0, "ok").when(bad <= 0.01 * F.col("n"), "warn").otherwise("fail").alias("status"))


def coverage(df: DataFrame, columns: Sequence[str], ok: float = 90.0, warn: float = 70.0) -> DataFrame:
    """Share of non-null rows of each joined column, with a status."""
    pct = {c: share(F.count(c), F.count("*")) for c in columns}
    out = melt(df, "column", {c: {"n": F.count(c), "pct": p} for c, p in pct.items()})
    return out.withColumn("status", F.when(F.col("pct") >= ok, "ok").when(F.col("pct") >= warn, "warn").otherwise("fail"))


def missing_drift(df: DataFrame, columns: Sequence[str], split: str, base: str = "train", limit: float = 5.0) -> DataFrame:
    """Missing rate per split and column, its distance from the base split in percentage points, and a status."""
    rates = df.groupBy(split).agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("rate")) for c in columns]).alias("x"))
    long = rates.select(split, F.explode("x").alias("x")).select(split, "x.*")
    ref = long.where(F.col(split) == base).select("column", F.col("rate").alias("ref"))
    gap = F.round(100 * (F.col("rate") - F.col("ref")), 4)
    return long.join(F.broadcast(ref), "column").select(split, "column", F.round("rate", 6).alias("rate"), gap.alias("gap_pp"), F.when(F.abs(gap) <= limit, "ok").otherwise("warn").alias("status"))


def fanout(df: DataFrame, key: str, split: str | None = None) -> DataFrame:
    """Rows against distinct keys after a join: ok without surplus, warn below 1 %, else fail."""
    groups = [split] if split else []
    per_key = df.groupBy(*groups, key).agg(F.count("*").alias("c"))
    counted = per_key.groupBy(*groups) if groups else per_key
    out = counted.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_keys")).withColumn("surplus", F.col("n_rows") - F.col("n_keys"))
    return out.withColumn("status", F.when(F.col("surplus") == 0, "ok").when(F.col("surplus") < 0.01 * F.col("n_rows"), "warn").otherwise("fail"))


def reconciliation(raw: DataFrame, clean: DataFrame, split: str, imputed: dict[str, Column]) -> DataFrame:
    """Rows per split before and after, rows dropped, and how many values were filled (null before, known after)."""
    a = raw.groupBy(split).agg(F.count("*").alias("raw_rows"), *[F.count_if(c).alias(f"raw_null_{n}") for n, c in imputed.items()])
    b = clean.groupBy(split).agg(F.count("*").alias("clean_rows"), *[F.count_if(c).alias(f"clean_null_{n}") for n, c in imputed.items()])
    out = a.join(b, split, "full_outer").na.fill(0)
    return out.select(split, "raw_rows", "clean_rows", (F.col("raw_rows") - F.col("clean_rows")).alias("dropped"), *[(F.col(f"raw_null_{n}") - F.col(f"clean_null_{n}")).alias(f"filled_{n}") for n in imputed])


def cleaning_summary(raw: DataFrame, clean: DataFrame, raw_edges: DataFrame, clean_edges: DataFrame, key: str, member: str, text_col: str, canonical: Column, variant: str, capped: str, train: Column, tokens: Sequence[str] = (r"\N", "")) -> DataFrame:
    """(metric, value): rows and edges before and after cleaning, tokens met, duplicates, variant groups, cap bounds."""
    variants = raw.where(train).groupBy(canonical.alias("_c")).agg(F.count_distinct(variant).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("variant_groups"))
    caps = clean.where(train).agg(F.percentile(capped, F.array(F.lit(0.01), F.lit(0.99))).alias("_q")).select(F.round(F.col("_q")[0], 4).alias("cap_low"), F.round(F.col("_q")[1], 4).alias("cap_high"))
    a = raw.agg(F.count("*").alias("raw_rows"), (F.count("*") - F.count_distinct(key)).alias("duplicate_keys"), F.count_if(F.trim(text_col).isin(list(tokens))).alias("missing_tokens"))
    e = raw_edges.agg(F.count("*").alias("raw_edges"), F.count_if(F.trim(member).isin(list(tokens))).alias("unknown_members"))
    one = a.crossJoin(clean.agg(F.count("*").alias("clean_rows"))).crossJoin(e).crossJoin(clean_edges.agg(F.count("*").alias("clean_edges"))).crossJoin(variants).crossJoin(caps)
    one = one.withColumn("edges_removed", F.col("raw_edges") - F.col("clean_edges"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("x")).select("x.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
