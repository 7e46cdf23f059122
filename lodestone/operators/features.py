"""Feature preparation: lexical and structural features, target encoding, caps, fills and selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def lexical(c: Column) -> dict[str, Column]:
    """Length, words, digit, colon, question mark, share of capitals."""
    n = F.length(c)
    return {
        "len": n.cast("long"), "word_count": text.word_count(c).cast("long"), "has_digit": c.rlike(r"[0-9]").cast("int"), "has_colon": F.contains(c, F.lit(":")).cast("int"),
        "has_question": F.contains(c, F.lit("?")).cast("int"), "upper_ratio": F.round(F.regexp_count(c, F.lit("[A-Z]")) / F.greatest(n, F.lit(1)), 6),
    }


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def year_span(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(end - start, F.lit(0))).otherwise(0)


def edge_counts(entities: DataFrame, edges: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """Edges and distinct members per entity; 0 without edges."""
    per = edges.groupBy(key).agg(F.count(member).alias(f"num_{name}"), F.count_distinct(member).alias(f"num_unique_{name}"))
    return entities.join(per, key, "left").na.fill(0, [f"num_{name}", f"num_unique_{name}"])


def shared_member(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Keys with a member on both kinds of edge."""
    return left.select(key, F.col(a).alias("_m")).distinct().join(right.select(key, F.col(b).alias("_m")).distinct(), [key, "_m"]).select(key).distinct().withColumn("is_shared", F.lit(1))


def group_statistics(train: DataFrame, group: str, year: str) -> DataFrame:
    """Size, distinct years and a conflict flag of each group, fitted on the training rows."""
    return train.groupBy(group).agg(F.count("*").alias("group_size"), F.count_distinct(year).alias("unique_years")).withColumn("conflicting_years", (F.col("unique_years") > 1).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """``fold`` in 0..k-1, round robin in the order of the keys' MD5 within each label.

    The first digits of the MD5 part each label into 4,096 pieces in that order. Rows are numbered within their piece,
    from how many rows the pieces before it have, so no label gathers in one task.
    """
    code = F.md5(F.col(key).cast("string").cast("binary"))
    at = df.withColumns({"_code": code, "_piece": F.substring(code, 1, 3)})
    before = Window.partitionBy(label).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(label, F.substring(code, 1, 3).alias("_piece")).agg(F.count("*").alias("_n"))
    first = sizes.select(F.col(label).alias("_y"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(label, "_piece").orderBy("_code", key))
    placed = at.withColumn("_nth", nth).join(first, F.col(label).eqNullSafe(F.col("_y")) & (F.col("_piece") == F.col("_p")))
    return placed.select(*df.columns, ((F.col("_first") + F.col("_nth")) % k).cast("int").alias("fold"))


def hash_folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(k)).cast("int"))


def oof_encode(labelled: DataFrame, edges: DataFrame, key: str, entity: str, label: str, fold: str = "fold", smoothing: float = 20.0) -> DataFrame:
    """(key, encoded): mean over a key's entities of their smoothed label rate in the other folds.

    An entity's rate without a fold is its total less that fold's part, so one aggregation by entity and fold serves all
    folds. An unseen entity and a key without entities get the global mean.
    """
    mean = labelled.agg(F.avg(F.col(label).cast("double")).alias("gm"))
    e = edges.select(key, entity).distinct().join(labelled.select(key, F.col(label).cast("long").alias("_y"), fold), key)
    by_fold = e.groupBy(entity, fold).agg(F.sum("_y").alias("_sf"), F.count("*").alias("_cf"))
    total = by_fold.groupBy(entity).agg(F.sum("_sf").alias("_s"), F.sum("_cf").alias("_c"))
    rates = by_fold.join(total, entity).crossJoin(F.broadcast(mean))
    rates = rates.select(entity, fold, ((F.col("_s") - F.col("_sf") + smoothing * F.col("gm")) / (F.col("_c") - F.col("_cf") + smoothing)).alias("rate"))
    per_key = e.select(key, entity, fold).join(rates, [entity, fold]).groupBy(key).agg(F.avg("rate").alias("rate"))
    return labelled.select(key).join(per_key, key, "left").crossJoin(F.broadcast(mean)).select(key, F.round(F.coalesce("rate", "gm"), 6).alias("encoded"))


def fit_rates(labelled: DataFrame, edges: DataFrame, key: str, entity: str, label: str, smoothing: float = 20.0) -> DataFrame:
    """The lookup for unseen rows: each entity's smoothed rate over all training rows, with the global mean."""
    mean = labelled.agg(F.avg(F.col(label).cast("double")).alias("gm"))
    e = edges.select(key, entity).distinct().join(labelled.select(key, F.col(label).cast("long").alias("_y")), key)
    s = e.groupBy(entity).agg(F.sum("_y").alias("_s"), F.count("*").alias("_c"))
    return s.crossJoin(F.broadcast(mean)).select(entity, ((F.col("_s") + smoothing * F.col("gm")) / (F.col("_c") + smoothing)).alias("rate"))


def apply_rates(keys: DataFrame, edges: DataFrame, rates: DataFrame, mean: DataFrame, key: str, entity: str) -> DataFrame:
    """(key, encoded) from a fitted lookup; an unseen entity, or none, counts the global mean ``gm``."""
    e = keys.select(key).join(edges.select(key, entity).distinct(), key).join(rates, entity, "left").crossJoin(F.broadcast(mean))
    per_key = e.groupBy(key).agg(F.avg(F.coalesce("rate", "gm")).alias("rate"))
    return keys.select(key).join(per_key, key, "left").crossJoin(F.broadcast(mean)).select(key, F.round(F.coalesce("rate", "gm"), 6).alias("encoded"))


def person_history(entities: DataFrame, edges: DataFrame, rates: DataFrame, key: str, person: str, rate: str, n: str) -> DataFrame:
    """Mean and best success rate of an entity's people, their experience, 0.5 and 0 where unknown."""
    per = edges.select(key, person).distinct().join(rates, person).groupBy(key).agg(F.round(F.avg(rate), 6).alias("avg_rate"), F.round(F.max(rate), 6).alias("max_rate"), F.sum(n).alias("experience"), F.count("*").alias("n_people"))
    return entities.join(per, key, "left").na.fill(0.5, ["avg_rate", "max_rate"]).na.fill(0, ["experience", "n_people"])


@dataclass(frozen=True)
class QuantileCap:
    """Lower and upper caps of columns, fitted on the training split."""

    bounds: dict[str, tuple[float, float]]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> QuantileCap:
        row = train.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(low), F.lit(high))).alias(c) for c in columns]).first()
        return QuantileCap({c: (row[c][0], row[c][1]) for c in columns if row[c] and row[c][0] is not None})

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        new = {f"{c}{suffix}": F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.lit(b)), F.lit(a))) for c, (a, b) in self.bounds.items()}
        return df.withColumns(new)


@dataclass(frozen=True)
class FeatureRule:
    """What happens to a feature: ``action`` drop or keep; ``fill`` none, median, zero or mean; ``cap`` at quantiles."""

    name: str
    action: str = "keep"
    fill: str = "none"
    cap: bool = False


@dataclass(frozen=True)
class FeaturePlan:
    """Fitted caps and fills of a registry of rules; applied as one projection."""

    rules: tuple[FeatureRule, ...]
    caps: QuantileCap
    fills: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, rules: Sequence[FeatureRule]) -> FeaturePlan:
        have = [r for r in rules if r.name in train.columns and r.action != "drop"]
        caps = QuantileCap.fit(train, [r.name for r in have if r.cap]) if any(r.cap for r in have) else QuantileCap({})
        how = {"median": lambda c: F.percentile(F.col(c).cast("double"), 0.5), "mean": lambda c: F.avg(c), "zero": lambda c: F.lit(0.0)}
        asked = [r for r in have if r.fill != "none"]
        row = caps.transform(train).agg(*[F.coalesce(how[r.fill](r.name), F.lit(0.0)).alias(r.name) for r in asked]).first() if asked else {}
        return FeaturePlan(tuple(rules), caps, {r.name: float(row[r.name]) for r in asked})

    def transform(self, df: DataFrame) -> DataFrame:
        gone = [r.name for r in self.rules if r.action == "drop"]
        return self.caps.transform(df).na.fill({c: v for c, v in self.fills.items() if c in df.columns}).drop(*gone)


def token_bag(edges: Sequence[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """(key, bag): sorted ``<prefix>_<id>`` tokens of all edge types."""
    tokens = None
    for df, member, prefix in edges:
        t = df.select(key, F.concat(F.lit(prefix + "_"), F.col(member).cast("string")).alias("t")).distinct()
        tokens = t if tokens is None else tokens.union(t)
    return tokens.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("bag"))


def tfidf(docs: DataFrame, key: str, column: str, most: int = 5000, min_df: int = 2) -> DataFrame:
    """(key, term, w): L2-normalised weights of words and word pairs, smoothed idf ln((1 + n) / (1 + df)) + 1.

    The vocabulary is the ``most`` terms with the highest corpus count among those in ``min_df`` documents at least.
    """
    words = F.regexp_extract_all(F.lower(column), F.lit(r"(\w\w+)"), F.lit(1))
    d = docs.select(key, words.alias("w"))
    pairs = F.expr("transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(x, ' ', w[i + 1]))")
    tf = d.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), F.asc("term")).limit(most)
    n = docs.agg(F.count("*").alias("n"))
    raw = tf.join(F.broadcast(vocabulary), "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def centroid_similarity(weights: DataFrame, labelled: DataFrame, docs: DataFrame, key: str, label: str, fold: str | None = None) -> DataFrame:
    """Cosine of each document to the mean vector of either class, and the margin.

    With ``fold``, a labelled document is compared with centroids of the other folds: the class sums less its fold's.
    """
    vectors = weights.join(labelled.select(key, F.col(label).cast("int").alias("y"), *([F.col(fold).alias("f")] if fold else [])), key)
    sums = vectors.groupBy("y", "term", *(["f"] if fold else [])).agg(F.sum("w").alias("s"))
    folds = labelled.select(F.col(fold).alias("f")).distinct() if fold else None
    if fold:
        total = sums.groupBy("y", "term").agg(F.sum("s").alias("t")).crossJoin(F.broadcast(folds))
        sums = total.join(sums, ["y", "term", "f"], "left").select("y", "term", "f", (F.col("t") - F.coalesce("s", F.lit(0.0))).alias("s"))
    own = ["f"] if fold else []
    norm = sums.groupBy("y", *own).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    who = weights.join(labelled.select(key, F.col(fold).alias("f")), key) if fold else weights
    dots = who.join(sums, ["term", *own]).groupBy(key, "y", *own).agg(F.sum(F.col("w") * F.col("s")).alias("dot")).join(F.broadcast(norm), ["y", *own])
    cos = dots.select(key, "y", F.try_divide(F.col("dot"), F.col("norm")).alias("cos")).groupBy(key).agg(F.sum(F.when(F.col("y") == 1, F.col("cos"))).alias("sim_1"), F.sum(F.when(F.col("y") == 0, F.col("cos"))).alias("sim_0"))
    base = labelled.select(key) if fold else docs.select(key)
    out = base.join(cos, key, "left").na.fill(0.0, ["sim_1", "sim_0"])
    return out.select(key, F.round("sim_1", 6).alias("sim_1"), F.round("sim_0", 6).alias("sim_0"), F.round(F.col("sim_1") - F.col("sim_0"), 6).alias("margin"))


def entity_index(entities: DataFrame, key: str, count: str, edges: DataFrame | None, entity: str) -> DataFrame:
    """(key, entity): the distinct edges of each entity row, or, without any, one entity of its own where ``count`` > 0.

    A synthetic entity occurs in one row only, so its out-of-fold rate is the global mean.
    """
    keys = entities.select(key, F.col(count).alias("_n"))
    known = keys.sparkSession.createDataFrame([], f"`{key}` {entities.schema[key].dataType.simpleString()}, `{entity}` string") if edges is None else edges.select(key, F.col(entity).cast("string").alias(entity)).where(F.col(entity).isNotNull()).distinct()
    both = keys.join(known, key, "left")
    made = F.when(F.col(entity).isNotNull(), F.col(entity)).when(F.col("_n") > 0, F.concat(F.lit("synthetic_"), F.col(key).cast("string")))
    return both.select(key, made.alias(entity)).where(F.col(entity).isNotNull())


def reduced_set(status: DataFrame, least: int = 8, best: int = 15) -> DataFrame:
    """The features to train again with: those kept, or the ``best`` by score if fewer than ``least`` are kept."""
    kept = status.agg(F.count_if(F.col("status") == "keep").alias("_kept"))
    ranked = status.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature")))  # a row per feature
    return ranked.crossJoin(F.broadcast(kept)).where(F.when(F.col("_kept") >= least, F.col("status") == "keep").otherwise(F.col("_r") <= best)).select("feature")


def goodness(stats: DataFrame) -> DataFrame:
    """Composite score and status of each feature from auc, mi, abs_spearman, psi and missing_rate.

    Percentile ranks blend .35/.25/.20/.10/.10. keep from .60 on; drop_candidate with an AUC under .52 and both mutual
    information and score below the median; else review. One row per feature: a small frame by nature.
    """
    filled = stats.select("feature", F.coalesce("auc", F.lit(0.5)).alias("auc"), F.coalesce("mi", F.lit(0.0)).alias("mi"), F.coalesce("abs_spearman", F.lit(0.0)).alias("sp"), F.col("psi").alias("psi0"), F.coalesce("missing_rate", F.lit(1.0)).alias("miss"))
    everything = Window.partitionBy()
    filled = filled.withColumn("psi", F.coalesce("psi0", F.max("psi0").over(everything), F.lit(1.0)))

    def pct(c: Column) -> Column:
        return (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2) / F.count("*").over(everything)

    r = filled.select("*", pct(F.col("auc")).alias("r1"), pct(F.col("mi")).alias("r2"), pct(F.col("sp")).alias("r3"), pct(-F.col("psi")).alias("r4"), pct(-F.col("miss")).alias("r5"))
    score = 0.35 * F.col("r1") + 0.25 * F.col("r2") + 0.20 * F.col("r3") + 0.10 * F.col("r4") + 0.10 * F.col("r5")
    r = r.withColumn("goodness", F.round(score, 6))
    r = r.select("*", F.median("goodness").over(everything).alias("mg"), F.median("mi").over(everything).alias("mm"))  # a join with r itself would compute all measures twice
    low = (F.col("auc") < 0.52) & (F.col("mi") < F.col("mm")) & (F.col("goodness") < F.col("mg"))
    return r.select("feature", "goodness", F.when(low, "drop_candidate").when(F.col("goodness") >= 0.60, "keep").otherwise("review").alias("status"))


def diagnostic_status(table: DataFrame) -> DataFrame:
    """Status from the ranks of goodness, permutation importance (not below 0) and the boosted model's gain.

    Percentile ranks blend .50/.35/.15; absent importances and gains count 0. keep from .60 on or with an AUC drop of
    .002 or more; drop_candidate without a drop and with less than the median goodness; else review.
    """
    everything = Window.partitionBy()

    def pct(c: str) -> Column:
        return (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2) / F.count("*").over(everything)

    full = table.select("feature", "goodness", F.coalesce("permutation", F.lit(0.0)).alias("permutation"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    full = full.withColumn("clipped", F.greatest("permutation", F.lit(0.0)))
    r = full.select("*", F.round(0.50 * pct("goodness") + 0.35 * pct("clipped") + 0.15 * pct("gain"), 6).alias("score"))
    r = r.withColumn("mg", F.median("goodness").over(everything))
    keep = (F.col("score") >= 0.60) | (F.col("permutation") >= 0.002)
    return r.select("feature", "score", F.when(keep, "keep").when((F.col("permutation") <= 0) & (F.col("goodness") < F.col("mg")), "drop_candidate").otherwise("review").alias("status"))
