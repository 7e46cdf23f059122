"""Enrichment of entities from an external catalog that lists them with text fields, in several files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cast, text
from .quality import melt, share


def load_catalog(raw: DataFrame, key: str, title: str, numbers: dict[str, str], tags: str, source: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Catalog rows with parsed numbers (``money`` or ``leading`` by column), sorted tags and a title key."""
    parse = {"money": cast.money, "leading": cast.leading_number, "double": lambda c: c.try_cast("double")}
    return raw.select(
        F.col(key), F.col(title), text.title_key(F.col(title)).alias("title_key"), F.col(source).alias("source"), cast.tokens_of(F.col(tags), renames).alias("tags"),
        *[parse[how](F.col(c).cast("string")).alias(c) for c, how in numbers.items()],
    )


def file_profile(catalog: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return catalog.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), *[share(F.count_if(F.col(c).isNull()), F.count("*")).alias(f"{c}_missing_pct") for c in columns])


def token_long(catalog: DataFrame, key: str) -> DataFrame:
    """Distinct (key, token): the tags of each row and its source."""
    return catalog.select(key, F.explode(F.concat("tags", F.array(F.lower("source")))).alias("token")).where("token IS NOT NULL").distinct()


def entity_aggregate(catalog: DataFrame, tokens: DataFrame, key: str, title: str, numbers: Sequence[str]) -> DataFrame:
    """One row per key: medians, numbers of variants, the first title, and its tokens."""
    base = catalog.groupBy(key).agg(
        F.count("*").alias("external_rows"), F.count_distinct("source").alias("n_sources"), F.count_distinct(F.nullif("title_key", F.lit(""))).alias("n_titles"),
        F.min(F.struct(title, "title_key")).alias("_t"), *[F.percentile(c, 0.5).alias(f"{c}_direct") for c in numbers], *[F.count_distinct(c).alias(f"n_{c}") for c in numbers],
    )
    tagged = tokens.groupBy(key).agg(F.count("*").alias("n_tokens"), F.array_join(F.array_sort(F.collect_list("token")), "|").alias("labels"))
    out = base.join(tagged, key, "left").withColumns({"title_external": F.col("_t")[title], "title_key_external": F.col("_t")["title_key"]}).drop("_t")
    return out.na.fill(0, ["n_tokens"])


def centers(tokens: DataFrame, aggregate: DataFrame, key: str, numbers: Sequence[str], log_scaled: Sequence[str] = ()) -> DataFrame:
    """Medians and interquartile ranges of each token's entities; log-scaled columns are averaged as log1p."""
    d = tokens.join(aggregate.select(key, *[F.col(f"{c}_direct") for c in numbers]), key)
    scaled = {c: F.log1p(F.greatest(F.col(f"{c}_direct"), F.lit(0.0))) if c in log_scaled else F.col(f"{c}_direct") for c in numbers}
    d = d.select("token", key, *[F.when(F.col(f"{c}_direct").isNotNull(), x).alias(c) for c, x in scaled.items()])
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    out = d.groupBy("token").agg(F.count_distinct(key).alias("n_entities"), *[F.percentile(c, q).alias(c) for c in numbers])
    mid = {c: F.expm1(F.col(c)[1]) if c in log_scaled else F.col(c)[1] for c in numbers}
    return out.select("token", "n_entities", *[m.alias(f"median_{c}") for c, m in mid.items()], *[(F.col(c)[2] - F.col(c)[0]).alias(f"iqr_{c}") for c in numbers])


def join_strategies(entities: DataFrame, aggregate: DataFrame, key: str, title: str, year: str, minutes: str, year_ext: str, minutes_ext: str) -> DataFrame:
    """Matches, coverage and ambiguity of the join by id and of two fallbacks by title and rounded numbers for the rest.

    The fallbacks join on equal keys, so a title that occurs often meets only its namesakes of the same year.
    """
    keys = aggregate.select(F.col(key).alias("x_key"), F.col("title_key_external").alias("t"), F.round(year_ext).alias("y"), F.round(minutes_ext).alias("m"))
    marked = entities.select(key, text.title_key(F.col(title)).alias("t"), F.round(year).alias("y"), F.round(minutes).alias("m")).join(keys.select(F.col("x_key").alias(key), F.lit(1).alias("_hit")), key, "left")
    total = marked.agg(F.count("*").alias("total"), F.count("_hit").alias("direct"))
    rest = marked.where("_hit IS NULL").drop("_hit")

    def fallback(on: list[str], name: str) -> DataFrame:
        hit = rest.select(key, *on).join(keys.select("x_key", *on).distinct(), on).groupBy(key).agg(F.count_distinct("x_key").alias("c"))
        return hit.agg(F.count("*").alias("matched"), F.count_if(F.col("c") > 1).alias("ambiguous")).crossJoin(total).select(F.lit(name).alias("strategy"), "matched", "ambiguous", share(F.col("matched"), F.col("total")).alias("coverage_pct"), F.lit("reject").alias("decision"))

    direct = total.select(F.lit("direct").alias("strategy"), F.col("direct").alias("matched"), F.lit(0).cast("long").alias("ambiguous"), share(F.col("direct"), F.col("total")).alias("coverage_pct"), F.lit("use").alias("decision"))
    return direct.unionByName(fallback(["t", "y"], "title_year")).unionByName(fallback(["t", "y", "m"], "title_year_minutes"))


def row_centers(aggregate: DataFrame, tokens: DataFrame, middle: DataFrame, key: str, numbers: Sequence[str]) -> DataFrame:
    """Per key the median of its tokens' centres."""
    m = tokens.join(middle, "token").groupBy(key).agg(*[F.percentile(f"median_{c}", 0.5).alias(f"{c}_center") for c in numbers])
    return aggregate.join(m, key, "left")


def fill_cascade(entities: DataFrame, enriched: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Entities with the direct value, else the centre, and which of them it was, for each field (own to external name)."""
    out = entities.join(enriched, key, "left").withColumn("matched", F.col("external_rows").isNotNull().cast("int"))
    for own, ext in fields.items():
        d, c = F.col(f"{ext}_direct"), F.col(f"{ext}_center")
        out = out.withColumn(f"fill_{own}", F.coalesce(d, c)).withColumn(f"fill_{own}_source", F.when(d.isNotNull(), "direct").when(c.isNotNull(), "center").otherwise("none"))
    return out


def alignment(filled: DataFrame, fields: dict[str, str], tolerance: dict[str, float], relative: Sequence[str] = ()) -> DataFrame:
    """How observed own values agree with direct external ones: exact, within tolerance, median difference, correlation."""
    rows = {}
    for own, ext in fields.items():
        a, b = F.col(own).cast("double"), F.col(f"{ext}_direct").cast("double")
        both = a.isNotNull() & b.isNotNull()
        diff = F.when(both, F.abs(a - b))
        near = (F.try_divide(diff, F.greatest(a, b)) if own in relative else diff) <= tolerance[own]
        rows[own] = {"n": F.count(diff), "exact_pct": share(F.count_if(diff == 0), F.count(diff)), "near_pct": share(F.count_if(near), F.count(diff)), "median_diff": F.round(F.percentile(diff, 0.5), 3), "r": F.round(F.corr(F.when(both, a), F.when(both, b)), 4)}
    return melt(filled, "field", rows)


def recovery(filled: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Of the rows that lack a field, how many the direct value, the centre, and either can fill."""
    rows = {}
    for own, ext in fields.items():
        gone, d, c = F.col(own).isNull(), F.col(f"{ext}_direct").isNotNull(), F.col(f"{ext}_center").isNotNull()
        n = F.count_if(gone)
        rows[own] = {"n_missing": n, "n_direct": F.count_if(gone & d), "n_center": F.count_if(gone & c), "n_either": F.count_if(gone & (d | c)), "either_pct": F.coalesce(share(F.count_if(gone & (d | c)), n), F.lit(0.0))}
    return melt(filled, "field", rows)


def fill_candidates(filled: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows that lack a field and have some fill."""
    lacks, has = F.lit(False), F.lit(False)
    for f in fields:
        lacks, has = lacks | F.col(f).isNull(), has | F.col(f"fill_{f}").isNotNull()
    return filled.where(lacks & has).select(key, *[c for f in fields for c in (f, f"fill_{f}", f"fill_{f}_source")])


def top_tokens(tokens: DataFrame, key: str, entities: DataFrame | None = None) -> DataFrame:
    """Entities per token, of the whole catalog or of those that match."""
    t = tokens if entities is None else tokens.join(entities.select(key).distinct(), key, "left_semi")
    return t.groupBy("token").agg(F.count_distinct(key).alias("n_entities"))


def conflicts(aggregate: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Keys with several sources, titles, values of a number, or tokens."""
    of = {"entities": F.count("*"), "catalog_rows": F.sum("external_rows"), "many_sources": F.count_if(F.col("n_sources") > 1), "many_titles": F.count_if(F.col("n_titles") > 1), "many_tokens": F.count_if(F.col("n_tokens") > 1)}
    of |= {f"many_{c}": F.count_if(F.col(f"n_{c}") > 1) for c in numbers}
    return melt(aggregate, "metric", {k: {"value": v} for k, v in of.items()})


def subgroup_coverage(filled: DataFrame, year: str, group: str) -> DataFrame:
    """Coverage by decade and by category: ok from 80 %, warn from 50 %, else low."""
    decade = F.concat((F.floor(F.col(year) / 10) * 10).cast("int").cast("string"), F.lit("s"))
    kinds = F.array(F.struct(F.lit("decade").alias("group_type"), decade.alias("group_value")), F.struct(F.lit(group).alias("group_type"), F.col(group).cast("string").alias("group_value")))
    out = filled.select("matched", F.explode(kinds).alias("g")).where("g.group_value IS NOT NULL").groupBy("g.group_type", "g.group_value").agg(F.count("*").alias("total"), F.sum("matched").alias("n_matched"))
    pct = share(F.col("n_matched"), F.col("total"))
    return out.withColumn("coverage_pct", pct).withColumn("status", F.when(pct >= 80, "ok").when(pct >= 50, "warn").otherwise("low"))


def join_precision(filled: DataFrame, fields: dict[str, str], tolerance: dict[str, float]) -> DataFrame:
    """Matches of which every comparable field diverges are suspicious; the rest bounds the precision from below."""
    m = filled.where("matched = 1")
    both = {f: F.col(f).isNotNull() & F.col(f"{e}_direct").isNotNull() for f, e in fields.items()}
    ok = {f: F.abs(F.col(f) - F.col(f"{e}_direct")) <= tolerance[f] for f, e in fields.items()}
    odd = F.lit(True)
    for f in fields:
        odd = odd & F.coalesce(both[f] & ~ok[f], F.lit(False))
    cols = [c for f in fields for c in (F.count_if(both[f]).alias(f"{f}_comparable"), share(F.count_if(both[f] & ok[f]), F.count_if(both[f])).alias(f"{f}_ok_pct"))]
    return m.agg(F.count("*").alias("n_matched"), *cols, F.count_if(odd).alias("n_suspicious"), share(F.count_if(~odd), F.count("*")).alias("precision_floor_pct"))


def consistency(filled: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per check the rows that it applies to, those flagged, and a severity."""
    out = melt(filled, "check", {n: {"n_flagged": F.count_if(scope & bad), "total": F.count_if(scope)} for n, (scope, bad) in checks.items()})
    return out.withColumn("flag_pct", F.coalesce(share(F.col("n_flagged"), F.col("total")), F.lit(0.0))).withColumn("severity", F.when(F.col("n_flagged") > 0, "warn").otherwise("ok"))


def shares_token(labels: Column, other: Column) -> Column:
    """Whether any of the ``|``-joined labels occurs in the other text."""
    return F.exists(F.split(labels, r"\|"), lambda t: (F.trim(t) != "") & F.contains(F.lower(other), F.trim(t)))


def delta_impact(filled: DataFrame, fields: dict[str, Column], threshold: dict[str, float]) -> DataFrame:
    """How far fills are from own values: rows beyond the threshold, median and 90th percentile of the distance."""
    rows = {}
    for own, fill in fields.items():
        d = F.abs(F.col(own).cast("double") - fill)
        rows[own] = {"n_fill": F.count(fill), "n": F.count(d), "n_material": F.count_if(d > threshold[own]), "material_pct": share(F.count_if(d > threshold[own]), F.count(d)), "median_delta": F.round(F.percentile(d, 0.5), 3), "p90_delta": F.round(F.percentile(d, 0.9), 3)}
    return melt(filled, "field", rows)


def schema_profile(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return melt(df, "column", {c: {"dtype": F.max(F.lit(t)), "n": F.count(c), "missing_pct": share(F.count_if(F.col(c).isNull()), F.count("*")), "n_distinct": F.count_distinct(c)} for c, t in kinds.items()})
