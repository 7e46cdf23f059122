"""The stages from raw tables to predictions; what one stage leaves for the next is Parquet."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, enrich, features, impute, models, quality, report, stats
from ..operators.contracts import TableContract
from ..sources import files
from . import enriching
from . import tables as t

MOVIES = TableContract("movies", ("k",), {"k": r"^\d+$"})
NUMERIC = ["yr", "votes_log1p", "num_people", "num_unique_people", "title_missing", "yr_missing", "person_rate"]


def cleaning(spark: SparkSession, source: str, out: str) -> None:
    """Cleaned, joined and imputed rows per split, gated before they are written."""
    m = clean.deduplicate(clean.replace_missing(t.movies(spark, source), (r"\N", "")), ("k",))
    m = m.withColumns({"yr_missing": features.missing_flag(F.col("yr")), "title_missing": features.missing_flag(F.col("price_text"))}).drop("price_text")
    people = clean.person_aggregate(files.usable_edges(t.dirty_people(spark, source), "person").withColumn("s", F.regexp_extract("person", r"(\d+)", 1).cast("long")), t.people(spark, source), "k", "s", "dir", "birth", "job")
    wide = clean.log_scale(clean.wide_join(m, "k", aggregates=[clean.export_columns(people, drop=("dir_ids",))]), "votes")
    train = wide.where("split = 'train'")
    done = impute.ChainedImputer.fit(train, ["yr", "votes_log1p"], rounded=("yr",)).transform(wide)
    clean.gate(done, MOVIES, ("yr", "votes_log1p")).write.mode("overwrite").partitionBy("split").parquet(f"{out}/clean")


def feature_building(spark: SparkSession, source: str, out: str) -> None:
    """Counts, out-of-fold person rates for training rows, fitted rates for the others; caps and fills from training rows."""
    m = spark.read.parquet(f"{out}/clean")
    e = t.people_edges(spark, source)
    train, rest = m.where("split = 'train'"), m.where("split <> 'train'")
    mean = train.agg(F.avg(F.col("y").cast("double")).alias("gm"))
    rates = features.oof_encode(features.hash_folds(train, "k"), e, "k", "s", "y").union(features.apply_rates(rest, e, features.fit_rates(train, e, "k", "s", "y"), mean, "k", "s"))
    x = features.edge_counts(m, e, "k", "s", "people").join(rates.withColumnRenamed("encoded", "person_rate"), "k")
    rules = [features.FeatureRule("votes_log1p", fill="median", cap=True), features.FeatureRule("yr", fill="median"), features.FeatureRule("person_rate", fill="mean"), features.FeatureRule("status", action="drop")]
    plan = features.FeaturePlan.fit(x.where("split = 'train'"), rules)
    plan.transform(x).write.mode("overwrite").partitionBy("split").parquet(f"{out}/features")


def modelling(spark: SparkSession, source: str, out: str) -> None:
    """The better of two models by validation AUC, its metrics, and predictions for the test rows in key order."""
    x = spark.read.parquet(f"{out}/features")
    train, val, test = (x.where(F.col("split") == s) for s in t.SPLITS)
    tr, va, te = models.scaled(train, [train, val, test], NUMERIC)
    scores = {}
    for name, est in (("boosted", models.boosted(rounds=10)), ("logistic", models.logistic(tr.count()))):
        fitted = est.fit(tr)
        scores[name] = (models.evaluate(models.probability(fitted, va)).first().asDict(), fitted)
    best = max(scores, key=lambda n: (scores[n][0]["auc"], n == "boosted"))
    rows = [(n, json.dumps(s), n == best) for n, (s, _) in scores.items()]
    files.write_metrics(spark.createDataFrame(rows, "model string, metrics string, chosen boolean"), f"{out}/metrics")
    files.write_lines(models.predictions(models.probability(scores[best][1], te), "k"), f"{out}/predictions")


def enrichment(spark: SparkSession, source: str, out: str) -> None:
    """The filled entities, and the tables that tell how far the catalog can be trusted."""
    files.write_parquet(enriching.filled(spark, source), f"{out}/enriched")
    filled = spark.read.parquet(f"{out}/enriched")
    catalog, tokens, aggregate, middle = enriching.parts(spark, source)
    pair = {"yr": "year", "mins": "minutes"}
    artefacts = {
        "file_profile": enrich.file_profile(catalog, "k", ("gross", "minutes", "year")),
        "centers": middle,
        "join_strategies": enrich.join_strategies(enriching.entities(spark, source), aggregate, "k", "title", "yr", "mins", "year_direct", "minutes_direct"),
        "conflicts": enrich.conflicts(aggregate, enriching.NUMBERS),
        "top_tokens": enrich.top_tokens(tokens, "k"),
        "alignment": enrich.alignment(filled, enriching.FIELDS, {"yr": 2.0, "mins": 10.0, "votes": 0.9}, ("votes",)),
        "recovery": enrich.recovery(filled, enriching.FIELDS),
        "fill_candidates": enrich.fill_candidates(filled, "k", ("yr", "mins", "votes")),
        "subgroup_coverage": enrich.subgroup_coverage(filled, "yr", "kind"),
        "join_precision": enrich.join_precision(filled, pair, {"yr": 2.0, "mins": 15.0}),
        "delta_impact": enrich.delta_impact(filled, {f: F.col(f"fill_{f}") for f in pair}, {"yr": 2.0, "mins": 10.0}),
        "schema_profile": enrich.schema_profile(filled.select("k", "yr", "mins", "votes", "matched")),
    }
    for name, df in artefacts.items():
        files.write_parquet(df, f"{out}/enrichment/{name}")


def reporting(spark: SparkSession, source: str, out: str) -> report.Report:
    m = spark.read.parquet(f"{out}/clean")
    r = report.Report()
    r.add_frame("clean", "coverage", quality.coverage(m, ("dir_avg_birth", "yr")))
    r.add_frame("clean", "fanout", quality.fanout(m, "k", "split"), "split")
    r.add_frame("clean", "label balance", quality.label_balance(m, "y"), "y")
    r.add_frame("clean", "domain", quality.domain_bounds(m, {"yr": (1990, 2030), "votes_log1p": (0, 20)}))
    raw = t.movies(spark, source)
    r.add_frame("clean", "reconciliation", quality.reconciliation(raw, m, "split", {"yr": F.col("yr").isNull()}), "split")
    r.add_frame("clean", "missing drift", quality.missing_drift(raw, ("yr",), "split"))
    r.add_frame("clean", "imputation shift", stats.shift_table(m, "yr", F.col("yr_missing") == 1), "status")
    r.add_frame("clean", "imputation shift by priority", stats.shift_table(m, "yr", F.col("yr_missing") == 1, ["priority"]), "priority")
    r.add_frame("clean", "correlation shift", stats.correlation_shift(m.where("yr_missing = 0"), m, ("yr", "votes_log1p")), "none")
    for s in t.SPLITS[1:]:
        r.add_frame("clean", f"drift against {s}", stats.drift_table(m.where("split = 'train'"), m.where(F.col("split") == s), ("yr", "votes_log1p"), s))
    files.write_parquet(r.frame(spark), f"{out}/report")
    return r


STAGES: dict[str, Callable] = {"cleaning": cleaning, "features": feature_building, "models": modelling, "report": reporting}


def choose(start: str | None = None, only: str | None = None, stages: Sequence[str] | None = None) -> list[str]:
    """The stages to run in canonical order; at most one of the three ways to choose may be used."""
    if sum(x is not None for x in (start, only, stages)) > 1:
        raise ValueError("choose by one of from, only and stages")
    names = list(STAGES)
    unknown = {x for x in (start, only, *(stages or ())) if x is not None} - set(names)
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    if only:
        return [only]
    if start:
        return names[names.index(start) :]
    return [n for n in names if stages is None or n in stages]


class Timer:
    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        yield
        self.rows.append((name, round(time.monotonic() - began, 3)))


def run(spark: SparkSession, source: str, out: str, names: Sequence[str], enriched: bool = False) -> list[tuple[str, float]]:
    """Run the stages; enrichment follows cleaning and needs it among them. Timings are written as CSV."""
    if enriched and "cleaning" not in names:
        raise ValueError("enrichment follows cleaning")
    timer = Timer()
    for n in names:
        with timer.step(n):
            STAGES[n](spark, source, out)
        if enriched and n == "cleaning":
            with timer.step("enrichment"):
                enrichment(spark, source, out)
    files.write_csv(spark.createDataFrame(timer.rows, "step string, seconds double").coalesce(1), f"{out}/timings")
    return timer.rows


def audit_files(spark: SparkSession, paths: Sequence[str]) -> report.Report:
    frames: dict[str, DataFrame] = {}
    for p in paths:
        name = files.table_name(p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], list(frames))
        frames[name] = spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else files.read_csv(spark, p, infer=True)
    return report.audit_tables(frames)
