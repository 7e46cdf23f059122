"""Cleaning stages as functions from DataFrame to DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import cast, text
from .contracts import TableContract, violations


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def replace_missing(df: DataFrame, tokens: Sequence[str] = cast.STRICT_TOKENS, drop: Sequence[str] = ()) -> DataFrame:
    """Disguised missing values of every text column become null; declared columns go."""
    own = set(strings(df))
    return df.select(*[cast.blank_tokens(F.col(c), tokens).alias(c) if c in own else F.col(c) for c in df.columns if c not in drop])


def probe_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column the counts that decide its type, and the type, from one pass over the table.

    Over 95 % true/false: boolean. At least half numeric: integer if over 90 % of these are whole, else double.
    """
    cols = list(columns or strings(df))
    num = {c: cast.safe_double(F.col(c)) for c in cols}
    flags = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.count(num[c]).alias("n_numeric"),
            F.count_if(num[c] == F.floor(num[c])).alias("n_whole"),
            F.count_if(F.lower(F.trim(c)).isin("true", "false")).alias("n_boolean"),
        )
        for c in cols
    ]
    probed = df.agg(F.array(*flags).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    kind = (
        F.when(F.col("n") == 0, "string")
        .when(F.col("n_boolean") > 0.95 * F.col("n"), "boolean")
        .when(F.col("n_numeric") < 0.5 * F.col("n"), "string")
        .when(F.col("n_whole") > 0.9 * F.col("n_numeric"), "int")
        .otherwise("double")
    )
    return probed.withColumn("type", kind)


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Types by column; fit on the training split and apply to all."""
    return {r["column"]: r["type"] for r in probe_types(df, columns).collect()}


_CASTS = {"int": cast.safe_int, "double": cast.safe_double, "boolean": cast.safe_boolean, "string": lambda c: c}


def apply_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[_CASTS[types.get(c, "string")](F.col(c)).alias(c) if types.get(c, "string") != "string" else F.col(c) for c in df.columns])


def standardise(df: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """Text columns but ids normalised, with a fingerprint ``__fp_<column>`` of each."""
    own = [c for c in strings(df) if c not in id_cols]
    done = [text.normalize(F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns]
    return df.select(*done, *[text.fingerprint(F.col(c)).alias(f"__fp_{c}") for c in own])


def deduplicate(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: the first in the order of all columns, so that the survivor does not depend on the layout."""
    w = Window.partitionBy(*key).orderBy(*[F.asc_nulls_last(c) for c in df.columns])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def guess_key(df: DataFrame, sample: int = 100) -> str | None:
    """The first text column without repeats of which over 90 % of a sample look like an id."""
    cols = strings(df)
    if not cols:
        return None
    n = df.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in cols]).first()
    head = df.select(*cols).limit(sample).collect()
    for c in cols:
        seen = [r[c] for r in head if r[c] is not None]
        if seen and n[c] == n["_n"] and sum(_id_like(v) for v in seen) > 0.9 * len(seen):
            return c
    return None


def _id_like(v: str) -> bool:
    return bool(re.fullmatch(r"[a-zA-Z]{1,4}\d+", v))


def person_aggregate(edges: DataFrame, people: DataFrame, key: str, person: str, prefix: str, value: str, tag: str) -> DataFrame:
    """One row per key: how many people, who, average and least value, and their distinct tags.

    The edges are reduced before anything is joined to the entity, so the entity's rows never multiply.
    """
    e = edges.select(key, person).distinct().join(people.select(person, value, tag), person, "left")
    return e.groupBy(key).agg(
        F.count(person).alias(f"{prefix}_count"),
        F.array_join(F.array_sort(F.collect_set(F.col(person).cast("string"))), ",").alias(f"{prefix}_ids"),
        F.avg(value).alias(f"{prefix}_avg_{value}"),
        F.min(value).alias(f"{prefix}_min_{value}"),
        F.array_join(F.array_sort(F.collect_set(tag)), ",").alias(f"{prefix}_{tag}s"),
    )


def detect_key(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def wide_join(base: DataFrame, key: str, one_to_one: Sequence[tuple[DataFrame, Sequence[str]]] = (), aggregates: Sequence[DataFrame] = ()) -> DataFrame:
    """``base`` with columns of 1:1 tables and of pre-aggregated edges; absent counts are 0. One row per key stays."""
    out = base
    for df, cols in one_to_one:
        out = out.join(df.select(key, *cols), key, "left")
    for df in aggregates:
        out = out.join(df, key, "left")
    counts = [c for df in aggregates for c in df.columns if c.endswith("_count")]
    return out.na.fill(0, counts) if counts else out


def log_scale(df: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by ``<column>_log1p``."""
    return df.select(*[F.log1p(c).alias(f"{c}_log1p") if c == column else F.col(c) for c in df.columns])


def residual_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("x")).select("x.*")


def gate(df: DataFrame, contract: TableContract, complete: Sequence[str]) -> DataFrame:
    """``df`` if the contract holds and the listed columns are complete, else an error with all findings."""
    bad = [f"{r['check']}: {r['n']}" for r in violations(df, contract).where("n > 0").collect()]
    bad += [f"null:{r['column']}: {r['n_null']}" for r in residual_nulls(df, complete).where("n_null > 0").collect()]
    if bad:
        raise ValueError(f"{contract.name} failed the quality gate: " + "; ".join(sorted(bad)))
    return df


def export_columns(df: DataFrame, internal: Sequence[str] = ("__fp_",), drop: Sequence[str] = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if not any(c.startswith(p) for p in internal) and c not in drop])


def coalesce_text(primary: Column, fallback: Column) -> Column:
    """The normalised first text, or that of the second where the first is missing or empty."""
    return F.coalesce(text.normalize(primary), text.normalize_keep_empty(fallback))


def run(df: DataFrame, contract: TableContract, types: dict[str, str] | None = None) -> DataFrame:
    """All single-table stages in order; ``types`` come from the training split, else from the table itself."""
    present = replace_missing(df, drop=contract.drop_cols)
    kinds = types if types is not None else infer_schema(present, [c for c in strings(present) if c not in contract.id_cols])
    return deduplicate(standardise(apply_schema(present, kinds), contract.id_cols), contract.key)
