"""Declared tables: keys, id patterns and columns to drop, and the checks that hold a table to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableContract:
    name: str
    key: tuple[str, ...]
    id_regex: dict[str, str] = field(default_factory=dict)
    drop_cols: tuple[str, ...] = ()

    @property
    def id_cols(self) -> tuple[str, ...]:
        return tuple(self.id_regex) or self.key


def match(contracts: list[TableContract], table: str) -> TableContract | None:
    """The contract whose name is the table's, or precedes an underscore in it."""
    return next((c for c in contracts if table == c.name or table.startswith(c.name + "_")), None)


def violations(df: DataFrame, contract: TableContract) -> DataFrame:
    """(check, n) for each id pattern and for the key: malformed non-null ids, and keys that occur more than once.

    The patterns are counted in one pass; the key needs one aggregation.
    """
    present = {c: r for c, r in contract.id_regex.items() if c in df.columns}
    parts = []
    if present:
        counts = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(r)).alias(c) for c, r in present.items()])
        parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(f"format:{c}").alias("check"), F.col(c).alias("n")) for c in present])).alias("x")).select("x.*"))
    repeated = df.groupBy(*contract.key).agg(F.count("*").alias("n")).where("n > 1")
    parts.append(repeated.agg(F.count("*").alias("n")).select(F.lit(f"unique:{','.join(contract.key)}").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enforce(df: DataFrame, contract: TableContract) -> DataFrame:
    """``df``, or an error that lists every violated check."""
    bad = [f"{contract.name}: {r['n']} violations of {r['check']}" for r in violations(df, contract).where("n > 0").orderBy("check").collect()]
    if bad:
        raise ValueError("; ".join(bad))
    return df
