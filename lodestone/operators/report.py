"""Reports: a tidy table of findings, and text, Markdown or HTML made of it."""

from __future__ import annotations

import html
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, NumericType

from . import audit, clean
from .contracts import TableContract, violations

FIELDS = "table string, column string, check string, metric string, value string"


@dataclass
class Report:
    """Findings as (table, column, check, metric, value); every reading is derived from them."""

    rows: list[tuple[str, str | None, str, str, str | None]] = field(default_factory=list)
    figures: list[str] = field(default_factory=list)

    def add(self, table: str, column: str | None, check: str, **metrics: object) -> None:
        self.rows += [(table, column, check, m, None if v is None else str(v)) for m, v in metrics.items()]

    def add_frame(self, table: str, check: str, df: DataFrame, column: str = "column", most: int = 10_000) -> None:
        """All rows of a small result; more than ``most`` are an error, as such a frame belongs in a table of its own."""
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{table}, {check}: over {most} rows, too many for a report")
        for r in rows:
            d = r.asDict()
            self.add(table, d.pop(column, None), check, **d)

    def add_bars(self, title: str, df: DataFrame, label: str, value: str, most: int = 100) -> None:
        """A bar chart of a small aggregate, in the order of its labels, for the HTML page; over ``most`` bars are an error."""
        rows = df.orderBy(label).select(label, value).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title}: over {most} bars")
        self.figures.append(bars(title, [(str(r[0]), float(r[1] or 0)) for r in rows]))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, FIELDS)

    def sections(self) -> list[tuple[str, list[str]]]:
        found: dict[str, dict[tuple[str, str | None], list[str]]] = {}
        for table, column, check, metric, value in self.rows:
            found.setdefault(check, {}).setdefault((table, column), []).append(f"{metric}={value}")
        return [(c, [f"{t}{'.' + k if k else ''}: {', '.join(v)}" for (t, k), v in rows.items()]) for c, rows in found.items()]

    def text(self) -> str:
        return "\n".join(f"== {c} ==\n" + "\n".join(f"  {x}" for x in lines) for c, lines in self.sections()) + "\n"

    def markdown(self) -> str:
        return "\n".join(f"## {c}\n\n" + "\n".join(f"- {x}" for x in lines) + "\n" for c, lines in self.sections())

    def html(self, title: str) -> str:
        body = "".join(f"<h2>{html.escape(c)}</h2><ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in lines) + "</ul>" for c, lines in self.sections())
        return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}{''.join(self.figures)}"


def bars(title: str, values: Sequence[tuple[str, float]]) -> str:
    """Horizontal bars as SVG, which needs no plotting library; negative values have length 0."""
    top, step, wide = 24, 20, 400
    scale = wide / max([v for _, v in values if v > 0], default=1.0)
    lines = [
        f"<text x='150' y='{top + step * i + 14}' text-anchor='end'>{html.escape(k)}</text><rect x='160' y='{top + step * i + 3}' width='{max(0.0, v * scale):.1f}' height='14'/><text x='{165 + max(0.0, v * scale):.1f}' y='{top + step * i + 14}'>{v:g}</text>"
        for i, (k, v) in enumerate(values)
    ]
    return f"<svg width='700' height='{top + step * len(values) + 8}' font-size='11' fill='#345'><text x='0' y='14'>{html.escape(title)}</text>{''.join(lines)}</svg>"


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def audit_tables(tables: dict[str, DataFrame], label: Sequence[str] = ("label", "target", "class", "y")) -> Report:
    """Every schema-agnostic section over every table, then the key overlaps between tables."""
    out, keys = Report(), {}
    for name, df in tables.items():
        scalar = [f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType)) or f.dataType.simpleString() == "string"]
        out.add(name, None, "schema", rows=df.count(), columns=len(df.columns))
        out.add_frame(name, "columns", audit.profile(df, scalar))
        out.add_frame(name, "type conflicts", audit.dtype_conflicts(df, scalar))
        candidates = audit.key_candidates(df, scalar)
        keys[name] = [r["column"] for r in candidates.collect()]
        out.add_frame(name, "key candidates", candidates)
        out.add_frame(name, "exact duplicates", audit.exact_duplicates(df.select(*scalar)))
        out.add_frame(name, "label candidates", audit.label_columns(df, scalar, label))
        for c in clean.strings(df):
            out.add_frame(name, f"missing tokens: {c}", audit.entropy_tokens(df, c), "value")
            out.add_frame(name, f"normalisation: {c}", audit.normalisation(df, c))
        for c in numeric(df):
            out.add_frame(name, f"robust statistics: {c}", audit.robust_statistics(df, c))
    names = list(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for ka in keys[a]:
                if ka in tables[b].columns:
                    out.add_frame(f"{a}, {b}", f"key overlap: {ka}", audit.key_overlap(tables[a], tables[b], ka, ka))
    return out


def contract_report(tables: dict[str, tuple[DataFrame, TableContract]]) -> Report:
    out = Report()
    for name, (df, c) in tables.items():
        out.add_frame(name, "contract", violations(df, c), "check")
    return out
