"""Imputation fitted on the training split: constants, medians, and chained linear equations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConstantFill:
    values: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str], how: str = "median") -> ConstantFill:
        """Exact medians or means of the training rows (0 without any)."""
        f = {"median": lambda c: F.percentile(F.col(c).cast("double"), 0.5), "mean": lambda c: F.avg(F.col(c).cast("double"))}[how]
        row = train.agg(*[f(c).alias(c) for c in columns]).first()
        return ConstantFill({c: float(row[c]) if row[c] is not None else 0.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.values.items()})


@dataclass(frozen=True)
class ChainedImputer:
    """Round-robin ridge regressions of each column on the others, started from the means.

    A sweep's moments come from one aggregation over the table, whatever its size; the small systems are solved on the
    driver. ``transform`` replays the fitted sweeps in order. Observed values never change.
    """

    columns: tuple[str, ...]
    start: dict[str, float]
    steps: tuple[tuple[tuple[str, tuple[float, ...]], ...], ...]  #: per sweep: target, intercept and slopes (other columns in order)
    rounded: tuple[str, ...] = ()

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str], sweeps: int = 10, ridge: float = 1e-3, tolerance: float = 1e-3, rounded: Sequence[str] = ()) -> ChainedImputer:
        cols = list(columns)
        start = ConstantFill.fit(train, cols, "mean").values
        steps: list[tuple[tuple[str, tuple[float, ...]], ...]] = []
        last = None
        for _ in range(sweeps):
            model = ChainedImputer(tuple(cols), start, tuple(steps))
            filled = model._replay(train)
            moments = {}
            for t in cols:
                x = [F.lit(1.0), *[F.col(f"_f_{c}") for c in cols if c != t]]
                seen = F.col(t).isNotNull()
                y = F.col(t).cast("double")
                for i, a in enumerate(x):
                    moments[f"{t}:{i}:y"] = F.sum(F.when(seen, a * y))
                    for j in range(i, len(x)):
                        moments[f"{t}:{i}:{j}"] = F.sum(F.when(seen, a * x[j]))
            m = filled.agg(*[c.alias(f"m{k}") for k, c in enumerate(moments.values())]).first()
            value = dict(zip(moments, m, strict=True))
            now = []
            for t in cols:
                n = len(cols)
                a = np.array([[value[f"{t}:{min(i, j)}:{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
                b = np.array([value[f"{t}:{i}:y"] or 0.0 for i in range(n)])
                if a[0, 0] == 0:
                    now.append((t, (start[t], *[0.0] * (n - 1))))
                    continue
                penalty = np.diag([0.0, *(ridge * np.maximum(np.diag(a)[1:], 1e-12))])
                now.append((t, tuple(np.linalg.lstsq(a + penalty, b, rcond=None)[0].tolist())))
            steps.append(tuple(now))
            if last is not None and max(abs(p - q) / (1e-9 + abs(q)) for (_, u), (_, v) in zip(now, last, strict=True) for p, q in zip(u, v, strict=True)) < tolerance:
                break
            last = now
        return ChainedImputer(tuple(cols), start, tuple(steps), tuple(rounded))

    def _replay(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_f_<column>``: all fitted sweeps in order, as one fold over their coefficients."""
        known = F.array(*[F.col(c).isNotNull() for c in self.columns])
        state = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(self.start[c])) for c in self.columns])
        out = df.withColumns({"_known": known, "_state": state})
        if self.steps:
            rows = []
            for t, (base, *slopes) in (step for sweep in self.steps for step in sweep):
                own = self.columns.index(t)
                weights = [*slopes[:own], 0.0, *slopes[own:]]
                rows.append(F.struct(F.lit(own).alias("t"), F.lit(float(base)).alias("base"), F.array(*[F.lit(float(w)) for w in weights]).alias("w")))

            def step(s: Column, p: Column) -> Column:
                guess = F.aggregate(F.zip_with(s, p["w"], lambda u, w: u * w), p["base"], lambda a, z: a + z)
                return F.transform(s, lambda x, i: F.when((i == p["t"]) & ~F.get("_known", i), guess).otherwise(x))

            out = out.withColumn("_state", F.aggregate(F.array(*rows), F.col("_state"), step))
        return out.withColumns({f"_f_{c}": F.get("_state", F.lit(i)) for i, c in enumerate(self.columns)}).drop("_known", "_state")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._replay(df)
        done = {c: F.bround(f"_f_{c}") if c in self.rounded else F.col(f"_f_{c}") for c in self.columns}
        return out.withColumns(done).drop(*[f"_f_{c}" for c in self.columns])


def hash_mask(df: DataFrame, key: str, column: str, share: float = 0.2) -> Column:
    """A repeatable mask of observed values, by a hash of the key."""
    return F.col(column).isNotNull() & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(column)), F.lit(10_000)) < int(share * 10_000))


def masked_validation(df: DataFrame, key: str, columns: Sequence[str], tolerance: dict[str, float], share: float = 0.2) -> DataFrame:
    """Errors with which chained, median and mean imputation recover hidden known values, per column."""
    hidden = df.withColumns({f"_m_{c}": hash_mask(df, key, c, share) for c in columns})
    hidden = hidden.withColumns({f"_t_{c}": F.col(c).cast("double") for c in columns}).withColumns({c: F.when(~F.col(f"_m_{c}"), F.col(c).cast("double")) for c in columns})
    models = {"chained": ChainedImputer.fit(hidden, columns), "median": ConstantFill.fit(hidden, columns, "median"), "mean": ConstantFill.fit(hidden, columns, "mean")}
    out = None
    for name, m in models.items():
        d = m.transform(hidden)
        rows = [
            F.struct(
                F.lit(name).alias("method"), F.lit(c).alias("column"), F.count_if(f"_m_{c}").alias("n"),
                F.round(F.avg(F.when(F.col(f"_m_{c}"), F.abs(F.col(c) - F.col(f"_t_{c}")))), 4).alias("mae"),
                F.round(F.sqrt(F.avg(F.when(F.col(f"_m_{c}"), F.pow(F.col(c) - F.col(f"_t_{c}"), F.lit(2.0))))), 4).alias("rmse"),
                F.round(F.avg(F.when(F.col(f"_m_{c}"), (F.abs(F.col(c) - F.col(f"_t_{c}")) <= tolerance[c]).cast("double"))), 4).alias("within"),
            )
            for c in columns
        ]
        r = d.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out = r if out is None else out.unionByName(r)
    return out
