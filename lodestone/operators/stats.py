"""Distribution, rank and drift statistics.

Order statistics over a whole column work on its distinct values with their counts, so a repeated value costs one row.
Windows over all distinct values are the only global order that remains.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPS = 1e-6


def _edges(train: DataFrame, column: str, bins: int) -> DataFrame:
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return train.agg(F.percentile(F.col(column).cast("double"), points).alias("edges"))


def psi_quantile(train: DataFrame, other: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Stability index over quantile bins of the training values.

    The outer edges are widened by a millionth; other values outside are dropped; an empty bin counts half a row.
    """
    e = _edges(train, column, bins).withColumn("inner", F.slice("edges", 2, bins - 1))

    def counts(df: DataFrame, name: str) -> DataFrame:
        v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(e))
        v = v.where((F.col("v") >= F.col("edges")[0] - _EPS) & (F.col("v") <= F.col("edges")[bins] + _EPS))
        return v.groupBy(F.size(F.filter("inner", lambda x: x <= F.col("v"))).alias("bin")).agg(F.count("*").alias(name))

    grid = train.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    c = grid.join(counts(train, "a"), "bin", "left").join(counts(other, "b"), "bin", "left")
    c = c.select(F.coalesce(F.nullif(F.col("a"), F.lit(0)).cast("double"), F.lit(0.5)).alias("a"), F.coalesce(F.col("b").cast("double"), F.lit(0.5)).alias("b"))
    t = c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    p, q = F.col("a") / F.col("sa"), F.col("b") / F.col("sb")
    return c.crossJoin(F.broadcast(t)).agg(F.round(F.sum((q - p) * F.log(q / p)), 6).alias("psi"))


def psi_unique(train: DataFrame, other: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """The variant over distinct edges with right-closed bins; shares are at least a millionth; null below three edges."""
    e = _edges(train, column, bins).select(F.array_distinct("edges").alias("edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(e))
        v = v.where((F.col("v") >= F.col("edges")[0]) & (F.col("v") <= F.element_at("edges", -1)))
        bin_ = F.greatest(F.size(F.filter("edges", lambda x: x < F.col("v"))), F.lit(1))
        c = v.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"))
        return c.crossJoin(F.broadcast(c.agg(F.sum("c").alias("n")))).select("bin", (F.col("c") / F.col("n")).alias(name))

    both = shares(train, "p").join(shares(other, "q"), "bin", "full_outer")
    p, q = (F.greatest(F.coalesce(c, F.lit(_EPS)), F.lit(_EPS)) for c in ("p", "q"))
    total = both.agg(F.sum((q - p) * F.log(q / p)).alias("s"))
    return total.crossJoin(F.broadcast(e)).select(F.when(F.size("edges") >= 3, F.round("s", 6)).alias("psi"))


def _steps(df: DataFrame, value: Column, flag: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of both samples at each distinct value, and both totals."""
    d = df.select(*groups, value.cast("double").alias("v"), flag.cast("boolean").alias("f")).where("v IS NOT NULL AND f IS NOT NULL")
    c = d.groupBy(*groups, "v").agg(F.count_if("f").alias("c1"), F.count_if(~F.col("f")).alias("c0"))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = c.groupBy(*groups).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
    steps = c.withColumn("s1", F.sum("c1").over(run)).withColumn("s0", F.sum("c0").over(run)).withColumn("next", F.lead("v").over(w))
    return steps.join(total, list(groups)) if groups else steps.crossJoin(F.broadcast(total))


def kolmogorov(d: Column, n1: Column, n0: Column, terms: int = 40) -> Column:
    """Asymptotic p-value of a two-sample statistic: the Kolmogorov series with Stephens' correction."""
    n = F.sqrt(n1 * n0 / (n1 + n0))
    x = (n + 0.12 + F.lit(0.11) / n) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def two_sample(df: DataFrame, value: str, flag: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov statistic, Wasserstein-1 distance and both sizes of the samples that ``flag`` parts."""
    s = _steps(df, F.col(value), flag, groups)
    gap = F.abs(F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0"))
    return s.groupBy(*groups).agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next") - F.col("v"))).alias("w1"), F.max("n1").alias("n1"), F.max("n0").alias("n0"))


def average_rank(df: DataFrame, column: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with the average rank of the column (ties share their mean rank), from counts by value."""
    c = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_c"))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(column)
    below = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    return df.join(c.select(*groups, column, (below + (F.col("_c") + 1) / 2).alias(out)), [*groups, column])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half, and its reflection to 0.5 or more."""
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("c1"))
    below = F.sum("c").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    r = c.select("c", "c1", (F.col("c1") * (below + (F.col("c") + 1) / 2)).alias("r")).agg(F.sum("r").alias("r"), F.sum("c1").alias("n1"), (F.sum("c") - F.sum("c1")).alias("n0"))
    area = F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0"))
    return r.select(area.alias("auc"), F.greatest(area, 1 - area).alias("auc_reflected"), "n1", "n0")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def rank_pct(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank over the number of values."""
    n = df.agg(F.count(column).alias("_n"))
    return average_rank(df, column, "_r").crossJoin(F.broadcast(n)).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def correlations(df: DataFrame, columns: Sequence[str], name: str = "r") -> DataFrame:
    """Pearson correlation of each pair of columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(name)) for a, b in pairs]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def correlation_shift(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest change of a correlation and the Frobenius norm of the change of the matrix."""
    d = correlations(before, columns, "r0").join(correlations(after, columns, "r1"), ["a", "b"]).withColumn("d", F.col("r1") - F.col("r0"))
    return d.agg(F.round(F.max(F.abs("d")), 6).alias("max_change"), F.round(F.sqrt(2 * F.sum(F.col("d") * F.col("d"))), 6).alias("frobenius"))


def mutual_information(df: DataFrame, column: str, label: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between quantile bins of the column and the label."""
    e = _edges(df, column, bins).select(F.slice("edges", 2, bins - 1).alias("inner"))
    d = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).crossJoin(F.broadcast(e))
    c = d.groupBy(F.size(F.filter("inner", lambda x: x <= F.col(column))).alias("bin"), F.col(label).alias("y")).agg(F.count("*").alias("c"))
    by_bin, by_y = Window.partitionBy("bin"), Window.partitionBy("y")
    total = c.agg(F.sum("c").alias("n"))
    m = c.withColumn("cb", F.sum("c").over(by_bin)).withColumn("cy", F.sum("c").over(by_y)).crossJoin(F.broadcast(total))
    return m.agg(F.round(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))), 6).alias("mi"))


def label_measures(train: DataFrame, other: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, auc, mi, abs_spearman, psi, missing_rate): ``auc`` (reflected), ``mutual_information``, ``spearman`` with
    a label of 0 and 1, ``psi_unique`` and the share of nulls, of all columns in three queries whatever their number.

    Rows are a column's values with their edges; ranks come from counts by value, and as the label's ranks are linear in
    it, its correlation is the label's own. The driver sees sums, and counts by bin.
    """
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = train.agg(*[F.percentile(F.col(c).cast("double"), points).alias(str(i)) for i, c in enumerate(columns)]).first()

    def values(df: DataFrame, fitted: bool) -> DataFrame:
        rows = [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"), (F.array(*map(F.lit, e)) if e else F.lit(None)).cast("array<double>").alias("e")) for i, (c, e) in enumerate(zip(columns, edges, strict=True))]
        return df.select(F.col(label).cast("long").alias("y"), F.explode(F.array(*rows)).alias("x")).select("x.*", "y", F.lit(fitted).alias("fitted"))

    c = values(other, False).where("v IS NOT NULL AND y IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("c"), F.sum("y").alias("c1"))
    below = F.sum("c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    r = c.select("i", "c", "c1", (below + (F.col("c") + 1) / 2).alias("r"))
    sums = r.groupBy("i").agg(F.sum("c").alias("n"), F.sum("c1").alias("n1"), F.sum(F.col("c1") * F.col("r")).alias("s1"), F.sum(F.col("c") * F.col("r")).alias("s"), F.sum(F.col("c") * F.col("r") * F.col("r")).alias("ss"))
    ranks = {x["i"]: x for x in sums.collect()}

    e = F.array_distinct("e")
    inside = (F.col("v") >= e[0]) & (F.col("v") <= F.element_at(e, -1))
    bin_ = {"tenth": F.size(F.filter(F.slice("e", 2, bins - 1), lambda x: x <= F.col("v"))), "psi": F.when(inside, F.greatest(F.size(F.filter(e, lambda x: x < F.col("v"))), F.lit(1)))}
    both = values(train, True).union(values(other, False))
    cells = both.groupBy("i", "fitted", "y", F.isnull("v").alias("absent"), *[b.alias(n) for n, b in bin_.items()]).agg(F.count("*").alias("n")).collect()

    def measures(i: int) -> tuple:
        auc = rho = mi = psi = None
        if i in ranks:
            n, n1, s1, total, squares = ranks[i]["n"], ranks[i]["n1"], ranks[i]["s1"], ranks[i]["s"], ranks[i]["ss"]
            spread = (squares - total * total / n) * (n1 - n1 * n1 / n)
            auc = (s1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) if 0 < n1 < n else None
            rho = abs(s1 - n1 * total / n) / math.sqrt(spread) if spread > 0 else None
        mine = [x for x in cells if x["i"] == i]
        joint, by_bin, by_y, share, size = Counter(), Counter(), Counter(), Counter(), Counter()
        for x in mine:
            if x["fitted"] and not x["absent"] and x["y"] is not None:
                joint[x["tenth"], x["y"]] += x["n"]
                by_bin[x["tenth"]] += x["n"]
                by_y[x["y"]] += x["n"]
            if x["psi"] is not None:
                share[x["fitted"], x["psi"]] += x["n"]
                size[x["fitted"]] += x["n"]
        if joint:
            n = sum(joint.values())
            mi = round(math.fsum(k / n * math.log(k * n / (by_bin[b] * by_y[y])) for (b, y), k in joint.items()), 6)
        if edges[i] and len(set(edges[i])) >= 3:
            pq = [[max(share[f, b] / (size[f] or 1), _EPS) for f in (True, False)] for b in {b for _, b in list(share)}]
            psi = round(math.fsum((q - p) * math.log(q / p) for p, q in pq), 6)
        rows = sum(x["n"] for x in mine if x["fitted"])
        missing = sum(x["n"] for x in mine if x["fitted"] and x["absent"]) / rows if rows else None
        return columns[i], None if auc is None else max(auc, 1 - auc), mi, rho, psi, missing

    return train.sparkSession.createDataFrame([measures(i) for i in range(len(columns))], "feature string, auc double, mi double, abs_spearman double, psi double, missing_rate double")


def threshold_sweep(df: DataFrame, score: str, label: str, steps: int = 20) -> DataFrame:
    """Confusion counts and measures at thresholds i / ``steps``; scores fall into cells first, whose counts add up."""
    cell = F.least(F.floor(F.col(score) * steps), F.lit(steps)).cast("int")
    c = df.groupBy(cell.alias("cell")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    hit = F.col("cell") >= F.col("step")
    m = grid.crossJoin(F.broadcast(c)).groupBy("step").agg(
        F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("fp"), F.sum("p").alias("pos"), F.sum("n").alias("neg")
    )
    precision, recall, specificity = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("pos")), F.try_divide(F.col("neg") - F.col("fp"), F.col("neg"))
    return m.select(
        (F.col("step") / steps).alias("threshold"), "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"),
        F.round((F.col("tp") + F.col("neg") - F.col("fp")) / (F.col("pos") + F.col("neg")), 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("sensitivity"),
        F.round(specificity, 6).alias("specificity"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("pos") - F.col("tp")), 6).alias("f1"), F.round(recall + specificity - 1, 6).alias("youden"),
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(label).cast("double")), 6).alias("rate"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts; values below and above fall into bins 0 and ``bins`` + 1."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    q = F.percentile(v, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    r = df.agg(F.count(column).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("least"), q.alias("q"), F.max(v).alias("most"), F.round(F.skewness(v), 4).alias("skew"))
    return r.select("n", "mean", "std", "skew", "least", *[F.round(F.col("q")[i], 4).alias(a) for i, a in enumerate(("p01", "p50", "p99"))], "most")


def shift_status(psi: Column) -> Column:
    return F.when(psi < 0.10, "stable").when(psi < 0.25, "moderate_shift").otherwise("high_shift")


def drift_table(train: DataFrame, other: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """PSI, KS statistic and means of each column against the training split."""
    out = None
    for c in columns:
        both = train.select(c, F.lit(True).alias("_f")).union(other.select(c, F.lit(False).alias("_f")))
        row = two_sample(both, c, F.col("_f")).crossJoin(psi_quantile(train, other, c)).crossJoin(train.agg(F.round(F.avg(c), 4).alias("mean_train")).crossJoin(other.agg(F.round(F.avg(c), 4).alias("mean_other"))))
        row = row.select(F.lit(c).alias("column"), F.lit(name).alias("against"), "psi", F.round("ks", 6).alias("ks"), "mean_train", "mean_other", shift_status(F.col("psi")).alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def shift_table(df: DataFrame, column: str, imputed: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Observed against imputed values: KS, its p-value, Wasserstein-1, and whether the imputed ones look plausible.

    With groups, only those with five observed and two imputed values at least are judged.
    """
    r = two_sample(df, column, imputed, groups)
    if groups:
        r = r.where("n0 >= 5 AND n1 >= 2")
    r = r.withColumn("p", kolmogorov(F.col("ks"), F.col("n1"), F.col("n0")))  # before ks is rounded under its own name
    p = F.col("p")
    return r.select(*groups, F.col("n0").alias("n_observed"), F.col("n1").alias("n_imputed"), F.round("ks", 6).alias("ks"), F.round("w1", 4).alias("w1"), F.round(p, 6).alias("p_value"), F.when(p >= 0.05, "plausible").otherwise("suspicious").alias("status"))


def distribution_shift(df: DataFrame, column: str, imputed: Column, least: int = 5) -> DataFrame:
    """One row: observed against imputed values by KS, Wasserstein-1, stability index and moments, with a status.

    Fewer than ``least`` imputed values are not judged: their measures are null and the status is no_imputed_rows.
    """
    v = F.col(column).cast("double")
    d = df.select(v.alias("v"), imputed.alias("f")).where("v IS NOT NULL")
    side = {"obs": ~F.col("f"), "imp": F.col("f")}
    m = d.agg(
        F.count_if(side["obs"]).alias("n_observed"), F.count_if(side["imp"]).alias("n_imputed"), F.round(F.try_divide(100.0 * F.count_if(side["imp"]), F.count("*")), 4).alias("imputed_pct"),
        *[F.round(F.avg(F.when(c, F.col("v"))), 3).alias(f"{n}_mean") for n, c in side.items()], *[F.round(F.stddev_pop(F.when(c, F.col("v"))), 3).alias(f"{n}_std") for n, c in side.items()],
    )
    both = two_sample(d, "v", F.col("f")).select("ks", "w1").crossJoin(psi_quantile(d.where(side["obs"]), d.where(side["imp"]), "v"))
    out = m.crossJoin(F.broadcast(both))
    enough = F.col("n_imputed") >= least
    judged = lambda c: F.when(enough, c)
    return out.select(
        F.lit(column).alias("column"), "n_observed", "n_imputed", "imputed_pct", judged(F.round("ks", 4)).alias("ks"), judged(F.round("w1", 4)).alias("wasserstein"), judged(F.col("psi")).alias("psi"),
        "obs_mean", judged(F.col("imp_mean")).alias("imp_mean"), "obs_std", judged(F.col("imp_std")).alias("imp_std"), F.when(enough, shift_status(F.col("psi"))).otherwise("no_imputed_rows").alias("status"),
    )
