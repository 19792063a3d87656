"""Linear and logistic models, agreement, contingency and multiple testing.

Models meet the data only in aggregates: a pass sums the K x K matrices of a design of K columns per batch, the sums of batches
are added, and numpy solves on the driver, whose share does not grow with the rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- distributions (no SciPy) ---------------------------------------------------------------------------------------
def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else float("nan")


def z_tail(z: float) -> float:
    """Two-sided p of the normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi squared: by series below the mean, by continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


# ---- design ------------------------------------------------------------------------------------------------------------
def _levels(df: DataFrame, name: str) -> list[str]:
    rows = df.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("v")).distinct().orderBy("v").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError(f"{name} has too many levels to be a category")
    return [r["v"] for r in rows]


def design(df: DataFrame, formula: str, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Columns ``y``, ``x0`` .. and ``keep`` of a formula ``y ~ a + C(b) * c + a:c``, and the names of the terms.

    A category's reference level is its least value. Rows with a null in any term drop out.
    """
    left, right = (s.strip() for s in formula.split("~"))

    def factor(text: str) -> list[tuple[str, Column]]:
        text = text.strip()
        if m := re.fullmatch(r"C\((\w+)\)", text):
            return [(f"{m[1]}[{v}]", F.when(F.col(m[1]).isNotNull(), (F.col(m[1]).cast("string") == v).cast("double"))) for v in _levels(df, m[1])[1:]]
        return [(text, F.col(text).cast("double"))]

    def product(a: list[tuple[str, Column]], b: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
        return [(f"{n}:{m}", c * e) for n, c in a for m, e in b]

    terms: dict[str, Column] = {"Intercept": F.lit(1.0)}
    for part in right.split("+"):
        factors = [factor(x) for x in re.split(r"[*:]", part)]
        if "*" in part:
            for f in factors:
                terms.update(f)
        whole = factors[0]
        for f in factors[1:]:
            whole = product(whole, f)
        terms.update(whole)
    names = list(terms)
    out = df.select(F.col(left).cast("double").alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(terms.values())), *keep)
    return out.dropna(subset=["y", *(f"x{i}" for i in range(len(names)))]), names


def _arrays(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)]
    return columns[0], np.column_stack(columns[1:]) if k else np.empty((b.num_rows, 0))


def _sums(d: DataFrame, k: int, beta: np.ndarray | None) -> np.ndarray:
    """[XᵀWX | XᵀWz-like | scalars] summed over all rows; beta None for least squares, else a logistic step at beta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y, x = _arrays(b, k)
            if beta is None:
                total[:k, :k] += x.T @ x
                total[:k, k] += x.T @ y
            else:
                eta = np.clip(x @ beta, -35, 35)
                p = 1 / (1 + np.exp(-eta))
                total[:k, :k] += (x * (p * (1 - p))[:, None]).T @ x
                total[:k, k] += x.T @ (y - p)
                total[k, k] += float(np.sum(y * np.log(p + 1e-300) + (1 - y) * np.log1p(-p + 1e-300)))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["s"])

    parts = d.select("y", *(f"x{i}" for i in range(k))).mapInArrow(run, "s array<double>")
    each = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    row = each.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).first()["v"]
    if row is None or not row:
        return np.zeros((k + 1, k + 1))
    return np.array([r["v"] for r in row]).reshape(k + 1, k + 1)


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    kind: str
    goodness: float

    def table(self, use_t: bool) -> list[tuple[str, float, float, float, float, int]]:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        out = []
        for name, c, s in zip(self.names, self.coef, se, strict=True):
            stat = c / s if s > 0 else float("nan")
            p = t_tail(stat, self.n - len(self.names)) if use_t else z_tail(stat)
            out.append((name, float(c), float(s), float(stat), float(p), self.n))
        return out


RESULT = "variable string, coef double, se double, statistic double, pvalue double, n_obs long"


def fit(df: DataFrame, formula: str, kind: str = "ols", cluster: str | None = None) -> Fit:
    """A linear (``ols``) or ``logit`` model; with ``cluster`` its covariance is robust to dependence inside clusters.

    Rows with a null cluster drop out then. The small-sample factor is G/(G-1) (N-1)/(N-K) for least squares, G/(G-1) for logit.
    """
    d, names = design(df, formula, [cluster] if cluster else [])
    if cluster:
        d = d.dropna(subset=[cluster])
    k = len(names)
    d = d.persist()
    try:
        n, sy, syy = d.agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
        if not n or n <= k:
            return Fit(names, np.full(k, np.nan), np.full((k, k), np.nan), int(n or 0), kind, float("nan"))
        if kind == "ols":
            s = _sums(d, k, None)
            bread = np.linalg.pinv(s[:k, :k])
            beta = bread @ s[:k, k]
            sse = float(syy - beta @ s[:k, k])
            cov, good = bread * sse / (n - k), 1 - sse / (syy - sy * sy / n) if syy - sy * sy / n else float("nan")
        else:
            beta, before = np.zeros(k), -np.inf
            for _ in range(60):
                s = _sums(d, k, beta)
                step = np.linalg.pinv(s[:k, :k]) @ s[:k, k]
                beta = beta + step
                if np.abs(step).max() < 1e-10 or abs(s[k, k] - before) < 1e-12 * abs(before):
                    break
                before = s[k, k]
            s = _sums(d, k, beta)
            bread = cov = np.linalg.pinv(s[:k, :k])
            share = sy / n
            null = n * (share * math.log(share) + (1 - share) * math.log(1 - share)) if 0 < share < 1 else float("nan")
            good = 1 - s[k, k] / null if null else float("nan")
        if cluster:
            fitted = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
            rest = F.col("y") - (fitted if kind == "ols" else 1 / (1 + F.exp(-fitted)))
            g = d.groupBy(cluster).agg(*(F.sum(F.col(f"x{i}") * rest).alias(f"u{i}") for i in range(k)))
            cells = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]
            row = g.agg(F.count(F.lit(1)).alias("g"), *cells).first()
            meat = np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
            factor = row["g"] / max(row["g"] - 1, 1) * ((n - 1) / (n - k) if kind == "ols" else 1)
            cov = bread @ meat @ bread * factor
        return Fit(names, beta, cov, int(n), kind, float(good))
    finally:
        d.unpersist()


def fitted_table(df: DataFrame, formula: str, kind: str = "ols", cluster: str | None = None) -> DataFrame:
    """The model as a table; least squares without clusters has t, everything else z statistics."""
    f = fit(df, formula, kind, cluster)
    return df.sparkSession.createDataFrame(f.table(use_t=kind == "ols" and cluster is None), RESULT)


def sparse_terms(df: DataFrame, outcome: str, flags: Sequence[str], least: int = 20) -> DataFrame:
    """``(variable, positives, least_cell, keep)``: 0/1 terms too rare, or empty in a cell with the outcome, to be fitted."""
    y = F.col(outcome).cast("int")
    cells = []
    for f in flags:
        x = F.col(f).cast("int")
        count = [F.count_if((x == a) & (y == b)) for a in (0, 1) for b in (0, 1)]
        cells.append(F.struct(F.lit(f).alias("variable"), F.count_if(x == 1).alias("positives"), F.least(*count).alias("least_cell")))
    g = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return g.withColumn("keep", (F.col("positives") >= least) & (F.col("least_cell") > 0))


# ---- agreement and contingency ---------------------------------------------------------------------------------------------
def kappa(pairs: DataFrame, a: str, b: str, order: Sequence[str], weights: str = "nominal") -> DataFrame:
    """``(n, agreement, kappa)`` of two ratings; ``weights`` nominal, linear or quadratic over ``order``. Other values drop out."""
    place = F.create_map(*(x for i, v in enumerate(order) for x in (F.lit(v), F.lit(float(i)))))
    rows = pairs.select(F.try_element_at(place, F.col(a)).alias("i"), F.try_element_at(place, F.col(b)).alias("j")).where("i is not null and j is not null")
    top = max(len(order) - 1, 1)
    cost = {"nominal": lambda gap: float(gap > 0), "linear": lambda gap: gap / top, "quadratic": lambda gap: (gap / top) ** 2}[weights]
    gap = F.abs(F.col("i") - F.col("j"))
    own = {"nominal": (gap > 0).cast("double"), "linear": gap / top, "quadratic": gap * gap / (top * top)}[weights]
    places = range(len(order))
    c = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gap == 0).alias("same"),
        F.sum(own).alias("d"),
        *(F.count_if(F.col("i") == float(p)).alias(f"a{p}") for p in places),
        *(F.count_if(F.col("j") == float(p)).alias(f"b{p}") for p in places),
    )
    expected = sum((F.col(f"a{p}") * F.col(f"b{q}") * cost(abs(p - q)) for p in places for q in places), F.lit(0.0))
    return c.select("n", F.try_divide("same", "n").alias("agreement"), (1 - F.try_divide(F.col("d") * F.col("n"), expected)).alias("kappa"))


def fleiss(ratings: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """``(n_items, kappa)`` over the items that exactly ``raters`` rated."""
    c = ratings.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    full = c.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).where(F.col("m") == raters)
    p = full.agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.col("pairs") / (raters * (raters - 1))).alias("seen"))
    by = c.join(full.select(item), item, "left_semi").groupBy(label).agg(F.sum("n").alias("n"))
    chance = by.agg(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).scalar()
    return p.select("n_items", F.try_divide(F.col("seen") - chance, 1 - chance).alias("kappa"))


def classification_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of the four cells, base rate, accuracy, precision, recall and F1 of two 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    c = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(
        F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn")
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(F.col("tp") + F.col("fn"), n).alias("base_rate"),
        F.try_divide(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def chi_square(df: DataFrame, a: str, b: str) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of independence; 2 x 2 tables with Yates' correction. The table itself is small."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).limit(10_001).collect()
    if len(cells) > 10_000:
        raise ValueError("too many cells for a contingency table")
    rows, columns = sorted({r[a] for r in cells}), sorted({r[b] for r in cells})
    t = np.zeros((len(rows), len(columns)))
    for r in cells:
        t[rows.index(r[a]), columns.index(r[b])] = r["n"]
    free = (len(rows) - 1) * (len(columns) - 1)
    if free < 1:
        return 0.0, 0, 1.0
    e = t.sum(1, keepdims=True) @ t.sum(0, keepdims=True) / t.sum()
    gap = np.abs(t - e)
    if free == 1:
        gap = gap - np.minimum(0.5, gap)
    x = float((gap**2 / e).sum())
    return x, free, chi2_tail(x, free)


def adjusted(results: DataFrame, p: str = "pvalue") -> DataFrame:
    """A table of results with Bonferroni's and Benjamini-Hochberg's p. It has a line per test, so one ordered pass is small."""
    from pyspark.sql.window import Window

    order = Window.orderBy(F.col(p), *[c for c in results.columns if c != p][:1])
    known = results.where(F.col(p).isNotNull())
    m = known.agg(F.count(F.lit(1))).scalar()
    r = known.withColumn("__r", F.row_number().over(order)).withColumn("bonferroni", F.least(F.col(p) * m, F.lit(1.0)))
    down = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("bh", F.least(F.min(F.col(p) * m / F.col("__r")).over(down), F.lit(1.0))).drop("__r")


def largest_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``(n_common, n_only_a, n_only_b, max_abs_diff)`` of two result tables."""
    j = a.select(key, F.col(value).alias("x"), F.lit(1).alias("ina")).join(b.select(key, F.col(value).alias("y"), F.lit(1).alias("inb")), key, "full")
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return j.agg(
        F.count_if(both).alias("n_common"), F.count_if(F.col("inb").isNull()).alias("n_only_a"), F.count_if(F.col("ina").isNull()).alias("n_only_b"),
        F.max(F.when(both, F.abs(F.col("x") - F.col("y")))).alias("max_abs_diff"),
    )
