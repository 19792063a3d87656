"""Relational building blocks with fully determined results: every choice among rows has a total order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # for n = 1 Spark keeps only the leading rows per key before and after the shuffle (window group limit)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def shares(counts: DataFrame, value: str, name: str = "share") -> DataFrame:
    """``counts`` with each line's share of the sum of ``value``; the sum is a scalar subquery, not a one-task window."""
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn(name, F.try_divide(F.col(value).cast("double"), total))


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, ``value``, ``n``: the most frequent value of each key, the least value among equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), (-F.col("b.minus")).alias("n"))


def top_with_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """As :func:`most_frequent` with the share of the key's rows that have the value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_all"), F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("v"))).alias("b")
    )
    return best.select(*keys, F.col("b.v").alias(value), (-F.col("b.minus")).alias("n"), (-F.col("b.minus") / F.col("n_all")).alias("share"))


def concentration(df: DataFrame, key: str, part: str, least: int = 3) -> DataFrame:
    """Herfindahl index of each key over its parts, with the leading part and its share; keys of fewer rows drop out."""
    counts = df.groupBy(key, part).agg(F.count(F.lit(1)).alias("n"))
    g = counts.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.min(F.struct((-F.col("n")).alias("minus"), F.col(part).alias("v"))).alias("b"),
    )
    return g.where(F.col("total") >= least).select(
        key,
        "total",
        (F.col("squares") / (F.col("total") * F.col("total"))).alias("hhi"),
        F.col("b.v").alias("leading"),
        (-F.col("b.minus") / F.col("total")).alias("leading_share"),
    )


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)``: Pearson's correlation of every two columns, all in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    lines = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(lines))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the rank of ``value``, tied ones sharing their mean rank; null values have none.

    Ranks are counted over distinct values in ranges, so that no task orders them all, and go back to the rows by a join that
    spreads the rows of frequent values.
    """
    c = cut_lineage(cumulative(df, value))
    ranks = c.select(F.col("v").alias(value), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return skew_join(df, ranks, c.select(F.col("v").alias(value), "n"), value, "n", "left").select(*df.columns, name)


def cumulative(df: DataFrame, value: str) -> DataFrame:
    """``(v, n, before)``: each distinct value, its rows, and the rows of all lesser values; null values are left out.

    Values are spread by ranges. A range is added up by itself, and only the ranges' sums, one line per task, pass through one.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(counts.repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum("n").alias("s"))
    sums = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sums), "part").select("v", "n", (F.col("start") + inside).alias("before"))


def quantiles(df: DataFrame, value: str, at: Sequence[float], discrete: bool = False) -> DataFrame:
    """One row ``(q)``: the array of exact quantiles, interpolated ones or, if ``discrete``, values that occur; nulls if there is no value."""
    c = cut_lineage(cumulative(df, value))
    total = c.agg(F.sum("n")).scalar()
    upto = F.col("before") + F.col("n")
    at_rank = lambda r: F.min(F.when(upto > r, F.col("v")))  # noqa: E731  the value of the row with so many rows before it
    c = c.withColumn("all", total)
    out = []
    for q in at:
        if discrete:
            out.append(F.min(F.when(upto >= F.lit(q) * F.col("all"), F.col("v"))))
            continue
        pos = F.lit(q) * (F.col("all") - 1)
        low, high = at_rank(F.floor(pos)), at_rank(F.ceil(pos))
        out.append(low + (high - low) * F.first(pos - F.floor(pos)))
    return c.agg(F.array(*out).alias("q"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(rho, n)``: rank correlation over the rows where both values are present."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    ranked = average_ranks(average_ranks(rows, "__a", "__ra"), "__b", "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """``df`` with ``name``: the quantile bin from 0, right-closed, the least value in the first, equal edges merged.

    Edges are interpolated quantiles, computed once as a scalar. Null values have no bin.
    """
    edges = quantiles(df, value, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q")).scalar()
    above = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    out = df.withColumn("__edges", edges)
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(above - 1, F.lit(0)))).drop("__edges")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """``(rows, columns, n, row_share)`` with the count of every cell and its share of the row."""
    cells = df.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(F.col(rows).alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    j = cells.join(totals, cells[rows].eqNullSafe(totals["__r"]))
    return j.select(rows, columns, "n", (F.col("n") / F.col("__n")).alias("row_share"))


def keep_extreme(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """One whole row per key, the greatest by ``by``; an aggregate, so copies of a hot key are combined map side."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*(c.alias(f"__{i}") for i, c in enumerate(by)), *(F.col(c) for c in df.columns if c not in keys))).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{c}").alias(c) for c in df.columns if c not in keys)).select(*df.columns)


def anti(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys, as text, do not stand in ``other``."""
    o = other.select(*(F.col(k).cast("string").alias(f"__{k}") for k in keys)).distinct()
    on = [F.col(k).cast("string") == F.col(f"__{k}") for k in keys]
    return df.join(o, on, "left_anti")


def ordered_concat(df: DataFrame, key: str, text: str, order: str, sep: str = " ", most: int = 1_000_000, block: int = 4096) -> DataFrame:
    """``(key, start, text)``: the whole texts of a key joined in order, null texts left out.

    ``order`` is a whole number. A key has one line that starts at 0, unless its text is much longer than ``most`` signs: then it has
    several, cut between rows, and ``start`` is a line's place in the key's whole text. Lines in order, with ``sep`` between them,
    are that text. No task ever holds more than about ``most`` signs and one ``block`` of ``order`` of a key, however hot it is.
    """
    d = df.where(F.col(text).isNotNull()).select(
        key, F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62))).alias("__b"), F.col(order).alias("__o"), F.col(text).alias("__t")
    )
    sizes = d.groupBy(key, "__b").agg(F.sum(F.length("__t") + len(sep)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = sizes.withColumn("__s", before).where(F.col("__s") >= most).select(F.col(key).alias("__k"), F.col("__b").alias("__c"), "__s")
    j = d.join(later, d[key].eqNullSafe(later["__k"]) & (d["__b"] == later["__c"]), "left").withColumn("__s", F.coalesce("__s", F.lit(0)))
    rows = F.sort_array(F.collect_list(F.struct("__o", "__t")))
    g = j.groupBy(key, F.floor(F.col("__s") / most).alias("__p")).agg(F.min("__s").alias("start"), rows.alias("__r"))
    return g.select(key, "start", F.array_join(F.transform("__r", lambda x: x["__t"]), sep).alias(text))


def skew_join(left: DataFrame, right: DataFrame, counts: DataFrame, keys: str | Sequence[str], n: str, how: str = "inner", heavy_share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique, so that no hot key is shuffled to one task.

    ``counts`` names each key with its number ``n`` of rows. Keys with more than one in ``heavy_share`` of all rows are heavy; there
    are fewer than ``heavy_share`` of them by that definition, so their lines of ``right`` are broadcast. The rows of all
    other keys are shuffled. Null keys meet nothing. ``left`` is read twice and should be a written table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = counts.agg(F.sum(n)).scalar()
    heavy = cut_lineage(counts.where(F.col(n) * heavy_share > total).select(*keys))
    at_hand = right.join(F.broadcast(heavy), keys, "left_semi")
    of_heavy = left if how == "inner" else left.join(F.broadcast(heavy), keys, "left_semi")
    of_heavy = of_heavy.join(F.broadcast(at_hand), keys, how)
    return of_heavy.unionByName(left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, how))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by a seeded hash of ``key``: the same for a seed, whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, quota: int, seed: int = 0) -> DataFrame:
    """Up to ``quota`` rows of each stratum by a seeded hash; a short stratum gives all it has."""
    return first_per_key(df, strata, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], quota)


def train_validation(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """``df`` with ``part``, ``train`` for about ``share`` of the keys."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("part", F.when(u < share, "train").otherwise("validation"))


def by_bins(df: DataFrame, template: Callable[[DataFrame], DataFrame], value: str, bins: Sequence[tuple[str, float, float]]) -> DataFrame:
    """``template`` applied to the rows of each half-open bin ``(name, low, high)``, united with the bin's name."""
    parts = [template(df.where((F.col(value) >= lo) & (F.col(value) < hi))).withColumn("bin", F.lit(name)) for name, lo, hi in bins]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
