"""Lookup lists, matching cascades, evidence rules, quotas and strata of fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import statistics as S
from loomline.session import cut_lineage


def by_priority(lists: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key from several lists; where they agree in the key the earlier list wins."""
    united = None
    for i, x in enumerate(lists):
        part = x.withColumn("__rank", F.lit(i))
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    rest = [c for c in united.columns if c not in (*keys, "__rank")]
    best = united.groupBy(*keys).agg(F.min(F.struct("__rank", *rest)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{c}").alias(c) for c in rest))


def first_contained(text: Column, names: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first name of a short list that the text contains."""
    out = F.lit(otherwise)
    for name, label in reversed(names):
        out = F.when(F.contains(text, F.lit(name)), label).otherwise(out)
    return out


def cascade(df: DataFrame, key: str, lists: Sequence[tuple[str, DataFrame]], otherwise: str = "none") -> DataFrame:
    """``df`` with ``matched``: the name of the first list that has the key. Lists hold ``key``; repeated entries do not multiply."""
    hit = F.lit(None).cast("string")
    for i, (name, known) in enumerate(lists):
        marked = known.select(F.col(key).alias(f"__k{i}")).distinct()
        df = df.join(marked, df[key] == marked[f"__k{i}"], "left")
        hit = F.coalesce(hit, F.when(F.col(f"__k{i}").isNotNull(), F.lit(name)))
    return df.withColumn("matched", F.coalesce(hit, F.lit(otherwise))).drop(*(f"__k{i}" for i in range(len(lists))))


def containments(df: DataFrame, key: str, text: str, names: DataFrame, name: str, gram: int = 3, at_hand: int = 64 << 20) -> DataFrame:
    """``(key, name)``: every name of a table that a text contains, anywhere and in any letter case.

    Not every text is compared with every name: both are met by the first letters of the name, ``gram`` of them, or 4, 16 or 64
    times as many if the name has them, which are among the text's runs of so many letters, and only such pairs are compared.
    Shorter names are met by all they have. Runs are made only of the numbers of letters that names are met by. Names and texts
    that are null, and empty names, give nothing; a name listed twice counts once.

    The names are written once and measured: up to ``at_hand`` bytes they go to the tasks, and no text is shuffled; beyond that both
    are shuffled. The runs, about a hundred times the texts, are never broadcast, however small Spark takes the texts to be.
    """
    own = names.select(F.col(name).alias("name"), F.lower(name).alias("__low")).where(F.length("__low") > 0).distinct()
    n = F.length("__low")
    head = F.coalesce(*(F.when(n >= gram * k, gram * k) for k in (64, 16, 4, 1)), n)
    own = cut_lineage(own.withColumn("__gram", F.substring("__low", F.lit(1), head)))
    size = F.sum(F.octet_length("name") + F.octet_length("__low") + F.octet_length("__gram") + 64)
    known = own.agg(size.alias("size"), F.collect_set(F.length("__gram")).alias("heads")).first()
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.lower(text).alias("__text"))
    # found by a look ahead, in one pass: a substring by its position is looked for from the text's start
    runs = [F.regexp_extract_all("__text", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sorted(known["heads"])]
    runs = F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")
    own = F.broadcast(own) if (known["size"] or 0) <= at_hand else own.hint("merge")
    met = rows.withColumn("__gram", F.explode(runs)).join(own, "__gram")
    return met.where(F.contains(F.col("__text"), F.col("__low"))).select("key", "name").distinct()


def attribution_class(quote: Column, verb: Column, entity: Column) -> Column:
    """What a text's quotation, reporting verb and entity make together."""
    return (
        F.when(quote & verb & entity, "quoted source")
        .when(verb & entity, "reported source")
        .when(quote & entity, "quote near entity")
        .when(quote & verb, "unnamed quote")
        .when(entity, "entity only")
        .when(verb, "verb only")
        .when(quote, "quote only")
        .otherwise("none")
    )


def most_informative(labels: DataFrame, key: str, label: str, least: int, most: Column) -> DataFrame:
    """``(key, label, df)``: of each key's labels the one of lowest document frequency between the bounds."""
    df_ = labels.groupBy(label).agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least) & (F.col("df") <= most))
    return labels.join(df_, label).groupBy(key).agg(F.min(F.struct("df", label)).alias("b")).select(key, f"b.{label}", "b.df")


def evidence_level(agreeing: Column, n: Column) -> Column:
    """Confidence by the share of the evidence that agrees."""
    return F.when(agreeing == n, "high").when((agreeing * 2 >= n) & (agreeing > 0), "medium").when(agreeing > 0, "low").otherwise("none")


def lean(a: Column, b: Column) -> Column:
    """a / (a + b), a half where there is neither."""
    return F.when(a + b > 0, a / (a + b)).otherwise(0.5)


def quota_per_value(df: DataFrame, value: str, quota: Mapping[object, int], order: Sequence[Column], otherwise: int) -> DataFrame:
    """The first rows of each value in order, as many as its quota says."""
    limit = F.lit(otherwise)
    for v, n in quota.items():
        limit = F.when(F.col(value) == v, n).otherwise(limit)
    top = max([*quota.values(), otherwise])
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(value).orderBy(*order))).where(F.col("__rn") <= top)
    return ranked.where(F.col("__rn") <= limit).drop("__rn")


def kmeans_centroids(df: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """``(label, vector)``: k centroids of the unit vectors, the same for a seed and partitioning."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("u"))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(rows.select(array_to_vector("u").alias("features")))
    cents = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(cents, f"label int, {vector} array<double>")


def fit_strata(df: DataFrame, formula: str, stratum: str, values: Sequence[int], covariances: Mapping[str, str | None], kind: str = "ols", least: int = 30) -> DataFrame:
    """The model of every stratum and covariance in one table; strata of fewer rows give one line with a note."""
    rows: list[tuple[object, ...]] = []
    counts = {r[stratum]: r["n"] for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).where(F.col(stratum).isin(*values)).collect()}
    for v in values:
        for name, cluster in covariances.items():
            if counts.get(v, 0) < least:
                rows.append((v, name, None, None, None, None, None, counts.get(v, 0), "too few rows"))
                continue
            f = S.fit(df.where(F.col(stratum) == v), formula, kind, cluster)
            rows += [(v, name, *r, None) for r in f.table(use_t=kind == "ols" and cluster is None)]
    return df.sparkSession.createDataFrame(rows, f"stratum int, covariance string, {S.RESULT}, note string")
