"""Text classifiers: TF-IDF and logistic regression, staged cascades, cross-validation, response parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.statistics import kappa


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight`` N / (K n_k), so that every class weighs the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = counts.agg(F.struct(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return df.join(counts, label).withColumn("weight", whole["n"] / (whole["k"] * F.col("__n"))).drop("__n")


def train(df: DataFrame, text: str, label: str, features: int = 1 << 14, strength: float = 0.001) -> PipelineModel:
    """TF-IDF and balanced logistic regression of a 0/1 label. Hashed terms need no vocabulary on the driver."""
    rows = balanced(df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("double").alias("label")), "label")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(weightCol="weight", regParam=strength, standardization=False, maxIter=60),
    ]
    return Pipeline(stages=stages).fit(rows)


def probability(model: PipelineModel, df: DataFrame, text: str, name: str = "p") -> DataFrame:
    """``df`` with the probability of class 1; null texts have the empty text's."""
    scored = model.transform(df.withColumn("text", F.coalesce(F.col(text), F.lit("")))) if text != "text" else model.transform(df.fillna({"text": ""}))
    return scored.select(*(df[c] if c != "text" or text != "text" else F.col("text") for c in df.columns), vector_to_array("probability")[1].alias(name))


def staged(gate: Column, p: Column, low: float = 0.3, high: float = 0.7, decide: Callable[[Column], Column] | None = None) -> Column:
    """Decision of a staged classifier: out at the gate, clear by probability, or borderline, which a later stage may settle."""
    d = F.when(~F.coalesce(gate, F.lit(False)), "auto_negative").when(p < low, "negative").when(p >= high, "positive")
    return d.otherwise(decide(p) if decide else F.lit("borderline"))


def cascade(p_other: Column, p_hostile_if_clear: Column) -> list[Column]:
    """Probabilities of hostile, endorsing and other from a two-stage cascade."""
    clear = 1 - p_other
    return [(clear * p_hostile_if_clear).alias("p_hostile"), (clear * (1 - p_hostile_if_clear)).alias("p_endorsing"), p_other.alias("p_other")]


def cross_validated(df: DataFrame, key: str, text: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``(fold, n, agreement, kappa)``: held-out agreement per fold; folds are cut by a seeded hash of the key, whatever the class."""
    from loomline.session import cut_lineage

    d = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    d = cut_lineage(d.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(folds)).cast("int")))
    out = None
    for i in range(folds):
        m = train(d.where(F.col("fold") != i), "text", "y")
        held = probability(m, d.where(F.col("fold") == i), "text").select(F.col("y").cast("string").alias("y"), (F.col("p") >= 0.5).cast("int").cast("string").alias("g"))
        part = kappa(held, "y", "g", ["0", "1"]).select(F.lit(i).alias("fold"), "n", "agreement", "kappa")
        out = part if out is None else out.unionByName(part)
    return out


def tagged_sentences(df: DataFrame, key: str, text: str, tag: Callable[[Column], Column]) -> DataFrame:
    """``(key, tagged)``: the text with the tag of each sentence before it."""
    from loomline.functions.text import sentences

    s = F.transform(sentences(text), lambda x: F.concat(F.lit("<"), tag(x), F.lit("> "), x))
    return df.select(F.col(key).alias("key"), F.array_join(s, " ").alias("tagged"))


def parsed_labels(response: Column, categories: Sequence[str]) -> list[Column]:
    """0/1 flags of the categories a free-text answer names; "none" is all 0, an empty or failed answer all null."""
    low = F.lower(F.trim(response))
    failed = response.isNull() | (low == "") | low.startswith("error")
    return [F.when(failed, None).when(F.contains(low, F.lit("none")), 0).otherwise(F.contains(low, F.lit(c.lower())).cast("int")).alias(c) for c in categories]
