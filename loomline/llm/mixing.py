"""Mixing sources to target weights, by capped water-filling.

The level rises over all sources in proportion to their weights; a source whose level reaches all its tokens times the
number of times it may be repeated is clamped there, and what it cannot take is spread over the others in proportion,
until every share is feasible. A source's share is then whole repetitions of all its records and a fraction of one more:
records enter the fraction in the order of a seeded hash until the wanted tokens are reached.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.tokens import VOCABULARY, token_counts
from loomline.session import cut_lineage


def source_name(c: Column | str) -> Column:
    """One spelling of a source: lower case, no white space at the ends, ``_`` for ``-``; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "-", "_")
    return F.when(s != "", s)


def water_fill(weight: np.ndarray, cap: np.ndarray, budget: float) -> np.ndarray:
    """Amounts in proportion to ``weight``, none above ``cap``, that add up to ``budget`` or to all caps if that is less."""
    weight, cap = np.where(cap > 0, weight, 0.0), cap.astype(float)
    out = np.zeros(len(weight))
    open_ = weight > 0
    left = min(float(budget), cap[open_].sum())
    while open_.any() and left > 1e-9:
        level = left / weight[open_].sum()
        full = open_ & (level * weight >= cap - 1e-9)
        if not full.any():
            out[open_] = level * weight[open_]
            break
        out[full] = cap[full]
        left -= cap[full].sum()
        open_ &= ~full
    return out


def _plan(sizes: DataFrame, targets: DataFrame, budget: int | None) -> DataFrame:
    """One line per source of ``targets``, a list made by hand: weight, tokens, cap, wanted tokens, repetitions.

    Sources of the documents that are no target have no share and never reach the driver, however many they are.
    """
    t = targets.select(source_name("source").alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").alias("r"))
    t = t.where("source is not null").groupBy("source").agg(
        F.sum(F.when((F.col("w") > 0) & ~F.isnan("w"), F.col("w")).otherwise(0.0)).alias("w"), F.max(F.greatest("r", F.lit(0))).alias("r")
    )
    p = sizes.join(F.broadcast(t), "source", "right").select("source", "w", "r", "tokens", "docs").toPandas().sort_values("source")
    w, tokens = p["w"].fillna(0.0).to_numpy(float), p["tokens"].fillna(0).to_numpy(float)
    cap = tokens * p["r"].fillna(0).to_numpy(float)
    wanted = water_fill(w, cap, budget if budget is not None else tokens[w > 0].sum())
    share = w / w.sum() if w.sum() else w
    repeat = np.divide(wanted, tokens, out=np.zeros(len(w)), where=tokens > 0)
    whole = np.floor(repeat + 1e-12)
    rows = [
        (s, float(a), int(k), float(c), float(q), int(n), int(round((r - n) * k)))
        for s, a, k, c, q, n, r in zip(p["source"], share, tokens, cap, wanted, whole, repeat, strict=True)
    ]
    kind = "source string, target_share double, tokens long, cap double, wanted double, whole long, part long"
    return sizes.sparkSession.createDataFrame(rows, kind)


def mixture(
    documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, path: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """The records with their repetitions ``(doc_id, source, n_tokens, repeats)`` and the report per source.

    The total is ``budget`` tokens, by default all tokens of the sources that have a weight, or what the caps allow if that is
    less. Records of a source without a target, with weight 0 or without a name are left out; a target without records gets
    nothing, and its weight goes to the others. A source listed twice has the sum of its weights and the larger cap; null or
    negative weights and caps are 0. Records without tokens cost nothing and follow their source's whole repetitions.
    """
    d = token_counts(documents.withColumn("source", source_name("source")), ["doc_id", "source"], path=path).where("source is not null")
    d = cut_lineage(d)
    sizes = d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = cut_lineage(_plan(sizes, targets, budget))
    h = d.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftright(F.col("h"), 50))
    # Where in the hash order the fraction ends: sums per bucket first, single records of the bucket that holds the end after.
    sums = h.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = h.withColumn("run", F.sum("n_tokens").over(inside)).join(sums, ["source", "bucket"])
    ranked = ranked.join(F.broadcast(plan.where("wanted > 0").select("source", "whole", "part")), "source")
    # a record enters the fraction if at least half of it lies before the end
    extra = (F.col("before") + F.col("run") - F.col("n_tokens") / 2 <= F.col("part")) & (F.col("part") > 0) & (F.col("n_tokens") > 0)
    repeats = (F.col("whole") + extra.cast("long")).cast("int")
    records = ranked.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")
    got = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.max("repeats").alias("max_used"))
    everything = got.agg(F.sum("actual_tokens")).scalar()
    wanted = plan.agg(F.sum("wanted")).scalar()
    actual, due = (F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c, total in (("actual_tokens", everything), ("wanted", wanted)))
    # all sources, those without a target too
    both = plan.withColumnRenamed("tokens", "own").join(sizes.select("source", F.col("tokens").alias("met")), "source", "full")
    report = both.join(got, "source", "left").select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("met", "own").alias("tokens"),
        F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        actual.alias("actual_share"),
        F.abs(actual - due).alias("share_error"),
        F.coalesce("max_used", F.lit(0)).alias("max_used"),
        F.coalesce((F.col("wanted") >= F.col("cap") - 1e-6) & (F.col("wanted") > 0), F.lit(False)).alias("clamped"),
    )
    return records, report
