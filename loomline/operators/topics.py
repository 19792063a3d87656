"""Topics by nearest centroid, anchors, rollups and dominance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centroids and anchors go to every task; more than this many are refused, as they are a model's size, not the data's.
MOST_CENTROIDS = 20_000


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, vector)``: the mean vector of every label. Summed by place, so partial sums are combined map side."""
    each = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy(label).agg(ordered.alias(vector))


def _matrix(rows: list[object], what: str) -> np.ndarray:
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} {what}")
    m = np.array(rows, float) if rows else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest_centroid(df: DataFrame, key: str, vector: str, cents: DataFrame, label: str, least: float = 0.35) -> DataFrame:
    """``(key, topic, similarity)``: the label of the most similar centroid by cosine, the least label among equals; -1 below ``least``.

    Null and zero vectors have topic -1 and similarity 0.
    """
    listed = cents.orderBy(label).limit(MOST_CENTROIDS + 1).collect()
    labels = np.array([r[label] for r in listed], np.int64)
    m = _matrix([r[vector] for r in listed], "centroids")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic, best = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            ok = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
            if len(ok) and len(m):
                x = np.array(b.column(1).take(pa.array(ok)).to_pylist(), float)
                s = np.round((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ m.T, 12)
                at = s.argmax(1)
                best[ok] = s[np.arange(len(ok)), at]
                topic[ok] = np.where(best[ok] >= least, labels[at], -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(topic), pa.array(best)], names=["key", "topic", "similarity"])

    return df.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(run, f"key {kind}, topic long, similarity double")


def with_fallback(own: DataFrame, threads: DataFrame, key: str) -> DataFrame:
    """``own`` ``(key, topic)`` with the thread's topic where the row's is an outlier, else -1."""
    j = own.join(threads.select(key, F.col("topic").alias("__t")), key, "left")
    return j.select(*own.columns[:1], F.when(F.col("topic") >= 0, F.col("topic")).otherwise(F.coalesce("__t", F.lit(-1))).alias("topic"))


def dominance(df: DataFrame, period: Column, topic: str) -> DataFrame:
    """Per period its leading topic, that topic's rows and their share of the period."""
    counts = df.groupBy(period.alias("period"), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    g = counts.groupBy("period").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("m"), "topic")).alias("b"))
    return g.select("period", F.col("b.topic").alias("topic"), (-F.col("b.m")).alias("n"), (-F.col("b.m") / F.col("all")).alias("share"))


def anchor_margin(df: DataFrame, key: str, vector: str, high: DataFrame, low: DataFrame) -> DataFrame:
    """``(key, high, low, margin)``: cosine with the nearest anchor of each side, and the difference."""
    sides = [_matrix([r[0] for r in x.select(vector).limit(MOST_CENTROIDS + 1).collect()], "anchors") for x in (high, low)]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            h, l = ((x @ m.T).max(1) if len(m) and len(x) else np.zeros(len(x)) for m in sides)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h), pa.array(l), pa.array(h - l)], names=["key", "high", "low", "margin"])

    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(run, f"key {kind}, high double, low double, margin double")
