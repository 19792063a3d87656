"""Exactly-once view of messages that were delivered at least once.

Identifiers are numbers written in base 36 that producers hand out in sequence. A producer is the block of numbers that
share all but their last bits, as many as hold ``seq_digits`` digits (2,048 numbers for two digits). For every producer the acceptor keeps the numbers seen so far as disjoint
ranges: a delivery whose number no range covers is accepted and its number merged into the ranges, a covered one is a
repetition. Identifiers that are not canonical base-36 numbers are resolved by their exact text: a task sorts them by text, so
that equal ones are neighbours and it need remember only one.

The acceptor runs twice. First inside every input partition, in order of delivery and without a shuffle, so that however
often one identifier was delivered at most one row of it leaves a partition as a candidate. Then the candidates alone are
shuffled by producer and accepted again in order of delivery. Rows turned away in either pass are the repetitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.identifiers import full_name


class SeenRanges:
    """Disjoint, closed, ascending ranges of numbers; those of all producers in one pair of arrays, as blocks don't overlap."""

    def __init__(self, bits: int) -> None:
        self.bits = bits  # a number's producer is what is left without so many bits
        self.start = np.empty(0, np.int64)
        self.end = np.empty(0, np.int64)

    def covered(self, n: np.ndarray) -> np.ndarray:
        """Which of ``n`` lie in a range."""
        if not len(self.start):
            return np.zeros(len(n), bool)
        at = np.searchsorted(self.start, n, side="right") - 1
        return (at >= 0) & (n <= self.end[np.maximum(at, 0)])

    def add(self, n: np.ndarray) -> None:
        """Merge ascending, distinct, uncovered numbers, joining a producer's ranges that touch."""
        if not len(n):
            return
        at = np.searchsorted(self.start, n)
        s, e = np.insert(self.start, at, n), np.insert(self.end, at, n)
        first = np.r_[True, (s[1:] > e[:-1] + 1) | (s[1:] >> self.bits != e[:-1] >> self.bits)]
        self.start, self.end = s[first], e[np.r_[np.flatnonzero(first)[1:] - 1, len(e) - 1]]

    def accept(self, n: np.ndarray) -> np.ndarray:
        """Mask of the deliveries in ``n`` (in order of delivery) that are the first of their number."""
        values, at = np.unique(n, return_index=True)  # the first place of each number
        new = ~self.covered(values)
        self.add(values[new])
        ok = np.zeros(len(n), bool)
        ok[at[new]] = True
        return ok


def _acceptor(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over columns number, odd, pos, ok: rows that come with ``ok`` false stay so, the others are accepted or not."""

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = SeenRanges(bits), None
        for b in batches:
            ok = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            plain = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(plain & ok)
            ok[rows] = seen.accept(b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64))
            rows = np.flatnonzero(~plain & ok)
            keys = b.column(1).take(pa.array(rows)).to_pylist()
            ok[rows] = [key != before for before, key in zip([last, *keys], keys, strict=False)]
            last = keys[-1] if keys else last
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ok)], names=b.schema.names)

    return accept


_OUT = "number long, odd string, pos long, ok boolean"


def _keyed(df: DataFrame, id_col: str, pos_col: str, kind: str) -> DataFrame:
    key = full_name(id_col, kind)
    bare = F.regexp_replace(key, rf"^{kind}_", "")
    # canonical: no leading zero and at most twelve digits, so that equal numbers mean equal texts and fit in 64 bits
    canonical = bare.rlike("^[1-9a-z][0-9a-z]{0,11}$")
    number = F.when(canonical, F.conv(bare, 36, 10).cast("long"))
    return df.select(key.alias("key"), number.alias("number"), F.col(pos_col).cast("long").alias("pos")).where(
        "key is not null and pos is not null"
    ).select(
        "number",
        F.when(F.col("number").isNull(), F.col("key")).alias("odd"),
        "pos",
    )


def repeated_deliveries(
    df: DataFrame, id_col: str = "id", pos_col: str = "delivery_no", kind: str = "t1", seq_digits: int = 2
) -> DataFrame:
    """``(pos)`` of every row whose identifier already stands in a row with a lower position.

    ``pos_col`` gives the order of delivery. A row whose identifier is null, empty or a bare kind has no identity and is
    never a repetition; a row without a position is none either. Of rows that agree in identifier and position exactly
    one is kept and the others are repetitions. An empty table gives an empty result. Other columns are not read.
    """
    bits = int(np.ceil(np.log2(36.0**seq_digits)))
    keyed = _keyed(df, id_col, pos_col, kind).withColumn("ok", F.lit(True))
    order = (F.col("odd").asc_nulls_first(), "pos")  # malformed identifiers by text, all others in order of delivery
    once = keyed.sortWithinPartitions(*order).mapInArrow(_acceptor(bits), _OUT)
    # Rows turned away already are done with: they are spread evenly, so a hot identifier makes no hot task.
    to = F.when(F.col("ok"), F.coalesce(F.shiftright("number", bits), F.xxhash64("odd"))).otherwise(F.xxhash64("pos"))
    again = once.repartition(to).sortWithinPartitions(*order).mapInArrow(_acceptor(bits), _OUT)
    return again.where("not ok").select("pos")


def deliver_once(
    df: DataFrame, id_col: str = "id", pos_col: str = "delivery_no", kind: str = "t1", seq_digits: int = 2
) -> DataFrame:
    """The rows of ``df`` with exactly one, the earliest delivered, of each identifier; rows without identity stay.

    ``pos_col`` must be unique, as an order of delivery is. Whole rows never pass through Python: the repetitions' positions
    are found on three short columns and taken away by an anti join, whose right side is the minority of repeated rows.
    """
    gone = repeated_deliveries(df, id_col, pos_col, kind, seq_digits).withColumnRenamed("pos", "__pos")
    return df.join(gone, df[pos_col] == gone["__pos"], "left_anti")


def repetition_counts(df: DataFrame, by: Column, **kw: str) -> DataFrame:
    """Per ``by``: rows delivered and how many of them were repetitions."""
    gone = repeated_deliveries(df, **kw).withColumn("__again", F.lit(1))
    pos = kw.get("pos_col", "delivery_no")
    return (
        df.join(gone, df[pos] == gone["pos"], "left")
        .groupBy(by.alias("part"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("__again").alias("n_again"))
    )
