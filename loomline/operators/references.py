"""References to records that do not exist, are deleted, or arrive later.

Every referring row names a target and has a time. A target has up to two facts: when it was first removed and when it was
first seen. References are first aggregated per table, key and month (count, earliest and latest time), which combines map
side, so the shuffle carries groups instead of rows. Keys that hold more than one in ``heavy_share`` of all references are
heavy; by that definition there are fewer than ``heavy_share`` of them, so their facts may be broadcast. The facts of all
other keys are met by a shuffle join. Both parts are united. A group that lies on one side of both facts has a verdict for
all its rows; only rows of groups that a fact cuts in two are compared one by one. Where rows are wanted, those of heavy keys
meet their facts in the same way, without a shuffle, and only the others are shuffled to their groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.identifiers import full_name
from loomline.session import cut_lineage


@dataclass(frozen=True)
class Referrer:
    """A table with a column that refers to things of one kind."""

    name: str
    df: DataFrame
    row: str
    ref: str
    time: str
    kind: str


def references(referrers: list[Referrer]) -> DataFrame:
    """``(src_table, src_row, key, t, period)`` of every row that refers to something; null or bare references drop out."""
    out = None
    for r in referrers:
        part = r.df.select(
            F.lit(r.name).alias("src_table"),
            F.col(r.row).cast("long").alias("src_row"),
            full_name(r.ref, r.kind).alias("key"),
            F.lit(r.kind).alias("wanted"),
            F.col(r.time).cast("long").alias("t"),
        ).where("key is not null")
        out = part if out is None else out.unionByName(part)
    period = F.date_format(F.timestamp_seconds("t"), "yyyy-MM")
    return out.withColumn("period", period)


def target_facts(targets: list[tuple[DataFrame, str, str, str]], removals: DataFrame) -> DataFrame:
    """``(key, first_seen, first_removed)`` per thing; ``targets`` are (table, id column, time seen column, kind)."""
    seen = None
    for df, key, time, kind in targets:
        name = full_name(key, kind)
        # a row of the table of one kind is a thing of that kind whatever prefix its id was given
        part = df.select(
            F.concat(F.lit(f"{kind}_"), F.regexp_replace(name, r"^t\d_", "")).alias("key"), F.col(time).cast("long").alias("seen")
        ).where("key is not null")
        part = part.groupBy("key").agg(F.min("seen").alias("first_seen"), F.lit(True).alias("present"))
        seen = part if seen is None else seen.unionByName(part)
    gone = (
        removals.select(full_name("fullname", "t?").alias("key"), F.col("removed_utc").cast("long").alias("gone"))
        .where("key is not null and gone is not null")
        .groupBy("key")
        .agg(F.min("gone").alias("first_removed"))
    )
    return seen.join(gone, "key", "full").select("key", "first_seen", "first_removed", F.coalesce("present", F.lit(False)).alias("present"))


def _reason(t: Column) -> Column:
    """Verdict on a reference made at ``t``; a row without a time can be neither deleted nor late."""
    absent = ~F.coalesce(F.col("present"), F.lit(False)) | ~F.startswith(F.col("key"), F.col("wanted"))
    return (
        F.when(F.col("first_removed") <= t, "deleted").when(absent, "missing").when(F.col("first_seen") > t, "late")
    )


@dataclass(frozen=True)
class _Judged:
    """Groups of references with their verdicts, ``heavy`` keys apart, and the facts of these."""

    groups: DataFrame
    heavy: DataFrame
    heavy_facts: DataFrame


def _judged_groups(refs: DataFrame, facts: DataFrame, heavy_share: int) -> _Judged:
    groups = refs.groupBy("src_table", "wanted", "key", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    groups = cut_lineage(groups)  # read several times below; the tables themselves are then not read again
    facts = cut_lineage(facts)
    per_key = groups.groupBy("key").agg(F.sum("n").alias("n_key"))
    total = groups.agg(F.sum("n")).scalar()
    heavy = cut_lineage(per_key.where(F.col("n_key") * heavy_share > total).select("key"))  # fewer than heavy_share rows, whatever the input
    at_hand = facts.join(F.broadcast(heavy), "key", "left_semi")
    heavy_facts = cut_lineage(heavy.join(F.broadcast(at_hand), "key", "left"))
    of_heavy = groups.join(F.broadcast(heavy_facts), "key").withColumn("is_heavy", F.lit(True))
    of_rest = groups.join(F.broadcast(heavy), "key", "left_anti").join(facts, "key", "left").withColumn("is_heavy", F.lit(False))
    judged = of_heavy.unionByName(of_rest)
    first, last = _reason(F.col("t0")), _reason(F.col("t1"))
    return _Judged(judged.withColumn("reason", first).withColumn("cut", ~first.eqNullSafe(last)), heavy, heavy_facts)


def _rows_of_heavy(refs: DataFrame, judged: _Judged) -> DataFrame:
    """References to heavy keys, row by row against the facts of these keys, which are at hand; nothing is shuffled."""
    rows = refs.join(F.broadcast(judged.heavy_facts), "key").withColumn("reason", _reason(F.col("t")))
    return rows.where("reason is not null").select("src_table", "src_row", "period", "reason")


def _rows_of_rest(refs: DataFrame, judged: _Judged, which: str) -> DataFrame:
    """References to other keys, joined with their groups that match ``which``; none of these keys is hot."""
    groups = judged.groups.where("not is_heavy").where(which).select("src_table", "key", "period", "reason", "cut", "first_seen", "first_removed", "present")
    rest = refs.join(F.broadcast(judged.heavy), "key", "left_anti")
    r = rest.alias("r").join(
        groups.alias("g"),
        (F.col("r.src_table") == F.col("g.src_table"))
        & (F.col("r.key") == F.col("g.key"))
        & F.col("r.period").eqNullSafe(F.col("g.period")),
    )
    rows = r.select(
        "r.src_table", "r.src_row", "r.period", "r.wanted", "r.key", "r.t", "reason", "cut", "first_seen", "first_removed", "present"
    )
    verdict = F.when(F.col("cut"), _reason(F.col("t"))).otherwise(F.col("reason"))
    return rows.withColumn("reason", verdict).where("reason is not null").select("src_table", "src_row", "period", "reason")


def orphans(refs: DataFrame, facts: DataFrame, heavy_share: int = 1000) -> DataFrame:
    """``(src_table, src_row, period, reason)`` of every dangling reference.

    ``deleted``: the target was removed at or before the referring row's time; else ``missing``: no row is the target; else
    ``late``: the target was first seen after that time. Sound references and rows that refer to nothing give no row.
    Repeated rows each count. Empty tables give an empty result. Rows that refer to a heavy key are never shuffled.
    """
    refs = cut_lineage(refs)  # spellings are resolved once
    judged = _judged_groups(refs, facts, heavy_share)
    return _rows_of_heavy(refs, judged).unionByName(_rows_of_rest(refs, judged, "reason is not null or cut"))


def orphan_report(refs: DataFrame, facts: DataFrame, heavy_share: int = 1000) -> DataFrame:
    """``(src_table, reason, period, n)``: dangling references per table, reason and month.

    Groups with one verdict are counted as they are; only the rows of groups that a fact cuts in two are read again. A fact
    cuts one month per table, so the cut groups of heavy keys are few and go to the rows; those of other keys are not hot.
    """
    refs = cut_lineage(refs)  # spellings are resolved once
    judged = _judged_groups(refs, facts, heavy_share)
    columns = ("src_table", "reason", "period")
    whole = judged.groups.where("reason is not null and not cut").select(*columns, "n")
    few = judged.groups.where("is_heavy and cut").select("src_table", "key", "period", "first_seen", "first_removed", "present")
    heavy = refs.join(F.broadcast(few), ["src_table", "key", "period"]).withColumn("reason", _reason(F.col("t"))).where("reason is not null")
    rows = heavy.select(*columns).unionByName(_rows_of_rest(refs, judged, "cut").select(*columns)).withColumn("n", F.lit(1).cast("long"))
    return whole.unionByName(rows).groupBy(*columns).agg(F.sum("n").alias("n"))
