"""Populations of comments and profiles of authors and threads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.relational import first_per_key, quantiles

# Names that are no author of interest.
NOT_AUTHORS = ("[deleted]", "[removed]", "AutoModerator")


def real_authors(df: DataFrame, author: str = "author") -> DataFrame:
    """Rows of a named author; null authors drop out as in SQL's NOT IN."""
    return df.where(~F.col(author).isin(*NOT_AUTHORS))


def elasticity_flags(posts: DataFrame, audited: DataFrame, key: str = "id") -> DataFrame:
    """``posts`` with ``elasticity_ratio`` (score per comment, the score itself without comments) and crosspost flags."""
    ratio = F.when(F.col("num_comments") > 0, F.col("score") / F.col("num_comments")).otherwise(F.col("score").cast("double"))
    crossposted = F.coalesce((F.col("num_crossposts") >= 1).cast("int"), F.lit(0))
    marked = audited.select(F.col(key).alias("__k")).distinct().withColumn("__in", F.lit(1))
    j = posts.join(marked, posts[key] == marked["__k"], "left")
    return j.select(
        *(posts[c] for c in posts.columns), ratio.alias("elasticity_ratio"), crossposted.alias("is_crossposted"), F.coalesce("__in", F.lit(0)).alias("is_high_crosspost")
    )


def brigade_flags(comments: DataFrame, key: str, author: str = "author", score: str = "upvotes") -> DataFrame:
    """Strongly rated comments with their author's number of comments and the two brigade flags."""
    rows = real_authors(comments, author).select(F.col(key).alias("comment_id"), F.col(author).alias("author"), F.col(score).alias("score"))
    counts = rows.groupBy("author").agg(F.count(F.lit(1)).alias("total_global_comments"))
    strong = rows.where((F.col("score") >= 100) | (F.col("score") <= -6)).join(counts, "author")
    return strong.select(
        "comment_id",
        "author",
        "score",
        "total_global_comments",
        ((F.col("score") >= 100) & (F.col("total_global_comments") == 1)).cast("int").alias("brigade_upvote_flag"),
        ((F.col("score") <= -6) & (F.col("total_global_comments") >= 21)).cast("int").alias("brigade_downvote_flag"),
    )


def presence_ratio(comments: DataFrame, insiders: DataFrame, thread: str, author: str = "author") -> DataFrame:
    """Per thread its distinct commenters, how many of them are insiders, and the ratio."""
    pairs = real_authors(comments, author).select(thread, author).where(F.col(thread).isNotNull()).distinct()
    known = insiders.select(F.col(author).alias("__a")).distinct()
    j = pairs.join(known, pairs[author] == known["__a"], "left")
    g = j.groupBy(thread).agg(F.count(F.lit(1)).alias("n_distinct_commenters"), F.count("__a").alias("n_insider_commenters"))
    return g.withColumn("insider_presence_ratio", F.col("n_insider_commenters") / F.col("n_distinct_commenters"))


def population(
    comments: DataFrame, threads: DataFrame, presence: DataFrame | None, brigades: DataFrame, key: str, thread: str, order: str, presence_least: float = 0.75, p: float = 0.33
) -> DataFrame:
    """Comments of threads that were not spread widely, free of brigades, one row per id.

    With ``presence`` the pure form: low-elasticity threads (at or below the discrete quantile ``p``) with enough insiders; with
    None the unfiltered form. ``threads``, ``presence`` and ``brigades`` are keyed by ``thread`` and ``key``.
    """
    t = threads.where(F.col("is_high_crosspost") == 0)
    if presence is not None:
        cut = quantiles(threads, "elasticity_ratio", [p], discrete=True).select(F.col("q")[0]).scalar()
        t = t.where(F.col("elasticity_ratio") <= cut).join(presence.where(F.col("insider_presence_ratio") >= presence_least), thread, "left_semi")
    flagged = brigades.where((F.col("brigade_upvote_flag") == 1) | (F.col("brigade_downvote_flag") == 1)).select(key)
    rows = comments.join(t.select(thread, "elasticity_ratio"), thread).join(flagged, key, "left_anti")
    return first_per_key(rows, [key], [F.col(order), F.col("elasticity_ratio")])


def repeat_posters(df: DataFrame, author: str, text: str, bot_name: str = r"(?i)^automoderator$|bot$", left_out: Sequence[str] = ("[deleted]", "AutoModerator")) -> DataFrame:
    """Per author rows, distinct texts, their ratio to two places, and whether it is likely a bot or a repeat poster.

    Null authors and those ``left_out`` give no line. An author without any text has no ratio.
    """
    rows = df.where(F.col(author).isNotNull() & ~F.col(author).isin(*left_out))
    g = rows.groupBy(author).agg(F.count(F.lit(1)).alias("n_comments"), F.countDistinct(text).alias("n_distinct_texts"))
    ratio = F.try_divide("n_comments", "n_distinct_texts")
    named = F.col(author).rlike(bot_name)
    likely = named | F.coalesce(ratio >= 20, F.lit(False))
    repeat = ~likely & (F.col("n_comments") >= 20) & F.coalesce(ratio >= 1.5, F.lit(False))
    return g.select(
        author, "n_comments", "n_distinct_texts", F.round(ratio, 2).alias("dup_ratio"), named.alias("is_named_bot"), likely.alias("is_likely_bot"), repeat.alias("is_repeat_poster")
    )


def ladder(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first step whose upper bound is not below ``value``."""
    out = None
    for bound, name in steps:
        out = F.when(value <= bound, name) if out is None else out.when(value <= bound, name)
    return out.otherwise(last)


def activity_tiers(df: DataFrame, author: str = "author") -> DataFrame:
    """Tiers of activity: authors, their rows, and both as shares in percent."""
    counts = real_authors(df, author).groupBy(author).agg(F.count(F.lit(1)).alias("n"))
    steps = [(1, "1"), (5, "2-5"), (20, "6-20"), (50, "21-50"), (200, "51-200"), (1000, "201-1000")]
    t = counts.groupBy(ladder(F.col("n"), steps, "1001+").alias("tier")).agg(F.count(F.lit(1)).alias("n_authors"), F.sum("n").alias("n_rows"))
    all_ = t.agg(F.struct(F.sum("n_authors").alias("a"), F.sum("n_rows").alias("r"))).scalar()
    return t.select("tier", "n_authors", "n_rows", (F.col("n_authors") * 100 / all_["a"]).alias("pct_authors"), (F.col("n_rows") * 100 / all_["r"]).alias("pct_rows"))


def monthly_active(df: DataFrame, author: str = "author", time: str = "created_utc", heavy: int = 21) -> DataFrame:
    """Per month the distinct authors and how many of them have at least ``heavy`` rows in all."""
    rows = real_authors(df, author).where(F.col(time).isNotNull())
    # one line per author and month first, then one pass: an author's total comes from those lines
    months = rows.groupBy(author, F.date_format(F.timestamp_seconds(time), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    total = months.groupBy(author).agg(F.sum("n").alias("total"))
    j = months.join(total, author)
    return j.groupBy("month").agg(F.count(F.lit(1)).alias("n_authors"), F.count_if(F.col("total") >= heavy).alias("n_heavy"))


def cohorts(df: DataFrame, author: str = "author", score: str = "upvotes", value: str = "controversiality") -> DataFrame:
    """Cohorts by an author's number of rows and a row's score: size, mean and discrete quantiles of ``value``."""
    counts = real_authors(df, author).groupBy(author).agg(F.count(F.lit(1)).alias("n"))
    j = df.join(counts, author)
    s, n = F.col(score), F.col("n")
    cohort = F.when((s >= 100) & (n == 1), "one-off hit").when((s <= -6) & (n >= 21), "regular sunk").when(s.between(5, 49) & (n >= 21), "regular liked")
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    g = j.withColumn("cohort", cohort).where("cohort is not null").groupBy("cohort")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), disc(0.5).cast("int").alias("p50"), disc(0.9).cast("int").alias("p90"))


def affinity(counts: DataFrame, user: str, place: str, home: str, m: float = 50.0) -> DataFrame:
    """Per place its users, those also at ``home``, the raw share, and the share shrunk to the mean of all by ``m`` users."""
    at_home = counts.where(F.col(place) == home).select(F.col(user).alias("__u")).distinct()
    pairs = counts.where(F.col(place) != home).select(user, place).distinct()
    j = pairs.join(at_home, pairs[user] == at_home["__u"], "left")
    g = j.groupBy(place).agg(F.count(F.lit(1)).alias("n_users"), F.count("__u").alias("n_shared"))
    mean = g.agg(F.sum("n_shared") / F.sum("n_users")).scalar()
    g = g.withColumn("share", F.col("n_shared") / F.col("n_users"))
    return g.withColumn("shrunk", (F.col("n_shared") + m * mean) / (F.col("n_users") + m))


def composite_z(df: DataFrame, key: str, parts: Sequence[tuple[str, Column]]) -> DataFrame:
    """``key``, ``z_<name>`` per part, and ``score``: the mean of the z-scores that are present."""
    d = df.select(key, *(c.cast("double").alias(n) for n, c in parts))
    s = d.agg(F.struct(*(F.struct(F.avg(n).alias("m"), F.stddev_samp(n).alias("sd")).alias(n) for n, _ in parts))).scalar()
    z = [F.try_divide(F.col(n) - s[n]["m"], s[n]["sd"]).alias(f"z_{n}") for n, _ in parts]
    out = d.select(key, *z)
    names = [F.col(f"z_{n}") for n, _ in parts]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    present = sum((c.isNotNull().cast("int") for c in names[1:]), names[0].isNotNull().cast("int"))
    return out.withColumn("score", F.try_divide(total, present))
