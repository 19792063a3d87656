"""Cited addresses: extraction, normal form, domains, source tiers, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an address in a text is, and what may trail it.
URL = r"https?://[^\s\]>\"']+"
_TRAIL = r"[.,;:!?'\"\]]+$"


def _without_loose_parens(u: Column) -> Column:
    """An address without the closing parentheses at its end that nothing opened."""
    closes, opens = F.regexp_count(u, F.lit(r"\)")), F.regexp_count(u, F.lit(r"\("))
    run = F.length(F.regexp_extract(u, r"(\)*)$", 1))
    drop = F.greatest(F.least(run, closes - opens), F.lit(0))
    return F.substr(u, F.lit(1), F.length(u) - drop)


def normal_form(u: Column) -> Column:
    """https, the host in lower case, no lone slash at the end."""
    host = F.lower(F.regexp_extract(u, r"^https?://([^/]+)", 1))
    path = F.regexp_extract(u, r"^https?://[^/]+(/.*)?$", 1)
    return F.concat(F.lit("https://"), host, F.when(path == "/", "").otherwise(path))


def urls_of(text: Column | str) -> Column:
    """The distinct addresses of a text in normal form, longer than 15 signs, sorted."""
    c = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(c, F.lit(f"({URL})"), 1)
    cut = F.transform(raw, lambda u: F.regexp_replace(u, _TRAIL, ""))
    cut = F.transform(cut, _without_loose_parens)
    cut = F.transform(cut, lambda u: F.regexp_replace(u, _TRAIL, ""))
    return F.sort_array(F.array_distinct(F.transform(F.filter(cut, lambda u: F.length(u) > 15), normal_form)))


def domain_of(url: Column | str) -> Column:
    """The host without ``www.``."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.lower(c), r"^https?://(?:www\.)?([^/:?#]+)", 1)


def cited(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys``, ``url``, ``domain``: one row per row and address. Texts without "http" never reach the pattern."""
    rows = df.where(F.contains(F.col(text), F.lit("http"))).select(*keys, F.explode(urls_of(text)).alias("url"))
    return rows.withColumn("domain", domain_of("url"))


def by_parent_domain(domains: DataFrame, lookup: DataFrame) -> DataFrame:
    """``domains`` with the columns of the longest parent domain that ``lookup`` has: a.b.c, then b.c.

    Each domain's few suffixes are exploded and met by an equi join, instead of comparing all with all.
    """
    parts = F.split("domain", r"\.")
    n = F.size(parts)
    suffix = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    names = [c for c in lookup.columns if c != "domain"]
    one = domains.select("domain").distinct()
    pairs = one.select("domain", F.posexplode(suffix).alias("at", "suffix"))
    j = pairs.join(lookup.select(F.col("domain").alias("suffix"), F.struct(*names).alias("hit")), "suffix")
    best = j.groupBy("domain").agg(F.min_by("hit", "at").alias("hit"))
    return domains.join(best, "domain", "left").select(*domains.columns, *(F.col(f"hit.{c}").alias(c) for c in names))


def first_matcher(urls: DataFrame, matchers: DataFrame) -> DataFrame:
    """``(url, label)``: of an ordered list of patterns ``(rank, pattern, label)`` the first that fits, each distinct address once.

    The list is a curated one of bounded size; it is refused beyond 10,000 patterns.
    """
    listed = matchers.orderBy("rank").limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("too many patterns for a list that is tried in order")
    label = F.lit(None).cast("string")
    for r in reversed(listed):
        label = F.when(F.col("url").rlike(r["pattern"]), r["label"]).otherwise(label)
    return urls.select("url").distinct().withColumn("label", label)


def source_tier(category: Column, reliability: Column, platform: Column, domain: Column) -> Column:
    """Tier of a citation by what is known of its domain, the first rule that applies."""
    r = F.lower(reliability)
    official = domain.rlike(r"\.(?:gov|mil)$") | category.isin("government", "academic")
    return (
        F.when(platform, "aggregator_or_platform")
        .when(official | r.isin("high", "very high", "mostly factual"), "mainstream_reliable")
        .when(r.isin("mixed", "low", "very low") & (category != "alternative"), "mainstream_imperfect")
        .when(category == "alternative", "alt_media")
        .when(category == "news", "mainstream_reliable")
        .otherwise("unmatched_link")
    )


# Precedence of tiers, the strongest first.
TIERS = ("mainstream_reliable", "mainstream_imperfect", "alt_media", "aggregator_or_platform", "unmatched_link")


def strongest_tier(tiers: DataFrame, key: str) -> DataFrame:
    """``(key, tier)``: the tier of highest precedence among a row's citations."""
    rank = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    return tiers.groupBy(key).agg(F.min_by("tier", rank).alias("tier"))


def url_ranking(citations: DataFrame) -> DataFrame:
    """``(url, n_mentions, n_authors, per_author, is_spam)`` of rows ``(url, author)``: ranked by distinct authors."""
    g = citations.groupBy("url").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("author").alias("n_authors"))
    g = g.withColumn("per_author", F.try_divide("n_mentions", "n_authors"))
    return g.withColumn("is_spam", (F.col("n_mentions") >= 10) & F.coalesce(F.col("per_author") >= 5, F.lit(True)))


def domain_performance(citations: DataFrame) -> DataFrame:
    """Per domain citations, distinct addresses, authors and rows, mean and median score."""
    return citations.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("url").alias("n_urls"),
        F.countDistinct("author").alias("n_authors"),
        F.avg("score").alias("mean_score"),
        F.median("score").alias("median_score"),
    )
