"""Queries pN_ of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import abuse, mixing, personal, residue, splits, terms, tokens
from loomline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "r_conspiracy_comments3"), "line_no", "body").select(F.col("key").alias("line_no"))


@query
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "r_conspiracy_comments3"), "line_no", "body").select("line_no", "id", "body")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal.items(table(spark, d, "empath_scores_full"), "delivery_no")
    return found.select(F.col("key").alias("delivery_no"), "kind", "nth")


@query
def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = personal.sanitised(table(spark, d, "empath_scores_full"), "delivery_no")
    return rows.select(F.col("key").alias("delivery_no"), F.col("clean").alias("text"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = splits.together(table(spark, d, "empath_scores_full"), "delivery_no", "author", "id")
    return pairs.select(F.col("a").alias("delivery_no_a"), F.col("b").alias("delivery_no_b"))


@query
def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.split_rows(table(spark, d, "empath_scores_full"), "delivery_no", "author", "id", label="has_link")
    return rows.select(F.col("row").alias("delivery_no"), "split")


@query
def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each split next to its quota, and whether they are as near to it as whole rows can be."""
    s = splits.shares(table(spark, d, "empath_scores_full"), "delivery_no", "author", "id", label="has_link")
    total = s.agg(F.sum("n_rows")).scalar()
    near = F.abs(F.col("n_rows") - F.col("target_share") * total) < 1
    return s.select("split", F.round(F.col("target_share") * total, 3).alias("quota"), near.alias("at_quota"))


SQL["p5_shares"] = """
select split, round(target * (select count(*) from empath_scores_full), 3) as quota, true as at_quota
from (values ('train', 0.8::double), ('validation', 0.1::double), ('test', 0.1::double)) as t(split, target)"""


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "empath_scores_full")).where("mark is not null").select("term", "mark")


@query
def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "empath_scores_full")).select("term", "n", "n_rows", "mark")


_TERMS = """
with t as (select rowid as r, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from (select row_number() over () as rowid, text
 from empath_scores_full)), c as (select term, count(*) as n, count(distinct r) as n_rows from t group by 1),
m as (select c.*, case when n_rows <= 2 then 'rare' when n_rows * 100 > 15 * (select count(text) from empath_scores_full) then 'common' end as mark from c)"""
SQL["p7_found"] = f"{_TERMS} select term, mark from m where mark is not null"
SQL["p7_terms"] = f"{_TERMS} select term, n, n_rows, mark from m"


@query
def p7_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "empath_scores_full"), max_n=3)


_WORDS = "(select r, regexp_extract_all(lower(text), '[a-z0-9]+') as w from (select row_number() over () as r, text from empath_scores_full where text is not null))"
_GRAMS = " union all ".join(
    f"select r, array_to_string(w[i:i + {n - 1}], ' ') as term from (select r, w, unnest(range(1, len(w) - {n} + 2)) as i from {_WORDS} where len(w) >= {n})"
    for n in (1, 2, 3)
)
SQL["p7_ngrams"] = (
    f"with c as (select term, count(*) as n, count(distinct r) as n_rows from ({_GRAMS}) group by term) "
    "select *, case when n_rows <= 2 then 'rare' when n_rows * 100 > 15 * (select count(text) from empath_scores_full) then 'common' end as mark from c"
)


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[1]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "content_labels"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.explode("categories").alias("category"))


@query
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "source", *abuse.CATEGORIES)


@query
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))
