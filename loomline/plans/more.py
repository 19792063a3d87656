"""Queries of lookups, cascades, evidence rules, fit grids, sampling queues and result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import lookups as K
from loomline.operators import relational as R
from loomline.operators import statistics as S
from loomline.operators import topics
from loomline.plans.analysis import _PAIRS, _pairs
from loomline.plans.domain import _CITED, _citations
from loomline.plans.relational import EMPATH, POSTS
from loomline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    "with u as (select 1 as rank, domain, 'post' as origin, count(*) as n from r_conspiracy_posts where domain is not null group by domain union all "
    f"select 2, domain, 'comment', n from (with {_CITED} select domain, count(*) as n from cited group by domain)) "
    "select domain, origin, n from (select *, row_number() over (partition by domain order by rank) as rn from u) where rn = 1"
)
def domain_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One record per domain from several lists; the earlier list wins."""
    p = table(spark, d, POSTS).where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("post"))
    c = _citations(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("comment"))
    return K.by_priority([p, c], ["domain"]).select("domain", "origin", "n")


_ENT = "(values ('report', 'document'), ('archive', 'place'), ('hum', 'sound')) as e(word, kind)"


@query(
    "with t as (select line_no, lower(title) as t from r_conspiracy_posts where title is not null), m as (select line_no, t, (select min(word) from "
    f"{_ENT} where contains(t, word)) as w from t) select line_no, coalesce((select kind from {_ENT} where word = w), 'other') as kind from m"
)
def containment_match(spark: SparkSession, d: str) -> DataFrame:
    """The first of a short list of names that a title contains, and that name's kind."""
    names = [("archive", "place"), ("hum", "sound"), ("report", "document")]
    t = table(spark, d, POSTS).where("title is not null")
    return t.select("line_no", K.first_contained(F.lower("title"), names, "other").alias("kind"))


@query(
    "with w as (select distinct domain as name from r_conspiracy_posts where domain is not null union select distinct split_part(domain, '.', 1) from r_conspiracy_posts where domain is not null), "
    "t as (select line_no, lower(url) as u from r_conspiracy_posts where url is not null) "
    "select line_no, name from t join w on name <> '' and contains(u, lower(name)) qualify row_number() over (partition by line_no order by length(name) desc, name) = 1"
)
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    """The longest name of a table of domains and their first parts that a post's address contains."""
    posts = table(spark, d, POSTS)
    own = posts.where("domain is not null").select("domain")
    names = own.unionAll(own.select(F.split_part("domain", F.lit("."), F.lit(1)).alias("domain")))
    m = K.containments(posts, "line_no", "url", names, "domain")
    return R.first_per_key(m, ["key"], [F.desc(F.length("name")), F.col("name")]).select(F.col("key").alias("line_no"), "name")


@query(
    "with a as (select r_name as name from region), b as (select n_name as name, n_regionkey as k from nation), q as (select c_custkey, case when c_custkey % 3 = 0 then 'EUROPE' "
    "when c_custkey % 3 = 1 then (select min(n_name) from nation) else 'nowhere' end as name from customer) select c_custkey, case when q.name in (select name from a) then 'region' "
    "when q.name in (select name from b) then 'nation' else 'none' end as matched from q"
)
def cascaded_match(spark: SparkSession, d: str) -> DataFrame:
    """Names met against one list after the other; the first that knows a name decides."""
    least = table(spark, d, "nation").agg(F.min("n_name")).scalar()
    k = F.col("c_custkey") % 3
    q = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "EUROPE").when(k == 1, least).otherwise("nowhere").alias("name"))
    lists = [("region", table(spark, d, "region").select(F.col("r_name").alias("name"))), ("nation", table(spark, d, "nation").select(F.col("n_name").alias("name")))]
    return K.cascade(q, "name", lists).select("c_custkey", "matched")


@query(
    "with t as (select delivery_no, regexp_matches(text, '\"[^\"]+\"|“[^”]+”') as q, regexp_matches(text, '(?i)\\b(said|says|claims?|wrote|explained)\\b') as v, regexp_matches(text, '(?i)\\b(agency|baba|lawyer)\\b') as e "
    "from empath_scores_full where text is not null) select delivery_no, case when q and v and e then 'quoted source' when v and e then 'reported source' when q and e then 'quote near entity' when q and v then 'unnamed quote' "
    "when e then 'entity only' when v then 'verb only' when q then 'quote only' else 'none' end as form from t"
)
def attribution_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    q = t.rlike("\"[^\"]+\"|“[^”]+”")
    v = t.rlike(r"(?i)\b(said|says|claims?|wrote|explained)\b")
    e = t.rlike(r"(?i)\b(agency|baba|lawyer)\b")
    return table(spark, d, EMPATH).where("text is not null").select("delivery_no", K.attribution_class(q, v, e).alias("form"))


@query(
    "with w as (select distinct p_partkey, unnest(string_split(lower(p_type), ' ')) as w from part), f as (select w, count(*) as df from w group by 1), "
    "r as (select p_partkey, w.w, df, row_number() over (partition by p_partkey order by df, w.w) as rn from w join f on w.w = f.w where df between 2 and (select 0.5 * count(*) from part)) "
    "select p_partkey, w as cluster, df from r where rn = 1"
)
def informative_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Of each item's labels the rarest that is neither a single item's nor most items'."""
    p = table(spark, d, "part")
    w = p.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("w"))
    return K.most_informative(w, "p_partkey", "w", 2, p.agg(F.count(F.lit(1)) * 0.5).scalar()).select("p_partkey", F.col("w").alias("cluster"), "df")


@query(
    "select doc_id, n, case when n_bad = n then 'high' when n_bad * 2 >= n and n_bad > 0 then 'medium' when n_bad > 0 then 'low' else 'none' end as confidence from ("
    "select doc_id, count(label) as n, count(*) filter (where label <> 'none') as n_bad from content_labels group by 1) where n > 0"
)
def evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in a verdict by how much of the evidence agrees."""
    g = table(spark, d, "content_labels").groupBy("doc_id").agg(F.count("label").alias("n"), F.count_if(F.col("label") != "none").alias("n_bad")).where("n > 0")
    return g.select("doc_id", "n", K.evidence_level(F.col("n_bad"), F.col("n")).alias("confidence"))


@query()
def topic_model(spark: SparkSession, d: str) -> DataFrame:
    """Centroids by k-means instead of given labels, and every vector's topic by them."""
    e = table(spark, d, "embeddings")
    c = K.kmeans_centroids(e, "embedding", 8, seed=3)
    return topics.nearest_centroid(e, "vec_id", "embedding", c, "label", 0.0)


@query(
    "select case when label < 3 then 'a' when label < 7 then 'b' else 'c' end as topic, count(*) as n from embeddings group by 1"
)
def topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    above = spark.createDataFrame([(i, "a" if i < 3 else "b" if i < 7 else "c") for i in range(10)], "label int, topic string")
    return table(spark, d, "embeddings").join(above, "label").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query()
def fit_grid(spark: SparkSession, d: str) -> DataFrame:
    """One model per stratum of length and form of covariance; sparse strata come out with a note instead of a fit."""
    e = table(spark, d, EMPATH).where("upvotes is not null and char_length is not null")
    e = R.quantile_bins(e.select("upvotes", "char_length", "has_link", "evidence_count", "author"), "char_length", 3, "stratum")
    return K.fit_strata(e, "upvotes ~ has_link + evidence_count", "stratum", [0, 1, 2], {"naive": None, "author": "author"})


@query()
def population_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of two populations side by side, with the largest difference tested by an interaction."""
    e = table(spark, d, EMPATH).where("upvotes is not null").withColumn("early", (F.col("delivery_no") % 2).cast("int"))
    a = S.fitted_table(e.where("early = 1"), "upvotes ~ has_link").select("variable", F.col("coef").alias("coef_a"))
    b = S.fitted_table(e.where("early = 0"), "upvotes ~ has_link").select("variable", F.col("coef").alias("coef_b"))
    i = S.fitted_table(e, "upvotes ~ has_link * early").select("variable", F.col("pvalue").alias("p_joint"))
    return a.join(b, "variable", "full").join(i, "variable", "full")


@query(
    "select delivery_no, case when evidence_count + adversarial_count > 0 then evidence_count / (evidence_count + adversarial_count) else 0.5 end as lean from empath_scores_full"
)
def lean_guarded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, EMPATH).select("delivery_no", K.lean(F.col("evidence_count"), F.col("adversarial_count")).alias("lean"))


@query(
    f"with p as {_PAIRS}, f as (select case when x = 'none' and y = 'none' then 'aligned' when x <> 'none' and y <> 'none' then 'opposed' else 'mixed' end as view, x from p) "
    "select view, count(*) filter (where x = 'none') as n_none, count(*) filter (where x <> 'none') as n_marked from f group by view"
)
def stance_crosstab(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    a, b = F.col("x") == "none", F.col("y") == "none"
    view = F.when(a & b, "aligned").when(~a & ~b, "opposed").otherwise("mixed")
    return p.groupBy(view.alias("view")).agg(F.count_if(a).alias("n_none"), F.count_if(~a).alias("n_marked"))


@query(
    "with v as (select doc_id, count(*) filter (where label <> 'none') as votes from content_labels where label is not null group by 1), r as (select *, row_number() over (partition by votes order by doc_id) as rn from v) "
    "select doc_id, votes from r where rn <= case votes when 2 then 40 when 1 then 30 else 30 end"
)
def vote_strata(spark: SparkSession, d: str) -> DataFrame:
    """A rating queue by how many raters marked a text, with a quota per number of votes."""
    v = table(spark, d, "content_labels").where("label is not null").groupBy("doc_id").agg(F.count_if(F.col("label") != "none").alias("votes"))
    return K.quota_per_value(v, "votes", {0: 30, 1: 30, 2: 40}, [F.col("doc_id")], 30)


@query()
def uncertainty_queue(spark: SparkSession, d: str) -> DataFrame:
    """Texts nearest to a middling score first, already rated ones left out."""
    e = table(spark, d, "documents").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000).alias("p"))
    return R.anti(e, table(spark, d, "content_labels"), ["doc_id"]).withColumn("u", 1 - F.greatest("p", 1 - F.col("p"))).orderBy(F.desc("u"), "doc_id").limit(200)


@query(
    "select c as variable, max(v) filter (where g = 0) as without_link, max(v) filter (where g = 1) as with_link from (select has_link as g, 'evidence' as c, avg(evidence_count) as v from empath_scores_full group by 1 "
    "union all select has_link, 'hedge', avg(hedge_count) from empath_scores_full group by 1) group by c"
)
def result_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A tidy table of results turned into one line per variable."""
    g = table(spark, d, EMPATH).groupBy("has_link").agg(F.avg("evidence_count").alias("evidence"), F.avg("hedge_count").alias("hedge"))
    tidy = g.unpivot(["has_link"], ["evidence", "hedge"], "variable", "v")
    wide = tidy.groupBy("variable").pivot("has_link", [0, 1]).agg(F.max("v"))
    return wide.select("variable", F.col("0").alias("without_link"), F.col("1").alias("with_link"))


@query(
    "with f as (select line_no, id, title, row_number() over (partition by id order by retrieved_utc, line_no) as rn from r_conspiracy_posts where id is not null), l as (select id, title, row_number() over (partition by id order by retrieved_utc desc, line_no desc) as rn "
    "from r_conspiracy_posts where id is not null) select f.id, coalesce(f.title, l.title) as title from f join l on f.id = l.id where f.rn = 1 and l.rn = 1"
)
def preferred_title(spark: SparkSession, d: str) -> DataFrame:
    """The first title known of a post, else the latest."""
    p = table(spark, d, POSTS).where("id is not null").select("id", "title", "retrieved_utc", "line_no")
    first = R.first_per_key(p, ["id"], [F.col("retrieved_utc"), F.col("line_no")]).select("id", F.col("title").alias("t1"))
    last = R.first_per_key(p, ["id"], [F.col("retrieved_utc").desc(), F.col("line_no").desc()]).select("id", F.col("title").alias("t2"))
    return first.join(last, "id").select("id", F.coalesce("t1", "t2").alias("title"))


@query(
    "with y as (select domain, count(*) as n, count(*) filter (where media.oembed.title is not null) as got from r_conspiracy_posts group by 1) select domain, n, got, got / n as yield from y"
)
def crawl_yield(spark: SparkSession, d: str) -> DataFrame:
    """Per domain how many captures gave something."""
    g = table(spark, d, POSTS).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count("media.oembed.title").alias("got"))
    return g.withColumn("yield", F.col("got") / F.col("n"))
