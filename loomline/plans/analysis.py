"""Queries of near-duplicates, mentions, topics, models, agreement, sources and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import classify as C
from loomline.operators import lexicon as L
from loomline.operators import neardup, spans, topics
from loomline.operators import statistics as S
from loomline.plans.relational import EMPATH, POSTS, RAW
from loomline.session import table
from loomline.sources import readers
from loomline.streaming import micro

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


@query()
def near_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), "doc_id", "text")


# ---- mentions -----------------------------------------------------------------------------------------------------------
ENTITIES = {"baba": ("Baba Holdings", "Baba"), "hoka": ("Hoka Trust", "Hoka"), "agency": ("the agency", "agency")}


@query(
    "select delivery_no, regexp_matches(text, '(?i)\\b(baba holdings|the agency|hoka trust|agency|baba|hoka)\\b') as mentioned from empath_scores_full where text is not null"
)
def entity_flag(spark: SparkSession, d: str) -> DataFrame:
    from loomline.functions.text import any_of

    pattern = any_of([f for forms in ENTITIES.values() for f in forms])
    return table(spark, d, EMPATH).where("text is not null").select("delivery_no", F.col("text").rlike(pattern).alias("mentioned"))


@query()
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return spans.mentions(table(spark, d, EMPATH), "delivery_no", "text", ENTITIES)


@query()
def attribution_confidence(spark: SparkSession, d: str) -> DataFrame:
    return spans.strongest_confidence(spans.attributed(table(spark, d, EMPATH), "delivery_no", "text", ENTITIES))


# Sentences in every shape that tells a source from one who is only named, about the names of the nations' table
_SHAPES = (
    ("According to {e}, the files are real.", "before", "high"),
    ("{e} said the leak was real.", "after", "high"),
    ("{e} did nothing wrong, according to the paper.", "none", "none"),
    ("{e} is a professor who studies clouds.", "standing", "high"),
    ("{e}, a researcher at the lab, created the leak.", "standing", "none"),
    ("{e}, a researcher at the lab, made a point about clouds.", "standing", "high"),
    ("It was headed by {e}.", "none", "none"),
    ("According to Rumor, {e} was there.", "before", "low"),
    ("{e} for once and in front of all the others said so.", "after", "low"),
    ("{e} hid the map and later confirmed it.", "after", "low"),
    ("{e} in the same old hall said so.", "after", "medium"),
)
_SHAPE = "case " + " ".join(f"when n_nationkey % {len(_SHAPES)} = {i} then {{{i}}}" for i in range(len(_SHAPES))) + " end"


@query(
    "select cast(n_nationkey as bigint) as n_nationkey, " + _SHAPE.format(*(f"'{f}'" for _, f, _ in _SHAPES)) + " as form, " + _SHAPE.format(*(f"'{c}'" for *_, c in _SHAPES)) + " as confidence from nation"
)
def attribution_shapes(spark: SparkSession, d: str) -> DataFrame:
    """One sentence per nation, its name the entity; another name stands in some."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    names = {r["n_name"]: (r["n_name"],) for r in nations.select("n_name").collect()}  # a fixed table of 25
    shape = F.element_at(F.array(*(F.lit(t) for t, *_ in _SHAPES)), (F.col("n_nationkey") % len(_SHAPES) + 1).cast("int"))
    rows = nations.select("n_nationkey", F.replace(shape, F.lit("{e}"), F.col("n_name")).alias("text"))
    found = spans.attributed(rows, "n_nationkey", "text", {**names, "rumor": ("Rumor",)})
    return found.where("entity != 'rumor'").select(F.col("key").alias("n_nationkey"), "form", "confidence")


@query()
def keyness_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Words around mentions of one entity against those around another, by signed log-likelihood."""
    e = table(spark, d, EMPATH)
    stop = ("the", "a", "of", "and", "to", "in", "it", "is", "that", "was")
    of = lambda forms: spans.contexts(e, "delivery_no", "text", forms, stop).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return L.keyness(of(ENTITIES["agency"]), of(ENTITIES["baba"]))


@query(
    "with t as (select delivery_no, text, list_transform(string_split(lower(text), 'archive'), lambda x: length(x)) as gaps from empath_scores_full where lower(text) like '%archive%'), "
    "n as (select *, unnest(range(1, least(len(gaps), 4))) as nth from t), m as (select *, list_sum(gaps[1:nth]) + (nth - 1) * 7 + 1 as a from n), "
    "s as (select *, cast(greatest(a - 100, 1) as bigint) as b, cast(least(a + 107, length(text) + 1) as bigint) as e from m) "
    "select delivery_no, cast(nth as int) as nth, case when b > 1 then '...' else '' end || substr(text, b, e - b) || case when e <= length(text) then '...' else '' end as snippet from s"
)
def context_snippets(spark: SparkSession, d: str) -> DataFrame:
    return spans.snippets(table(spark, d, EMPATH), "delivery_no", "text", "archive")


@query()
def credential_names(spark: SparkSession, d: str) -> DataFrame:
    names = spans.credential_names(table(spark, d, EMPATH), "delivery_no", "text", r"\b(?:engineer|pilots|lawyer|committee)\b")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# ---- topics ----------------------------------------------------------------------------------------------------------------
_CENT = (
    "c as (select label, i, avg(x) as x from (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2), "
    "cn as (select label, list(x order by i) as v from c group by 1)"
)


@query(
    f"with {_CENT}, s as (select vec_id, cn.label, round(list_cosine_similarity(cast(embedding as double[]), v), 12) as s from embeddings, cn), "
    "r as (select *, row_number() over (partition by vec_id order by s desc, label) as rn from s) select vec_id, cast(case when s >= 0.35 then label else -1 end as bigint) as topic, round(s, 6) as similarity from r where rn = 1"
)
def topic_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    t = topics.nearest_centroid(e, "vec_id", "embedding", topics.centroids(e, "label", "embedding"), "label")
    return t.select(F.col("key").alias("vec_id"), "topic", F.round("similarity", 6).alias("similarity"))


@query(
    "with c as (select cast(date_trunc('day', ts) as date) as period, event_type as topic, count(*) as n from events group by 1, 2), "
    "r as (select *, n / sum(n) over (partition by period) as share, row_number() over (partition by period order by n desc, topic) as rn from c) select period, topic, n, share from r where rn = 1"
)
def topic_dominance(spark: SparkSession, d: str) -> DataFrame:
    return topics.dominance(table(spark, d, "events"), F.to_date("ts"), "event_type")


@query(
    "with n as (select vec_id, label, embedding from embeddings), a as (select vec_id, max(list_cosine_similarity(cast(n.embedding as double[]), cast(h.embedding as double[]))) as high from n, (select embedding from embeddings where vec_id % 100 = 0) h group by 1), "
    "b as (select vec_id, max(list_cosine_similarity(cast(n.embedding as double[]), cast(l.embedding as double[]))) as low from n, (select embedding from embeddings where vec_id % 100 = 50) l group by 1) "
    "select a.vec_id, round(high, 5) as high, round(low, 5) as low from a join b using (vec_id)"
)
def anchor_margin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = topics.anchor_margin(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), e.where("vec_id % 100 = 50"))
    return m.select(F.col("key").alias("vec_id"), F.round("high", 5).alias("high"), F.round("low", 5).alias("low"))


# ---- models ----------------------------------------------------------------------------------------------------------------
_OLS = (
    "select regr_slope(y, x) as coef, regr_intercept(y, x) as icept, regr_count(y, x) as n, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_r2(y, x) as r2 from ("
    "select cast(upvotes as double) as y, cast(char_length as double) as x from empath_scores_full where upvotes is not null and char_length is not null)"
)


@query(f"with m as ({_OLS}) select 'char_length' as variable, round(coef, 8) as coef, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 8) as se, cast(n as bigint) as n_obs from m")
def ols_naive(spark: SparkSession, d: str) -> DataFrame:
    t = S.fitted_table(table(spark, d, EMPATH), "upvotes ~ char_length").where("variable = 'char_length'")
    return t.select("variable", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), "n_obs")


_CL = "(select author, cast(upvotes as double) as y, cast(has_link as double) as x from empath_scores_full where upvotes is not null and has_link is not null and author is not null)"


@query(
    f"with m as (select regr_slope(y, x) as b, regr_intercept(y, x) as a, count(*) as n, avg(x) as mx, regr_sxx(y, x) as sxx from {_CL}), "
    f"u as (select author, sum((x - mx) * (y - a - b * x)) as s from {_CL}, m group by 1), c as (select count(*) as g, sum(s * s) as q from u) "
    "select 'has_link' as variable, round(b, 8) as coef, round(sqrt(q * g / (g - 1) * (n - 1) / (n - 2)) / sxx, 8) as se, n as n_obs from m, c"
)
def ols_cluster(spark: SparkSession, d: str) -> DataFrame:
    t = S.fitted_table(table(spark, d, EMPATH), "upvotes ~ has_link", cluster="author").where("variable = 'has_link'")
    return t.select("variable", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), "n_obs")


@query()
def logit_naive(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, EMPATH).withColumn("high", (F.col("upvotes") >= 5).cast("int"))
    return S.fitted_table(e, "high ~ has_link + evidence_count + C(controversiality) * hedge_count", "logit")


@query()
def logit_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The same logit over several cuts of the score, with adjusted p values."""
    e = table(spark, d, EMPATH).where("upvotes is not null").select("upvotes", "has_link", "evidence_count")
    out = None
    for cut in (1, 5, 20):
        t = S.fitted_table(e.withColumn("high", (F.col("upvotes") >= cut).cast("int")), "high ~ has_link + evidence_count", "logit")
        t = t.withColumn("cut", F.lit(cut))
        out = t if out is None else out.unionByName(t)
    return S.adjusted(out.where("variable <> 'Intercept'"))


@query(
    "with x as (select cast(upvotes >= 5 as int) as y, cast(evidence_count > 0 as int) as evidence, has_link from empath_scores_full) select 'has_link' as variable, count(*) filter (where has_link = 1) as positives, "
    "least(count(*) filter (where has_link = 0 and y = 0), count(*) filter (where has_link = 0 and y = 1), count(*) filter (where has_link = 1 and y = 0), count(*) filter (where has_link = 1 and y = 1)) as least_cell from x "
    "union all select 'evidence', count(*) filter (where evidence = 1), least(count(*) filter (where evidence = 0 and y = 0), count(*) filter (where evidence = 0 and y = 1), "
    "count(*) filter (where evidence = 1 and y = 0), count(*) filter (where evidence = 1 and y = 1)) from x"
)
def sparsity_guard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, EMPATH).select((F.col("upvotes") >= 5).cast("int").alias("y"), (F.col("evidence_count") > 0).cast("int").alias("evidence"), "has_link")
    return S.sparse_terms(e, "y", ["has_link", "evidence"]).drop("keep")


_PAIRS = (
    "(select a.label as x, b.label as y from (select doc_id, min(label) as label from content_labels where rater = (select min(rater) from content_labels) group by 1) a join "
    "(select doc_id, min(label) as label from content_labels where rater = (select max(rater) from content_labels) group by 1) b on a.doc_id = b.doc_id where a.label is not null and b.label is not null)"
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_labels")
    who = t.agg(F.struct(F.min("rater").alias("a"), F.max("rater").alias("b"))).scalar()
    side = lambda w, n: t.where(F.col("rater") == who[w]).groupBy("doc_id").agg(F.min("label").alias(n))
    return side("a", "x").join(side("b", "y"), "doc_id").where("x is not null and y is not null")


@query(
    f"with p as {_PAIRS}, n as (select count(*) as n, avg(cast(x = y as int)) as po from p), c as (select sum(a.k * b.k) as s from (select x, count(*) as k from p group by 1) a join (select y, count(*) as k from p group by 1) b on a.x = b.y) "
    "select n, po as agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 9) as kappa from n, c"
)
def kappa_nominal(spark: SparkSession, d: str) -> DataFrame:
    k = S.kappa(_pairs(spark, d), "x", "y", ["none", "abusive", "hateful", "sexual"])
    return k.withColumn("kappa", F.round("kappa", 9))


_W = "(abs({a} - {b}) / 3.0) * (abs({a} - {b}) / 3.0)"
_RANKED = f"(select list_position(['none', 'sexual', 'abusive', 'hateful'], x) as i, list_position(['none', 'sexual', 'abusive', 'hateful'], y) as j from {_PAIRS})"


@query(
    f"with p as {_RANKED}, a as (select i, count(*) as k from p group by 1), b as (select j, count(*) as k from p group by 1), e as (select sum({_W.format(a='i', b='j')} * a.k * b.k) as e from a, b) "
    f"select count(*) as n, round(1 - sum({_W.format(a='i', b='j')}) * count(*) / max(e), 9) as kappa from p, e"
)
def kappa_weighted(spark: SparkSession, d: str) -> DataFrame:
    k = S.kappa(_pairs(spark, d), "x", "y", ["none", "sexual", "abusive", "hateful"], "quadratic")
    return k.select("n", F.round("kappa", 9).alias("kappa"))


@query(
    "with c as (select doc_id, label, count(*) as n from content_labels where label is not null group by 1, 2), f as (select doc_id, sum(n * (n - 1)) / 2.0 as p from c group by 1 having sum(n) = 2), "
    "k as (select label, sum(n) as n from c where doc_id in (select doc_id from f) group by 1), e as (select sum(n * n) / (sum(n) * sum(n)) as e from k) select count(*) as n_items, round((avg(p) - max(e)) / (1 - max(e)), 9) as kappa from f, e"
)
def kappa_fleiss(spark: SparkSession, d: str) -> DataFrame:
    return S.fleiss(table(spark, d, "content_labels"), "doc_id", "label", 2).withColumn("kappa", F.round("kappa", 9))


@query(
    f"with p as (select cast(x <> 'none' as int) as t, cast(y <> 'none' as int) as g from {_PAIRS}), c as (select count(*) filter (where t = 1 and g = 1) as tp, count(*) filter (where t = 0 and g = 1) as fp, "
    "count(*) filter (where t = 1 and g = 0) as fn, count(*) filter (where t = 0 and g = 0) as tn from p) select tp, fp, fn, tn, tp / (tp + fp) as precision, tp / (tp + fn) as recall from c"
)
def prf(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select((F.col("x") != "none").cast("int").alias("t"), (F.col("y") != "none").cast("int").alias("g"))
    return S.classification_scores(p, "t", "g").select("tp", "fp", "fn", "tn", "precision", "recall")


_CHI = "(select controversiality as a, has_link as b, count(*) as n from empath_scores_full where controversiality is not null and has_link is not null group by 1, 2)"


@query(
    f"with c as {_CHI}, e as (select n, sum(n) over (partition by a) * sum(n) over (partition by b) / sum(n) over () as e from c) select round(sum(pow(abs(n - e) - 0.5, 2) / e), 6) as statistic, 1 as free from e"
)
def chi2(spark: SparkSession, d: str) -> DataFrame:
    x, free, _ = S.chi_square(table(spark, d, EMPATH), "controversiality", "has_link")
    return spark.createDataFrame([(round(x, 6), free)], "statistic double, free int")


@query()
def staged_classifier(spark: SparkSession, d: str) -> DataFrame:
    """A gate by patterns, then TF-IDF with logistic regression, then bands of probability."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    marks = table(spark, d, "content_labels").where("label is not null").groupBy("doc_id").agg(F.max((F.col("label") != "none").cast("int")).alias("y"))
    m = C.train(docs.join(marks, "doc_id"), "text", "y")
    p = C.probability(m, docs, "text")
    return p.select("doc_id", C.staged(F.col("text").rlike("(?i)[a-z]{3}"), F.col("p")).alias("decision"))


@query()
def classifier_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    marks = table(spark, d, "content_labels").where("label is not null").groupBy("doc_id").agg(F.max((F.col("label") != "none").cast("int")).alias("y"))
    return C.cross_validated(docs.join(marks, "doc_id"), "doc_id", "text", "y", 3)


# ---- sources and streams ---------------------------------------------------------------------------------------------------
@query("select id, media.oembed.title as title, concat_ws(' - ', media.oembed.title, media.oembed.description) as combined_payload from r_conspiracy_posts where media.oembed.title <> ''")
def media_titles(spark: SparkSession, d: str) -> DataFrame:
    return readers.media_titles(table(spark, d, POSTS))


@query("select line_no, title, 'u' || coalesce(author, '') as author from r_conspiracy_posts where title is not null and title not like '%<%' and title not like '%&%' and trim(title) <> '' and trim(title) = title")
def byline_from_html(spark: SparkSession, d: str) -> DataFrame:
    """Titles and authors read back out of pages built from posts."""
    p = table(spark, d, POSTS).where("title is not null and title not like '%<%' and title not like '%&%' and trim(title) <> '' and trim(title) = title")
    head = F.concat(F.lit("<html><head><title>"), "title", F.lit('</title><meta name="author" content="u'), F.coalesce("author", F.lit("")), F.lit('"></head><body><p>x</p></body></html>'))
    return readers.byline(p.select("line_no", head.alias("html")), "line_no", "html").select(F.col("key").alias("line_no"), "title", "author")


@query(
    "select line_no, 0 as post_no, case when trim(coalesce(author, '')) = '' then 'unknown' else author end as author from r_conspiracy_comments3 where body is not null and (author is null or author = trim(author))"
)
def forum_posts_from_html(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, RAW).where("body is not null and (author is null or author = trim(author))")
    html = F.concat(
        F.lit('<html><title>t</title><div class="midAd">buy</div><div class="post" id="post7"><span class="author">'), F.coalesce("author", F.lit("")),
        F.lit('</span><div class="body">'), F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</div></div></html>"),
    )
    return readers.forum_posts(c.select("line_no", html.alias("html")), "line_no", "html").select(F.col("key").alias("line_no"), "post_no", "author")


@query("select cast(time_bucket(interval '1 day', ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2")
def stream_day_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day by a stream over the table, run to its end; equal to the batch form."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(d)
    counts = micro.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"])
    return micro.run_to_table(counts).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
