"""Relational queries over the forum archive: scans, filters, joins, aggregates, windows, samples, set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import text as T
from loomline.functions.identifiers import full_name
from loomline.operators import relational as R
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


EMPATH = "empath_scores_full"
POSTS = "r_conspiracy_posts"
RAW = "r_conspiracy_comments3"
# SQL of the spelling-free id of a column with its kind
_ID = r"regexp_replace(lower({c}), '^\s+|\s+$', '', 'g')"


def _full(c: str, kind: str) -> str:
    s = _ID.format(c=c)
    bare = rf"regexp_replace({s}, '^t\d_', '')"
    return rf"case when {bare} <> '' then case when regexp_matches({s}, '^t\d_') then {s} else '{kind}_' || {bare} end end"


# ---- projections and filters ---------------------------------------------------------------------------------------
@query(
    "select line_no, id, coalesce(try_cast(controversiality as int), 0) as controversiality, length(body) as char_length, "
    "cast(contains(body, 'http') as int) as has_link from r_conspiracy_comments3 where body is not null and body not in ('[deleted]', '[removed]') and length(body) > 100"
)
def prj_safe_cast_live(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, RAW).where(T.is_live("body") & (F.length("body") > 100))
    return rows.select(
        "line_no",
        "id",
        T.whole_number("controversiality").alias("controversiality"),
        F.length("body").cast("long").alias("char_length"),
        F.contains("body", F.lit("http")).cast("int").alias("has_link"),
    )


@query(
    "select delivery_no, case when adversarial_count >= evidence_count and adversarial_count > 0 then 'adversarial' when evidence_count > 0 then 'evidence' "
    "when hedge_count > 0 then 'hedge' when certainty_count > 0 then 'certainty' else 'none' end as move from empath_scores_full"
)
def prj_primary_move(spark: SparkSession, d: str) -> DataFrame:
    move = (
        F.when((F.col("adversarial_count") >= F.col("evidence_count")) & (F.col("adversarial_count") > 0), "adversarial")
        .when(F.col("evidence_count") > 0, "evidence")
        .when(F.col("hedge_count") > 0, "hedge")
        .when(F.col("certainty_count") > 0, "certainty")
        .otherwise("none")
    )
    return table(spark, d, EMPATH).select("delivery_no", move.alias("move"))


@query(
    "select delivery_no, ln(char_length + 1) as log_length, ln(upvotes - (select min(upvotes) from empath_scores_full) + 1) as log_upvotes, "
    "cast(upvotes >= 5 as int) as high_traction from empath_scores_full where upvotes is not null and char_length is not null"
)
def prj_log_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).where("upvotes is not null and char_length is not null")
    least = rows.agg(F.min("upvotes")).scalar()
    return rows.select(
        "delivery_no",
        F.log(F.col("char_length") + 1).alias("log_length"),
        F.log(F.col("upvotes") - least + 1).alias("log_upvotes"),
        (F.col("upvotes") >= 5).cast("int").alias("high_traction"),
    )


@query(
    "select delivery_no, author, upvotes from empath_scores_full where author not in ('[deleted]', '[removed]', 'AutoModerator') and upvotes between 5 and 49 "
    "and (text like '%according to%' or text like '%they don%t want%' or text like '%look at%')"
)
def flt_like_any(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).where(~F.col("author").isin("[deleted]", "[removed]", "AutoModerator") & F.col("upvotes").between(5, 49))
    t = F.col("text")
    return rows.where(t.like("%according to%") | t.like("%they don%t want%") | t.like("%look at%")).select("delivery_no", "author", "upvotes")


@query(
    "select row_no, post_id, elasticity_ratio from thread_quality_metrics where elasticity_ratio <= (select quantile_disc(elasticity_ratio, 0.33) from thread_quality_metrics)"
)
def flt_below_p33(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "thread_quality_metrics")
    p33 = t.agg(F.expr("percentile_disc(0.33) within group (order by elasticity_ratio)")).scalar()
    return t.where(F.col("elasticity_ratio") <= p33).select("row_no", "post_id", "elasticity_ratio")


@query(
    "select delivery_no from empath_scores_full where regexp_matches(text, '(?i)\\b(i|my|we)\\b') and regexp_matches(text, '(?i)\\b(archive|report|footage)\\b') "
    "and regexp_matches(text, '(?i)\\b(quiet|hidden|buried)\\b')"
)
def flt_two_stage_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    gate = t.rlike(T.any_of(["i", "my", "we"])) & t.rlike(T.any_of(["archive", "report", "footage"])) & t.rlike(T.any_of(["quiet", "hidden", "buried"]))
    return table(spark, d, EMPATH).where(gate).select("delivery_no")


# ---- joins ---------------------------------------------------------------------------------------------------------
@query(
    f"select e.delivery_no, p.line_no, p.title from (select *, {_full('link_id', 't3')} as k from empath_scores_full) e join "
    f"(select *, {_full('id', 't3')} as k from r_conspiracy_posts) p on e.k = p.k"
)
def jn_comment_post(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, EMPATH).select("delivery_no", full_name("link_id", "t3").alias("k"))
    p = table(spark, d, POSTS).select("line_no", "title", full_name("id", "t3").alias("k"))
    return e.join(p, "k").select("delivery_no", "line_no", "title")


@query(
    f"with c as (select {_full('link_id', 't3')} as k, count(*) as n_comments, sum(upvotes) as s, count(distinct author) as n_authors from empath_scores_full group by 1), "
    f"p as (select *, {_full('id', 't3')} as k, row_number() over (partition by {_full('id', 't3')} order by retrieved_utc desc, line_no) as rn from r_conspiracy_posts) "
    "select p.k as post, title, n_comments, cast(s as bigint) as sum_upvotes, n_authors from p join c on p.k = c.k where rn = 1 order by n_comments desc, p.k limit 50"
)
def thread_synthesis_topk(spark: SparkSession, d: str) -> DataFrame:
    """The fifty threads with most comments; comments are aggregated before the join, which then meets one line per thread."""
    e = table(spark, d, EMPATH).select(full_name("link_id", "t3").alias("k"), "upvotes", "author")
    c = e.groupBy("k").agg(F.count(F.lit(1)).alias("n_comments"), F.sum("upvotes").alias("sum_upvotes"), F.countDistinct("author").alias("n_authors"))
    p = table(spark, d, POSTS).select(full_name("id", "t3").alias("k"), "title", "retrieved_utc", "line_no")
    p = R.first_per_key(p, ["k"], [F.col("retrieved_utc").desc(), F.col("line_no")])
    j = p.join(c, "k").select(F.col("k").alias("post"), "title", "n_comments", "sum_upvotes", "n_authors")
    return j.orderBy(F.desc("n_comments"), "post").limit(50)


@query(
    "with q as (select regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as f, delivery_no, id from empath_scores_full where text is not null), "
    "k as (select substr(f, 1, 200) as key, delivery_no, id from q where f <> ''), "
    "r as (select line_no, substr(regexp_replace(lower(body), '[^a-z0-9]', '', 'g'), 1, 200) as key from r_conspiracy_comments3 where body is not null) "
    "select line_no, min(id) as id from r join k on r.key = k.key group by line_no having count(distinct id) = 1"
)
def jn_text_key_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, EMPATH).select(T.text_key("text").alias("key"), "id").where("key <> ''")
    one = k.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("other"))  # per key first: copies do not multiply
    r = table(spark, d, RAW).select("line_no", T.text_key("body").alias("key"))
    return r.join(one.where("id = other"), "key").select("line_no", "id")


@query(
    "select e.delivery_no, n.n_name as reader from (select delivery_no, cast(delivery_no % 25 as int) as k from empath_scores_full) e left join nation n on e.k = n.n_nationkey"
)
def jn_dictionary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, EMPATH).select("delivery_no", (F.col("delivery_no") % 25).cast("int").alias("n_nationkey"))
    return e.join(table(spark, d, "nation"), "n_nationkey", "left").select("delivery_no", F.col("n_name").alias("reader"))


@query(
    "select distinct author from empath_scores_full where author is not null and author not in (select author from r_conspiracy_comments3 where author is not null)"
)
def jn_anti_authors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, EMPATH).where("author is not null").select("author").distinct()
    return R.anti(a, table(spark, d, RAW).where("author is not null"), ["author"])


@query(
    f"with c as (select delivery_no, {_full('id', 't1')} as k, {_full('parent_id', 't1')} as p from empath_scores_full where id is not null), "
    "one as (select k, p, min(delivery_no) as delivery_no from c where p is not null group by 1, 2) "
    "select a.delivery_no, b.k as sibling from one a join one b on a.p = b.p and a.k <> b.k qualify row_number() over (partition by a.k, a.p order by b.k) <= 5"
)
def jn_siblings_top5(spark: SparkSession, d: str) -> DataFrame:
    """The first five siblings of every comment. Six candidates per parent are enough, whichever of them is the comment itself, so a
    large thread gives no square."""
    c = table(spark, d, EMPATH).where("id is not null").select("delivery_no", full_name("id", "t1").alias("k"), full_name("parent_id", "t1").alias("p"))
    one = c.groupBy("k", "p").agg(F.min("delivery_no").alias("delivery_no")).where("p is not null")
    six = R.first_per_key(one.select("p", F.col("k").alias("sibling")), ["p"], [F.col("sibling")], 6)
    six = six.groupBy("p").agg(F.sort_array(F.collect_list("sibling")).alias("six"))
    return one.join(six, "p").select("delivery_no", F.explode(F.slice(F.filter("six", lambda s: s != F.col("k")), 1, 5)).alias("sibling"))


# ---- aggregates ----------------------------------------------------------------------------------------------------
@query(
    "select count(*) as n, count(distinct author) as authors, min(created_utc) as first, max(created_utc) as last, avg(upvotes) as mean_upvotes, "
    "count(*) filter (where has_link = 1) as with_link, count(distinct case when upvotes >= 100 then author end) as strong_authors from empath_scores_full"
)
def ag_overview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, EMPATH).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("author").alias("authors"),
        F.min("created_utc").alias("first"),
        F.max("created_utc").alias("last"),
        F.avg("upvotes").alias("mean_upvotes"),
        F.count_if(F.col("has_link") == 1).alias("with_link"),
        F.countDistinct(F.when(F.col("upvotes") >= 100, F.col("author"))).alias("strong_authors"),
    )


@query(
    "select cast(sum(case when upvotes >= 5 then 1 else 0 end) as bigint) as ge5, cast(sum(case when upvotes >= 50 then 1 else 0 end) as bigint) as ge50, "
    "cast(sum(case when upvotes <= -6 then 1 else 0 end) as bigint) as le_6 from empath_scores_full"
)
def threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    u = F.col("upvotes")
    return table(spark, d, EMPATH).agg(hit(u >= 5).alias("ge5"), hit(u >= 50).alias("ge50"), hit(u <= -6).alias("le_6"))


@query(
    "select subreddit, quantile_disc(score, 0.5) as p50, quantile_disc(score, 0.9) as p90, quantile_cont(score, 0.75) as c75, median(score) as med "
    "from r_conspiracy_posts where score is not null group by subreddit"
)
def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by score)")
    g = table(spark, d, POSTS).where("score is not null").groupBy("subreddit")
    return g.agg(
        disc(0.5).cast("bigint").alias("p50"), disc(0.9).cast("bigint").alias("p90"), F.percentile("score", F.lit(0.75)).alias("c75"), F.median("score").alias("med")
    )


@query()
def ag_approx_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketched quantiles: one mergeable sketch per task instead of all values."""
    g = table(spark, d, EMPATH).where("upvotes is not null")
    return g.agg(*(F.approx_percentile("upvotes", q, 10_000).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9, 0.99)))


@query(
    "with c as (select domain, title, count(*) as n from r_conspiracy_posts where title is not null group by 1, 2) "
    "select domain, title, n from (select *, row_number() over (partition by domain order by n desc, title) as r from c) where r = 1"
)
def ag_mode_title(spark: SparkSession, d: str) -> DataFrame:
    return R.most_frequent(table(spark, d, POSTS), ["domain"], "title")


@query(
    "with t as (select link_id, floor(delivery_no / 4096) as b, delivery_no, text from empath_scores_full where text is not null), "
    "z as (select link_id, b, sum(length(text) + 1) as n from t group by 1, 2), "
    "p as (select link_id, b, coalesce(sum(n) over (partition by link_id order by b rows between unbounded preceding and 1 preceding), 0) as before from z), "
    "q as (select link_id, b, case when before >= 1000000 then before else 0 end as s from p) "
    "select t.link_id, cast(min(s) as bigint) as start, string_agg(text, ' ' order by delivery_no) as text from t join q on t.b = q.b and t.link_id is not distinct from q.link_id "
    "group by t.link_id, floor(s / 1000000)"
)
def ag_ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts of every thread in order of delivery; a long thread in several lines."""
    return R.ordered_concat(table(spark, d, EMPATH), "link_id", "text", "delivery_no")


_COUNTS = tuple(f"{c}_count" for c in "evidence adversarial hedge certainty alt_authority intuitive pattern meta demand anecdotal quantitative".split()) + (
    "upvotes", "controversiality", "char_length", "has_link",
)


@query(
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from empath_scores_full" for i, a in enumerate(_COUNTS) for b in _COUNTS[i + 1 :]
    )
)
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.pairwise_correlations(table(spark, d, EMPATH), _COUNTS)


@query(
    "with t as (select upvotes as x, char_length as y from empath_scores_full where upvotes is not null and char_length is not null), "
    "r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from t) "
    "select corr(rx, ry) as rho, count(*) as n from r"
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return R.spearman(table(spark, d, EMPATH), "upvotes", "char_length")


@query(
    "with c as (select controversiality as r, has_link as k, count(*) as n from empath_scores_full group by 1, 2) "
    "select r as controversiality, k as has_link, n, n / sum(n) over (partition by r) as row_share from c"
)
def crosstab_norm(spark: SparkSession, d: str) -> DataFrame:
    return R.crosstab(table(spark, d, EMPATH), "controversiality", "has_link")


@query(
    "select coalesce(cast(controversiality as varchar), 'all') as c, coalesce(cast(has_link as varchar), 'all') as k, count(*) as n from empath_scores_full "
    "where controversiality is not null and has_link is not null group by cube (controversiality, has_link)"
)
def ag_margins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).where("controversiality is not null and has_link is not null")
    g = rows.cube("controversiality", "has_link").agg(F.count(F.lit(1)).alias("n"))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all"))
    return g.select(label("controversiality").alias("c"), label("has_link").alias("k"), "n")


@query(
    "with c as (select author, link_id, count(*) as n from empath_scores_full group by 1, 2), "
    "b as (select author, link_id, n, sum(n) over (partition by author) as total, sum(n * n) over (partition by author) as sq, "
    "row_number() over (partition by author order by n desc, link_id nulls first) as r from c) "
    "select author, cast(total as bigint) as total, sq / (total * total) as hhi, link_id as leading, n / total as leading_share from b where r = 1 and total >= 3"
)
def hhi_specialisation(spark: SparkSession, d: str) -> DataFrame:
    return R.concentration(table(spark, d, EMPATH), "author", "link_id", 3)


_METRICS = ("upvotes", "has_link", "controversiality", "evidence_count", "hedge_count", "certainty_count", "char_length")
_DECILES = ", ".join(f"{i / 10}" for i in range(11))


@query(
    f"with e as (select list_sort(list_distinct(quantile_cont(char_length, [{_DECILES}]))) as edges from empath_scores_full), "
    "b as (select greatest(len(list_filter(edges, lambda x: x < char_length)) - 1, 0) as bin, * exclude (edges) from empath_scores_full, e where char_length is not null) "
    f"select cast(bin as int) as bin, count(*) as n, {', '.join(f'avg({c}) as mean_{c}' for c in _METRICS)} from b group by 1"
)
def qcut_deciles(spark: SparkSession, d: str) -> DataFrame:
    b = R.quantile_bins(table(spark, d, EMPATH), "char_length", 10).where("bin is not null")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in _METRICS))


@query(
    "with t as (select delivery_no, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from empath_scores_full where text is not null) "
    "select w, count(*) as n from t group by w"
)
def ag_entity_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).where("text is not null").select(F.explode(F.array_distinct(T.words("text"))).alias("w"))
    return rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with t as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from empath_scores_full), c as (select w, count(*) as n from t where length(w) > 2 group by 1) "
    "select w, n, n / (select sum(n) from c) as freq from c order by n desc, w limit 5000"
)
def word_baseline_top(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, EMPATH).select(F.explode(T.words("text", 3)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return R.shares(w, "n", "freq").orderBy(F.desc("n"), "w").limit(5000)


@query(
    "with y as (select regexp_extract(text, '\\b(19\\d\\d|20[0-2]\\d)\\b', 1) as year from empath_scores_full) select year, count(*) as n from y where year <> '' group by year"
)
def ag_years_in_text(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, EMPATH).select(F.regexp_extract("text", r"\b(19\d\d|20[0-2]\d)\b", 1).alias("year")).where("year <> ''")
    return y.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, cast(sum(length(text)) as bigint) as chars, ceil(sum(length(text)) / 4.0) as est_tokens from documents group by lang")
def ag_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.length("text")).cast("bigint").alias("chars"))
    return g.withColumn("est_tokens", F.ceil(F.col("chars") / 4).cast("double"))


@query(
    "with m as (select doc_id, max(case label when 'hateful' then 3 when 'abusive' then 2 when 'sexual' then 1 when 'none' then 0 end) as p from content_labels group by 1) "
    "select doc_id, case p when 3 then 'hateful' when 2 then 'abusive' when 1 then 'sexual' when 0 then 'none' end as label from m where p is not null"
)
def link_tier_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The label of highest precedence per id."""
    order = ("none", "sexual", "abusive", "hateful")
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("label"))
    best = table(spark, d, "content_labels").where("label is not null").groupBy("doc_id").agg(F.max_by("label", rank).alias("label"))
    return best


@query("select rater, list_sort(list_distinct(list(label) filter (where label is not null))) as labels from content_labels group by rater")
def ag_category_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_labels").groupBy("rater").agg(F.sort_array(F.collect_set("label")).alias("labels"))


# ---- windows, sorts, samples, sets -----------------------------------------------------------------------------------
@query(
    f"select delivery_no, k from (select delivery_no, {_full('id', 't1')} as k, row_number() over (partition by {_full('id', 't1')} order by delivery_no) as rn "
    "from empath_scores_full) where rn = 1 and k is not null"
)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).select("delivery_no", full_name("id", "t1").alias("k")).where("k is not null")
    return R.first_per_key(rows, ["k"], [F.col("delivery_no")])


@query(
    "select id, line_no, body from (select id, line_no, body, row_number() over (partition by id order by length(body) desc nulls last, line_no) as rn "
    "from r_conspiracy_comments3 where id is not null) where rn = 1"
)
def dedup_longest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, RAW).where("id is not null").select("id", "line_no", "body")
    return R.keep_extreme(rows, ["id"], [F.length("body"), -F.col("line_no")])


@query(
    "select post_id, row_no, exported_utc from (select *, row_number() over (partition by post_id order by exported_utc desc, row_no desc) as rn from thread_quality_metrics "
    "where post_id is not null) where rn = 1"
)
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "thread_quality_metrics").where("post_id is not null").select("post_id", "row_no", "exported_utc")
    return R.keep_extreme(rows, ["post_id"], [F.col("exported_utc"), F.col("row_no")])


@query(
    "with c as (select source, count(*) as n from documents group by 1) select source, n, n / (select sum(n) from c) as share from c"
)
def wn_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return R.shares(table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "n")


@query(
    "with s as (select avg(upvotes) as m, stddev_samp(upvotes) as sd from empath_scores_full) select delivery_no, (upvotes - m) / sd as z from empath_scores_full, s where upvotes is not null"
)
def wn_z_score(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, EMPATH).where("upvotes is not null")
    s = t.agg(F.struct(F.avg("upvotes").alias("m"), F.stddev_samp("upvotes").alias("sd"))).scalar()
    return t.select("delivery_no", F.try_divide(F.col("upvotes") - s["m"], s["sd"]).alias("z"))


@query(
    "with t as (select author, date_trunc('month', make_timestamp(created_utc * 1000000)) as m from empath_scores_full where author is not null and created_utc is not null), "
    "f as (select author, min(m) as f from t group by 1) select t.author, cast((year(m) - year(f)) * 12 + month(m) - month(f) as int) as age, count(*) as n "
    "from t join f on t.author = f.author group by 1, 2"
)
def wn_months_since_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, EMPATH).where("author is not null and created_utc is not null")
    ts = F.timestamp_seconds("created_utc")
    t = t.select("author", (F.year(ts) * 12 + F.month(ts)).alias("m"))
    t = t.groupBy("author", "m").agg(F.count(F.lit(1)).alias("n"))  # counted first: the window sees a line per author and month
    first = F.min("m").over(Window.partitionBy("author"))
    return t.select("author", (F.col("m") - first).cast("int").alias("age"), "n")


@query(
    "select link_id, delivery_no from (select link_id, delivery_no, row_number() over (partition by link_id order by delivery_no) as rn from empath_scores_full "
    "where link_id is not null and text like '%archive%') where rn <= 3"
)
def wn_first_three(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).where(F.col("link_id").isNotNull() & F.contains("text", F.lit("archive"))).select("link_id", "delivery_no")
    return R.first_per_key(rows, ["link_id"], [F.col("delivery_no")], 3)


@query(
    "with m as (select author, median(created_utc) as mid, count(*) as n from empath_scores_full where created_utc is not null and author is not null group by 1), "
    "h as (select e.author, avg(case when created_utc <= mid then has_link end) as early, avg(case when created_utc > mid then has_link end) as late "
    "from empath_scores_full e join m on e.author = m.author where e.created_utc is not null and n >= 20 group by 1) "
    "select author, early, late, (early < 0.5 and late >= 0.5) or (early >= 0.5 and late < 0.5) as reversed from h where late is not null"
)
def reversal_split(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, EMPATH).where("created_utc is not null and author is not null").select("author", "created_utc", "has_link")
    m = t.groupBy("author").agg(F.median("created_utc").alias("mid"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    early = F.col("created_utc") <= F.col("mid")
    h = t.join(m, "author").groupBy("author").agg(F.avg(F.when(early, F.col("has_link"))).alias("early"), F.avg(F.when(~early, F.col("has_link"))).alias("late"))
    turned = ((F.col("early") < 0.5) & (F.col("late") >= 0.5)) | ((F.col("early") >= 0.5) & (F.col("late") < 0.5))
    return h.where("late is not null").withColumn("reversed", turned)


@query("select line_no, id, score from r_conspiracy_posts where score is not null order by score desc, num_comments desc nulls last, line_no limit 25")
def so_top_posts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, POSTS).where("score is not null")
    return t.orderBy(F.desc("score"), F.desc_nulls_last("num_comments"), "line_no").limit(25).select("line_no", "id", "score")


@query()
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified_sample(table(spark, d, EMPATH).select("delivery_no", "controversiality", "has_link"), ["controversiality", "has_link"], "delivery_no", 120, 7)


@query()
def so_bernoulli_after_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, EMPATH).where("has_link = 1").sample(0.03, seed=11).select("delivery_no")


@query()
def so_hashed_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.train_validation(R.hashed_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 500, 3), "doc_id", 0.8, 3)


@query(
    "with q as (select doc_id, label, 1 - abs(hash_free) as u from (select doc_id, label, (doc_id % 97) / 97.0 as hash_free from content_labels)) "
    "select doc_id, label, u from q order by case when label is null then 1 else 0 end, u desc, doc_id, label limit 100"
)
def so_rerank_queue(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows first, then by a score, highest first."""
    q = table(spark, d, "content_labels").select("doc_id", "label", (1 - (F.col("doc_id") % 97) / 97).alias("u"))
    return q.orderBy(F.col("label").isNull(), F.desc("u"), "doc_id", F.asc_nulls_last("label")).limit(100)


@query(
    "select 'low' as bin, count(*) as n from empath_scores_full where upvotes >= -1000 and upvotes < 5 union all select 'mid', count(*) from empath_scores_full where upvotes >= 5 and upvotes < 50 "
    "union all select 'high', count(*) from empath_scores_full where upvotes >= 50 and upvotes < 1000000"
)
def so_binned_query(spark: SparkSession, d: str) -> DataFrame:
    bins = [("low", -1000, 5), ("mid", 5, 50), ("high", 50, 1_000_000)]
    return R.by_bins(table(spark, d, EMPATH), lambda t: t.agg(F.count(F.lit(1)).alias("n")), "upvotes", bins)


@query(
    "select 'comment' as kind, author from empath_scores_full union all select 'raw' as kind, author from r_conspiracy_comments3 union all select 'post' as kind, author from r_conspiracy_posts"
)
def st_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, k: table(spark, d, t).select("author", F.lit(k).alias("kind"))
    return part(EMPATH, "comment").unionByName(part(RAW, "raw")).unionByName(part(POSTS, "post"))


@query(f"select distinct {_full('id', 't1')} as k from empath_scores_full intersect select distinct {_full('id', 't1')} as k from r_conspiracy_comments3")
def st_intersection(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t: table(spark, d, t).select(full_name("id", "t1").alias("k"))
    return ids(EMPATH).intersect(ids(RAW))


@query(f"select distinct {_full('id', 't1')} as k from r_conspiracy_comments3 except select {_full('id', 't1')} as k from empath_scores_full")
def overlap_excluded(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t: table(spark, d, t).select(full_name("id", "t1").alias("k"))
    return ids(RAW).subtract(ids(EMPATH))


# ---- functions ---------------------------------------------------------------------------------------------------------
@query(
    "select delivery_no, strftime(make_timestamp(created_utc * 1000000), '%Y-%m') as month, year(make_timestamp(created_utc * 1000000)) as y, "
    "cast(epoch(date_trunc('month', make_timestamp(created_utc * 1000000))) as bigint) as month_start from empath_scores_full where created_utc is not null"
)
def fn_time_parts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.timestamp_seconds("created_utc")
    return table(spark, d, EMPATH).where("created_utc is not null").select(
        "delivery_no", F.date_format(ts, "yyyy-MM").alias("month"), F.year(ts).cast("bigint").alias("y"), F.unix_timestamp(F.date_trunc("month", ts)).alias("month_start")
    )


@query(
    "select line_no, regexp_extract(url, 'https?://(?:www\\.)?([^/\\s]+)', 1) as host, len(regexp_extract_all(url, '/')) as slashes, regexp_replace(url, '\\?.*$', '') as path "
    "from r_conspiracy_posts where url is not null"
)
def fn_regex_family(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, POSTS).where("url is not null").select(
        "line_no",
        F.regexp_extract("url", r"https?://(?:www\.)?([^/\s]+)", 1).alias("host"),
        F.regexp_count("url", F.lit("/")).cast("bigint").alias("slashes"),
        F.regexp_replace("url", r"\?.*$", "").alias("path"),
    )


@query(
    "select event_id, cast(json_extract_string(props, '$.k') as int) as k, round(ln(1 + abs(value)), 4) as v, case when value > 50 then 'high' else 'low' end as side from events"
)
def fn_json_and_maths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.log1p(F.abs("value")), 4).alias("v"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("side"),
    )


@query()
def fn_text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Names, keys and acronyms out of titles; tested on fixtures."""
    t = table(spark, d, POSTS).where("title is not null")
    return t.select(
        "line_no", T.entity_key("title").alias("key"), T.acronym("title").alias("initials"), T.person_name("author").alias("name"),
        T.token_overlap("title", "url").alias("overlap"), F.size(T.sentences("title")).alias("n_sentences"),
    )
