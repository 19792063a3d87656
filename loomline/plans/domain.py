"""Queries of the domain operators: dictionaries, populations, author profiles, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.identifiers import full_name
from loomline.operators import lexicon as L
from loomline.operators import population as P
from loomline.operators import relational as R
from loomline.operators import urls as U
from loomline.plans.relational import EMPATH, POSTS, RAW, _full
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


# A small dictionary in the manner of a caller's: hyphenated, apostrophed, underscored (dead), listed twice, several words
LEXICON = {
    "evidence": ("report", "footage", "documents", "weather-balloon", "actual_study", "archive"),
    "hedge": ("maybe", "as far as i know", "supposedly", "rumour has it", "maybe"),
    "adversarial": ("so called", "the same office", "theatre", "don't trust"),
}


def _contains(term: str) -> str:
    return f"cast(contains(c, ' {term.replace('-', ' ').replace(chr(39), ' ')} ') as int)"


_SPACED = "(select *, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', ' ', 'g') || ' ' as c from empath_scores_full)"


@query("select delivery_no, " + ", ".join(f"{' + '.join(_contains(t) for t in own)} as {c}_count" for c, own in LEXICON.items()) + f" from {_SPACED}")
def lexicon_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).select("delivery_no", "text")
    return L.lexicon_scores(rows, "text", LEXICON).drop("text")


_TOK = "unnest(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
CATEGORIES = tuple("evidence adversarial hedge certainty alt_authority intuitive pattern meta demand anecdotal quantitative".split())


@query(
    f"with w as (select distinct delivery_no, {_TOK.format(c='text')} as word from empath_scores_full), c as (select word, count(*) as n from w where length(word) > 2 group by 1), "
    "top as (select word, row_number() over (order by n desc, word) as r from c order by n desc, word limit 533), "
    f"h as (select delivery_no, {', '.join(f'count(*) filter (where r % 11 = {i}) as c{i}' for i in range(11))} from w join top using (word) group by 1) "
    f"select e.delivery_no, {', '.join(f'cast(coalesce(c{i}, 0) as int) as {c}_count' for i, c in enumerate(CATEGORIES))} from empath_scores_full e left join h using (delivery_no)"
)
def lexicon_scores_533(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of full size, 533 terms in eleven categories, here the words met in most texts, dealt out in turn."""
    rows = table(spark, d, EMPATH).select("delivery_no", "text")
    n = rows.select(F.explode(F.array_distinct(T.words("text", 3))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = [r["word"] for r in n.orderBy(F.desc("n"), "word").limit(533).collect()]  # a dictionary of a fixed size
    return L.lexicon_scores(rows, "text", {c: [t for r, t in enumerate(terms, 1) if r % 11 == i] for i, c in enumerate(CATEGORIES)}).drop("text")


_LIKES = {
    "claim": ("%according to%", "%they don%t want%", "%the record%"),
    "doubt": ("%so what%", "%supposedly%", "%funny how%"),
    "demand": ("%show me%", "%source%?%", "%does anyone%"),
    "certainty": ("%debunked%", "%nobody denies%", "%obvious%"),
    "experience": ("%i read%", "%i used to%", "%my uncle%"),
}


@query(
    "select delivery_no, "
    + ", ".join(f"{' + '.join(f'coalesce(cast(lower(text) like {chr(39)}{p}{chr(39)} as int), 0)' for p in own)} as {c}_count" for c, own in _LIKES.items())
    + " from empath_scores_full"
)
def lexicon_like_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.like_scores(table(spark, d, EMPATH).select("delivery_no", "text"), "text", _LIKES).drop("text")




@query(
    f"with a as (select {_TOK.format(c='text')} as word from documents where lang = 'en'), b as (select {_TOK.format(c='text')} as word from documents where lang = 'de'), "
    "x as (select word, count(*) as n1 from a group by 1), y as (select word, count(*) as n2 from b group by 1), "
    "j as (select coalesce(x.word, y.word) as word, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2, cast((select sum(n1) from x) as double) as t1, cast((select sum(n2) from y) as double) as t2 "
    "from x full join y on x.word = y.word), g as (select *, (n1 + n2) / (t1 + t2) as p from j), "
    "l as (select *, 2 * (case when n1 > 0 then n1 * ln(n1 / (t1 * p)) else 0 end + case when n2 > 0 then n2 * ln(n2 / (t2 * p)) else 0 end) as v from g) "
    "select word, n1, n2, round(case when n1 / t1 > n2 / t2 then v else -v end + 0.0, 6) as g2 from l"
)
def keyness_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    of = lambda lang: L.word_counts(docs.where(F.col("lang") == lang), "text")
    return L.keyness(of("en"), of("de")).withColumn("g2", F.round("g2", 6))


@query(
    f"with t as (select distinct delivery_no, has_link, {_TOK.format(c='text')} as word from empath_scores_full) "
    "select word, cast(sum(has_link) as bigint) as pos, cast(sum(1 - has_link) as bigint) as neg, (sum(has_link) + 0.01) / (sum(1 - has_link) + 0.01) as lift from t group by word"
)
def word_lift(spark: SparkSession, d: str) -> DataFrame:
    return L.word_lift(table(spark, d, EMPATH), "text", "has_link")


_MONTHLY = (
    "with e as (select author, strftime(make_timestamp(created_utc * 1000000), '%Y-%m') as month, text from empath_scores_full where created_utc is not null and {rows}), "
    f"w as (select author, month, {_TOK.format(c='text')} as word from e), c as (select month, word, count(*) as w from w where length(word) > 2 group by 1, 2), "
    "b as (select * from c qualify row_number() over (partition by month order by w desc, word) <= 5000), norm as (select month, sqrt(sum(w * w)) as norm from b group by 1), "
    "k as (select author, month, word, count(*) as n from w semi join ({chosen}) using ({keys}) where length(word) > 2 group by 1, 2, 3) "
    "select author, month, sum(n * w) / (sqrt(sum(n * n)) * any_value(norm)) as cosine from k join b using (month, word) join norm using (month) group by 1, 2"
)


@query(
    _MONTHLY.format(
        rows="text is not null and text not in ('[deleted]', '[removed]')",
        chosen="select author, month from e where author not in ('[deleted]', '[removed]', 'AutoModerator') group by 1, 2 having count(*) >= 5",
        keys="author, month",
    )
)
def lexical_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Per author and month of at least five live comments the cosine with that month's words."""
    rows = _live_by_month(spark, d)
    active = P.real_authors(rows).groupBy("author", "month").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("author", "month")
    return _monthly_cosine(rows, rows.join(active, ["author", "month"], "left_semi"))


def _live_by_month(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, EMPATH).where(T.is_live("text") & F.col("created_utc").isNotNull())
    return rows.select("author", F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("month"), "text")


def _monthly_cosine(rows: DataFrame, scored: DataFrame, top: int = 5000) -> DataFrame:
    """``(author, month, cosine)``: of the words of ``scored`` with the month's ``top`` most frequent words in ``rows``."""
    own = L.word_counts(scored, "text", 3, ["author", "month"])
    month = R.first_per_key(L.word_counts(rows, "text", 3, ["month"]), ["month"], [F.desc("n"), F.col("word")], top)
    norm = month.groupBy("month").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    j = own.join(month.select("month", "word", F.col("n").alias("w")), ["month", "word"])
    g = j.groupBy("author", "month").agg(F.sum(F.col("n") * F.col("w")).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own"))
    return g.join(norm, "month").select("author", "month", F.try_divide(F.col("dot"), F.col("own") * F.col("norm")).alias("cosine"))


@query(_MONTHLY.format(rows="author is not null", chosen="select author from e group by 1 having count(distinct month) >= 12 and count(*) > 50", keys="author"))
def lifecycle_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Per author and month the cosine with that month's words; authors of several months only."""
    rows = table(spark, d, EMPATH).where("author is not null and created_utc is not null")
    rows = rows.select("author", F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("month"), "text")
    long_ = rows.groupBy("author").agg(F.countDistinct("month").alias("m"), F.count(F.lit(1)).alias("n")).where("m >= 12 and n > 50").select("author")
    return _monthly_cosine(rows, rows.join(long_, "author", "left_semi"))


@query()
def disambiguate(spark: SparkSession, d: str) -> DataFrame:
    """Language of texts by the signature words of texts whose language is known."""
    docs = table(spark, d, "documents").where("text is not null")
    known = docs.where(F.col("lang").isin("en", "de", "fr", "es"))
    return L.disambiguated(docs, "doc_id", "text", L.signature_words(known, "text", "lang"), "lang")


@query(
    f"with t as (select lang, {_TOK.format(c='text')} as word from documents where lang in ('en', 'de', 'fr', 'es')), c as (select lang, word, count(*) as n from t where length(word) >= 3 group by 1, 2), "
    "a as (select word, sum(n) as n_all from c group by 1), r as (select lang, c.word, row_number() over (partition by lang order by n desc, c.word) as rn from c join a on c.word = a.word "
    "where n >= 3 and n / n_all >= 0.7) select lang, word from r where rn <= 40"
)
def signature_words(spark: SparkSession, d: str) -> DataFrame:
    return L.signature_words(table(spark, d, "documents").where(F.col("lang").isin("en", "de", "fr", "es")), "text", "lang")


# ---- populations and profiles ------------------------------------------------------------------------------------------
@query(
    "select line_no, case when num_comments > 0 then score / num_comments else cast(score as double) end as elasticity_ratio, coalesce(cast(num_crossposts >= 1 as int), 0) as is_crossposted, "
    "cast(id in (select post_id from thread_quality_metrics where is_high_crosspost = 1 and post_id is not null) as int) as is_high_crosspost from r_conspiracy_posts where id is not null"
)
def elasticity_flags(spark: SparkSession, d: str) -> DataFrame:
    audited = table(spark, d, "thread_quality_metrics").where("is_high_crosspost = 1").select(F.col("post_id").alias("id"))
    posts = table(spark, d, POSTS).where("id is not null").select("line_no", "id", "score", "num_comments", "num_crossposts")
    return P.elasticity_flags(posts, audited).select("line_no", "elasticity_ratio", "is_crossposted", "is_high_crosspost")


_REAL = "author not in ('[deleted]', '[removed]', 'AutoModerator')"


@query(
    f"with c as (select author, count(*) as n from empath_scores_full where {_REAL} group by 1) select delivery_no as comment_id, e.author, upvotes as score, n as total_global_comments, "
    "cast(upvotes >= 100 and n = 1 as int) as brigade_upvote_flag, cast(upvotes <= -6 and n >= 21 as int) as brigade_downvote_flag from empath_scores_full e join c on e.author = c.author "
    "where upvotes >= 100 or upvotes <= -6"
)
def brigade_flags(spark: SparkSession, d: str) -> DataFrame:
    return P.brigade_flags(table(spark, d, EMPATH), "delivery_no")


_INSIDERS = f"(select author from empath_scores_full where {_REAL} group by 1 having count(*) >= 21)"


@query(
    f"with p as (select distinct link_id, author from empath_scores_full where {_REAL} and link_id is not null) select link_id, count(*) as n_distinct_commenters, "
    f"count(*) filter (where author in {_INSIDERS}) as n_insider_commenters, count(*) filter (where author in {_INSIDERS}) / count(*) as insider_presence_ratio from p group by link_id"
)
def presence_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, EMPATH)
    insiders = P.real_authors(e).groupBy("author").agg(F.count(F.lit(1)).alias("n")).where("n >= 21")
    return P.presence_ratio(e, insiders, "link_id")


def _population(spark: SparkSession, d: str, pure: bool) -> DataFrame:
    e = table(spark, d, EMPATH).select("delivery_no", full_name("id", "t1").alias("k"), full_name("link_id", "t3").alias("thread"), "author", "upvotes").where("k is not null")
    t = table(spark, d, "thread_quality_metrics").select(full_name("post_id", "t3").alias("thread"), "elasticity_ratio", "is_high_crosspost", "exported_utc", "row_no")
    t = R.keep_extreme(t.where("thread is not null"), ["thread"], [F.col("exported_utc"), F.col("row_no")])
    b = table(spark, d, "comment_brigade_flags").select(full_name("comment_id", "t1").alias("k"), "brigade_upvote_flag", "brigade_downvote_flag")
    presence = None
    if pure:
        insiders = P.real_authors(e).groupBy("author").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
        presence = P.presence_ratio(e, insiders, "thread")
    return P.population(e, t, presence, b, "k", "thread", "delivery_no", 0.5).select("k", "thread", "upvotes", "elasticity_ratio")


_POP = f"""
with e as (select delivery_no, {_full('id', 't1')} as k, {_full('link_id', 't3')} as thread, author, upvotes from empath_scores_full where {_full('id', 't1')} is not null),
t as (select thread, elasticity_ratio, is_high_crosspost from (select *, {_full('post_id', 't3')} as thread, row_number() over (partition by {_full('post_id', 't3')}
 order by exported_utc desc, row_no desc) as rn from thread_quality_metrics) where rn = 1 and thread is not null),
b as (select {_full('comment_id', 't1')} as k from comment_brigade_flags where brigade_upvote_flag = 1 or brigade_downvote_flag = 1),
i as (select author from e where {_REAL} group by 1 having count(*) >= 5),
pr as (select thread from (select distinct thread, author from e where {_REAL} and thread is not null) group by thread
 having count(*) filter (where author in (select author from i)) / count(*) >= 0.5),
x as (select e.k, e.thread, upvotes, elasticity_ratio, row_number() over (partition by e.k order by delivery_no, elasticity_ratio) as rn from e join t on e.thread = t.thread
 where is_high_crosspost = 0 and e.k not in (select k from b where k is not null) {{more}})
select k, thread, upvotes, elasticity_ratio from x where rn = 1"""


@query(_POP.format(more="and elasticity_ratio <= (select quantile_disc(elasticity_ratio, 0.33) from t) and e.thread in (select thread from pr)"))
def population_pure(spark: SparkSession, d: str) -> DataFrame:
    return _population(spark, d, True)


@query(_POP.format(more=""))
def population_unfiltered(spark: SparkSession, d: str) -> DataFrame:
    return _population(spark, d, False)


@query(
    "with g as (select author, count(*) as n_comments, count(distinct text) as n_distinct_texts, count(*) / nullif(count(distinct text), 0) as ratio, "
    "lower(author) = 'automoderator' or regexp_matches(author, '(?i)bot$') as is_named_bot from empath_scores_full where author not in ('[deleted]', 'AutoModerator') group by author), "
    "h as (select *, is_named_bot or coalesce(ratio >= 20, false) as is_likely_bot from g) "
    "select author, n_comments, n_distinct_texts, round(ratio, 2) as dup_ratio, is_named_bot, is_likely_bot, "
    "not is_likely_bot and n_comments >= 20 and coalesce(ratio >= 1.5, false) as is_repeat_poster from h"
)
def dup_ratio_flags(spark: SparkSession, d: str) -> DataFrame:
    return P.repeat_posters(table(spark, d, EMPATH), "author", "text")


@query(
    f"with c as (select author, count(*) as n from empath_scores_full where {_REAL} group by 1), t as (select case when n <= 1 then '1' when n <= 5 then '2-5' when n <= 20 then '6-20' "
    "when n <= 50 then '21-50' when n <= 200 then '51-200' when n <= 1000 then '201-1000' else '1001+' end as tier, count(*) as n_authors, cast(sum(n) as bigint) as n_rows from c group by 1) "
    "select tier, n_authors, n_rows, n_authors * 100 / (select sum(n_authors) from t) as pct_authors, n_rows * 100 / (select sum(n_rows) from t) as pct_rows from t"
)
def author_tiers(spark: SparkSession, d: str) -> DataFrame:
    return P.activity_tiers(table(spark, d, EMPATH))


@query(
    f"with v as (select author, strftime(make_timestamp(created_utc * 1000000), '%Y-%m') as month from empath_scores_full where {_REAL} and created_utc is not null), "
    "t as (select author, count(*) as total from v group by 1) select month, count(distinct v.author) as n_authors, count(distinct case when total >= 21 then v.author end) as n_heavy "
    "from v join t on v.author = t.author group by month"
)
def monthly_active_and_heavy(spark: SparkSession, d: str) -> DataFrame:
    return P.monthly_active(table(spark, d, EMPATH))


@query(
    f"with c as (select author, count(*) as n from empath_scores_full where {_REAL} group by 1), j as (select controversiality, case when upvotes >= 100 and n = 1 then 'one-off hit' "
    "when upvotes <= -6 and n >= 21 then 'regular sunk' when upvotes between 5 and 49 and n >= 21 then 'regular liked' end as cohort from empath_scores_full e join c on e.author = c.author) "
    "select cohort, count(*) as n, avg(controversiality) as mean, quantile_disc(controversiality, 0.5) as p50, quantile_disc(controversiality, 0.9) as p90 from j where cohort is not null group by cohort"
)
def cohort_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return P.cohorts(table(spark, d, EMPATH))


@query(
    "with p as (select distinct author as u, subreddit as s from r_conspiracy_posts where author is not null), h as (select distinct u from p where s = 'conspiracy'), "
    "g as (select s as subreddit, count(*) as n_users, count(*) filter (where u in (select u from h)) as n_shared from p where s <> 'conspiracy' group by 1), "
    "m as (select sum(n_shared) / sum(n_users) as mean from g) select subreddit, n_users, n_shared, n_shared / n_users as share, (n_shared + 50 * mean) / (n_users + 50) as shrunk from g, m"
)
def affinity_bayesian(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, POSTS).where("author is not null").select("author", "subreddit")
    return P.affinity(rows, "author", "subreddit", "conspiracy")


@query(
    f"with a as (select author, count(*) as n, avg(upvotes) as u, avg(has_link) as l from empath_scores_full where {_REAL} group by 1), "
    "s as (select avg(ln(1 + n)) as mn, stddev_samp(ln(1 + n)) as sn, avg(u) as mu, stddev_samp(u) as su, avg(l) as ml, stddev_samp(l) as sl from a), "
    "z as (select author, (ln(1 + n) - mn) / sn as z_volume, (u - mu) / su as z_score, (l - ml) / sl as z_links from a, s) select author, z_volume, z_score, z_links, "
    "(coalesce(z_volume, 0) + coalesce(z_score, 0) + coalesce(z_links, 0)) / ((z_volume is not null)::int + (z_score is not null)::int + (z_links is not null)::int) as score from z"
)
def insider_score_z(spark: SparkSession, d: str) -> DataFrame:
    a = P.real_authors(table(spark, d, EMPATH)).groupBy("author")
    a = a.agg(F.count(F.lit(1)).alias("n"), F.avg("upvotes").alias("u"), F.avg("has_link").alias("l"))
    return P.composite_z(a, "author", [("volume", F.log1p("n")), ("score", F.col("u")), ("links", F.col("l"))])


# ---- citations -------------------------------------------------------------------------------------------------------
_RAWURL = r"regexp_extract_all(text, 'https?://[^\s\]>\"'']+')"
_CUT = r"regexp_replace({u}, '[.,;:!?''\"\]]+$', '')"
_PAREN = (
    "substr({u}, 1, length({u}) - greatest(least(length(regexp_extract({u}, '\\)*$')), (length({u}) - length(replace({u}, ')', ''))) - (length({u}) - length(replace({u}, '(', '')))), 0))"
)
_C1 = _CUT.format(u="u0")
_NORM = (
    "'https://' || lower(regexp_extract(u, '^https?://([^/]+)', 1)) || case when regexp_extract(u, '^https?://[^/]+(/.*)?$', 1) = '/' then '' "
    "else regexp_extract(u, '^https?://[^/]+(/.*)?$', 1) end"
)
_CITED = f"""
a as (select delivery_no, author, upvotes, unnest({_RAWURL}) as u0 from empath_scores_full where text like '%http%'), b as (select *, {_C1} as u1 from a),
c as (select *, {_PAREN.format(u='u1')} as u2 from b), e as (select *, {_CUT.format(u='u2')} as u from c),
n as (select distinct delivery_no, author, upvotes, {_NORM} as url from e where length(u) > 15),
cited as (select *, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:?#]+)', 1) as domain from n)"""


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return U.cited(table(spark, d, EMPATH).select("delivery_no", "author", "upvotes", "text"), ["delivery_no", "author", "upvotes"], "text")


@query(f"with {_CITED} select delivery_no, url, domain from cited")
def url_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).select("delivery_no", "url", "domain")


@query(
    f"with {_CITED} select url, count(*) as n_mentions, count(distinct author) as n_authors, count(*) / nullif(count(distinct author), 0) as per_author, "
    "count(*) >= 10 and coalesce(count(*) / nullif(count(distinct author), 0) >= 5, true) as is_spam from cited group by url"
)
def url_rank(spark: SparkSession, d: str) -> DataFrame:
    return U.url_ranking(_citations(spark, d))


@query(
    f"with {_CITED} select domain, count(*) as n, count(distinct url) as n_urls, count(distinct author) as n_authors, avg(upvotes) as mean_score, median(upvotes) as median_score from cited group by domain"
)
def domain_performance(spark: SparkSession, d: str) -> DataFrame:
    return U.domain_performance(_citations(spark, d).withColumnRenamed("upvotes", "score"))


# A caller's list of domains, as an example
DOMAINS = [
    ("example.com", "platform", None, True),
    ("example.org", "news", "mixed", False),
    ("harborline.example", "news", "high", False),
    ("ledgerwatch.example", "alternative", "low", False),
    ("oldmill.example", "academic", None, False),
    ("kettle-post.example", "alternative", None, False),
]
_LOOKUP = "(values " + ", ".join(f"('{a}', '{b}', {'null' if c is None else chr(39) + c + chr(39)}, {str(p).lower()})" for a, b, c, p in DOMAINS) + ") as l(dom, category, reliability, platform)"
_TIER = (
    "case when platform then 'aggregator_or_platform' when regexp_matches(domain, '\\.(gov|mil)$') or category in ('government', 'academic') or reliability in ('high', 'very high', 'mostly factual') "
    "then 'mainstream_reliable' when reliability in ('mixed', 'low', 'very low') and category <> 'alternative' then 'mainstream_imperfect' when category = 'alternative' then 'alt_media' "
    "when category = 'news' then 'mainstream_reliable' else 'unmatched_link' end"
)
_TIERED = (
    f"with {_CITED}, x as (select delivery_no, url, domain, category, reliability, platform, row_number() over (partition by delivery_no, url order by length(dom) desc) as rn from cited "
    f"left join {_LOOKUP} on domain = dom or ends_with(domain, '.' || dom)), t as (select delivery_no, url, domain, {_TIER} as tier from x where rn = 1)"
)


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    lookup = spark.createDataFrame(DOMAINS, "domain string, category string, reliability string, platform boolean")
    c = U.by_parent_domain(_citations(spark, d), lookup)
    tier = U.source_tier(F.col("category"), F.col("reliability"), F.coalesce("platform", F.lit(False)), F.col("domain"))
    return c.select("delivery_no", "url", "domain", tier.alias("tier"))


@query(f"{_TIERED} select delivery_no, url, domain, tier from t")
def citation_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d)


@query(
    f"{_TIERED} select delivery_no, ['mainstream_reliable', 'mainstream_imperfect', 'alt_media', 'aggregator_or_platform', 'unmatched_link'][min(list_position("
    "['mainstream_reliable', 'mainstream_imperfect', 'alt_media', 'aggregator_or_platform', 'unmatched_link'], tier))] as tier from t group by delivery_no"
)
def comment_link_tier(spark: SparkSession, d: str) -> DataFrame:
    return U.strongest_tier(_tiers(spark, d), "delivery_no")


_MATCHERS = [(1, r"/[a-z]+\.html$", "page"), (2, r"[?&]id=\d+", "record"), (3, r"^https://files\.", "file")]


@query(
    f"with {_CITED} select distinct url, case when regexp_matches(url, '/[a-z]+\\.html$') then 'page' when regexp_matches(url, '[?&]id=\\d+') then 'record' "
    "when starts_with(url, 'https://files.') then 'file' end as label from cited"
)
def url_first_matcher(spark: SparkSession, d: str) -> DataFrame:
    return U.first_matcher(_citations(spark, d), spark.createDataFrame(_MATCHERS, "rank int, pattern string, label string"))


@query(
    f"with {_CITED}, p as (select unnest(regexp_extract_all(url, '[?&]id=(\\d+)', 1)) as rec from cited) select rec, count(*) as n from p group by rec"
)
def cited_record_ids(spark: SparkSession, d: str) -> DataFrame:
    c = _citations(spark, d).select(F.explode(F.regexp_extract_all("url", F.lit(r"[?&]id=(\d+)"), 1)).alias("rec"))
    return c.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
