"""Queries pN_ of the general problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import delivery, nesting, references
from loomline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.repeated_deliveries(table(spark, d, "empath_scores_full")).select(F.col("pos").alias("delivery_no"))


@query
def p1_once(spark: SparkSession, d: str) -> DataFrame:
    rows = delivery.deliver_once(table(spark, d, "empath_scores_full"))
    return rows.select("delivery_no", "id", "author", "created_utc", "text")


_ID = r"regexp_replace(regexp_replace(lower({}), '^\s+|\s+$', '', 'g'), '^t\d_', '')"
_EMPATH = "(select *, {} as k from empath_scores_full)".format(_ID.format("id"))
SQL["p1_found"] = f"""
select delivery_no from (select delivery_no, row_number() over (partition by k order by delivery_no) as n
from {_EMPATH} where k is not null and k <> '') where n > 1"""
SQL["p1_once"] = f"""
select delivery_no, id, author, created_utc, text from (select *, row_number() over (partition by k order by delivery_no) as n
from {_EMPATH}) where n = 1 or k is null or k = ''"""


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nesting.post_objects(table(spark, d, "r_conspiracy_posts"), attributes=False).select(F.col("key").alias("line_no"), "kind", "parent_pos", "pos")


@query
def p4_renditions(spark: SparkSession, d: str) -> DataFrame:
    objects = nesting.flatten_nested(table(spark, d, "r_conspiracy_posts"), "line_no", "media", nesting.MEDIA)
    fields = {"url": "string", "height": "int", "bitrate_kbps": "int"}
    return nesting.flat_table(objects, "rendition", fields).select(F.col("key").alias("line_no"), "pos", *fields)


def _unnest(path: str, kind: str) -> str:
    return f"""select line_no, '{kind}' as kind, cast(-1 as int) as parent_pos, cast(i - 1 as int) as pos
from (select line_no, {path} as l, unnest(range(1, len({path}) + 1)) as i from r_conspiracy_posts where {path} is not null) where l[i] is not null"""


def _unnest2(path: str, inner: str, kind: str) -> str:
    return f"""select line_no, '{kind}' as kind, cast(p - 1 as int) as parent_pos, cast(i - 1 as int) as pos from (
select line_no, p, l, unnest(range(1, len(l) + 1)) as i from (select line_no, p, o[p].{inner} as l from (
select line_no, {path} as o, unnest(range(1, len({path}) + 1)) as p from r_conspiracy_posts where {path} is not null) where o[p] is not null)
where l is not null) where l[i] is not null"""


# one JSON text each; a text delivered as a JSON string is decoded once more, and a lone object is a list of one
_EMBED = """
t as (select line_no, try_cast(secure_media_embed as json) as j from r_conspiracy_posts where trim(secure_media_embed) <> ''),
u as (select line_no, case when json_type(j) = 'VARCHAR' then try_cast(j ->> '$' as json) else j end as j from t),
o as (select line_no, j -> 'sources' as s from u where json_type(j) = 'OBJECT'),
s as (select line_no, case json_type(s) when 'ARRAY' then cast(s as json[]) when 'OBJECT' then [s] end as l from o),
e as (select line_no, l[i] as x, i - 1 as pos from (select line_no, l, unnest(range(1, len(l) + 1)) as i from s where l is not null)),
x as (select line_no, cast(pos as int) as pos, x from e where json_type(x) = 'OBJECT'),
z as (select line_no, pos as p, case json_type(x -> 'sizes') when 'ARRAY' then cast(x -> 'sizes' as json[]) when 'OBJECT' then [x -> 'sizes'] end as l from x),
y as (select line_no, p, l[i] as x, i - 1 as pos from (select line_no, p, l, unnest(range(1, len(l) + 1)) as i from z where l is not null))"""
SQL["p4_found"] = f"""
with {_EMBED}
{_unnest("media.oembed.thumbnails", "thumbnail")} union all {_unnest("media.hosted_video.renditions", "rendition")}
union all {_unnest2("media.hosted_video.renditions", "tracks", "track")} union all {_unnest("media.gallery", "gallery_item")}
union all {_unnest2("media.gallery", "variants", "variant")}
union all select line_no, 'source' as kind, cast(-1 as int) as parent_pos, pos from x
union all select line_no, 'size' as kind, p as parent_pos, cast(pos as int) as pos from y where json_type(x) = 'OBJECT'"""
SQL["p4_renditions"] = """
select line_no, cast(i - 1 as int) as pos, o[i].url as url, o[i].height as height, o[i].bitrate_kbps as bitrate_kbps from (
select line_no, media.hosted_video.renditions as o, unnest(range(1, len(media.hosted_video.renditions) + 1)) as i from r_conspiracy_posts
where media.hosted_video.renditions is not null) where o[i] is not null"""


def _refs_and_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    comments, posts = table(spark, d, "empath_scores_full"), table(spark, d, "r_conspiracy_posts")
    refs = references.references(
        [
            references.Referrer("empath_scores_full", comments, "delivery_no", "link_id", "retrieved_utc", "t3"),
            references.Referrer("thread_quality_metrics", table(spark, d, "thread_quality_metrics"), "row_no", "post_id", "exported_utc", "t3"),
            references.Referrer("comment_brigade_flags", table(spark, d, "comment_brigade_flags"), "row_no", "comment_id", "exported_utc", "t1"),
        ]
    )
    facts = references.target_facts(
        [(posts, "id", "retrieved_utc", "t3"), (comments, "id", "retrieved_utc", "t1")], table(spark, d, "removal_notices")
    )
    return refs, facts


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*_refs_and_facts(spark, d)).select("src_table", "src_row", "reason")


@query
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_refs_and_facts(spark, d))


def _ref(name: str, row: str, ref: str, time: str, kind: str) -> str:
    clean = rf"regexp_replace(lower({ref}), '^\s+|\s+$', '', 'g')"
    bare = rf"regexp_replace({clean}, '^t\d_', '')"
    key = rf"case when regexp_matches({clean}, '^t\d_') then {clean} else '{kind}_' || {bare} end"
    return f"select '{name}' as src_table, {row} as src_row, '{kind}' as wanted, {time} as t, {key} as k from {name} where {bare} <> ''"


_ORPHANS = f"""
with r as ({_ref("empath_scores_full", "delivery_no", "link_id", "retrieved_utc", "t3")}
 union all {_ref("thread_quality_metrics", "row_no", "post_id", "exported_utc", "t3")}
 union all {_ref("comment_brigade_flags", "row_no", "comment_id", "exported_utc", "t1")}),
seen as (select 't3_' || {_ID.format("id")} as k, min(retrieved_utc) as seen from r_conspiracy_posts group by 1
 union all select 't1_' || {_ID.format("id")} as k, min(retrieved_utc) as seen from empath_scores_full group by 1),
gone as (select regexp_replace(lower(fullname), '^\\s+|\\s+$', '', 'g') as k, min(removed_utc) as gone from removal_notices group by 1),
v as (select src_table, src_row, t, case when gone <= t then 'deleted' when seen is null or not starts_with(r.k, wanted) then 'missing'
 when seen > t then 'late' end as reason from r left join seen on r.k = seen.k left join gone on r.k = gone.k)"""
SQL["p6_found"] = f"{_ORPHANS} select src_table, src_row, reason from v where reason is not null"
SQL["p6_report"] = f"""{_ORPHANS} select src_table, reason, strftime(make_timestamp(t * 1000000), '%Y-%m') as period, count(*) as n
from v where reason is not null group by all"""
