"""Queries hold the whole of what they name, by definitions that share no cut with them."""

import os

import pytest

from loomline.operators import relational as R
from loomline.plans import domain, relational
from tests.differential import connect, plain, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connect(FOLDER)


def test_texts_are_joined_whole(spark, con):
    got = relational.QUERIES["ag_ordered_concat"](spark, FOLDER)
    assert same(got, con, "select link_id, 0 as start, string_agg(text, ' ' order by delivery_no) as text from empath_scores_full where text is not null group by link_id") == ""


def test_pieces_of_a_hot_key_make_its_text(spark):
    rows = [("hot", i * 7 % 100, f"text {i}") for i in range(100)] + [("cold", 3, "b"), ("cold", 1, "a"), ("cold", 2, None), ("cold", 5, ""), (None, 9, "z" * 70), (None, 50, "y"), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, o long, text string").repartition(3)
    got = sorted(map(tuple, R.ordered_concat(df, "k", "text", "o", ", ", most=60, block=4).collect()), key=plain)
    for key in ("hot", "cold", None):
        want = ", ".join(t for k, _, t in sorted((r for r in rows if r[2] is not None and r[0] == key), key=lambda r: r[1]))
        own = sorted((s, t) for k, s, t in got if k == key)
        assert ", ".join(t for _, t in own) == want and all(want[s : s + len(t)] == t for s, t in own)
    assert {k for k, _, _ in got} == {"hot", "cold", None} and sum(k == "hot" for k, _, _ in got) > 10 and max(len(t) for *_, t in got) < 120


def test_every_comment_has_five_siblings_if_there_are(spark, con):
    got = relational.QUERIES["jn_siblings_top5"](spark, FOLDER)
    sql = (
        f"with one as (select {relational._full('id', 't1')} as k, {relational._full('parent_id', 't1')} as p, min(delivery_no) as delivery_no from empath_scores_full where id is not null group by 1, 2) "
        "select a.delivery_no, b.k as sibling from one a join one b on a.p = b.p and a.k <> b.k qualify row_number() over (partition by a.k, a.p order by b.k) <= 5"
    )
    assert same(got, con, sql) == ""


_MONTHLY = """with e as (select author, strftime(to_timestamp(created_utc) at time zone 'UTC', '%Y-%m') as month, text from empath_scores_full where created_utc is not null and {rows}),
w as (select author, month, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from e), c as (select month, word, count(*) as w from w where length(word) > 2 group by 1, 2),
b as (select * from c qualify row_number() over (partition by month order by w desc, word) <= 5000), norm as (select month, sqrt(sum(w * w)) as norm from b group by 1),
k as (select author, month, word, count(*) as n from w semi join ({chosen}) using ({keys}) where length(word) > 2 group by 1, 2, 3)
select author, month, sum(n * w) / (sqrt(sum(n * n)) * any_value(norm)) as cosine from k join b using (month, word) join norm using (month) group by 1, 2"""


def test_lexical_alignment_by_month_and_5000_words(spark, con):
    real = "author not in ('[deleted]', '[removed]', 'AutoModerator')"
    sql = _MONTHLY.format(rows="text is not null and text not in ('[deleted]', '[removed]')", chosen=f"select author, month from e where {real} group by 1, 2 having count(*) >= 5", keys="author, month")
    assert same(domain.QUERIES["lexical_alignment"](spark, FOLDER), con, sql) == ""


def test_monthly_cosine_uses_5000_words(spark):
    rows = [("b", "2020-01", " ".join(f"w{i:04d} w{i:04d}" for i in range(4999))), ("a", "2020-01", "w4000 w4996 yyy zzz")]
    df = spark.createDataFrame(rows, "author string, month string, text string")
    got = {r["author"]: r["cosine"] for r in domain._monthly_cosine(df, df).collect()}  # yyy is the 5,000th word, zzz the next
    assert got["a"] == pytest.approx((3 + 3 + 1) / (3 * (4997 * 4 + 9 + 9 + 1)) ** 0.5)



def test_lifecycle_alignment(spark, con):
    folder = "/root/testdata/sf0.1"
    con = connect(folder)
    sql = _MONTHLY.format(rows="author is not null", chosen="select author from e group by 1 having count(distinct month) >= 12 and count(*) > 50", keys="author")
    assert same(domain.QUERIES["lifecycle_alignment"](spark, folder), con, sql) == ""
