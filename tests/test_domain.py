import itertools
import re

import pyspark.sql.functions as F
import pytest

from loomline.functions import text as T
from loomline.operators import components, lexicon, neardup, population, relational, spans
from loomline.operators import urls as U


def test_near_duplicates_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away from the old red barn near the river bank today"
    words = base.split()
    texts = [base, base, base.upper() + "!", " ".join(words[:-1]), " ".join(words[2:]), " ".join(words[:10]), "short text", "Short, text", "", None, "one", " ".join(reversed(words))]
    texts += [" ".join(words[:20] + [f"w{i}"]) for i in range(4)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1)))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = {i: set() for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
            if sets[i] != sets[j]:
                links[i].add(sets[j])
                links[j].add(sets[i])
    want = {i: (find(i), sum(find(j) == find(i) for j in sets), len(links[i])) for i in sets}
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in neardup.near_duplicates(df, "doc_id", "text").collect()}
    assert got == want
    assert neardup.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_urls(spark):
    text = (
        "see (http://Host.Example/a_(b)) and [x](https://www.two.example/p/?q=1). HTTP://no.example https://h.example/ http://short.io/, "
        "https://host.example/a_(b) \"https://quoted.example/page\" https://three.example/x.html)).!"
    )
    got = spark.createDataFrame([(text,)], "t string").select(U.urls_of("t").alias("u")).first()["u"]
    assert got == sorted(["https://host.example/a_(b)", "https://www.two.example/p/?q=1", "https://h.example", "https://quoted.example/page", "https://three.example/x.html", "https://short.io"])


def test_parent_domains(spark):
    d = spark.createDataFrame([("a.b.example",), ("b.example",), ("c.test",), ("example",)], "domain string")
    lookup = spark.createDataFrame([("b.example", 1), ("a.b.example", 2), ("test", 3)], "domain string, v int")
    assert dict(map(tuple, U.by_parent_domain(d, lookup).collect())) == {"a.b.example": 2, "b.example": 1, "c.test": None, "example": None}


def test_lexicon_traps(spark):
    df = spark.createDataFrame([("Double  space here, don't stop. actual study",), ("whistle-blower",), (None,), ("a a a",)], "text string")
    lex = {"c": ("double space", "don't", "actual_study", "whistle blower", "a", "a")}
    got = [r["c_count"] for r in lexicon.lexicon_scores(df, "text", lex).collect()]
    assert got == [1, 1, 0, 2]
    assert [r["c_count"] for r in lexicon.lexicon_scores(df, "text", lex, underscores=True).collect()] == [2, 1, 0, 2]


def test_keyness_turns_with_the_tables(spark):
    a = spark.createDataFrame([("x", 10), ("y", 5), ("z", 1)], "word string, n long")
    b = spark.createDataFrame([("x", 2), ("y", 5), ("w", 9)], "word string, n long")
    f = {r["word"]: r["g2"] for r in lexicon.keyness(a, b).collect()}
    g = {r["word"]: r["g2"] for r in lexicon.keyness(b, a).collect()}
    assert all(f[w] == pytest.approx(-g[w]) for w in f)
    same = lexicon.keyness(a, a).collect()
    assert all(r["g2"] == 0.0 for r in same)


def test_attribution_shapes():
    def of(s, e, others=()):
        i = s.index(e)
        return spans.attribution(s, i, i + len(e), others)

    assert of("according to Baba, it was closed", "Baba") == ("before", "high")
    assert of("Baba said it was closed", "Baba") == ("after", "high")
    assert of("Baba created the map and then said so", "Baba") == ("after", "low")
    assert of("according to Hoka, Baba knew", "Baba", ["Hoka"]) == ("before", "low")
    assert of("Baba is a noted historian", "Baba")[0] == "standing" or of("Baba is a noted historian", "Baba")[0] == "after"
    assert of("I saw Baba", "Baba") == ("none", "none")


def test_quoted_lines_and_link_dumps(spark):
    t = "> Baba is here\nBaba https://a.example/1 https://b.example/2"
    df = spark.createDataFrame([(1, t), (2, "&gt; Baba only quoted"), (3, None)], "id long, text string")
    rows = spans.mentions(df, "id", "text", {"baba": ["Baba"]}).collect()
    assert [(r["key"], r["n"], r["is_list_dump"]) for r in rows] == [(1, 1, True)]


def test_text_functions(spark):
    row = spark.createDataFrame([("By Dr. Jane Doe, PhD | Staff", "The New-York Times!", "J. K. Row", "https://en.example/wiki/Flat_Earth#x")], "a string, b string, c string, d string")
    got = row.select(T.person_name("a"), T.entity_key("b"), T.initials_only("c"), T.wiki_title("d"), T.acronym("b"), T.stars(F.lit(0.004))).first()
    assert tuple(got) == ("Jane Doe", "newyorktimes", True, "Flat Earth", "TNT", "**")


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 1, 1, 1, 2, 3, 4, None]], "v int")
    got = sorted((r["v"], r["bin"]) for r in relational.quantile_bins(df, "v", 4).collect() if r["v"] is not None)
    assert got[:5] == [(1, 0)] * 5 and got[-1][1] == max(b for _, b in got)


def test_elasticity_without_comments(spark):
    p = spark.createDataFrame([("a", 5, 0, 1), ("b", 6, None, None), ("c", 8, 4, 0)], "id string, score long, num_comments long, num_crossposts long")
    got = {r["id"]: (r["elasticity_ratio"], r["is_crossposted"]) for r in population.elasticity_flags(p, p.limit(0)).collect()}
    assert got == {"a": (5.0, 1), "b": (6.0, 0), "c": (2.0, 0)}


def test_language_is_the_callers():
    own = spans.Language(reporting=("murmur",), accusing=("brew",), harmless={"brew": ("tea",)}, bands=((1, "high"),))
    of = lambda t: spans.attribution(t, 0, 4, language=own)
    assert of("Baba murmured that it rained") == ("after", "high") and of("Baba said that it rained") == ("none", "none")
    assert of("Baba brews tea and murmurs") == ("after", "low") and of("Baba in March murmured") == ("after", "low")
    assert spans.attribution("Baba made a point and said so", 0, 4) == ("after", "medium") and spans.attribution("Baba made a bomb and said so", 0, 4) == ("after", "low")
    assert spans.told_forms("testify") == ("testifies", "testified") and spans.told_forms("cover up") == ("covers up", "covered up")


def test_bots_by_name_and_repeats(spark):
    rows = [("autobahn_fan", f"t{i}") for i in range(3)] + [("news_Bot", "x"), ("AutoModerator", "x"), ("[deleted]", "x"), (None, "x"), ("_bot_x", "x"), ("quiet", None)]
    rows += [("again", f"t{i % 9}") for i in range(20)] + [("wall", "same")] * 20
    got = {r["author"]: (r["is_named_bot"], r["is_likely_bot"], r["is_repeat_poster"], r["dup_ratio"]) for r in population.repeat_posters(spark.createDataFrame(rows, "author string, text string"), "author", "text").collect()}
    assert got == {
        "autobahn_fan": (False, False, False, 1.0),
        "news_Bot": (True, True, False, 1.0),
        "_bot_x": (False, False, False, 1.0),
        "quiet": (False, False, False, None),
        "again": (False, False, True, 2.22),
        "wall": (False, True, False, 20.0),
    }


def test_quantiles_and_ranks_over_ranges(spark):
    rows = [(x,) for x in [5, 1, 1, 1, 9, 3, 3, 7, None, 1, 1, 2]]
    df = spark.createDataFrame(rows, "v int").repartition(3)
    got = relational.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1]).first()["q"]
    want = df.selectExpr("percentile(v, array(0, 0.25, 0.5, 0.9, 1)) as q").first()["q"]
    assert got == pytest.approx(want)
    disc = relational.quantiles(df, "v", [0.33, 0.5, 1], discrete=True).first()["q"]
    assert disc == [df.selectExpr(f"percentile_disc({q}) within group (order by v) as q").first()["q"] for q in (0.33, 0.5, 1)]
    assert {(r["v"], r["r"]) for r in relational.average_ranks(df, "v", "r").collect()} == {(None, None), (1, 3.0), (2, 6.0), (3, 7.5), (5, 9.0), (7, 10.0), (9, 11.0)}
    assert relational.quantiles(df.limit(0), "v", [0.5]).first()["q"] == [None]


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(40)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1.0), ("k3", 2.0), ("other", 3.0)], "k string, x double")
    counts = left.where("k is not null").groupBy("k").count()
    for how in ("inner", "left"):
        got = sorted(map(str, relational.skew_join(left, right, counts, "k", "count", how, heavy_share=10).collect()))
        assert got == sorted(map(str, left.join(right, "k", how).collect()))
