from loomline.operators import references as R

REF = "row long, ref string, t long, key string, reason string"


def setup(spark, refs, posts=(), comments=(), removals=()):
    p = spark.createDataFrame(list(posts), "id string, seen long, key string")
    c = spark.createDataFrame(list(comments), "id string, seen long, present int")
    n = spark.createDataFrame(list(removals), "fullname string, removed_utc long, reason string")
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REF)
    facts = R.target_facts([(p, "id", "seen", "t3"), (c, "id", "seen", "t1")], n)
    return R.references([R.Referrer("x", r, "row", "ref", "t", "t3")]), facts


def test_reasons_spellings_and_precedence(spark):
    refs = [
        (1, "t3_aa", 100),  # sound
        (2, " T3_BB ", 100),  # missing
        (3, "cc", 100),  # late
        (4, "dd", 100),  # deleted at the very time
        (5, "dd", 99),  # before its removal, and there
        (6, "t1_k1", 100),  # a comment is no post: missing
        (7, None, 100),
        (8, "", 100),
        (9, "t3_", 100),
        (10, "gone", 100),  # in no table, but removed: deleted
        (11, "gone", 10),  # not removed yet: missing
        (12, "cc", None),  # a row without a time cannot be late
        (13, "bb", None),
    ]
    posts = [("AA", 50, "z"), ("aa", 70, "z"), ("cc", 101, "z"), ("t3_dd", 1, "z"), (None, 5, "z")]
    r, f = setup(spark, refs, posts, [("k1", 1, 0)], [("t3_dd", 100, None), ("t3_dd", 300, "x"), ("t3_gone", 50, None), ("t1_k1", 999, None)])
    got = {x["src_row"]: x["reason"] for x in R.orphans(r, f).collect()}
    assert got == {2: "missing", 3: "late", 4: "deleted", 6: "missing", 10: "deleted", 11: "missing", 13: "missing"}


def test_heavy_and_light_keys_agree(spark):
    refs = [(i, "hot" if i % 3 else f"k{i % 40}", i) for i in range(600)]
    posts = [(f"k{i}", i * 10, "") for i in range(0, 40, 2)] + [("hot", 250, "")]
    r, f = setup(spark, refs, posts, (), [("t3_hot", 400, None), ("t3_k4", 100, None)])
    one = sorted(map(tuple, R.orphans(r, f, heavy_share=1).collect()))
    many = sorted(map(tuple, R.orphans(r, f, heavy_share=10**6).collect()))
    assert one == many and one
    n = {}
    for x in one:
        n[x[0], x[3], x[2]] = n.get((x[0], x[3], x[2]), 0) + 1
    assert {(x["src_table"], x["reason"], x["period"]): x["n"] for x in R.orphan_report(r, f).collect()} == n


def test_report_months_and_repeated_rows(spark):
    jan, feb = 1_326_000_000, 1_329_000_000
    r, f = setup(spark, [(1, "q", jan), (1, "q", jan), (2, "q", feb), (3, "w", feb)], [("w", 5, "")])
    got = {(x["reason"], x["period"]): x["n"] for x in R.orphan_report(r, f).collect()}
    assert got == {("missing", "2012-01"): 2, ("missing", "2012-02"): 1}


def test_empty_tables(spark):
    r, f = setup(spark, [])
    assert R.orphans(r, f).count() == 0 and R.orphan_report(r, f).count() == 0
    r, f = setup(spark, [(1, "a", 1)])
    assert [x["reason"] for x in R.orphans(r, f).collect()] == ["missing"]


def test_rows_of_a_hot_key_are_not_shuffled(spark):
    refs = [(i, "hot" if i % 3 == 0 else f"k{i}", i) for i in range(6000)]
    posts = [(f"k{i}", i + i % 7, "") for i in range(6000)] + [("hot", 2500, "")]
    r, f = setup(spark, refs, posts, (), [("t3_hot", 4000, None)])
    judged = R._judged_groups(r, f, 1000)
    assert [x["key"] for x in judged.heavy.collect()] == ["t3_hot"]
    hot, rest = R._rows_of_heavy(r, judged), R._rows_of_rest(r, judged, "reason is not null or cut")
    assert "Exchange hashpartitioning" not in hot._jdf.queryExecution().executedPlan().toString()
    got = {x["src_row"]: x["reason"] for x in hot.collect()}
    assert got == {i: "late" if i < 2500 else "deleted" for i in range(0, 6000, 3) if i < 2500 or i >= 4000}
    assert {x["src_row"] for x in rest.collect()} == {i for i in range(6000) if i % 3 and i % 7}
