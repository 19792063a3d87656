import pyspark.sql.functions as F
import pytest

from loomline.operators import lookups as K
from loomline.operators import relational as R
from loomline.operators import topics


def test_earlier_list_wins(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "k string, v int")
    b = spark.createDataFrame([("y", 5), ("z", 6), ("z", 7)], "k string, v int")
    assert sorted(map(tuple, K.by_priority([a, b], ["k"]).collect())) == [("x", 1), ("y", None), ("z", 6)]


def test_cascade_does_not_multiply(spark):
    d = spark.createDataFrame([("x",), ("y",), (None,), ("q",)], "name string")
    one, two = (spark.createDataFrame([(v,) for v in vs], "name string") for vs in (["x", "x"], ["x", "y", None]))
    got = {r["name"]: r["matched"] for r in K.cascade(d, "name", [("one", one), ("two", two)]).collect()}
    assert got == {"x": "one", "y": "two", None: "none", "q": "none"}


def test_quota_and_short_strata(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, v int")
    got = K.quota_per_value(d, "v", {0: 2, 1: 50}, [F.col("id")], 1).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {0: 2, 1: 10, 2: 1}


def test_shares_add_up_and_ties_are_settled(spark):
    d = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "q"), ("b", None), ("c", None)], "k string, v string")
    assert sorted(map(tuple, R.most_frequent(d, ["k"], "v").collect())) == [("a", "p", 1), ("b", "q", 1)]
    n = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert R.shares(n, "n").agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_samples_do_not_depend_on_partitions(spark):
    d = spark.range(500).withColumn("s", F.col("id") % 4)
    one = {r["id"] for r in R.hashed_sample(d.repartition(3), "id", 40, 5).collect()}
    assert one == {r["id"] for r in R.hashed_sample(d.repartition(9), "id", 40, 5).collect()} and len(one) == 40
    s = R.stratified_sample(d, ["s"], "id", 7, 1)
    assert {r["s"]: r["count"] for r in s.groupBy("s").count().collect()} == dict.fromkeys(range(4), 7)


def test_topics_with_null_and_far_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 1), (3, None, None), (4, [-1.0, -1.0], None), (5, [0.0, 0.0], None)], "id long, v array<double>, label int")
    c = topics.centroids(d, "label", "v")
    got = {r["key"]: r["topic"] for r in topics.nearest_centroid(d, "id", "v", c, "label").collect()}
    assert got == {1: 0, 2: 1, 3: -1, 4: -1, 5: -1}
    own = spark.createDataFrame([(1, 4), (2, -1), (3, -1)], "t long, topic long")
    threads = spark.createDataFrame([(2, 9)], "t long, topic long")
    assert {r["t"]: r["topic"] for r in topics.with_fallback(own, threads, "t").collect()} == {1: 4, 2: 9, 3: -1}
    assert topics.nearest_centroid(d, "id", "v", c.limit(0), "label").where("topic = -1").count() == 5


def test_containments(spark):
    rows = spark.createDataFrame([(1, "The Hum of Norda"), (2, "nothing"), (3, None), (4, ""), (5, "ab"), (1, "The Hum of Norda")], "k long, t string")
    names = spark.createDataFrame([("hum",), ("NORDA",), ("ab",), ("a",), ("",), (None,), ("hum",), ("of norda x",)], "name string")
    got = sorted(map(tuple, K.containments(rows, "k", "t", names, "name").collect()))
    want = sorted({(k, n) for k, t in ((1, "the hum of norda"), (2, "nothing"), (5, "ab")) for n in ("hum", "NORDA", "ab", "a") if n.lower() in t})
    assert got == want and K.containments(rows.limit(0), "k", "t", names, "name").count() == 0


def _wide(spark, path):
    """Two tables whose files let Spark expect less of the texts than of the names."""
    pad = [F.lit("x").alias(f"c{i}") for i in range(30)]
    spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("https://www.site"), F.col("id") % 90, F.lit(".example.org/"), F.md5(F.col("id").cast("string"))).alias("t"), *pad).write.parquet(f"{path}/t")
    spark.range(3000).select(F.concat(F.lit("www.Site"), "id", F.lit(".example.org")).alias("name")).write.parquet(f"{path}/n")
    return spark.read.parquet(f"{path}/t"), spark.read.parquet(f"{path}/n")


def test_runs_of_texts_are_never_broadcast(spark, tmp_path):
    rows, names = _wide(spark, tmp_path)
    want = sorted((i, f"www.Site{i % 90}.example.org") for i in range(400))
    for at_hand, join in ((64 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        got = K.containments(rows, "k", "t", names, "name", at_hand=at_hand)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "BuildLeft" not in plan and ("Broadcast" in plan) == (at_hand > 0)
        assert sorted(map(tuple, got.collect())) == want


def test_names_that_begin_alike_meet_few_texts(spark, tmp_path, monkeypatch):
    rows, names = _wide(spark, tmp_path)
    monkeypatch.setattr(F, "contains", lambda a, b: F.lit(True))  # so that all pairs that are compared come out
    assert K.containments(rows, "k", "t", names, "name").count() < 400 * 3000 / 20


@pytest.mark.parametrize("at_hand", [0, 64 << 20])
def test_containments_of_any_length(spark, at_hand):
    base = "".join(chr(97 + i * i % 26) + ("é" if i % 7 == 0 else "😀" if i % 11 == 0 else "Ab\n."[i % 4]) for i in range(150))
    texts = [(i, t) for i, t in enumerate([base, base[::-1], base[5:], "x" + base[:40], "😀", "😀é", "a", "", None, "?😀 ?", base.upper()])]
    names = [base[s : s + n] for n in (1, 2, 3, 4, 11, 12, 13, 47, 48, 49, 191, 192, 193, 299) for s in (0, 1, 6, 100)] + ["?", "😀", "", None, "no such name"]
    rows, own = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(map(tuple, K.containments(rows, "k", "t", own, "name", at_hand=at_hand).collect()))
    assert got == sorted({(k, n) for k, t in texts if t for n in names if n and n.lower() in t.lower()})
    assert K.containments(rows, "k", "t", own.limit(0), "name", at_hand=at_hand).collect() == []
