import gzip
import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import classify as C
from loomline.sources import readers, sinks
from loomline.streaming import micro


def test_jsonl_skips_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "body": "x", "score": 3}\n{broken\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": "2", "author": "u", "extra": [1]}\n')
    df = readers.read_jsonl(spark, f"{tmp_path}/*.jsonl*")
    assert {r["id"]: r["score"] for r in df.collect()} == {"1": 3, "2": None}
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), skip_bad=False).collect()


def test_csv_with_mark_and_decimal_comma(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿Title;SJR\nA;1,5\nB;\n".encode())
    df = readers.read_csv(spark, str(tmp_path / "s.csv"), "title string, sjr string", sep=";")
    assert [tuple(r) for r in df.select("title", readers.decimal_comma(F.col("sjr"))).collect()] == [("A", 1.5), ("B", None)]


def test_markdown_table(spark, tmp_path):
    (tmp_path / "t.md").write_text("# x\n| Url | Tier |\n|---|:--:|\n| a.example | one |\n| b | two | three |\ntext\n| c.example | |\n")
    assert [tuple(r) for r in readers.markdown_rows(spark, str(tmp_path / "t.md"), ["url", "tier"]).collect()] == [("a.example", "one"), ("c.example", "")]


def test_warc_and_posts(spark, tmp_path):
    html = (
        "<html><head><title> T </title></head><div class='post' id='pid12'><b class='author'></b><i class='time'>posted on  Jan, 1</i>"
        "<div class='body'>one<br>two<script>bad()</script></div></div><div class='midAd'><div class='body'>ad</div></div></html>"
    )
    (tmp_path / "m.warc").write_bytes(gzip.compress(b"WARC/1.0\r\na: b\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + html.encode()))
    (tmp_path / "n.warc").write_bytes(gzip.compress(b"only one part"))
    pages = readers.warc_pages(spark, str(tmp_path))
    rows = readers.forum_posts(pages, "path", "html").collect()
    assert [(r["thread_title"], r["post_id"], r["author"], r["raw_timestamp"], r["body"]) for r in rows] == [("T", "12", "unknown", "Jan, 1", "one\ntwo")]


def test_byline_prefers_structured_data(spark):
    ld = '<script type="application/ld+json">{"author": {"@type": "Person", "name": "A B"}}</script>'
    pages = spark.createDataFrame([(1, f'<title>x</title><meta name="author" content="M">{ld}'), (2, '<meta name="author" content="M">'), (3, "<p"), (4, None)], "id long, html string")
    assert {r["key"]: r["author"] for r in readers.byline(pages, "id", "html").collect()} == {1: "A B", 2: "M", 3: None, 4: None}


def test_crawl_catalog_keeps_latest(spark):
    rows = [
        ("http://f/thread12/pg2", 200, "text/html", "20200101", "a", 1, 1),
        ("http://f/thread12/pg2", 200, "text/html", "20210101", "b", 1, 1),
        ("http://f/thread12/pglastpost", 200, "text/html", "2019", "c", 1, 1),
        ("http://f/thread13", 200, "text/html", "2019", "d", 1, 1),
        ("http://f/thread14", 404, "text/html", "2019", "e", 1, 1),
        ("http://f/thread15%20x", 200, "text/html", "2019", "f", 1, 1),
        ("http://f/thread16", 200, "image/png", "2019", "g", 1, 1),
    ]
    df = spark.createDataFrame(rows, "url string, status int, mime string, timestamp string, filename string, offset long, length long")
    got = {(r["thread_id"], r["page_num"], r["filename"]) for r in readers.crawl_catalog(df).collect()}
    assert got == {(12, "2", "b"), (12, "lastpost", "c"), (13, "1", "d")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(9)], "id long, g int, t string")
    sinks.write_parquet(df, str(tmp_path / "p"), by=["g"])
    assert spark.read.parquet(str(tmp_path / "p")).where("g = 1").count() == 3
    calls = []

    def run():
        calls.append(1)
        return df

    for _ in range(2):
        assert sinks.cached_query(spark, str(tmp_path / "c"), run, lambda x: x.where("id > 2")).count() == 6
    assert calls == [1]
    assert sinks.append_new(df.where("id < 5"), str(tmp_path / "a"), "id") == 5
    assert sinks.append_new(df, str(tmp_path / "a"), "id") == 4
    assert sinks.append_new(df, str(tmp_path / "a"), "id") == 0
    m = sinks.merged(df.where("id < 2"), df.withColumn("t", F.lit("new")), ["id"])
    assert m.where("t = 'new'").count() == 7 and m.count() == 9
    sinks.write_nested_json(df.limit(1), str(tmp_path / "j"), "id", ["g", "t"])
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0])["context"].keys() == {"g", "t"}
    assert sum(sinks.shard(df, "id", 3, i).count() for i in range(3)) == 9


def test_stream_scores_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.range(5).write.parquet(src)
    score = lambda d: d.withColumn("s", F.col("id") * 2)
    micro.score_new_files(spark, src, "id long", score, out, ck).awaitTermination()
    spark.range(5, 8).write.mode("append").parquet(src)
    micro.score_new_files(spark, src, "id long", score, out, ck).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_classifier_pieces(spark):
    row = spark.createDataFrame([("evidence, hedge",), ("None of these",), ("",), (None,), ("error: timeout",)], "r string")
    got = [tuple(r) for r in row.select(*C.parsed_labels(F.col("r"), ["evidence", "hedge", "meta"])).collect()]
    assert got == [(1, 1, 0), (0, 0, 0), (None, None, None), (None, None, None), (None, None, None)]
    p = spark.createDataFrame([(True, 0.1), (True, 0.5), (True, 0.9), (False, 0.9), (None, 0.9)], "g boolean, p double")
    assert [r[0] for r in p.select(C.staged(F.col("g"), F.col("p"))).collect()] == ["negative", "borderline", "positive", "auto_negative", "auto_negative"]
    three = p.select(*C.cascade(F.lit(0.2), F.lit(0.75))).first()
    assert sum(three) == pytest.approx(1) and three[0] == pytest.approx(0.6)


def test_classifier_learns(spark):
    rows = [(i, ("quiet archive hidden map " if i % 2 else "sunny garden lovely tea ") * 3, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    k = C.cross_validated(df, "id", "text", "y", 2).collect()
    assert sum(r["n"] for r in k) == 80 and all(r["kappa"] > 0.9 for r in k)
