import re
from collections import Counter, defaultdict

import pytest

from loomline.llm.terms import marked_terms, ngram_counts

SCHEMA = "delivery_no long, text string, term string, n int, n_rows int"


def brute(texts, max_n):
    n, rows = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t.lower()) if t else []
        for k in range(1, max_n + 1):
            for j in range(len(w) - k + 1):
                g = " ".join(w[j : j + k])
                n[g] += 1
                rows[g].add(i)
    return {g: (n[g], len(rows[g])) for g in n}


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_counts_equal_brute_force(spark, max_n, monkeypatch):
    texts = ["a b a b a b", "A-b, a!", "", None, "  ...  ", "x " * 3000, "a b a b a b", "İstanbul Kelvin K 9", "b", "ü a ü b"]
    df = spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["term"]: (r["n"], r["n_rows"]) for r in ngram_counts(df, max_n=max_n).collect()}
    assert got == brute(texts, max_n)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr("loomline.llm.terms.BLOCK", 3)
    texts = ["a b c", "c b a", "a b", "b c"] * 5
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["term"]: (r["n"], r["n_rows"]) for r in ngram_counts(df, max_n=2).collect()} == brute(texts, 2)


def test_marks_at_their_bounds(spark):
    texts = ["all"] * 3 + ["all fifteen"] * 15 + ["all sixteen"] * 16 + ["all two"] * 2 + ["all three"] * 3 + ["all"] * 61
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in enumerate(texts + [None] * 50)], SCHEMA)
    assert len(texts) == 100
    assert {r["term"]: r["mark"] for r in marked_terms(df).collect()} == {"all": "common", "fifteen": None, "sixteen": "common", "two": "rare", "three": None}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_counts(df, max_n=3).count() == 0 and marked_terms(df).count() == 0
    assert ngram_counts(spark.createDataFrame([(1, None, "", 0, 0)], SCHEMA)).count() == 0
