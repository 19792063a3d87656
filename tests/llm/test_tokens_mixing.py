import os
import random

import numpy as np
import pytest

from loomline.llm import mixing as M
from loomline.llm.tokens import VOCABULARY, PrefixEncoder, encode, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_ids_equal_the_public_tokenizer():
    rnd = random.Random(5)
    signs = [lambda: chr(rnd.randint(32, 126)), lambda: chr(rnd.randint(0xA0, 0x24F)), lambda: chr(rnd.randint(0x4E00, 0x4FFF)), lambda: chr(0x1F600 + rnd.randrange(60)), lambda: " ", lambda: "\n"]
    texts = ["".join(rnd.choice(signs)() for _ in range(rnd.randrange(80))) for _ in range(1500)]
    texts += ["", " ", "\n\n  x", "<|endoftext|> is text", "a" * 5000, "it's we'll I'M they'RE", "1234567890" * 40, "​﻿", "ab" * 700 + "c"]
    e = PrefixEncoder()
    assert [e.encode(t) for t in texts] == reference()(texts)


def test_table_of_ids(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "   "), (4, "   "), (None, "x")]
    df = spark.createDataFrame([(*r, [0]) for r in rows], "doc_id long, text string, ids array<int>")
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in encode(df).collect())
    want = reference()([t or "" for _, t in rows])
    assert got == sorted((k or 0, w) for (k, _), w in zip(rows, want, strict=True))
    assert encode(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in token_counts(df.where("doc_id < 4"), ["doc_id"]).orderBy("doc_id").collect()] == [2, 0, 0]


def test_water_filling():
    np.testing.assert_allclose(M.water_fill(np.array([0.5, 0.3, 0.2]), np.array([10, 1000, 1000]), 100), [10, 54, 36])
    np.testing.assert_allclose(M.water_fill(np.array([1, 1, 0]), np.array([5, 7, 100]), 50), [5, 7, 0])
    np.testing.assert_allclose(M.water_fill(np.array([1, 1]), np.array([0, 9]), 4), [0, 4])
    assert M.water_fill(np.array([]), np.array([]), 4).size == 0


DOCS = "doc_id long, text string, source string, n_tokens int"


def test_mixture_shares_caps_and_repeats(spark):
    docs = [(i, "one two three four", "Big-One " if i % 2 else "big_one", 0) for i in range(400)]
    docs += [(1000 + i, "one two three four", "small", 0) for i in range(20)] + [(2000 + i, "one two", "mid", 0) for i in range(200)]
    docs += [(3000, "x", "untargeted", 0), (3001, "x", None, 0), (3002, None, "small", 0), (3003, "", "mid", 0), (3004, "x", "never", 0)]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big_one", 1.0, 1), ("SMALL", 1.0, 3), ("mid", 2.0, 9), ("absent", 5.0, 2), ("never", 0.0, 4), ("bad", None, None)], "source string, target_weight double, max_repeats int")
    records, report = M.mixture(df, targets, budget=1600)
    r = {x["source"]: x for x in report.collect()}
    assert r["small"]["actual_tokens"] == 240 and r["small"]["clamped"] and r["small"]["max_used"] == 3
    # what the capped source leaves goes to the others by their weights 1 to 2
    assert r["mid"]["actual_tokens"] == pytest.approx((1600 - 240) * 2 / 3, abs=3)
    assert r["big_one"]["actual_tokens"] == pytest.approx((1600 - 240) / 3, abs=5)
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1) and max(x["share_error"] for x in r.values()) < 0.005
    assert r["absent"]["actual_tokens"] == r["never"]["actual_tokens"] == 0
    ids = {x["doc_id"]: x["repeats"] for x in records.collect()}
    assert not {3000, 3001, 3004} & set(ids) and all(1 <= v <= 9 for v in ids.values())
    again = {x["doc_id"]: x["repeats"] for x in M.mixture(df.repartition(7), targets, budget=1600)[0].collect()}
    assert ids == again


def test_empty_tables(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([], "source string, target_weight double, max_repeats int")
    some = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 3)], "source string, target_weight double, max_repeats int")
    for d, t in ((docs, targets), (docs, some), (spark.createDataFrame([(1, "x y", "a", 0)], DOCS), targets)):
        records, report = M.mixture(d, t)
        assert records.count() == 0 and report.agg({"actual_tokens": "sum"}).first()[0] in (None, 0)
