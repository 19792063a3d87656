import random

import numpy as np
import pytest

from loomline.llm import abuse as A

DOC = "doc_id long, text string, source string, lang string, categories int"
LABEL = "doc_id long, label string, rater string, text string"
PLAIN = ["the archive has the report", "nobody read the budget", "they moved the box in spring", "look at the second map", "what an odd summary"]
BAD = {"abusive": "you are a worthless dumbwit", "hateful": "zorgs are vermin and must leave", "sexual": "show me your naked frobs"}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        parts = rnd.sample(PLAIN, 3)
        kind = rnd.choice([None, None, *BAD])
        if kind:
            parts.insert(rnd.randrange(4), BAD[kind])
        docs.append((i, ". ".join(parts) + ".", rnd.choice(["a-b", "A_B ", "c"]), rnd.choice(["en", "EN ", None]), 0))
        labels.append((i, kind or "none", "r", "clash"))
    return docs, labels


def test_veiled_spelling_is_undone():
    assert A.sentences("F i c k e n gu​euuuule! Ｗｉｄｅ") == [["ficken", "gueule"], ["wide"]]
    lex = A.Lexicon({"dumbwit": 3.0, "frobs": 2.0, "escoria": 2.0})
    assert [lex.plain(w) for w in ("dumbwit", "d*mbwit", "fr0bs", "3$c0r14", "d*****t", "f@obs", "plain", "2012")] == ["dumbwit", "dumbwit", "frobs", "escoria", "dumbwit", "frobs", "plain", "2012"]


def test_held_out_accuracy_and_veils(spark):
    docs, labels = corpus(600)
    df, lb = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels[:400], LABEL)
    truth = {i: {k} - {"none"} for i, k, _, _ in labels}
    extra = [(9000, "so you are a worth​less d*mbwit. ok", None, "xx", 0), (9001, None, "c", None, 0), (9002, "", "c", "en", 0), (9003, "👍", "c", "en", 0)]
    scored = {r["doc_id"]: r for r in A.score(df.union(spark.createDataFrame(extra, DOC)), lb).collect()}
    held = [i for i in range(400, 600)]
    right = sum(set(scored[i]["categories"]) == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert list(scored[9000]["categories"]) == ["abusive"]
    assert all(list(scored[i]["categories"]) == [] and scored[i]["abusive"] == 0 for i in (9001, 9002, 9003))
    rates = {r["source"]: r for r in A.rates(A.score(df, lb)).collect()}
    assert set(rates) == {"a_b", "c"} and sum(r["n_docs"] for r in rates.values()) == 600


def test_without_labels_nothing_passes(spark):
    docs, labels = corpus(20)
    df = spark.createDataFrame(docs, DOC)
    none = spark.createDataFrame([], LABEL)
    assert all(list(r["categories"]) == [] for r in A.score(df, none).collect())
    only = spark.createDataFrame([(i, "none", "r", "") for i in range(10)] + [(None, "abusive", "r", ""), (1, None, "r", "")], LABEL)
    assert all(list(r["categories"]) == [] for r in A.score(df, only).collect())
    assert A.score(df.limit(0), none).count() == 0


def test_long_text_is_scored_whole():
    docs, labels = corpus(300)
    m = A.fit([d[1] for d in docs], [[x[1]] for x in labels], ["en"] * 300)
    filler = " ".join(PLAIN * 400)
    low, high = m.scores([filler, f"{filler} {BAD['hateful']} {filler}"])[:, 1]
    assert high > 0.5 > low


def test_thresholds_follow_the_scores():
    p, y, w = np.array([0.9, 0.8, 0.7, 0.2, 0.1] * 30), np.array([1, 1, 1, 0, 0] * 30, np.float32), np.ones(150, np.float32)
    assert 0.2 < A._best_threshold(p, y, w) < 0.7
    assert A._best_threshold(p, y * 0, w) == pytest.approx(0.5)


def test_same_sample_same_model():
    docs, labels = corpus(120)
    a, b = (A.fit([d[1] for d in docs], [[x[1]] for x in labels], ["en"] * 120) for _ in range(2))
    np.testing.assert_array_equal(a.scores([docs[3][1]]), b.scores([docs[3][1]]))
