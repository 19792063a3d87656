import numpy as np

from loomline.llm import abuse as A
from tests.llm.test_abuse import DOC, LABEL, corpus


def test_words_hardly_met_in_the_sample_stay_apart():
    docs, labels = corpus(120)
    m = A.fit([d[1] for d in docs] + ["a grumpfish"], [[x[1]] for x in labels] + [["none"]], ["en"] * 121)
    assert m.encode("grumpfish snarkwit archive") == [[A.bucket(w) for w in ("grumpfish", "snarkwit", "archive")]]


def test_only_labelled_rows_train(spark):
    docs, labels = corpus(160)
    df, lb = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels[:120], LABEL)
    a, b = A.fit_labels(df, lb), A.fit_labels(df.where("doc_id < 120"), lb)
    np.testing.assert_array_equal(a.embed, b.embed)
    assert a.thresholds == b.thresholds


def test_every_language_has_its_own_thresholds():
    docs, labels = corpus(300)
    langs = ["en", "de", "fr", "", "en"] * 60
    m = A.fit([d[1] for d in docs], [[x[1]] for x in labels], langs)
    assert set(m.thresholds) == {"", "en", "de", "fr"}
    p, y, w = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 0, 0], np.float32), np.ones(5, np.float32)
    few, many = (A._best_threshold(np.tile(p, k), np.tile(y, k), np.tile(w, k), 0.3) for k in (1, 200))
    assert 0.3 < few < 0.32 and many > 0.5 and A._best_threshold(p, y * 0, w, 0.3) == 0.3
