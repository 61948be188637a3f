"""Classifiers learn from texts of any length, and the driver gets a bounded part of them."""

import numpy as np

from presetlake.llm import compression, langid


def words(draw, alphabet, n):
    return " ".join("".join(draw.choice(list(alphabet), 5)) for _ in range(n))


def test_languages_of_long_texts_only(spark):
    draw = np.random.default_rng(0)
    rows = [(i, words(draw, "abcde" if i % 2 else "vwxyz", 34_000), "ab" if i % 2 else "yz") for i in range(8)]
    assert all(len(t) > 200_000 for _, t, _ in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs, held_out=None)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}
    short = spark.createDataFrame([(1, "wxyz zyxw"), (2, "abc cba")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(short, langid.fit(docs, held_out=None)).orderBy("doc_id").collect()] == ["yz", "ab"]


def test_equal_probabilities_take_the_first_language(spark):
    docs = spark.createDataFrame([(i, "one and the same text", lang) for i, lang in enumerate(["b", "a"] * 40)], "doc_id long, text string, lang string")
    model = langid.fit(docs, held_out=None)
    model.weights[:], model.bias[:] = 0, 0
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"a"}


def test_quality_of_long_texts_only(spark):
    draw = np.random.default_rng(1)
    rows = [(i, words(draw, "abcde" if i % 2 else "vwxyz", 34_000)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    model = compression.fit(docs, labels, held_out=None)
    got = compression.score(docs, model).collect()
    assert min(r.score for r in got if r.doc_id % 2) > 0.5 > max(r.score for r in got if not r.doc_id % 2)


def test_labels_of_one_class_give_the_prior(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    scores = {r.score for r in compression.score(docs, compression.fit(docs, labels, held_out=None)).collect()}
    assert len(scores) == 1 and scores.pop() > 0.9
