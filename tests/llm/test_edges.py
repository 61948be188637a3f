"""Every operator with nulls, empty and long texts, repeated rows, an empty table, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from presetlake.llm import bpe, compression, langid, licenses, linechunks, packing, quality, sharding, simhash, topk

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Names that the operators use themselves.
EXTRA = ["row", "id", "sig", "lines", "gone", "fp", "slot", "shard", "pack", "bin", "m", "p", "s", "d", "h", "lo", "n", "score", "held_out", "asked", "part", "cluster", "kept_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = "\n".join(f"line number {i} of a very long text" for i in range(30_000))
TEXTS = [(1, "One two three four.\nFive six."), (2, None), (3, ""), (4, "   \n\n "), (5, LONG), (5, LONG), (None, "no id at all"), (None, None), (6, "ünï cødé ✔ 文"), (7, "One two three four.\nFive six.")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None if i in (1, None) else "en", None if i == 3 else "web", 0 if t is None else len(t), *["x"] * len(EXTRA)) for i, t in rows], SCHEMA)


def labels(spark, rows=((1, 1), (5, 0), (6, None), (None, 1), (7, 5))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "packing": packing.pack,
    "simhash": simhash.near_duplicates,
    "lines": lambda d: linechunks.dedup_lines(d).select("row.doc_id", "new_text", "n_lines", "n_removed"),
    "bpe": lambda d: bpe.digests(d, VOCABULARY, public_tokenizers.PATTERN),
    "langid": langid.identify,
    "compression": lambda d: compression.score(d, compression.fit(d, labels(d.sparkSession))),
    "licenses": lambda d: licenses.digest(licenses.scan(d)),
    "quality": lambda d: quality.judge(d.select("doc_id", quality.measures(d).alias("m"))),
    "sharding": lambda d: sharding.place(d, ["a", "b", "c"], 101),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_gets_its_own(spark, name):
    rows = OPERATORS[name](table(spark, TEXTS)).collect()
    docs = sorted(str(r.doc_id) for r in rows if getattr(r, "part", 0) == 0)
    assert docs == sorted(str(i) for i, _ in TEXTS)
    twins = [tuple(r)[1:] for r in rows if r.doc_id == 5]
    if name == "lines":  # repeated rows are repeats too: one keeps its lines
        assert sorted(len(t[0]) for t in twins) == [0, len(LONG)]
    else:
        assert name == "packing" or twins[0] == twins[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("stage", [langid.keep_identified, quality.keep_good, linechunks.remove_lines, simhash.keep_one])
@pytest.mark.parametrize("rows", [TEXTS, []])
def test_stages_keep_the_columns(spark, stage, rows):
    docs = table(spark, rows)
    made = stage(docs)
    assert made.columns == docs.columns and made.count() <= len(rows)


def test_no_labels_give_the_prior(spark):
    docs = table(spark, TEXTS)
    assert {r.score for r in compression.score(docs, compression.fit(docs, labels(spark, []))).collect()} == {0.5}


def test_null_empty_and_wordless(spark):
    row = lambda name, doc: next(r for r in OPERATORS[name](table(spark, TEXTS)).collect() if r.doc_id == doc)
    assert row("simhash", 2).fingerprint == row("simhash", 3).fingerprint == "0" * 16 and row("simhash", 4).component_id == 2
    assert row("bpe", 2).n_tokens == 0 == row("bpe", 3).n_tokens and row("bpe", 4).n_tokens > 0
    assert (row("langid", 2).lang_pred, row("langid", 3).lang_pred, row("langid", 4).score) == ("und", "und", 0.0)
    assert (row("licenses", 2).n_words, row("licenses", 2).first_word, row("licenses", 2).labels) == (0, None, "")
    assert row("quality", 2).base_failed and not row("quality", 3).kept
    assert (row("lines", 2).new_text, row("lines", 2).n_lines, row("lines", 3).new_text, row("lines", 3).n_lines) == (None, 0, "", 1)
    assert row("packing", 2).n_words == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 0.0], 1), (7, [1.0, 0.0], 1), (8, [2.0], 1), (None, [9.0, 9.0], 1), (9, [], 1)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")).collect()
    of = lambda q: [(r.rank, r.vec_id, r.score) for r in sorted(found, key=lambda r: (r.query_id, r.rank)) if r.query_id == q]
    one, half = 1024 * 1024, 512 * 1024
    assert of(0) == [(1, 8, 2 * one), (2, 7, one), (3, 100, half), (4, 100, half), (5, 9, 0)]
    # Each row of an id that repeats asks, and finds its twin.
    assert of(100) == [x for x in [(1, 8, one), (2, 0, half), (3, 7, half), (4, 100, half), (5, 9, 0)] for _ in range(2)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_shipping_leaves_other_columns_alone(spark):
    docs = table(spark, TEXTS)
    made = bpe.decode(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    assert made.columns == [*docs.columns, "ids", "decoded"]
    assert made.where(F.col("decoded") != F.coalesce(F.col("text"), F.lit("")).cast("binary")).count() == 0
