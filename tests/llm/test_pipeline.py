"""Stages of the pipeline, each against a plain version on its own input, and the registered queries."""

import os
import re
from itertools import combinations

import pytest

import __spark_entry__
import corpus_pipeline
from presetlake.llm import langid, quality, simhash
from tests.llm.test_operators import plain_components, plain_line_dedup, plain_stats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_dedup", "packing"]
    held = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        held.append((name, docs, made := spark.read.parquet(path)))
        docs = made
    for _, _, made in held[:-1]:
        assert made.columns == columns
    (_, first, known), (_, _, good), (_, _, edited), (_, _, apart), (_, _, packed) = held
    predicted = {r.doc_id: r for r in langid.identify(first).collect()}
    assert set(rows(known)) == {d for d, r in predicted.items() if r.lang_pred != "und" and r.score >= 0.5}
    judged = {r.doc_id: r.kept for r in quality.judge(known.select("doc_id", quality.measures(known).alias("m"))).collect()}
    assert set(rows(good)) == {d for d, kept in judged.items() if kept}
    assert all(plain_stats(r.text)[0] >= 50 for r in rows(good).values())
    want = plain_line_dedup({d: r.text for d, r in rows(good).items()})
    assert {d: r.text for d, r in rows(edited).items()} == {d: text for d, (text, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows(edited).values())
    prints = {d: simhash.wide_fingerprint(r.text) for d, r in rows(edited).items()}
    near = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[a], prints[b])) <= simhash.WIDE
    component = plain_components([(a, b) for a, b in combinations(sorted(prints), 2) if near(a, b)], sorted(prints))
    assert set(rows(apart)) == set(component.values())
    assert all(r == rows(edited)[d] for d, r in rows(apart).items())
    sizes: dict[int, int] = {}
    for r in packed.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_words
    assert sizes == {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in rows(apart).items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "part", "n_words").collect())) == sorted(map(tuple, packed.select("doc_id", "part", "n_words").collect()))


def test_ten_operators_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
    assert {"op3_line_dedup", "op9_exact_top_k", "op10_sharding"} <= set(__spark_entry__.oracle_sql())
