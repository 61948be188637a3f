"""Packs of repeated ids."""

from collections import Counter

from presetlake.llm import packing


def test_a_repeated_id_is_spread_over_the_packs(spark):
    rows = [(-7 if i % 3 == 0 else i, "a few words", "web") for i in range(1_200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows=100).collect()
    packs = Counter(r.bin >> 32 for r in got)
    assert len(got) == 1_200 and sum(r.doc_id == -7 for r in got) == 400
    assert max(packs.values()) < 200 and len({r.bin >> 32 for r in got if r.doc_id == -7}) == 12
    assert len({r.bin for r in got}) == 1_200  # one cluster, so no two share a bin
