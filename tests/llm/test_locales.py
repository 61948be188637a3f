"""More languages than the 256 that were learned at first."""

from presetlake.llm import langid


def test_every_language_is_learned(spark):
    rows = []
    for k in range(300):
        word = "".join(chr(0x4E00 + 7 * k + j) for j in range(6))
        rows += [(f"{word} {word}", f"l{k:03d}")] * (1 if k == 299 else 4)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, held_out=None)
    assert len(model.languages) == 300
    got = langid.identify(docs, model).join(docs, "doc_id").collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)
