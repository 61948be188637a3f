"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all documents that may be learned from; the weights from a bounded sample of them, by
follow-the-regularised-leader with an elastic net; a temperature, fitted on a fifth of the sample that the weights
haven't seen, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import fold, ship

#: Hash buckets of n-grams; n-gram sizes; blocks of labelled text that the weights are fitted on, at most about twice;
#: share of each language in these at least, so that many languages make the sample larger; characters of a block.
BUCKETS, SIZES, SAMPLE, EACH, BLOCK = 1 << 15, (1, 2, 3), 2_000, 8, 8_192
UNKNOWN = "und"
_PIECE = 1 << 18


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), _PIECE):
        part, found = points[at : at + _PIECE + max(SIZES) - 1], []
        for n in SIZES:
            grams = min(_PIECE, len(part) - n + 1)
            if grams > 0:
                h = np.full(grams, n, np.uint64)
                for k in range(n):
                    h = (h ^ part[k : k + grams]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                found.append((h >> np.uint64(17)).astype(np.int64) & (BUCKETS - 1))
        out += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = counts(text)
    at = np.flatnonzero(found)
    x = found[at] * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, mostly zeros
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*_vector(text, self.idf)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases; rows are bucket indexes, values and the label's index. The bias is an input of 1."""
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))

    def weights(at) -> np.ndarray:
        short = np.maximum(np.abs(z[at]) - l1, 0)
        return -np.sign(z[at]) * short / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1].astype(np.float32), w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one of a fixed grid with the least log loss."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each bucket and the number of documents, over all rows of ``learn``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total += counts(text) > 0
                rows += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], rows)})

    # One row for each bucket at most reaches the driver.
    found = learn.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    idf, rows = np.zeros(BUCKETS, np.int64), int(found.loc[found["bucket"] == -1, "n"].sum())
    found = found[found["bucket"] >= 0]
    idf[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return idf, rows


def fit(docs: DataFrame, sample: int = SAMPLE, held_out: tuple[int, int] | None = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with text and language whose fold (crc32 of the id) isn't the one held out.

    All languages are learned; each costs the driver 0.5 MB while the weights are fitted. Each gives about an equal share
    of the sample, and one block at least: texts of any length are cut into blocks of ``BLOCK`` to twice as many
    characters, of which a hash draws some, so the driver gets ``2 * sample`` blocks at most.
    Without any such row the model has no language and predicts ``und``.
    """
    ship(docs.sparkSession)
    learn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    if held_out:
        learn = learn.where(fold("id", held_out[0]) != held_out[1])
    blocks = F.expr(f"greatest(1, length(text) div {BLOCK})")
    places = F.expr(f"transform(sequence(0L, greatest(1, length(text) div {BLOCK}) - 1), k -> struct(k, pmod(xxhash64(id, sig, k), {1 << 20}) as place))")
    placed = learn.withColumn("sig", F.xxhash64("text")).withColumn("blocks", places)
    seen = placed.groupBy("lang").agg(F.sum(blocks).alias("n"), F.min(F.expr("array_min(transform(blocks, b -> b.place))")).alias("least")).collect()
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    sample = max(sample, EACH * len(languages))
    documents, rows = _frequencies(learn)
    idf = np.log((1 + rows) / (1 + documents)) + 1
    share = F.create_map(*(F.lit(v) for r in seen for v in (r["lang"], max(min(1.0, sample / len(seen) / r["n"]) * (1 << 20), r["least"] + 1.0))))
    drawn = placed.withColumn("share", share[F.col("lang")]).select("lang", "id", "sig", "text", F.explode(F.expr("filter(blocks, b -> b.place < share)")).alias("b"))
    whole = f"substring(text, cast(b.k * {BLOCK} as int) + 1, if(b.k = greatest(1, length(text) div {BLOCK}) - 1, {2 * BLOCK}, {BLOCK}))"
    picked = drawn.select("lang", F.expr(whole).alias("text"), "id", "sig", "b.k").orderBy(F.xxhash64(F.lit("order"), "id", "sig", "k"), "id", "sig", "k", "lang").limit(2 * sample).select("text", "lang").toPandas()
    index = {lang: i for i, lang in enumerate(languages)}
    vectors = [(*_vector(t, idf), index[lang]) for t, lang in zip(picked["text"], picked["lang"])]
    few = len(vectors) < 50
    learned = {y for i, (*_, y) in enumerate(vectors) if few or i % 5}
    apart = vectors if few else [v for v in vectors[::5] if v[2] in learned] or vectors
    weights, bias = ftrl([v for i, v in enumerate(vectors) if few or i % 5 or v[2] not in learned], len(languages))
    model = Model(languages, idf, weights, bias)
    model.temperature = temperature(np.array([model.logits(at, x) for at, x, _ in apart]), np.array([y for *_, y in apart]))
    return model


def predictions(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column of structs ``lang_pred, score``, from the text alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(F.col(text_col))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row.

    Null texts and texts without a letter, the empty one too, are ``und`` with score 0. Repeated rows and null ids each
    give their own row (a null id is in fold 0); of equal probabilities the first language in order wins. Other columns
    are left out.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, 4) == 2).alias("held_out"), predictions(docs, model, text_col).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a probability of ``least`` or more; all rows, if no row has a language."""
    model = fit(docs)
    if not model.languages:
        return docs
    p = docs.select(F.struct("*").alias("row"), predictions(docs, model).alias("p"))
    return p.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
