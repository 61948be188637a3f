"""Quality classifier by compression.

One zstandard dictionary is built from good and one from bad labelled text. A text, in blocks so that no block can lean
on the text before it, is compressed with either; the difference of the sizes over the text's bytes, through a logistic
curve fitted on labelled rows that the dictionaries haven't seen, is the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import discard, fold, ship, store

#: Labelled rows of each class that are drawn, about, and blocks of their text that a dictionary is built from, at most;
#: bytes of a dictionary and of a block; the level.
SAMPLE, BLOCKS, DICTIONARY, BLOCK, LEVEL = 3_000, 6_000, 32_768, 1_024, 3
THRESHOLD = 0.3


def _blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """Trained where there is enough text, else the text itself."""
    samples = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.sizes = model, [self._size(d) for d in (model.good, model.bad)]

    @staticmethod
    def _size(data: bytes):
        kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        shared = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        return lambda blocks: sum(len(press(b)) for b in blocks)

    def difference(self, text: str) -> float:
        """(size with the bad dictionary - size with the good one) / bytes; 0 for the empty text."""
        blocks = _blocks(text)
        n = sum(map(len, blocks))
        good, bad = (size(blocks) for size in self.sizes)
        return (bad - good) / n if n else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.slope * self.difference(text or "") + self.model.offset))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge on standardised input."""
    scale = max(float(x.std()), 1e-9)
    design, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = np.clip(w + np.clip(np.linalg.solve(curve, gradient), -5, 5), -50, 50)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: tuple[int, int] | None = (5, 0), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows whose fold (crc32 of the id) isn't the one held out.

    About ``sample`` rows of each class are picked by a hash, of any length: two thirds for the dictionaries, the rest,
    weighted by the classes' true shares, for the curve. The driver gets ``BLOCKS`` blocks of ``BLOCK`` characters of each
    class at most, and one number for each row of the curve. Labels other than 0 and 1 and null ids or texts teach
    nothing. Without labels every score is the prior, or 0.5.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held_out:
        known = known.where(fold("id", held_out[0]) != held_out[1])
    seen = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not seen:
        return Model()
    prior = (seen.get(1, 0) + 1) / (sum(seen.values()) + 2)
    share = F.create_map(*(F.lit(v) for y, n in seen.items() for v in (y, min(1.0, sample / n))))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("y")] * F.lit(1 << 20)).orderBy(F.xxhash64("id"), "y").limit(4 * sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    # The drawn rows are 4 * sample at most; few rows of a class serve for both.
    few = [y for y in (0, 1) if seen.get(y, 0) < 6]
    third = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(3)) == 0
    rows = store(texts.join(F.broadcast(drawn), "id").select("id", "text", "y", (third | F.col("y").isin(few)).alias("curve"), (~third | F.col("y").isin(few)).alias("build")))
    blocks = rows.where("build").select("y", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block"))
    order = [F.xxhash64("block"), "block"]
    taken = {y: [r["block"] for r in blocks.where(F.col("y") == y).orderBy(*order).limit(BLOCKS).select("block").collect()] for y in (1, 0)}
    model = Model(*(dictionary(taken[y]) if taken[y] else b"" for y in (1, 0)), 0.0, math.log(prior / (1 - prior)))
    if not (model.good and model.bad):
        discard(rows)
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def difference(column: pd.Series) -> pd.Series:
        scorer = Scorer(shared.value)
        return pd.Series([scorer.difference(t) for t in column], dtype="float64")

    curve = rows.where("curve").select("y", difference("text").alias("x")).orderBy("y", "x").limit(4 * sample).toPandas()
    discard(rows)
    x, y = curve["x"].to_numpy(float), curve["y"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * len(y)
    model.slope, model.offset = logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, from the whole text alone.

    Null and empty texts get the curve's value at difference 0. Repeated rows and null ids each give their own row (a
    null id is in fold 0, so held out); other columns are left out.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = Scorer(shared.value)
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    scored = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, 5) == 0).alias("held_out"), run(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
