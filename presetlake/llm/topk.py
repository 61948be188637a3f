"""Exact top-k inner products over norm-sorted vectors.

Vectors are floored to integers, ordered by descending length and packed into blocks. In the frame of the singular
vectors of a bounded sample, the first ``HEAD`` coordinates give a partial sum, and Cauchy-Schwarz on the lengths of the
rest an upper bound; what can't reach a query's k-th best score so far is pruned, and only survivors are scored, in
integers. Each query first sees the longest vectors of all, which sets its threshold; whole blocks whose longest vector
can't reach it are pruned before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presetlake.llm.common import ship, store

SCALE, K, HEAD = 1024, 10, 16
#: Vectors of a block, of a step within it, and queries of a block; vectors that the rotation is fitted on.
BLOCK, STEP, QUERIES, SAMPLE = 8_192, 1_024, 256, 4_096
#: Blocks whose greatest length is known to all, at most; query blocks that meet a block together.
KNOWN, TOGETHER = 4_096, 16


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64)).astype(np.int64)
    return out


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix of the right singular vectors, by descending singular value."""
    if not len(sample):
        return np.eye(sample.shape[1])
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


class Block:
    """Vectors in descending length, with their row numbers, rotated heads and the lengths of the rest."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        turned = vectors @ turn
        head = min(HEAD, vectors.shape[1])
        self.head, self.rest = turned[:, :head], np.sqrt(np.square(turned[:, head:]).sum(1))
        self.length = np.sqrt(np.square(vectors.astype(np.float64)).sum(1))

    def part(self, chosen) -> Block:
        out = object.__new__(Block)
        for name, value in vars(self).items():
            setattr(out, name, value[chosen])
        return out


def _slack(reach: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound."""
    return 1e-6 * reach + 1


def search(queries: Block, floor: np.ndarray, block: Block, k: int = K) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """``(row, query_id, vec_id, score)`` of each query's k best here that may still be among its k best of all, and its new threshold.

    ``floor`` is the k-th best score that a query has seen, or the smallest integer.
    """
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.ids]
    floor = floor.copy()
    # Products of integers are exact in floating point as long as no sum can leave 53 bits.
    exact = len(block.length) == 0 or float(block.length.max()) * float(queries.length.max()) < 2**52
    floats = block.vectors.astype(np.float64) if exact else None
    for at in range(0, len(block.ids), STEP):
        end = at + STEP
        reach = queries.length * block.length[at:end].max()
        slack = _slack(reach)
        live = np.flatnonzero(reach + slack >= floor)
        if not len(live):
            break
        bound = queries.head[live] @ block.head[at:end].T + np.outer(queries.rest[live], block.rest[at:end])
        fits = bound + slack[live, None] >= floor[live, None]
        for row, q in enumerate(live):
            chosen = at + np.flatnonzero(fits[row])
            chosen = chosen[block.rows[chosen] != queries.rows[q]]
            if not len(chosen):
                continue
            scores = (floats[chosen] @ queries.vectors[q].astype(np.float64)).astype(np.int64) if exact else block.vectors[chosen] @ queries.vectors[q]
            ids, held = np.concatenate([best[q][0], block.ids[chosen]]), np.concatenate([best[q][1], scores])
            order = np.lexsort((ids, -held))[:k]
            best[q] = ids[order], held[order]
            if len(order) == k:
                floor[q] = max(floor[q], best[q][1][-1])
    return [(int(queries.rows[q]), int(queries.ids[q]), int(i), int(s)) for q, (ids, scores) in enumerate(best) for i, s in zip(ids, scores) if s >= floor[q]], floor


_LEAST = np.iinfo(np.int64).min


def reach_needed(queries: Block, floor: np.ndarray) -> float:
    """The least length of a vector that may reach the threshold of one of the queries; with no length no query reaches one over 0."""
    if (floor == _LEAST).any():
        return -np.inf
    need = np.where(floor > 0, (floor - 2) / np.maximum(queries.length * (1 + 2e-6), 1e-300), -np.inf)
    return float(need.min(initial=np.inf))


def _bytes(vectors: np.ndarray) -> bytes:
    return vectors.astype(np.int32 if np.abs(vectors).max(initial=0) < 2**31 else np.int64).tobytes()


def _vectors(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int64 if len(data) == 8 * rows * dims else np.int32).reshape(rows, dims).astype(np.int64)


def _packed(dims: int):
    """One row for each partition: ids and vectors, longest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, at = [], [], None
        for batch in batches:
            if len(batch):
                at = int(batch["part"].iloc[0])
                ids.append(batch["vec_id"].to_numpy(np.int64))
                parts.append(_matrix(batch["embedding"], dims))
        if ids:
            ids, vectors = np.concatenate(ids), np.concatenate(parts)
            square = np.square(vectors.astype(np.float64)).sum(1)
            order = np.lexsort((ids, -square))
            yield pd.DataFrame({"block": [at], "longest": [float(np.sqrt(square.max()))], "ids": [ids[order].tobytes()], "vectors": [_bytes(vectors[order])]})

    return run


def _opened(turn: np.ndarray, number: int, ids: bytes, vectors: bytes) -> Block:
    """A row's number is its block's, and its place there."""
    held = np.frombuffer(ids, np.int64)
    return Block((int(number) << 32) + np.arange(len(held)), held, _vectors(vectors, len(held), len(turn)), turn)


_FOUND = "rows array<struct<row:long,query_id:long,vec_id:long,score:long>>"
_ASKS = "q_block long, at binary, ids binary, vectors binary, floor binary, need double, " + _FOUND


def _structs(rows: list[tuple[int, int, int, int]]) -> list[dict]:
    return [dict(zip(("row", "query_id", "vec_id", "score"), r)) for r in rows]


def _asking(shared, every: int, k: int):
    """The queries of each block, in blocks of their own, after a search of the longest vectors of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, seed, _ = shared.value
        longest = _opened(turn, *seed)
        for batch in batches:
            for x in batch.itertuples():
                asked = np.flatnonzero(np.frombuffer(x.ids, np.int64) % every == 0)
                whole = _opened(turn, x.block, x.ids, x.vectors) if len(asked) else None
                for n, at in enumerate(range(0, len(asked), QUERIES)):
                    queries = whole.part(asked[at : at + QUERIES])
                    rows, floor = search(queries, np.full(len(queries.ids), _LEAST), longest, k)
                    yield pd.DataFrame({"q_block": [(x.block << 20) + n], "at": [queries.rows.tobytes()], "ids": [queries.ids.tobytes()], "vectors": [_bytes(queries.vectors)], "floor": [floor.tobytes()], "need": [reach_needed(queries, floor)], "rows": [_structs(rows)]})

    return run


def _searched(shared, k: int):
    """A block and the query blocks that it may hold something for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, seed, first = shared.value
        for batch in batches:
            for x in batch.itertuples():
                block = _opened(turn, x.block, x.ids, x.vectors)
                if x.block == first:
                    block = block.part(slice(len(seed[1]) // 8, None))  # what all queries have seen
                for q in x.asks:
                    ids = np.frombuffer(q["ids"], np.int64)
                    queries = Block(np.frombuffer(q["at"], np.int64), ids, _vectors(q["vectors"], len(ids), len(turn)), turn)
                    yield pd.DataFrame({"rows": [_structs(search(queries, np.frombuffer(q["floor"], np.int64), block, k)[0])]})

    return run


def pairs(asks: DataFrame, known: list[tuple[int, float]], last: int) -> DataFrame:
    """``asks`` once for each ``block`` that may hold something for it.

    Blocks are numbered by descending length. ``known`` has the greatest lengths of some, the first included; the blocks
    up to the next known one that is too short are searched.
    """
    ends = [b for b, _ in known[1:]] + [last + 1]
    lengths = F.array(*(F.lit(x) for _, x in known))
    n = F.size(F.filter(lengths, lambda x: x >= F.col("need")))
    return asks.withColumn("until", F.get(F.array(*(F.lit(b) for b in ends)), n - 1)).where("until is not null").withColumn("block", F.explode(F.sequence(F.lit(known[0][0]), F.col("until") - 1))).drop("until")


def top_k(vectors: DataFrame, k: int = K, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``, against all rows but the query's own.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do null ids. Shorter vectors count
    as filled up with zeros. Of rows with the same id each asks, and finds the others. Ties go to the smaller id.
    Components must keep products within a long.

    The longest vectors of all, ``STEP`` at most, and ``KNOWN`` lengths are broadcast. Query blocks are shuffled only to
    blocks whose longest vector may reach a threshold of theirs, and meet each in groups of ``TOGETHER``.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.monotonically_increasing_id().alias("rid")).where(
        F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    )
    n, dims = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dims = max(1, dims)
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["embedding"]
    turn = rotation(_matrix(sample, dims).astype(np.float64))
    length = F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)")
    ranged = usable.withColumn("length", -length).repartitionByRange(-(-n // BLOCK), "length", "vec_id", "rid").drop("rid")
    blocks = store(ranged.withColumn("part", F.spark_partition_id()).mapInPandas(_packed(dims), "block int, longest double, ids binary, vectors binary"))
    first, last = blocks.agg(F.min("block"), F.max("block")).first()
    seed = blocks.where(F.col("block") == first).select("block", F.substring("ids", 1, 8 * STEP).alias("ids"), F.expr(f"substring(vectors, 1, length(vectors) div (length(ids) div 8) * {STEP})").alias("vectors")).first()
    known = [tuple(r) for r in blocks.where((F.col("block") - first) % -(-(last - first + 1) // KNOWN) == 0).select("block", "longest").orderBy("block").collect()]
    shared = spark.sparkContext.broadcast((turn, tuple(seed), first))
    asks = store(blocks.select("block", "ids", "vectors").mapInPandas(_asking(shared, every, k), _ASKS))
    wanted = pairs(asks.drop("rows"), known, last).groupBy("block", F.expr(f"pmod(xxhash64(q_block), {max(1, -(-n // every // QUERIES) // TOGETHER)})").alias("together")).agg(F.collect_list(F.struct("at", "ids", "vectors", "floor")).alias("asks"))
    later = wanted.select("block", "asks").join(blocks.select("block", "ids", "vectors"), "block").mapInPandas(_searched(shared, k), _FOUND)
    found = asks.select("rows").unionByName(later).select(F.explode("rows").alias("x")).select("x.*")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the query over embeddings, by scoring every pair.
ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, p.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * p.e[i]))::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.r <> q.r),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {K}
"""
