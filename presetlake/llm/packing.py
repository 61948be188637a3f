"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are ordered by residual. Each carries one bitmap of the sources and duplicate clusters that it holds; a document
searches from the first bin whose residual is enough to its successors until one has none of its bits, which is the
tightest compatible bin. Rows are dealt by a hash of the id and the row's place into packs of about ``ROWS`` rows, whose
number grows with the table, so that a repeated id is spread too; each pack is filled on its own, largest first. Only ids, sizes, sources and clusters are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import ship

CAPACITY, ROWS = 2_048, 4_096


def best_fit(items: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int]]:
    """``(size, bits)`` of each item, none larger than the capacity, to its bin and its offset there, in the same order."""
    order: list[tuple[int, int]] = []  # residual and bin
    held: list[int] = []
    for size, bits in items:
        at = bisect_left(order, (size, -1))
        while at < len(order) and held[order[at][1]] & bits:
            at += 1
        if at < len(order):
            residual, bin_ = order.pop(at)
            held[bin_] |= bits
        else:
            residual, bin_ = capacity, len(held)
            held.append(bits)
        insort(order, (residual - size, bin_))
        yield bin_, capacity - residual


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "no_id", "doc_id", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        source, sources = pd.factorize(rows["source"])
        cluster, _ = pd.factorize(rows["cluster"])
        out, last, opened = [], [], 0
        for i, (doc, size) in enumerate(zip(zip(rows["doc_id"], rows["no_id"]), rows["n_words"])):
            whole = max(0, (int(size) - 1) // capacity)  # parts that fill a bin of their own
            for part in range(whole):
                out.append((doc, part, part * capacity, capacity, opened, 0))
                opened += 1
            bits = (1 << int(source[i]) if source[i] >= 0 else 0) | (1 << len(sources) + int(cluster[i]) if cluster[i] >= 0 else 0)
            last.append((doc, whole, whole * capacity, int(size) - whole * capacity, bits))
        last.sort(key=lambda x: -x[3])
        for (doc, part, start, size, _), (bin_, offset) in zip(last, best_fit(((x[3], x[4]) for x in last), capacity)):
            out.append((doc, part, start, size, opened + bin_, offset))
        packed = pd.DataFrame([(*doc, *rest) for doc, *rest in out], columns=["doc_id", "no_id", "part", "start_word", "n_words", "bin", "offset"])
        packed["bin"] += int(key[0]) << 32
        return packed

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """``doc_id, part, start_word, n_words, bin, offset``: where each part of each document lies.

    A size is the text's number of words ``[^\\x20\\x09-\\x0D]+``. Documents larger than a bin are cut into full bins and
    a rest, so that no word is lost. Two documents of one source, or of one duplicate cluster, share no bin; without
    ``cluster_col``, texts that agree but for case and white space are a cluster. Null and empty texts have size 0 and
    are packed like others; a null source or cluster conflicts with nothing. Null ids stay null; repeated rows are
    packed one by one, in different bins. Equal sizes go in the order of ids. Other columns are left out.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    alike = F.when(F.col(text_col).isNotNull(), F.md5(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))) if cluster_col is None else F.col(cluster_col).cast("string")
    packs = max(1, -(-docs.count() // rows))
    sized = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()), F.lit(packs)).cast("long").alias("pack"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),  # a null would make the column a float
        F.col(id_col).isNull().alias("no_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.col(source_col).cast("string").alias("source"),
        alike.alias("cluster"),
    )
    packed = sized.groupBy("pack").applyInPandas(_pack(capacity), "doc_id long, no_id boolean, part long, start_word long, n_words long, bin long, offset long")
    return packed.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "part", "start_word", "n_words", "bin", "offset")


#: DuckDB SQL for the words and the number of parts of each document, over distinct ids.
WORDS_SQL = f"""
SELECT doc_id, n AS n_words, greatest(1, (n + {CAPACITY - 1}) // {CAPACITY})::BIGINT AS parts
FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents)
"""
