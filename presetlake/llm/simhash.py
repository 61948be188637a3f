"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in few bits agree on one of three disjoint sets of bits. They are grouped by each of these
masks, sorted by Gray rank within the groups, and a tree over the sorted run keeps in each node the bits on which all
its fingerprints agree and which no ancestor holds already. A search adds up the differences on the way down and prunes
a node, with its whole group, once they exceed the limit.

Only distinct fingerprints are indexed. A group that is larger than ``GROUP`` is dealt again by three sets of the bits
that are still free, up to three times; then a group has 2**19 members at most, by the number of free bits.

For similarities as low as 0.8, of which two bits find few, ``keep_one`` takes fingerprints of 128 bits of five-word
shingles and links at ``WIDE`` differing bits. Disjoint sets of bits would be too small there, so the masks are drawn at
random, as many as find 98 of 100 pairs of that similarity; all else is the same index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import discard, ship, store
from presetlake.llm.graph import components

#: Distinct fingerprints of a group that one task indexes; larger groups are dealt again.
GROUP = 32_768
#: Fingerprints indexed together, queries searched together, children of a node.
CHUNK, BLOCK, FAN = 65_536, 512, 8
LEVELS = 3
#: Differing bits of 128 at which wide fingerprints link: 19.5 are expected at a similarity of 0.8, with a deviation of 4.1.
WIDE = 26
#: Wide fingerprints that a group of a mask should have; share of pairs at 0.8 that some mask finds; bits added for a group over GROUP.
CROWD, FOUND, DEEPER = 256, 0.98, 6
#: Share of bits on which two texts of similarity 0.8 agree: 1 - acos(2 * 0.8 / 1.8) / pi.
AGREE = 0.848


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    tokens = (text or "").encode().lower().split()  # for bytes, both are ASCII only
    if not tokens:
        return 0
    shingles = zip(*(tokens[i:] for i in range(words))) if len(tokens) >= words else [tokens]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of each row; a null text counts as empty."""

    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("fp"))


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in the Gray sequence, with the sign bit flipped so that longs sort as unsigned."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _thirds(mask: int) -> list[int]:
    """Three sets of the bits that ``mask`` leaves free, as even as can be, each with ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i * len(free) // 3 : (i + 1) * len(free) // 3]) for i in range(3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tree(fps: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the leaves up: pattern, mask, residual mask, first and last group of each node.

    ``fps`` has a row for each fingerprint and a column for each 64 of its bits.
    """
    one, none = fps, fps
    levels, lo, hi = [], group, group
    while True:
        mask = ~(one ^ none)
        levels.append([one & mask, mask, mask, lo, hi])
        if len(one) <= FAN:
            break
        at = np.arange(0, len(one), FAN)
        one, none = np.bitwise_and.reduceat(one, at), np.bitwise_or.reduceat(none, at)
        lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
    for child, parent in zip(levels, levels[1:]):
        child[2] = child[1] & ~np.repeat(parent[1], FAN, axis=0)[: len(child[1])]
    return [tuple(x) for x in levels]


def links(fps: np.ndarray, group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of positions in the same group whose fingerprints differ in ``most`` bits or fewer."""
    levels = tree(fps, group)
    for begin in range(0, len(fps), BLOCK):
        queries = np.arange(begin, min(begin + BLOCK, len(fps)))
        top = len(levels[-1][0])
        q, node, spent = np.repeat(queries, top), np.tile(np.arange(top), len(queries)), np.zeros(len(queries) * top, np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            pattern, _, residual, lo, hi = levels[depth]
            later = (node + 1) * FAN**depth - 1 > q  # each pair is looked up from its first member only
            own = group[q]
            fits = later & (lo[node] <= own) & (own <= hi[node])
            q, node, spent = q[fits], node[fits], spent[fits]
            for word in range(fps.shape[1]):
                spent = spent + np.bitwise_count((fps[q, word] ^ pattern[node, word]) & residual[node, word])
            near = spent <= most
            q, node, spent = q[near], node[near], spent[near]
            if depth:
                wide = len(levels[depth - 1][0])
                q, spent = np.repeat(q, FAN), np.repeat(spent, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < wide
                q, node, spent = q[there], node[there], spent[there]
        if len(q):
            yield q, node


def _forest(fps: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as positions, from each linked fingerprint to one of its component in this chunk: fewer edges than fingerprints."""
    label = np.arange(len(fps))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if (up == x).all():
                return x
            x = up

    for a, b in links(fps, group, most):
        while len(a):
            a, b = root(a), root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    top = root(label)
    moved = np.flatnonzero(top != np.arange(len(fps)))
    return moved, top[moved]


def _indexed(most: int, groups: list[str], bits: list[str], node: str):
    """mapInPandas over rows sorted by the columns ``groups`` and Gray rank: chunks end where a group ends.

    ``bits`` are the columns of a fingerprint; an edge has the ``node`` of both its ends.
    """

    def emit(part: pd.DataFrame) -> pd.DataFrame:
        keys = part[groups].to_numpy()
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]).astype(np.int64)
        fps = np.stack([part[c].to_numpy(np.int64).view(np.uint64) for c in bits], 1)
        a, b = _forest(fps, group, most)
        nodes = part[node].to_numpy(np.int64)
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                whole = pd.concat(held, ignore_index=True)
                last = (whole[groups] == whole[groups].iloc[-1]).all(axis=1)
                if not last.all():
                    yield emit(whole[~last])
                held = [whole[last]]
                rows = int(last.sum())
        if rows:
            yield emit(pd.concat(held, ignore_index=True))

    return run


def link(distinct: DataFrame, most: int = 2, group: int = GROUP) -> DataFrame:
    """``fp`` (distinct longs) to edges ``a, b`` that connect what differs in ``most`` (0 to 2) bits or fewer."""
    ship(distinct.sparkSession)
    masks, rows, found = [0], distinct.select(F.lit(0).alias("path"), "fp"), None
    for level in range(LEVELS):
        nested = [_thirds(m) for m in masks]
        masks = [m for three in nested for m in three]
        choices = F.array(*(F.array(*(F.struct(F.lit(3 * i + j).alias("path"), F.lit(_signed(m)).cast("long").alias("mask")) for j, m in enumerate(three))) for i, three in enumerate(nested)))
        keys = rows.select("fp", F.explode(choices[F.col("path")]).alias("m")).select("m.path", "fp", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
        hot = None
        if level < LEVELS - 1:
            hot = store(keys.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("path", "key"))
            hot = None if hot.isEmpty() else hot
        cold = keys if hot is None else keys.join(hot, ["path", "key"], "left_anti")
        ordered = cold.repartition("path", "key").sortWithinPartitions("path", "key", gray_rank(F.col("fp")))
        edges = ordered.select("path", "key", "fp").mapInPandas(_indexed(most, ["path", "key"], ["fp"], "fp"), "a long, b long")
        found = edges if found is None else found.union(edges)
        if hot is None:
            break
        rows = store(keys.join(hot, ["path", "key"], "left_semi").select("path", "fp"))
    return found


def near_duplicates(docs: DataFrame, most: int = 2, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest id that can be reached over links. Null and
    empty texts have fingerprint zero and are linked like others. A null id never names a component: where a component
    has no other id, ``component_id`` is null. Repeated rows are repeated; other columns are left out.
    """
    rows = store(fingerprints(docs, id_col, text_col))
    own = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link(own.select("fp"), most, group)).withColumnRenamed("node", "fp")
    least = roots.join(own, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    wider = roots.join(least, "root").select("fp", "component_id")
    # Stored, so that the rows' join stands alone in its stage, where adaptive execution can split a fingerprint that a
    # large part of all rows shares.
    named = store(own.join(wider, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[int, int]:
    """128 bits of the set of shingles, as two signed longs; a bit is what most of their hashes have, a tie is the least hash's.

    A shorter text is one shingle; without words all bits are 0.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0, 0
    known: dict[bytes, int] = {}
    own = np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t, 42) | 1) for t in tokens), np.uint64, len(tokens))
    n = max(1, len(own) - words + 1)
    h = np.full(n, len(own) if n == 1 else words, np.uint64)
    for k in range(min(words, len(own))):
        h = _mixed(h ^ own[k : k + n])
    h = np.unique(h)
    pairs = np.stack([h, _mixed(h ^ np.uint64(0xD6E8FEB86659FD93))], 1)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(pairs[at : at + (1 << 15)].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    first = np.unpackbits(pairs[0].view(np.uint8), bitorder="little")
    bits = np.where(2 * ones == len(h), first, 2 * ones > len(h)).astype(np.uint8)
    high, low = np.packbits(bits, bitorder="little").view(np.int64).tolist()
    return high, low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _drawn(tables: int, bits: int, level: int) -> list[tuple[int, int]]:
    """``tables`` masks of ``bits`` of the 128 bits, as pairs of signed longs."""
    draw, out = np.random.default_rng([tables, bits, level]), []
    for _ in range(tables):
        mask = np.zeros(128, np.uint8)
        mask[draw.choice(128, bits, replace=False)] = 1
        out.append(tuple(np.packbits(mask, bitorder="little").view(np.int64).tolist()))
    return out


def wide_link(distinct: DataFrame, most: int = WIDE, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """``node, high, low`` (distinct wide fingerprints) to edges ``a, b`` of nodes that differ in ``most`` bits or fewer.

    The masks have as many bits as give groups of about ``crowd``, none where there are no more fingerprints than that,
    so all are compared. More fingerprints take longer masks, and so more of them: about as their number to the power
    of 0.24. A group of over ``group`` is dealt again by masks of ``DEEPER`` bits.
    """
    ship(distinct.sparkSession)
    bits = int(np.ceil(np.log2(max(1, distinct.count() / crowd))))
    rows, found = distinct.select(F.lit(0).cast("long").alias("path"), "node", "high", "low"), None
    for level in range(LEVELS):
        tables = int(np.ceil(np.log(1 / (1 - FOUND)) / AGREE**bits)) if bits else 1
        masks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(_drawn(tables, bits, level))))
        key = F.xxhash64("path", "m.i", F.col("high").bitwiseAND(F.col("m.a")), F.col("low").bitwiseAND(F.col("m.b")))
        keys = rows.select("path", "node", "high", "low", F.explode(masks).alias("m")).select(key.alias("key"), "node", "high", "low")
        hot = None
        if level < LEVELS - 1 and bits:
            hot = store(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("key"))
            hot = None if hot.isEmpty() else hot
        cold = keys if hot is None else keys.join(hot, "key", "left_anti")
        ordered = cold.repartition("key").sortWithinPartitions("key", *_wide_rank(F.col("high"), F.col("low")))
        edges = ordered.mapInPandas(_indexed(most, ["key"], ["high", "low"], "node"), "a long, b long")
        found = edges if found is None else found.union(edges)
        if hot is None:
            break
        rows, bits = store(keys.join(hot, "key", "left_semi").withColumnRenamed("key", "path")), DEEPER
    return found


def _wide_rank(high: Column, low: Column) -> list[Column]:
    """Gray rank of 128 bits: an odd number of bits in the upper half turns the lower half's rank round."""
    turned = gray_rank(low)
    return [gray_rank(high), F.when(F.bit_count(high) % 2 == 1, F.bitwise_not(turned)).otherwise(turned)]


def keep_one(docs: DataFrame, most: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each group of near-duplicates keeps one row.

    Texts link where their wide fingerprints differ in ``most`` bits or fewer, which holds for 95 of 100 pairs with a
    five-word Jaccard similarity of 0.8 and for nearly all above 0.85. The row with the least id stays, one without an
    id only if no other has one; of several, the least text digest and then any one. Null and empty texts are one group.

    The rows are stored with their fingerprints; then only numbers are shuffled. The numbers of the rows that go are
    stored too, so that Spark knows their size and broadcasts them below its threshold alone.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("high long, low long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wide_fingerprint(t) for t in texts], columns=["high", "low"], dtype="int64")

    rows = store(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"), run(F.col(text_col)).alias("f")))
    cell = lambda c: F.col("row").getField(c)
    place = F.struct(cell(id_col).isNull().alias("none"), cell(id_col).alias("id"), F.md5(cell(text_col)).alias("digest"), "rid")
    own = store(rows.groupBy("f.high", "f.low").agg(F.min(place).alias("first")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(wide_link(own.select("node", "high", "low"), most))
    first = own.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    gone = store(rows.select("rid").join(first.select("first.rid"), "rid", "left_anti"))
    discard(own)
    return rows.join(gone, "rid", "left_anti").select("row.*")
