"""Line dedup by content-defined chunks of lines. Only DataFrame functions, no Python on the executors.

A rolling hash over the hashes of two neighbouring lines decides whether a chunk ends between them, so that an insertion
moves the boundaries next to it only, and whatever two documents share is cut alike from its first line to its last. A
shared passage seldom begins and ends where a chunk does; so a chunk is tried together with its beginnings and ends of
two lines or more, and so are the two lines around a boundary. Whatever of these occurs again anywhere is removed after
its bytes have been compared; the first occurrence, by id and place, stays. A line of over ``LONG`` words also counts
alone. Every removed line stands unchanged in an earlier place that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import discard, store, store_by

#: A chunk goes on where the rolling hash is 0 modulo ``DIVISOR``, up to ``MOST`` lines, which bounds its beginnings and ends.
DIVISOR, MOST, LONG = 3, 16, 50
_WORD = "[^\\\\x20\\\\x09-\\\\x0D]"

_LINES = "split(coalesce(text, ''), '\n')"
_VALUES = "transform(lines, x -> cast(conv(substring(md5(x), 1, 8), 16, 10) as bigint))"
_ENDS = f"filter(sequence(1, size(lines)), i -> i = size(lines) or pmod(31 * v[i - 1] + v[i], {DIVISOR}) <> 0)"
_SPANS = "transform(ends, (e, k) -> struct(if(k = 0, 1, ends[k - 1] + 1) as lo, if(k = 0, e, e - ends[k - 1]) as n))"
_CHUNKS = f"flatten(transform({_SPANS}, s -> transform(sequence(0, (s.n - 1) div {MOST}), j -> struct(s.lo + {MOST} * cast(j as int) as lo, least({MOST}, s.n - {MOST} * cast(j as int)) as n))))"
_NONE = "cast(array() as array<struct<lo:int,n:int>>)"
#: Lines of over LONG words; a shorter line than that many words and spaces isn't counted.
_LONG = f"transform(filter(sequence(1, size(lines)), i -> length(lines[i - 1]) > {2 * LONG} and regexp_count(lines[i - 1], '{_WORD}+') > {LONG}), i -> struct(i as lo, 1 as n))"
_PIECES = f"""concat(
  flatten(transform(chunks, c -> concat(
    if(c.n < 2, {_NONE}, transform(sequence(2, c.n), a -> struct(c.lo + c.n - a as lo, a as n))),
    if(c.n < 3, {_NONE}, transform(sequence(2, c.n - 1), b -> struct(c.lo as lo, b as n))),
    if(c.lo < 2, {_NONE}, array(struct(c.lo - 1 as lo, 2 as n)))))),
  {_LONG})"""
_HASHED = f"transform(filter(pieces, c -> exists(slice(lines, c.lo, c.n), x -> x rlike '{_WORD}')), c -> struct(c.lo as lo, c.n as n, xxhash64(slice(lines, c.lo, c.n)) as h))"


def _by_row(pieces: DataFrame, name: str) -> DataFrame:
    """The pieces of each row as one array, which the row's own number of pieces bounds."""
    return pieces.groupBy("rid").agg(F.collect_set(F.struct("lo", "n")).alias(name))


def _gone(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, gone: the pieces (lo, n) that each row loses; rows that lose none are left out."""
    texts = rows.select("rid", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    cut = texts.select("rid", F.expr(_LINES).alias("lines")).withColumn("v", F.expr(_VALUES)).select("rid", "lines", F.expr(_ENDS).alias("ends")).select("rid", "lines", F.expr(_CHUNKS).alias("chunks"))
    hashed = store(cut.select("rid", "lines", F.expr(_PIECES).alias("pieces")).select("rid", F.explode(F.expr(_HASHED)).alias("c")).select("rid", "c.*"))
    again = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    asked = _by_row(hashed.join(again, "h", "left_semi"), "asked")
    some = texts.join(asked.hint("merge"), "rid").select("rid", "id", F.xxhash64("text").alias("sig"), "asked", F.expr(_LINES).alias("lines"))
    pieces = some.select("rid", "id", "sig", F.explode(F.expr("transform(asked, c -> struct(c.lo as lo, c.n as n, array_join(slice(lines, c.lo, c.n), '\n') as bytes))")).alias("c")).select("rid", "id", "sig", "c.*")
    place = F.struct("id", "sig", "rid", "lo")
    firsts = pieces.groupBy("bytes").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1").select(F.sha2("bytes", 256).alias("digest"), "first")
    named = pieces.select("rid", "id", "sig", "lo", "n", F.sha2("bytes", 256).alias("digest"))
    gone = store(_by_row(named.join(firsts, "digest").where(~place.eqNullSafe(F.col("first"))), "gone"))
    discard(hashed)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``new_text, n_lines, n_removed`` of each row.

    A null text stays null with no lines; a text of which all goes is empty. The empty text is one empty line. Null ids
    sort first; of rows that agree in id and text any one counts as the first, and the others lose what it keeps. Pieces
    without a word stay. ``docs`` should be read from files, as the rows are numbered in the order in which they are read.

    Shuffles: the rows once, into buckets by their number, which both later joins use; the hashes of pieces without text;
    the bytes of pieces with a repeated hash, pre-aggregated, so copies of one passage meet as one row from each task,
    which then stands by its SHA-256 for the join with its places. What joins the rows grows with the corpus and its
    arrays are far larger than their files, so these joins are told not to broadcast it.
    """
    rows = store_by(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rid")
    gone = _gone(rows, id_col, text_col)
    joined = rows.join(gone.hint("merge"), "rid", "left").select("row", "gone", F.col("row").getField(text_col).alias("text"))
    lost = "array_distinct(flatten(transform(gone, g -> sequence(g.lo, g.lo + g.n - 1))))"
    lined = joined.select("row", "text", F.expr(_LINES).alias("lines"), F.expr(lost).alias("lost"))
    kept = "transform(array_except(sequence(1, size(lines)), lost), i -> lines[i - 1])"
    return lined.select(
        "row",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.expr(f"array_join({kept}, '\n')")).alias("new_text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_removed"),
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with their new texts, in the same columns; ``chars_col``, where there is one, follows the text."""
    done = dedup_lines(docs, id_col, text_col)
    new = {text_col: F.col("new_text"), chars_col: F.length("new_text").cast("long")}
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


#: DuckDB SQL for ``doc_id, text, n_lines, n_removed`` over documents with distinct ids.
ORACLE_SQL = f"""
WITH lined AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, lines, len(lines) AS total, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM lined),
valued AS (
  SELECT *, ('0x' || substr(md5(l), 1, 8))::BIGINT AS v FROM line),
ended AS (
  SELECT *, i = total OR (31 * v + lead(v) OVER d) % {DIVISOR} <> 0 AS e FROM valued WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM ended),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, k ORDER BY i) - 1) // {MOST} AS part FROM numbered),
chunk AS (
  SELECT doc_id, any_value(lines) AS lines, min(i) AS lo, count(*) AS n FROM placed GROUP BY doc_id, k, part),
piece AS (
  SELECT doc_id, lines, lo + n - a AS lo, a AS n FROM (SELECT *, unnest(range(2, n + 1)) AS a FROM chunk)
  UNION ALL SELECT doc_id, lines, lo, b FROM (SELECT *, unnest(range(2, n)) AS b FROM chunk)
  UNION ALL SELECT doc_id, lines, lo - 1, 2 FROM chunk WHERE lo > 1
  UNION ALL SELECT doc_id, lines, i, 1 FROM line WHERE len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) > {LONG}),
spelt AS (
  SELECT doc_id, lo, n, array_to_string(list_slice(lines, lo, lo + n - 1), chr(10)) AS bytes FROM piece),
gone AS (
  SELECT doc_id, lo, n FROM spelt WHERE regexp_matches(bytes, '[^\\x20\\x09-\\x0D]')
  QUALIFY row_number() OVER (PARTITION BY bytes ORDER BY doc_id, lo) > 1),
lost AS (
  SELECT DISTINCT doc_id, unnest(range(lo, lo + n)) AS i FROM gone),
edited AS (
  SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY line.i) FILTER (WHERE x.i IS NULL), '') AS new_text,
         count(*)::BIGINT AS n_lines, count(x.i)::BIGINT AS n_removed
  FROM line LEFT JOIN (SELECT doc_id AS d, i FROM lost) x ON doc_id = x.d AND line.i = x.i GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE e.new_text END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE e.n_lines END AS n_lines, e.n_removed
FROM documents d JOIN edited e USING (doc_id)
"""
