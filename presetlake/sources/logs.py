"""Structured logs: one JSON object in each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LINES, MOST_LINES = 20, 100


def scan(spark: SparkSession, path: str, level: str | None = None, message: str | None = None, key: str | None = None, value: str | None = None, limit: int | None = None) -> DataFrame:
    """``file, offset, level, msg, fields`` of the last matching lines, oldest first.

    ``level`` and ``message`` compare without case, the message as a part; ``key`` asks for a field, ``value`` for its
    text. The limit is between 1 and 100, 20 unless given. Lines that aren't JSON objects are passed over. The order is
    that of file names and of lines within a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    parsed = lines.withColumn("fields", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})).where("fields is not null and size(fields) > 0")
    rows = parsed.select("file", "block", "line", F.col("fields")["level"].alias("level"), F.col("fields")["msg"].alias("msg"), "fields")
    if level:
        rows = rows.where(F.lower("level") == level.lower())
    if message:
        rows = rows.where(F.contains(F.lower("msg"), F.lit(message.lower())))
    if key:
        rows = rows.where(F.map_contains_key("fields", F.lit(key)))
        if value is not None:
            rows = rows.where(F.col("fields")[key] == value)
    most = min(max(limit or DEFAULT_LINES, 1), MOST_LINES)
    order = ["file", "block", "line"]
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most).orderBy(*order).select("file", "line", "level", "msg", "fields")
