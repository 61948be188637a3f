"""Catalog, logs, locales, SQL fragments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presetlake.functions import fragments
from presetlake.functions.localize import localized
from presetlake.sources import logs
from presetlake.sources.catalog import Catalog, json_rows
from presetlake.sources.locale import Locale, spark_pattern


def test_catalog(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    catalog = Catalog(spark, str(tmp_path), {"even": "SELECT id FROM {t} WHERE id % 2 = 0", "one": lambda: spark.range(1)})
    assert catalog.table("even").count() == 2 and catalog.table("one").count() == 1
    catalog.add("even", spark.range(7))
    assert catalog.table("even").count() == 7
    spark.range(2).createOrReplaceTempView("tests_view")
    assert Catalog(spark).table("tests_view").count() == 2


def test_json_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert json_rows(rows).first().value == '{"a":1,"b":null}'


def test_logs(spark, tmp_path):
    lines = [f'{{"level":"{"ERROR" if n % 3 == 0 else "INFO"}","msg":"Message {n}","user":"{n % 2}"}}' for n in range(30)] + ["not json", ""]
    (tmp_path / "app.log").write_text("\n".join(lines))
    path = str(tmp_path / "app.log")
    messages = lambda **k: [r.msg for r in logs.scan(spark, path, **k).collect()]
    assert messages() == [f"Message {n}" for n in range(10, 30)]
    assert messages(level="error", limit=2) == ["Message 24", "Message 27"]
    assert messages(message="MESSAGE 2", key="user", value="1", limit=500) == [f"Message {n}" for n in (21, 23, 25, 27, 29)]
    assert messages(key="missing") == [] and len(messages(limit=-4)) == 1


def test_layouts():
    assert [spark_pattern(x) for x in ("02.01.2006", "2006-01-02 15:04:05", "Jan 02, 06 03:04 PM", "at 15h")] == ["dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "MMM dd, yy hh:mm a", "'a''t' HH'h'"]


def test_words_by_the_nearest_path():
    locale = Locale.of({"status": {0: "off", 1: "on"}, "card": {"status": {1: "ON"}}, "Person": {"card": {"status": {1: "present", "x": "else"}}}, "layoutSettings": {"ttime": "15h"}})
    assert locale.values("Person", "card", ("status",)) == {"0": "off", "1": "present", "x": "else"}
    assert locale.values("Pet", "card", ("status",)) == {"0": "off", "1": "ON"} == locale.values("Pet", "card", ("name", "status"))
    assert locale.values("Pet", "item", ("status",)) == {"0": "off", "1": "on"} and locale.values("Pet", "item", ("name",)) == {}
    assert locale.layouts == {"date": "yyyy-MM-dd", "time": "HH'h'", "datetime": "yyyy-MM-dd HH:mm:ss"}


def test_localized_columns(spark):
    locale = Locale.of({"status": {0: "off"}, "layoutSettings": {"date": "02.01.2006"}})
    df = spark.createDataFrame([(0, dt.date(2024, 5, 6)), (7, None), (None, None)], "n bigint, d date")
    words, kind = localized(F.col("n"), T.LongType(), locale, "M", "p", ("status",), "int")
    days, _ = localized(F.col("d"), T.DateType(), locale, "M", "p", ("d",), "date")
    assert isinstance(kind, T.StringType)
    assert [tuple(r) for r in df.select(words, days).collect()] == [("off", "06.05.2024"), ("7", None), (None, None)]


@pytest.mark.parametrize(
    "text, want",
    [
        (".kind = 'a.b' and used", "<kind> = 'a.b' and <used>"),
        ("concat(kind, {rel}.x, {rel.y}, {used})", "concat_ws('', <kind>, {rel|x}, {rel.y|}, {used|})"),
        ("(select max(n.a) from notes n where n.k = main.kind and kind = 1)", "(select max(n.a) from v_notes n where n.k = <kind> and kind = 1)"),
        ("sum(used) + 1.5", "sum(<used>) + 1.5"),
    ],
)
def test_fragments(text, want):
    table = (lambda t: f"v_{t}") if fragments.is_subquery(text) else None
    assert fragments.rewrite(text, lambda i, a: f"{{{i}|{a}}}", lambda c: f"<{c}>", {"kind", "used"}, table) == want


def test_aggregates_are_told_from_subqueries():
    assert fragments.is_aggregate("coalesce(SUM (x), 0)") and not fragments.is_aggregate("(select sum(x) from t)") and not fragments.is_aggregate("'sum(' || summary")
    assert fragments.strip_select("(select concat({a}, 'from'))") == "(concat({a}, 'from'))"
