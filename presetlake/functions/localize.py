"""Dictionary words and date layouts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presetlake.sources.locale import Locale


def localized(value: Column, kind: T.DataType, locale: Locale, model: str, preset: str, keys: tuple[str, ...], declared: str) -> tuple[Column, T.DataType]:
    """A date or a time as its layout says, any other value as the dictionary says.

    A column with a dictionary becomes a string column: values that it lacks stay as their own text. Null stays null.
    """
    if declared in locale.layouts and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, locale.layouts[declared]), T.StringType()
    if declared in locale.layouts and type(kind).__name__ == "TimeType":
        return F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + (value - F.expr("time'00:00:00'")), locale.layouts[declared]), T.StringType()
    if words := locale.values(model, preset, keys):
        text = value.cast("string")
        table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
        return F.coalesce(F.try_element_at(table, text), text), T.StringType()
    return value, kind
