"""Models from tables. Spark knows columns and types; keys, which it doesn't enforce, are given."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from presetlake.importers import naming

Keys = Mapping[tuple[str, str], tuple[str, str]]


def field_type(kind: T.DataType) -> str:
    for types, name in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
        ((T.FloatType, T.DoubleType, T.DecimalType), "float"),
        ((T.BooleanType,), "bool"),
        ((T.DateType,), "date"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"),
    ):
        if isinstance(kind, types):
            return name
    return "time" if type(kind).__name__ == "TimeType" else "string"


def from_tables(tables: Mapping[str, DataFrame], foreign: Keys, primary: Mapping[str, list[str]] | None = None, only_simple: bool = False) -> dict[str, dict]:
    """Model mappings by model name. ``foreign`` has (table, column) to (table, column); ``only_simple`` leaves out tables with foreign keys."""
    wanted = {n: df for n, df in tables.items() if not (only_simple and any(t == n for t, _ in foreign))}
    out = {}
    for table, df in sorted(wanted.items()):
        columns = {f.name: field_type(f.dataType) for f in df.schema.fields}
        parents = {naming.relation_name(c): {"type": "belongs_to", "model": naming.model_name(rt), "fk": c, "pk": rc} for (t, c), (rt, rc) in foreign.items() if t == table and rt in wanted}
        children = [(t.lower(), {"type": "has_many", "model": naming.model_name(t), "fk": c, "pk": rc}) for (t, c), (rt, rc) in foreign.items() if rt == table and t in wanted]
        made = naming.model(table, columns, list((primary or {}).get(table, [])), parents, children)
        if made:
            out[naming.model_name(table)] = made
    usable = lambda relation: relation["model"] in out
    return {name: _without(model, {r for r, x in model["relations"].items() if not usable(x)}) for name, model in out.items()}


def _without(model: dict, relations: set[str]) -> dict:
    """Drop relations to tables that gave no model, and the fields and presets that need them."""
    presets = {}
    for name, preset in model["presets"].items():
        fields = [f for f in preset["fields"] if not (f["type"] == "preset" and f["source"] in relations)]
        if fields:
            presets[name] = {"fields": fields}
    return model | {"relations": {n: r for n, r in model["relations"].items() if n not in relations}, "presets": presets}


def from_database(spark: SparkSession, database: str | None = None, foreign: Keys | None = None, primary: Mapping[str, list[str]] | None = None, only_simple: bool = False) -> dict[str, dict]:
    """The same from the tables of the session's catalog."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return from_tables({n: spark.table(f"`{database}`.`{n}`" if database else f"`{n}`") for n in names}, foreign or {}, primary, only_simple)
