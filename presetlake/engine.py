"""The entry points: rows of a preset, distinct values, counts and aggregates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presetlake.functions.fragments import is_aggregate
from presetlake.plans import filters
from presetlake.plans.frame import Context, Frame
from presetlake.plans.shape import Shape, _sorted, model_preset, sort_columns
from presetlake.sources.catalog import Catalog, json_rows
from presetlake.sources.locale import Locale
from presetlake.sources.scratch import store
from presetlake.spec.loader import AGGREGATES, Registry
from presetlake.spec.types import BadRequest, Preset

#: Rows of a page up to which its keys are broadcast to the children's scans; a request's limit is what proves the size.
BROADCAST_PAGE = 10_000


class Engine:
    """Compiles requests to DataFrames; only a page that relations start from is computed, and stored, at once.

    ``lenient`` drops tests with unknown operators or values of the wrong kind instead of refusing them; ``child_cap``
    bounds the children of each relation over all parents together.
    """

    def __init__(self, registry: Registry, catalog: Catalog, locale: Locale | None = None, lenient: bool = False, child_cap: int | None = None):
        self.registry, self.catalog = registry, catalog
        self.options: dict[str, Any] = {"locale": locale or Locale(), "lenient": lenient, "child_cap": child_cap}

    def _frame(self, request: dict) -> Frame:
        context = Context(self.registry, self.catalog, **self.options)
        return Frame(context, context.model(request.get("model") or ""))

    def index(self, request: dict) -> DataFrame:
        """``model, preset, filters, sorts, offset, limit`` to nested rows; with ``unique_by`` to a column ``value``."""
        if request.get("unique_by"):
            return self._page(self._distinct(request), [(F.col("value"), False)], request)
        return self._rows(request, page_first=_number(request, "limit") > 0)

    def _rows(self, request: dict, page_first: bool) -> DataFrame:
        """``page_first`` cuts the page before what only the output needs is joined; it can't, where joins repeat root rows."""
        frame = self._frame(request)
        preset = model_preset(frame.root.model, request.get("preset") or "")
        sorts = _listed(request.get("sorts"))
        used = [p for s in sorts for p in self._sort_paths(frame, preset, s)]
        computable = {f.source: frame.root.model.computable[f.source].source for f in preset.fields if f.source in frame.root.model.computable}
        frame.awaited = {name: text for name, text in computable.items() if is_aggregate(text) and name not in frame.root.types}
        filters.apply(frame, request.get("filters"), used)
        order = sort_columns(frame.context, frame, preset, sorts)
        names = [frame.context.fresh("s") for _ in order]
        hidden = [c.alias(n) for n, (c, _) in zip(names, order)]
        keys = frame.root.keys()
        by = [_sorted(F.col(n), down) for n, (_, down) in zip(names, order)]
        if page_first and not frame.many:
            by += [F.col(f"`{k}`").asc_nulls_last() for k in keys]
            page, limit = self._sliced(frame.df.select("*", *hidden), by, request)
            if preset and any(f.type in ("preset", "formatter", "nested_field", "computable") or f.formatter for f in preset.fields):
                page = store(page.drop(*_unmentioned(frame, preset)))  # else each relation would compute it again
            frame.turn_page(page, few=limit <= BROADCAST_PAGE)
            shape = Shape(frame, preset)
            if frame.many:
                return self._rows(request, page_first=False)
            made = shape.hydrate(frame.df)
        else:
            shape = Shape(frame, preset)
            wanted = dict(shape.columns)
            if not frame.many:
                wanted |= dict.fromkeys(keys)  # for the tie break
            rows = frame.df.select(*(F.col(f"`{c}`") for c in wanted), *hidden)
            if frame.many:
                rows = rows.distinct()
            by += [F.col(f"`{k}`").asc_nulls_last() for k in keys if k in wanted]
            cut = _number(request, "limit") or _number(request, "offset")
            page, _ = self._sliced(rows, by if order or cut else [], request)
            made = shape.hydrate(page, page if cut and (shape.tails or shape.late) else None)
        if order and made is not page:
            made = made.orderBy(*by)  # joins lose the order
        return made.select(*shape.outputs())

    def _sliced(self, rows: DataFrame, by: list, request: dict) -> tuple[DataFrame, int]:
        offset, limit = _number(request, "offset"), _number(request, "limit")
        page = rows.orderBy(*by) if by else rows
        if offset:
            page = page.offset(offset)
        if limit:
            page = page.limit(limit)
        return (page if by or offset or limit else rows), limit

    def _page(self, rows: DataFrame, order: list, request: dict) -> DataFrame:
        return self._sliced(rows, [_sorted(c, down) for c, down in order], request)[0]

    def _sort_paths(self, frame: Frame, preset: Preset | None, text: str) -> list:
        out = []
        for part in text.split(","):
            name = part.split()[0].lstrip(".") if part.split() else ""
            if not name or (preset and any(f.key == name for f in preset.fields)):
                continue
            path, last = frame.split(name)
            computable = frame.model_at(path).computable.get(last)
            aggregate = computable is not None and is_aggregate(computable.where or computable.source)
            out += [path] if aggregate else frame.mentions(name)
        return out

    def _distinct(self, request: dict) -> DataFrame:
        """One column ``value``; null is a value. Presets are not looked at."""
        frame = self._frame(request)
        path, name = frame.split(request["unique_by"])
        if frame.crosses_arrays(path):
            raise BadRequest("unique_by can't go through a has_many relation")
        computable = frame.model_at(path).computable.get(name)
        if computable and is_aggregate(computable.source):
            raise BadRequest("unique_by can't be an aggregate")
        filters.apply(frame, request.get("filters"), frame.mentions(request["unique_by"]))
        value = frame.value(request["unique_by"]).col
        return frame.df.select(value.alias("value")).distinct()

    def stats(self, request: dict) -> DataFrame:
        """One row: ``count`` and, by name, the aggregates ``{name: {"fn": ..., "field": ...}}``.

        Rows count once however often filters join them.
        """
        if request.get("unique_by"):
            if request.get("aggregates"):
                raise BadRequest("aggregates and unique_by exclude each other")
            return self._distinct(request).agg(F.count(F.lit(1)).alias("count"))
        frame = self._frame(request)
        if request.get("preset"):
            model_preset(frame.root.model, request["preset"])
        asked = [(name, *self._aggregate(frame, name, spec)) for name, spec in (request.get("aggregates") or {}).items()]
        filters.apply(frame, request.get("filters"), [p for _, _, field, _ in asked for p in frame.mentions(field)])
        values = [frame.value(field, asked=True).col.alias(f"v{i}") for i, (_, _, field, _) in enumerate(asked)]
        keys = [F.col(f"`{k}`") for k in frame.root.keys()]
        if not frame.many:
            rows = frame.df.select(*values) if values else frame.df
        elif not keys:
            raise BadRequest(f"{frame.root.model.name} needs primary_keys for counts over relations")
        else:
            rows = frame.df.select(*keys, *values).distinct()
        made = [F.count(F.lit(1)).alias("count")]
        for i, (name, fn, _, declared) in enumerate(asked):
            value = getattr(F, fn)(F.col(f"v{i}"))
            if fn in ("min", "max") and declared in ("date", "datetime"):
                value = F.date_format(value, "yyyy-MM-dd" if declared == "date" else "yyyy-MM-dd'T'HH:mm:ss'Z'")
            elif fn in ("min", "max") and isinstance(rows.schema[f"v{i}"].dataType, (T.ByteType, T.ShortType, T.IntegerType)):
                value = value.cast("long")
            made.append(value.alias(name))
        return rows.agg(*made)

    #: The older name.
    count = stats

    def _aggregate(self, frame: Frame, name: str, spec: dict) -> tuple[str, str, str]:
        fn, field = str(spec.get("fn") or "").strip().lower(), str(spec.get("field") or "").strip()
        if not name.strip() or name == "count" or not field:
            raise BadRequest(f"aggregate {name!r} needs a name other than count and a field")
        if fn not in AGGREGATES:
            raise BadRequest(f"aggregate {name!r}: unknown function {fn!r}")
        path, last = frame.split(field)
        if frame.crosses_arrays(path):
            raise BadRequest(f"aggregate {name!r}: {field} goes through a has_many relation")
        rule = frame.root.model.aggregatable.get(frame.expand(field)) or frame.root.model.aggregatable.get(field) or (frame.model_at(path).aggregatable.get(last) if path else None)
        if rule is None or fn not in rule.functions:
            raise BadRequest(f"aggregate {name!r}: {fn} of {field} isn't allowed")
        return fn, field, rule.type.lower()

    def index_json(self, request: dict) -> DataFrame:
        return json_rows(self.index(request))

    def explain(self, request: dict, mode: str = "formatted") -> None:
        self.index(request).explain(mode)


def _unmentioned(frame: Frame, preset: Preset) -> list[str]:
    """Columns of the root table that the preset, its relations and computed columns can't need: no text there has their name."""
    model = frame.root.model
    texts = [*model.primary_keys, *(str(v) for part in (*preset.fields, *model.relations.values(), *model.computable.values()) for v in vars(part).values())]
    words = set(re.findall(r"\w+", " ".join(texts)))
    return [frame.root.name(c) for c in frame.root.types if c not in words]


def _listed(sorts: Sequence[str] | str | None) -> list[str]:
    return [sorts] if isinstance(sorts, str) else list(sorts or ())


def _number(request: dict, key: str) -> int:
    value = request.get(key) or 0
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise BadRequest(f"{key} must be a whole number from 0")
    return value
