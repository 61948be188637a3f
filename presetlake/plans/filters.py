"""The filter language: parsing, columns, and the rewrite of has-many filters to semi joins."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presetlake.plans.frame import Frame, Path, Value
from presetlake.spec.types import BadRequest, Model

#: The operators of the language.
OPERATORS = {
    "eq", "eq_cs", "in", "lt", "lte", "gt", "gte", "start", "start_cs", "end", "end_cs", "cnt", "cnt_cs", "not_cnt", "not_cnt_cs", "null", "is_null", "not_null",
}


@dataclass(frozen=True)
class Test:
    names: tuple[str, ...]
    any: bool
    operator: str
    value: object


@dataclass(frozen=True)
class Group:
    any: bool
    parts: tuple


def parse(filters: dict | None, frame: Frame) -> Group:
    """A dictionary's keys hold together; ``or`` and ``and`` open groups of a dictionary or of a list of dictionaries."""
    return Group(False, tuple(_parts(filters or {}, frame)))


def _parts(filters: dict, frame: Frame) -> Iterator:
    if not isinstance(filters, dict):
        raise BadRequest("filters must be an object")
    for key, value in filters.items():
        if key in ("or", "and"):
            if isinstance(value, dict):
                parts = tuple(_parts(value, frame))
            elif isinstance(value, list):
                parts = tuple(Group(False, tuple(_parts(one, frame))) for one in value)
            else:
                raise BadRequest(f"{key!r} needs an object or a list")
            if parts:
                yield Group(key == "or", parts)
        elif (test := _test(key, value, frame)) is not None:
            yield test


def _test(key: str, value: object, frame: Frame) -> Test | None:
    name, mark, operator = key.rpartition("__")
    if not mark:
        name, operator = key, "eq"
    elif operator not in OPERATORS:
        if _known(key, frame):
            name, operator = key, "eq"
        elif frame.context.lenient:
            return None
        else:
            raise BadRequest(f"unknown operator {operator!r} in {key!r}")
    if not _fits(operator, value):
        if frame.context.lenient:
            return None
        raise BadRequest(f"{key!r} can't take {value!r}")
    for word in ("_or_", "_and_"):
        if word in name and not _known(name, frame):
            return Test(tuple(name.split(word)), word == "_or_", operator, value)
    return Test((name,), True, operator, value)


def _known(name: str, frame: Frame) -> bool:
    try:
        path, last = frame.split(name)
        model = frame.model_at(path)
    except (BadRequest, KeyError):
        return False
    return last in model.computable or last in frame.context.catalog.table(model.table).columns


def _fits(operator: str, value: object) -> bool:
    if operator.removesuffix("_cs") in ("start", "end", "cnt", "not_cnt"):
        return isinstance(value, str)
    if operator == "null":
        return isinstance(value, bool)
    if operator in ("lt", "lte", "gt", "gte"):
        return value is not None and not isinstance(value, (list, dict))
    return not isinstance(value, dict)


def tests(node) -> Iterator[Test]:
    if isinstance(node, Test):
        yield node
    else:
        for part in node.parts:
            yield from tests(part)


def compile(node, frame: Frame, below: Path = ()) -> Column:
    """One boolean column. ``below`` is cut from the front of all paths."""
    if isinstance(node, Group):
        made = [compile(part, frame, below) for part in node.parts]
        return reduce(or_ if node.any else and_, made) if made else F.lit(not node.any)
    columns = []
    for name in node.names:
        dotted = name if not below else ".".join(frame_relative(name, below))
        columns.append(_predicate(frame.value(dotted, asked=True), node.operator, node.value))
    return reduce(or_ if node.any else and_, columns)


def frame_relative(name: str, below: Path) -> list[str]:
    """``name`` has been expanded before."""
    return name.split(".")[len(below) :]


def _pattern(text: str) -> str:
    """A stray backslash stands for itself; ``%`` and ``_`` are wildcards."""
    return re.sub(r"\\(?![%_\\])|\\$", r"\\\\", text)


def _literal(value: object, kind: T.DataType) -> Column:
    if isinstance(value, (list, tuple)):
        raise BadRequest("a single value is expected")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)) or type(kind).__name__ == "TimeType":
        return F.lit(value if isinstance(value, (datetime.date, decimal.Decimal)) else str(value)).cast(kind)
    if isinstance(kind, T.IntegralType) and isinstance(value, str):
        return F.lit(value).try_cast("decimal(38,10)")
    if isinstance(kind, T.NumericType) and isinstance(value, str):
        return F.lit(value).try_cast("double")
    if isinstance(kind, T.BooleanType) and isinstance(value, str):
        return F.lit(value).try_cast("boolean")
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return F.lit(str(value).lower() if isinstance(value, bool) else str(value))
    return F.lit(value)


def _predicate(found: Value, operator: str, value: object) -> Column:
    col, kind = found.col, found.type
    text = col if isinstance(kind, T.StringType) else col.cast("string")
    base, exact = operator.removesuffix("_cs"), operator.endswith("_cs")
    if base == "eq":
        if value is None:
            return col.isNull()
        if isinstance(value, list):
            base = "in"
        elif isinstance(value, str):
            return text == value if exact else F.lower(text) == F.lower(F.lit(value))
        else:
            return col == _literal(value, kind)
    if base == "in":
        values = value if isinstance(value, list) else [value]
        known = [v for v in values if v is not None]
        if not known:
            return F.lit(False)
        if isinstance(kind, T.StringType):
            return col.isin([str(v) for v in known])
        return col.isin([_literal(v, kind) for v in known])
    if base in ("lt", "lte", "gt", "gte"):
        right = _literal(value, kind)
        return {"lt": col < right, "lte": col <= right, "gt": col > right, "gte": col >= right}[base]
    if base in ("start", "end", "cnt", "not_cnt"):
        plain = not re.search(r"[%_\\]", value)
        subject, wanted = (text, value) if exact else (F.lower(text), value.lower())
        if base == "start" and plain:
            return subject.startswith(wanted)
        if base == "end" and plain:
            return subject.endswith(wanted)
        pattern = _pattern(("" if base == "start" else "%") + value + ("" if base == "end" else "%"))
        hit = text.like(pattern) if exact else text.ilike(pattern)
        return ~hit if base == "not_cnt" else hit
    return col.isNull() if base == "is_null" or (base == "null" and value) else col.isNotNull()


# Semi joins


def rejects_null(node) -> bool:
    """Whether a row of nulls can't pass."""
    if isinstance(node, Group):
        return bool(node.parts) and (all if node.any else any)(rejects_null(p) for p in node.parts)
    nothing = node.operator == "is_null" or (node.operator == "null" and node.value) or (node.operator in ("eq", "eq_cs") and node.value is None)
    return not nothing


def _expanded(node, frame: Frame):
    if isinstance(node, Group):
        return Group(node.any, tuple(_expanded(p, frame) for p in node.parts))
    return Test(tuple(frame.expand(n) for n in node.names), node.any, node.operator, node.value)


def apply(frame: Frame, filters: dict | None, used: Iterable[Path] = ()) -> None:
    """Filter the frame.

    Tests of one has-one or has-many relation become a single semi join if they all stand in the top conjunction, reject
    missing rows, and nothing else uses the relation; so they hold for the same child row and repeat no root row. A lone
    test for a missing child becomes an anti join. All others filter the left joins.
    """
    top = _expanded(parse(filters, frame), frame)
    conjuncts, queue = [], list(top.parts)
    while queue:
        part = queue.pop(0)
        if isinstance(part, Group) and not part.any:
            queue = [*part.parts, *queue]
        else:
            conjuncts.append(part)
    ties: list[set[Path]] = []
    blocked = {p[: frame.crosses_many(p)] for p in used if frame.crosses_many(p)}
    for part in conjuncts:
        roots: set[Path] = set()
        for test in tests(part):
            for name in test.names:
                path, last = frame.split(name)
                computed = last in frame.model_at(path).computable
                for p in frame.mentions(name) if not _aggregated(frame, path, last) else [path]:
                    frame.guard(p)
                    n = frame.crosses_many(p)
                    roots.add(p[:n] if n else ())
                    if computed and n:
                        blocked.add(p[:n])
        ties.append(roots)
    for part, roots in zip(conjuncts, ties):
        if len(roots) > 1 or not rejects_null(part):
            blocked |= roots - {()}
    groups: dict[Path, list] = {}
    rest = []
    for part, roots in zip(conjuncts, ties):
        (only,) = roots if len(roots) == 1 else ((),)
        if only and only not in blocked:
            groups.setdefault(only, []).append(part)
        elif only and sum(only in r for r in ties) == 1 and only not in {p[: frame.crosses_many(p)] for p in used} and _is_missing(part, frame, only):
            _half_join(frame, only, [], "left_anti")
        else:
            rest.append(part)
    for path, parts in groups.items():
        _half_join(frame, path, parts, "left_semi")
    if rest:
        made = compile(Group(False, tuple(rest)), frame)
        frame.df = frame.df.where(made)


def _aggregated(frame: Frame, path: Path, name: str) -> bool:
    from presetlake.functions.fragments import is_aggregate

    computable = frame.model_at(path).computable.get(name)
    return computable is not None and is_aggregate(computable.where or computable.source)


def _is_missing(part, frame: Frame, path: Path) -> bool:
    if not isinstance(part, Test) or len(part.names) != 1 or rejects_null(part):
        return False
    own, name = frame.split(part.names[0])
    relation = frame.step(frame.model_at(path[:-1]), path[-1])
    return own == path and not relation.through and name == relation.fk


def _half_join(frame: Frame, path: Path, parts: list, how: str) -> None:
    parent = frame.ensure(path[:-1])
    relation = frame.step(parent.model, path[-1])
    target: Model = frame.context.registry[relation.model]
    child = Frame(frame.context, target)
    if relation.where:
        child.df = child.df.where(child.condition(child.root, relation.where))
    for part in parts:
        made = compile(part, child, path)
        child.df = child.df.where(made)
    key = frame.context.fresh("k")
    if relation.through:
        middle, inner, link = child.through(relation, target)
        on = inner.col(link.fk) == child.root.col(link.pk) if not link.many else child.root.col(link.fk) == inner.col(link.pk)
        keys = middle.join(child.df, on).select(inner.col(relation.fk).alias(key))
    else:
        keys = child.df.select(child.root.col(relation.fk).alias(key))
    frame.df = frame.df.join(keys, parent.col(relation.pk) == F.col(key), how)
