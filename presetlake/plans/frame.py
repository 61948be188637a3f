"""A root table with the relations that a request mentions, each joined once, each with columns of its own names."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presetlake.functions import fragments
from presetlake.sources.catalog import Catalog
from presetlake.sources.locale import Locale
from presetlake.spec.loader import Registry, depth_of
from presetlake.spec.types import BadRequest, Model, Relation

Path = tuple[str, ...]

_WORDED = re.compile(r"^\s*\.?(\w+)\s+(in|cnt|start|end)\s+([^()]+)$", re.I)


@dataclass
class Context:
    registry: Registry
    catalog: Catalog
    locale: Locale = field(default_factory=Locale)
    lenient: bool = False
    child_cap: int | None = None
    _numbers: itertools.count = field(default_factory=itertools.count)

    def fresh(self, kind: str) -> str:
        return f"{kind}{next(self._numbers)}"

    def model(self, name: str) -> Model:
        if name not in self.registry:
            raise BadRequest(f"unknown model {name!r}", 404)
        return self.registry[name]

    def view(self, table: str) -> str:
        """A temporary view of a table, for subqueries in computed columns."""
        name = f"presetlake_{table}_{self.catalog.token}"
        self.catalog.table(table).createOrReplaceTempView(name)
        return name


@dataclass(frozen=True)
class Node:
    """One path: its model and the names and types of its columns in the frame."""

    model: Model
    prefix: str
    types: dict[str, T.DataType]

    def name(self, column: str) -> str:
        if column not in self.types:
            raise BadRequest(f"{self.model.name} has no column {column!r}")
        return self.prefix + column

    def col(self, column: str) -> Column:
        return F.col(f"`{self.name(column)}`")

    def keys(self) -> list[str]:
        return [self.name(k) for k in self.model.primary_keys if k in self.types]


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType


class Frame:
    def __init__(self, context: Context, model: Model):
        self.context = context
        self.many = False
        self.df, node = self._table(model)
        self.nodes: dict[Path, Node] = {(): node}
        self._computed: dict[tuple, str] = {}
        #: Aggregates of the root, with their texts, that the output needs: made with others of the same relation.
        self.awaited: dict[str, str] = {}
        self.page: DataFrame | None = None
        self.few = False
        self._reached: dict[Path, DataFrame] = {}

    def turn_page(self, page: DataFrame, few: bool) -> None:
        """Go on from the rows of a page; ``few`` says that a limit bounds them well enough to be broadcast.

        What is joined from now on is first reduced to the rows that the page reaches, step by step, so that no large
        table is shuffled for the sake of a page.
        """
        self.df, self.page, self.few = page, page, few
        self._reached = dict.fromkeys(self.nodes, page)

    def reached(self, path: Path) -> DataFrame | None:
        """Rows that have the node's columns, for the page only; None without a page."""
        return self._reached.get(path)

    def reduce(self, rows: DataFrame, column: Column, source: DataFrame | None, key: Column) -> DataFrame:
        """The rows whose ``column`` is a ``key`` of the source; all rows if there is no source."""
        if source is None:
            return rows
        name = self.context.fresh("w")
        keys = source.select(key.alias(name)).distinct()
        return rows.join(F.broadcast(keys) if self.few else keys, column == F.col(name), "left_semi")

    @property
    def root(self) -> Node:
        return self.nodes[()]

    def _table(self, model: Model) -> tuple[DataFrame, Node]:
        source = self.context.catalog.table(model.table)
        prefix = self.context.fresh("p") + "__"
        node = Node(model, prefix, {f.name: f.dataType for f in source.schema.fields})
        return source.select([F.col(f"`{c}`").alias(prefix + c) for c in source.columns]), node

    def condition(self, node: Node, text: str) -> Column:
        """A relation's condition over its own table: SQL, or one of ``x in a, b``, ``x cnt a``, ``x start a``, ``x end a``."""
        if m := _WORDED.match(text):
            column, operator, said = F.col(f"`{node.name(m[1])}`").cast("string"), m[2].lower(), [v.strip().strip("'\"") for v in m[3].split(",")]
            if operator == "in":
                return column.isin(said)
            return column.ilike({"cnt": "%{}%", "start": "{}%", "end": "%{}"}[operator].format(m[3].strip().strip("'\"")))
        return F.expr(fragments.rewrite(text, lambda inside, after: f"`{node.name(after or inside)}`", lambda c: f"`{node.name(c)}`", node.types))

    def step(self, model: Model, name: str) -> Relation:
        if name not in model.relations:
            raise BadRequest(f"{model.name} has no relation {name!r}")
        relation = model.relations[name]
        if relation.polymorphic:
            raise BadRequest(f"{model.name}.{name} is polymorphic and can't be joined")
        return relation

    def guard(self, path: Path) -> None:
        """A path comes back to one of its models by reentrant relations only, and no deeper than they say."""
        model, seen, taken = self.root.model, {self.root.model.name}, []
        for name in path:
            relation = self.step(model, name)
            taken.append((model.name, name))
            if relation.model in seen:
                if not relation.reentrant:
                    raise BadRequest(f"{'.'.join(path)}: {model.name}.{name} isn't reentrant")
                if taken.count(taken[-1]) > depth_of(relation):
                    raise BadRequest(f"{'.'.join(path)}: deeper than {depth_of(relation)}")
            seen.add(relation.model)
            model = self.context.registry[relation.model]

    def crosses_many(self, path: Path) -> int:
        """Steps up to the first that may repeat rows, that one included; 0 if there is none."""
        model = self.root.model
        for n, name in enumerate(path, 1):
            relation = self.step(model, name)
            if relation.many:
                return n
            model = self.context.registry[relation.model]
        return 0

    def crosses_arrays(self, path: Path) -> bool:
        return any(self.step(self.model_at(path[:n]), name).type == "has_many" for n, name in enumerate(path))

    def ensure(self, path: Path) -> Node:
        """The path's node, after its left join, and those on the way to it, have been added where they were missing."""
        if path in self.nodes:
            return self.nodes[path]
        parent = self.ensure(path[:-1])
        relation = self.step(parent.model, path[-1])
        target = self.context.registry[relation.model]
        self.guard(path)
        right, node = self._table(target)
        if relation.where:
            right = right.where(self.condition(node, relation.where))
        if relation.through:
            middle, inner, link = self.through(relation, target)
            right = middle.join(right, _equal(inner.col(link.fk), node.col(link.pk)) if not link.many else _equal(node.col(link.fk), inner.col(link.pk)), "left")
            on = _equal(parent.col(relation.pk), inner.col(relation.fk))
        elif relation.many:
            on = _equal(parent.col(relation.pk), node.col(relation.fk))
        else:
            on = _equal(parent.col(relation.fk), node.col(relation.pk))
            if (source := self.reached(path[:-1])) is not None:
                right = self._reached[path] = self.reduce(right, node.col(relation.pk), source, parent.col(relation.fk))
        self.df = self.df.join(right, on, "left")
        self.many |= relation.many
        self.nodes[path] = node
        return node

    def through(self, relation: Relation, target: Model) -> tuple[DataFrame, Node, Relation]:
        """The table in between, its node, and its relation to the target."""
        middle = self.context.registry[relation.through]
        links = [r for r in middle.relations.values() if r.model == target.name]
        link = next((r for r in links if not r.many), links[0])
        df, node = self._table(middle)
        return (df.where(self.condition(node, relation.through_where)) if relation.through_where else df), node, link

    # Names of requests

    def expand(self, dotted: str) -> str:
        """Replace path aliases, of the root's model and of those on the way."""
        out: list[str] = []
        todo, model, budget = dotted.split("."), self.root.model, 64
        while todo:
            head, *todo = todo
            if head in model.aliases and head not in model.relations and budget:
                todo, budget = [*model.aliases[head].split("."), *todo], budget - 1
                continue
            out.append(head)
            relation = model.relations.get(head)
            model = self.context.registry.get(relation.model, model) if relation else model
        return ".".join(out)

    def split(self, dotted: str) -> tuple[Path, str]:
        *path, name = self.expand(dotted).split(".")
        if not all(x.replace("_", "a").isalnum() and not x[0].isdigit() for x in (*path, name) if x) or "" in (*path, name):
            raise BadRequest(f"{dotted!r} is no path")
        return tuple(path), name

    def model_at(self, path: Path) -> Model:
        model = self.root.model
        for name in path:
            model = self.context.registry[self.step(model, name).model]
        return model

    def mentions(self, dotted: str) -> list[Path]:
        """The paths that a name needs, those of a computed column's placeholders included."""
        path, name = self.split(dotted)
        computable = self.model_at(path).computable.get(name)
        return [path, *((*path, *p) for p in self.placeholder_paths(self.model_at(path), computable))] if computable else [path]

    def placeholder_paths(self, model: Model, computable) -> list[Path]:
        out = []
        for text in (computable.source, computable.where):
            out += [self._placeholder(model, inside, after)[0] for inside, after in fragments.placeholders(text)]
        return list(dict.fromkeys(out))

    def _placeholder(self, model: Model, inside: str, after: str) -> tuple[Path, str]:
        """``{path}.col``, ``{path.col}``, ``{col}`` and ``{}.col``."""
        parts = [p for p in inside.split(".") if p]
        if after:
            return tuple(parts), after
        return tuple(parts[:-1]), parts[-1] if parts else ""

    def value(self, dotted: str, asked: bool = False) -> Value:
        """A column or computed column; ``asked`` takes the text that the latter has for filters and sorts."""
        path, name = self.split(dotted)
        return self.value_at(path, name, asked)

    def value_at(self, path: Path, name: str, asked: bool = False) -> Value:
        node = self.ensure(path)
        if name in node.types:
            return Value(node.col(name), node.types[name])
        if name in node.model.computable:
            return self._compute(path, node, name, asked)
        raise BadRequest(f"{node.model.name} has no field {name!r}")

    def _sql(self, base: Path, node: Node, text: str) -> str:
        def placeholder(inside: str, after: str) -> str:
            path, column = self._placeholder(node.model, inside, after)
            return f"`{self.ensure((*base, *path)).name(column)}`"

        text = fragments.strip_select(text)
        view = self.context.view if fragments.is_subquery(text) else None
        return fragments.rewrite(text, placeholder, lambda c: f"`{node.name(c)}`", node.types, view)

    def _compute(self, path: Path, node: Node, name: str, asked: bool) -> Value:
        computable = node.model.computable[name]
        text = (asked and computable.where) or computable.source
        key = (path, name, text)
        if key not in self._computed:
            made = self.context.fresh("c")
            if fragments.is_aggregate(text):
                self._aggregate(path, node, text, made)
            else:
                sql = self._sql(path, node, text)  # joins what the text mentions
                self.df = self.df.withColumn(made, F.expr(sql))
            self._computed[key] = made
        made = self._computed[key]
        return Value(F.col(made), self.df.schema[made].dataType)

    def _aggregate(self, path: Path, node: Node, text: str, made: str) -> None:
        """Aggregate relations for each row of the node's own table, before they could repeat rows here."""
        keys = [k for k in node.model.primary_keys if k in node.types]
        if not keys:
            raise BadRequest(f"{node.model.name} needs primary_keys for aggregates")
        if (relation := self.summed_relation(node, text)) is not None:
            texts = {made: text}
            for name, other in self.awaited.items() if not path else ():
                if other != text and ((), name, other) not in self._computed and self.summed_relation(node, other) == relation:
                    self._computed[((), name, other)] = column = self.context.fresh("c")
                    texts[column] = other
            self.df = self.attach_sums(self.df, node.col(relation.pk), relation, texts)
            return
        inner = Frame(self.context, node.model)
        sql = inner._sql((), inner.root, text)
        per_row = inner.df.groupBy(*(inner.root.col(k).alias(f"{made}_{k}") for k in keys)).agg(F.expr(sql).alias(made))
        on = [node.col(k) == F.col(f"{made}_{k}") for k in keys]
        self.df = self.df.join(per_row, on, "left").drop(*(f"{made}_{k}" for k in keys))

    def summed_relation(self, node: Node, text: str) -> Relation | None:
        """The one relation that an aggregate reads, if its children can be grouped before they meet their parents."""
        paths = {self._placeholder(node.model, inside, after)[0] for inside, after in fragments.placeholders(text)}
        if len({p[:1] for p in paths}) != 1 or not all(paths):
            return None
        inner = Frame(self.context, node.model)
        for path in paths:
            inner.guard(path)
        relation = self.step(node.model, next(iter(paths))[0])
        own: list[str] = []
        fragments.rewrite(text, lambda inside, after: "", lambda c: own.append(c) or "", node.types)
        if own or not relation.many or relation.through or relation.pk not in node.types:
            return None
        kinds = node.types[relation.pk], Frame(self.context, self.context.registry[relation.model]).root.types.get(relation.fk)
        alike = kinds[0] == kinds[1] or all(isinstance(k, T.IntegralType) for k in kinds)  # else several foreign keys may equal one key
        return relation if alike else None

    def attach_sums(self, rows: DataFrame, parent: Column, relation: Relation, texts: dict[str, str], source: DataFrame | None = None) -> DataFrame:
        """Add columns with aggregates of a relation's children, by the parent's key; with a source, for its rows only.

        Children are grouped before the join, so that no task sorts or groups them all together with their parents. A
        parent without children sees one child of nulls: what that gives is worked out once.
        """
        child = Frame(self.context, self.context.registry[relation.model])
        if relation.where:
            child.df = child.df.where(child.condition(child.root, relation.where))
        fk = child.root.col(relation.fk)
        child.df = self.reduce(child.df.where(fk.isNotNull()), fk, source, parent)
        key, lone = self.context.fresh("k"), {name: self.context.fresh("d") for name in texts}
        sqls = {name: fragments.rewrite(fragments.strip_select(text), child._column_of, str, ()) for name, text in texts.items()}
        grouped = child.df.groupBy(fk.alias(key)).agg(*(F.expr(sql).alias(name) for name, sql in sqls.items()))
        nulls = rows.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in child.df.schema.fields))
        nothing = nulls.agg(*(F.expr(sql).alias(lone[name]) for name, sql in sqls.items()))
        rows = rows.join(grouped, parent == F.col(key), "left").crossJoin(F.broadcast(nothing))
        return rows.withColumns({n: F.when(F.col(key).isNull(), F.col(d)).otherwise(F.col(n)) for n, d in lone.items()}).drop(key, *lone.values())

    def _column_of(self, inside: str, after: str) -> str:
        """The column of a parent's placeholder, whose first step leads to this frame's root."""
        path, column = self._placeholder(self.root.model, inside, after)
        return f"`{self.ensure(path[1:]).name(column)}`"


def _equal(left: Column, right: Column) -> Column:
    return left == right
