"""Presets to nested rows: structs for belongs_to, first children for has_one, arrays for has_many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presetlake.functions import formatter
from presetlake.functions.fragments import is_aggregate
from presetlake.functions.localize import localized
from presetlake.plans.frame import Context, Frame, Node, Path
from presetlake.spec.loader import depth_of
from presetlake.spec.types import BadRequest, Field, Model, ModelError, Preset, Relation

Hops = dict[tuple[str, str], int]

#: Rows of one parent that share a task when the parent's array is attached to each.
SHARE = 10_000


@dataclass
class Leaf:
    """A column of the frame."""

    column: str
    type: T.DataType


@dataclass
class Late:
    """An aggregate that only the output needs: computed for the rows of the page."""

    path: Path
    name: str
    column: str = ""
    type: T.DataType = field(default_factory=T.NullType)
    relation: Relation | None = None  # if its children can be grouped on their own


@dataclass
class Tail:
    """Children that are attached to the page."""

    model: Model
    relation: Relation
    field: Field
    key: str
    hops: Hops
    path: Path = ()
    kind: str = ""  # of polymorphic parents: the column with the model's name
    column: str = ""
    type: T.DataType = field(default_factory=T.NullType)


@dataclass
class Template:
    parts: tuple
    leaves: dict[str, Leaf]


@dataclass
class Cut:
    """Where a recursion ends."""

    many: bool


@dataclass
class Branch:
    model: Model
    preset: Preset
    node: Node
    items: list[tuple[Field, object]]


@dataclass
class Shown:
    """A value while a branch is put together; ``inside`` has the parts of a belongs_to, hidden ones included."""

    col: Column
    type: T.DataType
    inside: dict[str, Shown] | None = None


def model_preset(model: Model, name: str) -> Preset:
    if name not in model.presets:
        raise BadRequest(f"{model.name} has no preset {name!r}")
    return model.presets[name]


class Shape:
    """The output of one preset over one frame: plan it, narrow the frame to its columns, hydrate, and show."""

    def __init__(self, frame: Frame, preset: Preset, hops: Hops | None = None):
        self.frame, self.context = frame, frame.context
        self.columns: dict[str, None] = {}
        self.tails: list[Tail] = []
        self.late: list[Late] = []
        self.branch = self._plan((), preset, hops or {})

    # Planning

    def _leaf(self, path: Path, name: str) -> Leaf:
        value = self.frame.value_at(path, name)
        node = self.frame.nodes[path]
        column = node.name(name) if name in node.types else self.frame._computed[(path, name, node.model.computable[name].source)]
        self.columns[column] = None
        return Leaf(column, value.type)

    def _plan(self, path: Path, preset: Preset, hops: Hops) -> Branch:
        node = self.frame.ensure(path)
        branch = Branch(node.model, preset, node, [])
        for f in preset.fields:
            branch.items.append((f, self._item(path, node, preset, f, hops)))
        return branch

    def _item(self, path: Path, node: Node, preset: Preset, f: Field, hops: Hops):
        if f.type in ("formatter", "nested_field") or (f.formatter and f.type != "preset"):
            return self._template(path, node, preset, f.source if f.type in ("formatter", "nested_field") else f.formatter, hops)
        if f.type == "preset":
            return self._nested(path, node, preset, f, hops)
        if f.source.startswith("("):
            made = self.context.fresh("c")
            self.frame.df = self.frame.df.withColumn(made, F.expr(self.frame._sql(path, node, f.source)))
            self.columns[made] = None
            return Leaf(made, self.frame.df.schema[made].dataType)
        if f.source in node.model.computable and f.source not in node.types:
            text = node.model.computable[f.source].source
            if is_aggregate(text) and (path, f.source, text) not in self.frame._computed and not path and node.keys():
                self.columns |= dict.fromkeys(node.keys())
                relation = self.frame.summed_relation(node, text)
                if relation:
                    self.columns[node.name(relation.pk)] = None
                self.late.append(Late(path, f.source, self.context.fresh("c"), relation=relation))
                return self.late[-1]
        return self._leaf(path, f.source)

    def _template(self, path: Path, node: Node, preset: Preset, text: str, hops: Hops) -> Template:
        """Names that no field of the preset has are looked up in the tables, over belongs_to relations."""
        parts, leaves = formatter.parse(text), {}
        keys = {f.key for f in preset.fields}
        nested = {f.key: f for f in preset.fields if f.type == "preset"}
        for name in formatter.references(parts):
            head, *rest = name.split(".")
            if name in keys or (head in nested and rest and self._offers(node.model, nested[head], rest[0])):
                continue
            steps, model = tuple(name.split(".")[:-1]), node.model
            for step in steps:
                relation = model.relations.get(step)
                if relation is None or relation.many or relation.polymorphic:
                    break
                model = self.context.registry[relation.model]
            else:
                last = name.split(".")[-1]
                known = last in model.computable or last in self.context.catalog.table(model.table).columns
                if known:
                    leaves[name] = self._leaf((*path, *steps), last)
        return Template(parts, leaves)

    def _offers(self, model: Model, f: Field, name: str) -> bool:
        relation = model.relations[f.source]
        return relation.polymorphic or relation.many or any(x.key == name for x in model_preset(self.context.registry[relation.model], f.preset).fields)

    def _nested(self, path: Path, node: Node, preset: Preset, f: Field, hops: Hops):
        relation = node.model.relations[f.source]
        step = (node.model.name, relation.name)
        if hops.get(step, 0) >= (depth_of(relation, f) if relation.reentrant or not relation.polymorphic else 1):
            return Cut(relation.type == "has_many")
        hops = hops | {step: hops.get(step, 0) + 1}
        if relation.polymorphic:
            key, kind = node.name(relation.fk), node.name(relation.type_column)
            self.columns |= {key: None, kind: None}
            return self._tail(Tail(node.model, relation, f, key, hops, path, kind))
        if relation.many:
            key = node.name(relation.pk)
            self.columns[key] = None
            return self._tail(Tail(node.model, relation, f, key, hops, path))
        target = self.context.registry[relation.model]
        return self._plan((*path, f.source), model_preset(target, f.preset), hops)

    def _tail(self, tail: Tail) -> Tail:
        self.tails.append(tail)
        return tail

    # Hydration

    def hydrate(self, df: DataFrame, keys_from: DataFrame | None = None) -> DataFrame:
        """Attach late aggregates and tails. ``keys_from`` has the rows whose children are wanted, if not all and if no page says so."""
        frame, self._bare = self.frame, df
        source = frame.page if frame.page is not None else keys_from
        for relation in {x.relation.name: x.relation for x in self.late if x.relation}.values():
            lates = [x for x in self.late if x.relation == relation]
            df = frame.attach_sums(df, frame.root.col(relation.pk), relation, {x.column: frame.root.model.computable[x.name].source for x in lates}, source)
            for late in lates:
                late.type = df.schema[late.column].dataType
        for late in (x for x in self.late if not x.relation):
            inner = Frame(self.context, frame.root.model)
            keys = frame.root.keys()
            if source is not None:
                wanted = source.select(*(F.col(f"`{k}`").alias(f"w_{k}") for k in keys)).distinct()
                on = [inner.root.col(k) == F.col(f"`w_{frame.root.prefix}{k}`") for k in self._key_names()]
                inner.df = inner.df.join(F.broadcast(wanted) if frame.few else wanted, on, "left_semi")
            value = self._aggregate(inner, late.name)
            late.type = value.schema[late.name].dataType
            names = [f"{late.column}_{n}" for n in self._key_names()]
            renamed = value.select(*(F.col(f"`{n}`").alias(m) for n, m in zip(self._key_names(), names)), F.col(f"`{late.name}`").alias(late.column))
            df = df.join(renamed, [F.col(f"`{k}`") == F.col(f"`{m}`") for k, m in zip(keys, names)], "left").drop(*names)
        for tail in self.tails:
            tail.column = self.context.fresh("t")
            source = frame.reached(tail.path) if frame.page is not None else keys_from
            df = self._polymorphic(df, tail, source) if tail.kind else self._children(df, tail, source)
        return df

    def _key_names(self) -> list[str]:
        root = self.frame.root
        return [k for k in root.model.primary_keys if k in root.types]

    def _aggregate(self, inner: Frame, name: str) -> DataFrame:
        sql = inner._sql((), inner.root, inner.root.model.computable[name].source)
        return inner.df.groupBy(*(inner.root.col(k).alias(k) for k in self._key_names())).agg(F.expr(sql).alias(name))

    def _children(self, df: DataFrame, tail: Tail, source: DataFrame | None) -> DataFrame:
        relation, context = tail.relation, self.context
        target = context.registry[relation.model]
        child = Frame(context, target)
        if relation.where:
            child.df = child.df.where(child.condition(child.root, relation.where))
        key = context.fresh("k")

        if relation.through:
            middle, inner, link = child.through(relation, target)
            middle = self.frame.reduce(middle, inner.col(relation.fk), source, F.col(f"`{tail.key}`"))
            on = inner.col(link.fk) == child.root.col(link.pk) if not link.many else child.root.col(link.fk) == inner.col(link.pk)
            child.df = child.df.join(middle, on).withColumn(key, inner.col(relation.fk))
        else:
            child.df = self.frame.reduce(child.df, child.root.col(relation.fk), source, F.col(f"`{tail.key}`")).withColumn(key, child.root.col(relation.fk))
        shape = Shape(child, model_preset(target, tail.field.preset), tail.hops)
        order = _relation_order(child, relation.order)
        child.df = child.df.where(F.col(key).isNotNull())
        made = shape.hydrate(child.df, child.df if source is not None and shape.tails else None)
        value = shape.text(tail.field.formatter) if tail.field.formatter else shape.struct()
        names = [context.fresh("o") for _ in order]
        rows = made.select(F.col(key), value.alias("v"), *(c.alias(n) for n, (c, _) in zip(names, order)))
        if context.child_cap:
            rows = rows.orderBy(*(_sorted(F.col(n), down) for n, (_, down) in zip(names, order))).limit(context.child_cap)
        downs = [down for _, down in order]
        if relation.type == "has_one":
            window = Window.partitionBy(key).orderBy(*(_sorted(F.col(n), down) for n, down in zip(names, downs)))
            first = rows.withColumn("n", F.row_number().over(window)).where("n = 1")
            made = first.select(F.col(key), F.col("v").alias(tail.column))
        else:
            listed = F.collect_list(F.struct(*names, F.col("v")))
            made = rows.groupBy(key).agg(F.transform(F.array_sort(listed, _comparator(names, downs)), lambda x: x["v"]).alias(tail.column))
        tail.type = made.schema[tail.column].dataType
        if relation.type == "has_many" and tail.path and self.frame.page is None:
            return self._shared(df, tail, made, key)
        return df.join(made, F.col(f"`{tail.key}`") == F.col(key), "left").drop(key)

    def _shared(self, df: DataFrame, tail: Tail, made: DataFrame, key: str) -> DataFrame:
        """Attach arrays of parents that many rows share.

        Rows of one parent may be few bytes and yet many elements, so a parent with over ``SHARE`` rows has its array
        repeated for every so many of them, and these go to different tasks. There is at most one such parent for
        ``SHARE`` rows, so that their keys can be broadcast.
        """
        parent, kinds = F.col(f"`{tail.key}`"), dict(self._bare.dtypes)
        spread = [k for k in self.frame.root.keys() if k in kinds] or [c for c, kind in kinds.items() if not kind.startswith(("array", "map", "struct", "variant"))]
        owner, shares, share, other = (self.context.fresh("h") for _ in range(4))
        hot = F.broadcast(self._bare.groupBy(parent.alias(owner)).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias(shares)).where(F.col(shares) > 1))
        place = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread)), F.col(shares)), F.lit(0))
        rows = df.join(hot, parent.eqNullSafe(F.col(owner)), "left").withColumn(share, place).drop(owner, shares)
        places = F.sequence(F.lit(0), F.coalesce(F.col(shares), F.lit(1)) - 1)
        made = made.join(hot, F.col(key) == F.col(owner), "left").withColumn(other, F.explode(places)).drop(owner, shares)
        # A given number of parts, as joining them by their bytes wouldn't see what they make.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows, made = rows.repartition(parts, parent, F.col(share)), made.repartition(parts, F.col(key), F.col(other))
        return rows.join(made.hint("merge"), (parent == F.col(key)) & (F.col(share) == F.col(other)), "left").drop(key, share, other)

    def _polymorphic(self, df: DataFrame, tail: Tail, source: DataFrame | None) -> DataFrame:
        """The parents of all models that have the preset, in one table with the model's name; they join once."""
        found, context = None, self.context
        key, kind = context.fresh("k"), context.fresh("k")
        for model in context.registry.values():
            if tail.field.preset not in model.presets:
                continue
            columns = context.catalog.table(model.table).columns
            pk = tail.relation.pk if tail.relation.pk in columns else model.primary_keys[0]
            parent = Frame(context, model)
            own = None if source is None else source.where(F.col(f"`{tail.kind}`") == model.name)
            parent.df = self.frame.reduce(parent.df, parent.root.col(pk), own, F.col(f"`{tail.key}`")).withColumn(key, parent.root.col(pk)).withColumn(kind, F.lit(model.name))
            shape = Shape(parent, model.presets[tail.field.preset], tail.hops)
            rows = shape.hydrate(parent.df)
            value = shape.text(tail.field.formatter) if tail.field.formatter else F.to_variant_object(shape.struct())
            rows = rows.select(F.col(key), F.col(kind), value.alias(tail.column))
            found = rows if found is None else found.union(rows)
        if found is None:
            raise BadRequest(f"no model has the preset {tail.field.preset!r}")
        tail.type = found.schema[tail.column].dataType
        return df.join(found, (F.col(f"`{tail.key}`") == F.col(key)) & (F.col(f"`{tail.kind}`") == F.col(kind)), "left").drop(key, kind)

    # Output

    def fields(self) -> dict[str, Shown]:
        return self._show(self.branch)[0]

    def outputs(self) -> list[Column]:
        shown = self.fields()
        return [shown[k].col.alias(k) for k in _visible(self.branch)]

    def struct(self) -> Column:
        return F.struct(*self.outputs())

    def text(self, template: str) -> Column:
        return formatter.compile(formatter.parse(template), _lookup(self.fields()))

    def _show(self, branch: Branch) -> tuple[dict[str, Shown], list[Column]]:
        """The branch's values by key, hidden ones included, and what says that it isn't empty."""
        shown: dict[str, Shown] = {}
        present: list[Column] = []
        waiting: dict[str, tuple[Field, Template]] = {}
        for f, item in branch.items:
            if isinstance(item, Branch):
                inside, any_ = self._show(item)
                there = reduce(or_, any_) if any_ else F.lit(False)
                if f.formatter:
                    shown[f.key] = Shown(F.when(there, formatter.compile(formatter.parse(f.formatter), _lookup(inside))), T.StringType(), inside)
                else:
                    visible = _visible(item)
                    made = F.struct(*(inside[k].col.alias(k) for k in visible)) if visible else F.struct(F.lit(None).alias("_"))
                    kind = T.StructType([T.StructField(k, inside[k].type) for k in visible])
                    shown[f.key] = Shown(F.when(there, made), kind, inside)
                present.append(there)
            elif isinstance(item, (Leaf, Late)):
                col = F.col(f"`{item.column}`")
                present.append(col.isNotNull())
                kind = item.type
                if f.localize:
                    col, kind = localized(col, kind, self.context.locale, branch.model.name, branch.preset.name, (f.key, f.source), _declared(branch.model, f))
                shown[f.key] = Shown(col, kind)
            elif isinstance(item, Tail):
                col = F.col(f"`{item.column}`")
                if item.relation.type == "has_many":
                    present.append(F.coalesce(F.size(col) > 0, F.lit(False)))
                    col = F.coalesce(col, F.array().cast(item.type))
                else:
                    present.append(col.isNotNull())
                shown[f.key] = Shown(col, item.type)
            elif isinstance(item, Cut):
                kind = T.ArrayType(T.StringType()) if item.many else T.StringType()
                shown[f.key] = Shown(F.array().cast(kind) if item.many else F.lit(None).cast(kind), kind)
            else:
                waiting[f.key] = (f, item)
                present += [F.col(f"`{leaf.column}`").isNotNull() for leaf in item.leaves.values()]
        done: dict[str, Shown] = {}

        def resolve(key: str, trail: tuple[str, ...]) -> Shown:
            if key in trail:
                raise ModelError(f"{branch.model.name}.{branch.preset.name}: templates mention each other: {' > '.join((*trail, key))}")
            if key not in done:
                f, item = waiting[key]

                def lookup(name: str):
                    if name in waiting and name != key:
                        found = resolve(name, (*trail, key))
                        return found.col, found.type
                    if (found := _find(shown, name)) is not None:
                        return found.col, found.type
                    leaf = item.leaves.get(name)
                    return (F.col(f"`{leaf.column}`"), leaf.type) if leaf else None

                if f.type == "nested_field":
                    only = item.parts[0] if len(item.parts) == 1 and isinstance(item.parts[0], formatter.Token) else None
                    found = lookup(only.path) if only else None
                    done[key] = Shown(*found) if found else Shown(F.lit(None).cast("string"), T.StringType())
                else:
                    done[key] = Shown(formatter.compile(item.parts, lookup), T.StringType())
            return done[key]

        for key in waiting:
            resolve(key, ())
        shown |= done
        return shown, present


def _declared(model: Model, f: Field) -> str:
    return model.computable[f.source].type if f.type == "computable" and f.source in model.computable else f.type


def _visible(branch: Branch) -> list[str]:
    return list(dict.fromkeys(f.key for f, _ in branch.items if not f.internal))


def _find(shown: dict[str, Shown], name: str) -> Shown | None:
    """A key as it stands, else a walk down its parts."""
    if name in shown:
        return shown[name]
    head, _, rest = name.partition(".")
    if not rest or head not in shown:
        return None
    top = shown[head]
    if top.inside is not None:
        return _find(top.inside, rest)
    col, kind = top.col, top.type
    for step in rest.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return None
        col, kind = col.getField(step), kind[step].dataType
    return Shown(col, kind)


def _lookup(shown: dict[str, Shown]):
    def lookup(name: str):
        found = _find(shown, name)
        return (found.col, found.type) if found else None

    return lookup


def parse_order(text: str) -> list[tuple[str, bool]]:
    """``a DESC, .b`` to names and whether they descend."""
    out = []
    for part in text.split(","):
        words = part.split()
        if not words:
            continue
        if len(words) > 2 or (len(words) == 2 and words[1].lower() not in ("asc", "desc")):
            raise BadRequest(f"{part.strip()!r} is no order")
        out.append((words[0].lstrip("."), len(words) == 2 and words[1].lower() == "desc"))
    return out


def _relation_order(child: Frame, text: str) -> list[tuple[Column, bool]]:
    """The relation's order with the primary key last, so that no two rows tie."""
    asked = parse_order(text)
    named = {n for n, _ in asked}
    asked += [(k, False) for k in child.root.model.primary_keys if k not in named and k in child.root.types]
    return [(child.value(n, asked=True).col, down) for n, down in asked]


def _sorted(col: Column, down: bool) -> Column:
    """Nulls come last in ascending and first in descending order."""
    return col.desc_nulls_first() if down else col.asc_nulls_last()


def _comparator(names: Sequence[str], downs: Sequence[bool]):
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, down in reversed(list(zip(names, downs))):
            x, y, less = a[name], b[name], 1 if down else -1
            out = (
                F.when(x.isNull() & y.isNull(), out)
                .when(x.isNull(), -less)
                .when(y.isNull(), less)
                .when(x < y, less)
                .when(x > y, -less)
                .otherwise(out)
            )
        return out

    return compare


def sort_columns(context: Context, frame: Frame, preset: Preset | None, sorts: Sequence[str]) -> list[tuple[Column, bool]]:
    """Request sorts: paths, computed columns, or keys of the preset."""
    out = []
    for text in sorts:
        for name, down in parse_order(text):
            by_key = {f.key: f for f in preset.fields} if preset else {}
            f = by_key.get(name)
            if f and f.alias and f.type not in ("preset", "formatter", "nested_field") and "." not in name:
                name = f.source
            out.append((frame.value(name, asked=True).col, down))
    return out
