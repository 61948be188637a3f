"""Model files to linked models: validation, template includes, preset inheritance, defaults and cross checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields, replace
from pathlib import Path

import yaml

from presetlake.spec.types import DEFAULT_DEPTH, Aggregatable, Computable, Field, Model, ModelError, Preset, Relation, snake

#: The keys that each part of a model file may have.
KEYS = {
    "model": {"table", "relations", "presets", "include", "computable", "aggregatable", "aliases", "primary_keys"},
    "relation": {"model", "type", "fk", "pk", "table", "where", "order", "through", "through_where", "reentrant", "max_depth", "polymorphic", "type_column"},
    "preset": {"extends", "fields"},
    "field": {"source", "type", "alias", "preset", "where", "internal", "formatter", "localize", "max_depth"},
    "computable": {"source", "type", "where"},
    "aggregatable": {"functions", "type"},
}
#: The types of fields and of relations.
FIELD_TYPES = {"int", "string", "formatter", "preset", "bool", "float", "time", "datetime", "date", "UUID", "nested_field", "computable"}
RELATION_TYPES = {"belongs_to", "has_one", "has_many"}
AGGREGATES = {"sum", "avg", "min", "max"}


def _names(value: object) -> tuple[str, ...]:
    """A name, names with commas between them, or a list of names."""
    parts = value.split(",") if isinstance(value, str) else value or ()
    return tuple(str(p).strip() for p in parts if str(p).strip())


def _table(value: object, kind: str, where: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, Mapping):
        raise ModelError(f"{where}: a mapping is expected")
    if kind and (odd := sorted(set(map(str, value)) - KEYS[kind])):
        raise ModelError(f"{where}: unknown key {odd[0]!r}")
    return dict(value)


def _make(cls, raw: dict, **more):
    own = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in raw.items() if k in own and v is not None}, **more)


def _preset(name: str, raw: object, where: str) -> Preset:
    raw = _table(raw, "preset", where)
    made = []
    for n, one in enumerate(raw.get("fields") or ()):
        at = f"{where}.fields[{n}]"
        one = _table(one, "field", at)
        if one.get("type") is not None and one["type"] not in FIELD_TYPES:
            raise ModelError(f"{at}: unknown type {one['type']!r}")
        made.append(_make(Field, {k: str(v) if k in ("source", "alias") else v for k, v in one.items()}, **({} if "source" in one else {"source": ""})))
    return Preset(name, tuple(made), _names(raw.get("extends")))


def parse(name: str, raw: object) -> tuple[Model, tuple[str, ...]]:
    """One model from its mapping, not linked yet, and the templates that it includes."""
    raw = _table(raw, "model", name)
    section = lambda key: _table(raw.get(key), "", f"{name}.{key}").items()
    relations = {}
    for k, v in section("relations"):
        v = _table(v, "relation", f"{name}.relations.{k}")
        relations[k] = _make(Relation, {x: y for x, y in v.items() if x != "type"}, name=k, type=v.get("type", ""))
    computable = {k: _make(Computable, _table(v, "computable", f"{name}.computable.{k}")) for k, v in section("computable")}
    aggregatable = {}
    for k, v in section("aggregatable"):
        v = _table(v, "aggregatable", f"{name}.aggregatable.{k}")
        aggregatable[k] = Aggregatable(tuple(x.lower() for x in _names(v.get("functions"))), v.get("type") or "")
    model = Model(
        name,
        raw.get("table") or "",
        relations,
        {k: _preset(k, v, f"{name}.presets.{k}") for k, v in section("presets")},
        computable,
        aggregatable,
        {k: str(v) for k, v in section("aliases")},
        _names(raw.get("primary_keys")) or ("id",),
    )
    return model, _names(raw.get("include"))


def _overlaid(below: tuple[Field, ...], above: tuple[Field, ...]) -> tuple[Field, ...]:
    """``above`` replaces fields of the same key where they stand; new ones follow."""
    out = {f.key: f for f in below}
    out.update({f.key: f for f in above})
    return tuple(out.values())


def inherit(model: Model) -> Model:
    """Presets with the fields of those that they extend, from left to right, under their own."""
    done: dict[str, Preset] = {}

    def resolve(name: str, trail: tuple[str, ...]) -> Preset:
        if name in trail:
            raise ModelError(f"{model.name}: presets extend each other: {' > '.join((*trail, name))}")
        if name not in model.presets:
            raise ModelError(f"{model.name}.{trail[-1]}: extends the unknown preset {name!r}")
        if name not in done:
            own = model.presets[name]
            base: tuple[Field, ...] = ()
            for parent in own.extends:
                base = _overlaid(base, resolve(parent, (*trail, name)).fields)
            # Without parents fields stay as they are, even those that share a key.
            done[name] = replace(own, fields=_overlaid(base, own.fields) if own.extends else own.fields)
        return done[name]

    return replace(model, presets={name: resolve(name, ()) for name in model.presets})


def include(model: Model, template: Model) -> Model:
    """Fill up from a template: the model's relations win, key by key; the model's fields replace the template's of the
    same key where they stand, and new ones follow. A field whose alias is ``skip`` is left out on either side.
    """
    relations = dict(model.relations)
    for name, theirs in template.relations.items():
        own = relations.get(name)
        relations[name] = theirs if own is None else replace(theirs, **{f.name: v for f in fields(Relation) if (v := getattr(own, f.name))})
    presets = dict(model.presets)
    shown = lambda fs: tuple(f for f in fs if f.alias.strip() != "skip")
    for name, theirs in template.presets.items():
        own = presets.get(name)
        presets[name] = theirs if own is None else replace(own, fields=_overlaid(shown(theirs.fields), shown(own.fields)), extends=own.extends or theirs.extends)
    return replace(model, relations=relations, presets=presets)


def _linked(model: Model, models: Mapping[str, Model]) -> Model:
    relations = {}
    for name, r in model.relations.items():
        at = f"{model.name}.relations.{name}"
        if r.type not in RELATION_TYPES:
            raise ModelError(f"{at}: type must be one of {', '.join(sorted(RELATION_TYPES))}")
        if r.polymorphic:
            if r.type != "belongs_to" or r.through:
                raise ModelError(f"{at}: only a plain belongs_to can be polymorphic")
            relations[name] = replace(r, fk=r.fk or f"{name}_id", pk=r.pk or "id", type_column=r.type_column or f"{name}_type")
            continue
        if r.model not in models:
            raise ModelError(f"{at}: unknown model {r.model!r}")
        target = models[r.model]
        if r.type == "belongs_to":
            r = replace(r, fk=r.fk or f"{name}_id", pk=r.pk or target.primary_keys[0])
        else:
            r = replace(r, fk=r.fk or f"{snake(model.name)}_id", pk=r.pk or model.primary_keys[0])
        if r.through:
            if r.through not in models:
                raise ModelError(f"{at}: unknown model {r.through!r}")
            if not any(x.model == r.model for x in models[r.through].relations.values()):
                raise ModelError(f"{at}: {r.through} has no relation to {r.model}")
        relations[name] = r
    for preset in model.presets.values():
        for f in preset.fields:
            at = f"{model.name}.presets.{preset.name}.{f.key}"
            if "{" in f.source and f.type not in ("formatter", "nested_field"):
                raise ModelError(f"{at}: a template needs type formatter or nested_field")
            if f.type in ("formatter", "nested_field") and not f.alias:
                raise ModelError(f"{at}: type {f.type} needs an alias")
            if f.type == "computable" and f.source not in model.computable:
                raise ModelError(f"{at}: unknown computable {f.source!r}")
            if f.type == "preset":
                r = relations.get(f.source)
                if r is None:
                    raise ModelError(f"{at}: unknown relation {f.source!r}")
                if not r.polymorphic and f.preset not in models[r.model].presets:
                    raise ModelError(f"{at}: {r.model} has no preset {f.preset!r}")
    for name, a in model.aggregatable.items():
        if odd := sorted(set(a.functions) - AGGREGATES):
            raise ModelError(f"{model.name}.aggregatable.{name}: unknown function {odd[0]!r}")
    return replace(model, relations=relations)


def depth_of(relation: Relation, field: Field | None = None) -> int:
    return (field.max_depth if field else 0) or relation.max_depth or DEFAULT_DEPTH


def _check_cycles(models: Mapping[str, Model]) -> None:
    """A preset may come back to a model that it is inside of by a reentrant relation only."""

    def visit(model: Model, preset: Preset, seen: tuple[str, ...], hops: dict[tuple[str, str], int]) -> None:
        for f in preset.fields:
            r = model.relations.get(f.source) if f.type == "preset" else None
            if r is None or r.polymorphic:
                continue
            target, key = models[r.model], (model.name, r.name)
            if r.model in seen:
                if not r.reentrant:
                    raise ModelError(f"{model.name}.presets.{preset.name}.{f.key}: comes back to {r.model}, which needs reentrant")
                if hops.get(key, 0) >= depth_of(r, f):
                    continue
            visit(target, target.presets[f.preset], (*seen, r.model), hops | {key: hops.get(key, 0) + 1})

    for model in models.values():
        for preset in model.presets.values():
            visit(model, preset, (model.name,), {})


class Registry(dict[str, Model]):
    """Models by name, linked and checked."""

    def __init__(self, raw: Mapping[str, object], templates: Mapping[str, object] | None = None):
        parsed: dict[str, Model] = {}
        for name, one in raw.items():
            model, includes = parse(name, one)
            for template in includes:
                if template not in (templates or {}):
                    raise ModelError(f"{name}: unknown template {template!r}")
                model = include(model, inherit(parse(template, templates[template])[0]))
            if not model.table:
                raise ModelError(f"{name}: table is missing")
            parsed[name] = inherit(model)
        super().__init__({name: _linked(model, parsed) for name, model in parsed.items()})
        _check_cycles(self)

    @classmethod
    def load(cls, folder: str | Path) -> Registry:
        """From ``<folder>/<Model>.yml`` and ``<folder>/templates/<name>.yml``."""
        read = lambda path: {p.stem: yaml.safe_load(p.read_text(encoding="utf-8")) for p in sorted(path.glob("*.yml"))}
        models = read(Path(folder))
        if not models:
            raise ModelError(f"{folder}: no model files")
        return cls(models, read(Path(folder) / "templates"))
