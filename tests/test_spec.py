"""Model files: includes, inheritance, validation, links."""

import copy

import pytest
import yaml

from presetlake.spec.loader import Registry
from presetlake.spec.types import ModelError, snake


def f(source, type="string", **more):
    return {"source": source, "type": type, **more}


def keys(model, preset):
    return [x.key for x in model.presets[preset].fields]


def test_snake():
    assert [snake(x) for x in ("Person", "PersonProfile", "HTTPLog")] == ["person", "person_profile", "http_log"]


def test_inheritance_overrides_in_place():
    raw = {"A": {"table": "a", "presets": {
        "one": {"fields": [f("id", "int"), f("x"), f("y")]},
        "two": {"fields": [f("z"), f("x", alias="y")]},
        "both": {"extends": "one, two", "fields": [f("id", "string"), f("w")]},
        "third": {"extends": ["both"], "fields": []},
    }}}
    a = Registry(raw)["A"]
    assert keys(a, "both") == ["id", "x", "y", "z", "w"] == keys(a, "third")
    by = {x.key: x for x in a.presets["both"].fields}
    assert by["id"].type == "string" and by["y"].source == "x"


@pytest.mark.parametrize("presets", [{"a": {"extends": "b"}, "b": {"extends": "a"}}, {"a": {"extends": "a"}}, {"a": {"extends": "nowhere"}}])
def test_broken_inheritance(presets):
    with pytest.raises(ModelError):
        Registry({"A": {"table": "a", "presets": presets}})


def test_includes_fill_up(tmp_path):
    model = {"table": "people", "include": "shared", "relations": {"boss": {"type": "belongs_to", "model": "Person", "fk": "chief"}}, "presets": {"item": {"fields": [f("id", "int"), f("a"), f("gone", alias="skip")]}}}
    shared = {"relations": {"boss": {"type": "belongs_to", "model": "Person", "fk": "x", "reentrant": True}, "mate": {"type": "has_one", "model": "Person"}}, "presets": {"item": {"fields": [f("a", "int"), f("b"), f("c", alias="skip")]}, "more": {"extends": "item", "fields": [f("d")]}}}
    (tmp_path / "templates").mkdir()
    (tmp_path / "Person.yml").write_text(yaml.safe_dump(model))
    (tmp_path / "templates" / "shared.yml").write_text(yaml.safe_dump(shared))
    person = Registry.load(tmp_path)["Person"]
    assert keys(person, "item") == ["a", "b", "id"] and person.presets["item"].fields[0].type == "string"
    assert (person.relations["boss"].fk, person.relations["boss"].reentrant) == ("chief", True)
    assert person.relations["mate"].fk == "person_id" and "d" in keys(person, "more")
    with pytest.raises(ModelError):
        Registry({"P": {"table": "p", "include": "nothing"}})


BASE = {
    "A": {"table": "a", "relations": {"bs": {"type": "has_many", "model": "B"}}, "presets": {"item": {"fields": [f("id", "int")]}, "deep": {"fields": [f("bs", "preset", preset="item")]}}},
    "B": {"table": "b", "relations": {"a": {"type": "belongs_to", "model": "A"}}, "presets": {"item": {"fields": [f("id", "int")]}}},
}


def test_defaults():
    made = Registry(copy.deepcopy(BASE))
    assert (made["A"].relations["bs"].fk, made["A"].relations["bs"].pk) == ("a_id", "id")
    assert (made["B"].relations["a"].fk, made["B"].relations["a"].pk) == ("a_id", "id")


@pytest.mark.parametrize(
    "path, value",
    [
        (("A", "colour"), 1),
        (("A", "table"), None),
        (("A", "relations", "bs", "type"), "has_few"),
        (("A", "relations", "bs", "model"), "Z"),
        (("A", "relations", "bs", "through"), "B"),
        (("A", "relations", "bs", "polymorphic"), True),
        (("A", "relations", "bs", "colour"), 1),
        (("A", "presets", "item", "fields", 0, "type"), "number"),
        (("A", "presets", "item", "fields", 0, "source"), "{id}"),
        (("A", "presets", "deep", "fields", 0, "preset"), "nothing"),
        (("A", "presets", "deep", "fields", 0, "source"), "nothing"),
        (("A", "aggregatable"), {"id": {"functions": "median"}}),
        (("A", "computable"), {"x": {"sql": "1"}}),
        (("B", "presets", "item", "fields", 0), f("a", "preset", preset="deep")),  # A > B > A isn't reentrant
    ],
)
def test_refusals(path, value):
    raw = copy.deepcopy(BASE)
    at = raw
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    with pytest.raises(ModelError):
        Registry(raw)


def test_reentrant_cycles_pass():
    raw = copy.deepcopy(BASE)
    raw["B"]["relations"]["a"]["reentrant"] = raw["A"]["relations"]["bs"]["reentrant"] = True
    raw["B"]["presets"]["item"]["fields"].append(f("a", "preset", preset="deep"))
    assert "A" in Registry(raw)
