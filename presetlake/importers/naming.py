"""Names and first presets of imported models."""

from __future__ import annotations

from collections.abc import Container, Mapping

#: Scores by which a column is taken to be a row's name, for whole names and for parts of names.
NAMES = {"name": 100, "full_name": 95, "short_name": 92, "title": 90, "label": 88, "display_name": 87}
PARTS = ((("name",), 70), (("title", "label"), 50), (("code", "number"), 30))
TEXT, OTHER = 25, 5
#: Plurals that follow no rule.
IRREGULAR = {"people": "person", "statuses": "status"}


def singular(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith("ies") and len(word) > 3:
        return word[:-3] + "y"
    if word.endswith(("sses", "shes", "ches", "xes", "zes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def model_name(table: str) -> str:
    return "".join(singular(p).capitalize() for p in table.strip().lower().split("_") if p)


def relation_name(column: str) -> str:
    """``author_id`` and ``authorId`` to ``author``."""
    if len(column) > 2 and column.endswith("Id"):
        return column[:-2]
    column = column.strip().lower()
    return column[:-3] if column.endswith("_id") and len(column) > 3 else column


def free(base: str, taken: Container[str]) -> str:
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    return name


def id_column(columns: Mapping[str, str], keys: list[str]) -> str | None:
    return "id" if "id" in columns else keys[0] if len(keys) == 1 and keys[0] in columns else None


def name_column(columns: Mapping[str, str], apart: str) -> str | None:
    """The first of the best: of columns other than the id, which makes the most of a name?"""

    def score(column: str) -> int:
        low = column.lower()
        return NAMES.get(low, 0) + sum(points for words, points in PARTS if any(w in low for w in words)) + (TEXT if columns[column] == "string" else OTHER)

    rest = [c for c in columns if c != apart]
    return max(rest, key=score) if rest else None


def model(table: str, columns: Mapping[str, str], keys: list[str], parents: Mapping[str, dict], children: list[tuple[str, dict]], localized: Container[str] = ()) -> dict | None:
    """A model's mapping from its columns' types, its belongs_to relations, and the (name, relation) pairs of tables that refer to it.

    Presets: ``item`` with id and name, ``full_info`` with all columns and parents if there are over two columns, and
    ``with_<relation>`` for each has_many. None, if no column identifies a row.
    """
    own = id_column(columns, keys)
    if own is None:
        return None
    field = lambda c: {"source": c, "type": columns[c]} | ({"localize": True} if c in localized else {})
    item = [{"source": own, "type": columns[own]} | ({} if own == "id" else {"alias": "id"})]
    if name := name_column(columns, own):
        item.append({"source": name, "type": columns[name]})
    item += [field(c) for c in sorted(columns) if c in localized and c != name]
    presets = {"item": {"fields": item}}
    relations = dict(parents)
    if len(columns) > 2:
        presets["full_info"] = {"fields": [field(c) for c in columns] + [{"source": r, "type": "preset", "preset": "item"} for r in parents]}
    for base, relation in children:
        relations[free(base, relations)] = relation
    for name, relation in relations.items():
        if relation["type"] == "has_many":
            presets[free(f"with_{name}", presets)] = {"fields": [{"source": name, "type": "preset", "preset": "item"}]}
    made = {"table": table, "relations": relations, "presets": presets}
    return made if own == "id" else made | {"primary_keys": [own]}
