"""Presets from nested selections, such as a client's query asks for.

A selection is a list of names, of ``{alias: name}`` mappings for renamed fields, and of ``{name: [...]}`` mappings (or
``{"alias:name": [...]}``) for relations.
"""

from __future__ import annotations

import copy
import hashlib


def _parsed(selection: list) -> list[tuple[str, str, list]]:
    """Alias (or empty), name and what is selected inside, of each field."""
    out = []
    for one in selection:
        for key, inner in [(one, [])] if isinstance(one, str) else one.items():
            if isinstance(inner, str):
                key, inner = f"{key}:{inner}", []
            alias, _, name = key.rpartition(":")
            out.append((alias if alias != name else "", name, inner))
    return out


def _signature(selection: list) -> str:
    return ",".join((f"{alias}:{name}" if alias else name) + (f"{{{_signature(inner)}}}" if inner else "") for alias, name, inner in _parsed(selection))


def preset_name(root: str, operation: str, selection: list, path: tuple[str, ...] = ()) -> str:
    """``<root>__<operation>__<hash of the shape>__<path>``."""
    shape = hashlib.sha1(_signature(selection).encode()).hexdigest()[:8]
    return "__".join([path[0] if path else root, *([operation] if operation else []), shape, *path])


def add_presets(models: dict[str, dict], root: str, selection: list, operation: str = "", replace: bool = False) -> tuple[dict[str, dict], list[str]]:
    """Models with the presets that a selection on a root field needs, and warnings of what was passed over.

    The root field's model is its name with capitals: ``user_card`` asks ``UserCard``. Presets of the same name stay
    unless ``replace`` is given. Columns that no preset has a type for are strings.
    """
    models, warnings = copy.deepcopy(models), []
    model = "".join(p[:1].upper() + p[1:] for p in root.strip().split("_"))
    if model not in models:
        return models, [f"root field {root!r}: no model {model!r}"]

    def build(name: str, chosen: list, path: tuple[str, ...]) -> str:
        own = models[name]
        types = {f["source"]: f["type"] for p in (own.get("presets") or {}).values() for f in p.get("fields") or () if f.get("type") not in (None, "preset")}
        fields = []
        for alias, column, inner in _parsed(chosen):
            field = {"source": column} | ({"alias": alias} if alias else {})
            if not inner:
                if column not in types:
                    warnings.append(f"{name}.{column}: taken for a string")
                fields.append(field | {"type": types.get(column, "string")})
                continue
            relation = (own.get("relations") or {}).get(column)
            if relation is None or relation.get("model") not in models:
                warnings.append(f"{name}.{column}: {'relation' if relation is None else 'model'} not found")
                continue
            fields.append(field | {"type": "preset", "preset": build(relation["model"], inner, (*path, column))})
        made = preset_name(root, operation, chosen, path)
        presets = own.setdefault("presets", {})
        if replace or made not in presets:
            presets[made] = {"fields": fields}
        return made

    build(model, selection, ())
    return models, warnings
