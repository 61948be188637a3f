"""Models from a Prisma schema file, read line by line."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

from presetlake.importers import naming

#: Prisma's scalar types and the field types for them.
SCALARS = {"Int": "int", "BigInt": "int", "Float": "float", "Decimal": "float", "Boolean": "bool", "DateTime": "datetime", "String": "string", "Json": "string", "Bytes": "string"}

_BLOCK = re.compile(r"^\s*(model|enum)\s+(\w+)\s*\{(.*?)^\s*\}", re.M | re.S)
_FIELD = re.compile(r"^(\w+)\s+(\w+)(\[\])?\??(.*)$")


def _listed(text: str, key: str) -> list[str]:
    m = re.search(key + r"\s*:\s*\[([^\]]*)\]", text)
    return [x.strip() for x in m[1].split(",") if x.strip()] if m else []


def read(schema: str) -> tuple[dict[str, dict], dict[str, dict[int, str]]]:
    """Model mappings, and texts for the numbers that stand for enum values, by column.

    An enum column is an int that is localized. Relations of one column each way are taken; a composite ``@@id`` names
    the primary key but identifies no row for presets.
    """
    schema = re.sub(r"//.*", "", schema)
    enums: dict[str, list[str]] = {}
    models: dict[str, dict] = {}
    for kind, name, body in _BLOCK.findall(schema):
        lines = [line.strip() for line in body.splitlines() if line.strip()]
        if kind == "enum":
            enums[name] = [line.split()[0] for line in lines if not line.startswith("@@")]
        else:
            models[name] = {"lines": lines}
    for name, model in models.items():
        model |= {"table": name, "columns": {}, "keys": [], "parents": {}, "lists": [], "enums": {}}
        for line in model["lines"]:
            if m := re.match(r'@@map\("([^"]+)"\)', line):
                model["table"] = m[1]
            elif m := re.match(r"@@id\(\s*(?:fields\s*:\s*)?\[([^\]]+)\]", line):
                model["keys"] = [x.strip() for x in m[1].split(",")]
            elif not line.startswith("@@") and (m := _FIELD.match(line)):
                field, kind, many, rest = m.groups()
                if kind in models:
                    label = re.search(r'@relation\((?:\s*name\s*:)?\s*"([^"]+)"|name\s*:\s*"([^"]+)"', rest)
                    own = label and (label[1] or label[2])
                    if many:
                        model["lists"].append((field, kind, own))
                    elif len(fks := _listed(rest, "fields")) == 1 and len(refs := _listed(rest, "references")) == 1:
                        model["parents"][naming.relation_name(fks[0])] = ({"type": "belongs_to", "model": kind, "fk": fks[0], "pk": refs[0]}, own)
                elif not many and (kind in SCALARS or kind in enums):
                    model["columns"][field] = "UUID" if "@db.Uuid" in rest else SCALARS.get(kind, "int")
                    if kind in enums:
                        model["enums"][field] = kind
                    if re.search(r"@id\b", rest):
                        model["keys"] = [field]
    out: dict[str, dict] = {}
    words: dict[str, dict[int, str]] = {}
    for name, model in sorted(models.items()):
        children = []
        for other, theirs in models.items():
            for relation, label in theirs["parents"].values():
                if relation["model"] == name:
                    own = next((f for f, kind, said in model["lists"] if kind == other and said == label), None)
                    children.append((own or theirs["table"].lower(), {"type": "has_many", "model": other, "fk": relation["fk"], "pk": relation["pk"]}))
        made = naming.model(model["table"], model["columns"], model["keys"], {k: r for k, (r, _) in model["parents"].items()}, children, model["enums"])
        if made:
            out[name] = made
            for column, enum in model["enums"].items():
                words.setdefault(column, {}).update({i: v for i, v in enumerate(enums[enum]) if i not in words.get(column, {})})
    return out, words


def merge_words(path: str | Path, words: dict[str, dict[int, str]]) -> None:
    """Add to a locale file the texts that it lacks; those that it has stay."""
    path = Path(path)
    held = (yaml.safe_load(path.read_text(encoding="utf-8")) if path.exists() else None) or {}
    for column, values in words.items():
        own = {str(k): v for k, v in (held.get(column) or {}).items()} if isinstance(held.get(column), dict) else {}
        held[column] = {str(k): v for k, v in values.items()} | own
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(held, allow_unicode=True, sort_keys=True), encoding="utf-8")
