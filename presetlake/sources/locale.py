"""Dictionaries and date layouts for localization."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

import yaml

#: Parts of layouts that are written as a reference time, and Spark's letters for them.
LAYOUT = (
    ("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "EEE"), ("01", "MM"), ("02", "dd"), ("15", "HH"),
    ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("MST", "zzz"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"),
)
_OPTIONS = {"date": ("date", "2006-01-02"), "time": ("ttime", "15:04:05"), "datetime": ("datetime", "2006-01-02 15:04:05")}


def spark_pattern(layout: str) -> str:
    """``02.01.2006`` to ``dd.MM.yyyy``; letters that aren't part of a layout are quoted."""
    out, at = "", 0
    while at < len(layout):
        for theirs, ours in LAYOUT:
            if layout.startswith(theirs, at):
                out, at = out + ours, at + len(theirs)
                break
        else:
            c = layout[at]
            out, at = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), at + 1
    return out


@dataclass(frozen=True)
class Locale:
    """``words`` is the tree of model, preset, field and value; ``layouts`` has Spark patterns by field type."""

    words: Mapping = field(default_factory=dict)
    layouts: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Locale:
        return cls.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    @classmethod
    def of(cls, raw: Mapping) -> Locale:
        settings = raw.get("layoutSettings") or {}
        layouts = {kind: spark_pattern(str(settings.get(name) or default)) for kind, (name, default) in _OPTIONS.items()}
        return cls({k: v for k, v in raw.items() if k != "layoutSettings"}, layouts)

    def values(self, model: str, preset: str, keys: tuple[str, ...]) -> dict[str, str]:
        """Texts by value for a field.

        Each value is looked for under the first key and then the others; under each key in model, preset and field, then
        in preset and field, then in the field alone.
        """
        found: dict[str, str] = {}
        for key in reversed(keys):
            for path in ((key,), (preset, key), (model, preset, key)):
                node: object = self.words
                for step in path:
                    node = node.get(step) if isinstance(node, Mapping) else None
                if isinstance(node, Mapping):
                    found |= {str(k).lower() if isinstance(k, bool) else str(k): str(v) for k, v in node.items() if not isinstance(v, Mapping)}
        return found
