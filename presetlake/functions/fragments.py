"""SQL fragments of models: computed columns, and the conditions of relations.

Names are resolved to the unique columns of a plan before Spark parses the text, so that self joins never make a name
ambiguous. Quoted text is never touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container

_PIECES = re.compile(r"'(?:[^']|'')*'|\{[^{}]*\}(?:\.[A-Za-z_]\w*)?|`[^`]*`|\"[^\"]*\"|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|\d+(?:\.\d+)?|\.[A-Za-z_]\w*|\s+|.", re.S)
_AGGREGATE = re.compile(r"\b(?:sum|count|avg|min|max)\s*\(", re.I)
_BARE_SELECT = re.compile(r"^\(\s*select\s+(?P<what>.+)\)$", re.I | re.S)


def pieces(text: str) -> list[str]:
    return _PIECES.findall(text)


def strip_select(text: str) -> str:
    """``(select x)`` without FROM is ``(x)``."""
    m = _BARE_SELECT.match(text.strip())
    return f"({m['what']})" if m and not any(p.lower() == "from" for p in pieces(m["what"])) else text.strip()


def is_subquery(text: str) -> bool:
    return any(p.lower() == "select" for p in pieces(text))


def is_aggregate(text: str) -> bool:
    """Whether it aggregates the rows of a relation, rather than those of a subquery of its own."""
    return not is_subquery(text) and any(_AGGREGATE.search(x) for x in re.split(r"'(?:[^']|'')*'", text))


def placeholders(text: str) -> list[tuple[str, str]]:
    """What stands in the braces and the column that follows them, if any, of each placeholder."""
    out = []
    for p in pieces(text):
        if p.startswith("{"):
            inside, _, after = p[1:].partition("}")
            out.append((inside.strip(), after.strip().lstrip(".").strip()))
    return out


def rewrite(text: str, placeholder: Callable[[str, str], str], own: Callable[[str], str], columns: Container[str], table: Callable[[str], str] | None = None) -> str:
    """SQL over a plan's columns.

    ``placeholder`` names the column of a placeholder, ``own`` that of a column of the text's model, ``columns`` are
    these, ``table`` names a view for a table of a subquery. ``.x``, ``main.x`` and, outside of subqueries, ``x`` are
    columns of the model. ``concat`` passes over nulls.
    """
    found, out, nested, expects = pieces(text), [], is_subquery(text), False
    for at, p in enumerate(found):
        following = next((x for x in found[at + 1 :] if x.strip()), "")
        if p.startswith("{"):
            inside, _, after = p[1:].partition("}")
            out.append(placeholder(inside.strip(), after.strip().lstrip(".").strip()))
        elif p[0] == "." and len(p) > 1:
            out.append(own(p[1:].strip()))
        elif p[0] == '"':
            out.append(own(p[1:-1]) if p[1:-1] in columns else p.replace('"', "`"))
        elif re.match(r"[A-Za-z_]", p):
            parts = [x.strip() for x in p.split(".")]
            if expects and table:
                out.append(table(p))
            elif len(parts) == 2 and parts[0] == "main" and parts[1] in columns:
                out.append(own(parts[1]))
            elif len(parts) == 1 and p.lower() == "concat" and following == "(":
                out.append("concat_ws('', ")
            elif len(parts) == 1 and p in columns and following != "(" and not nested:
                out.append(own(p))
            else:
                out.append(p)
            expects = p.lower() in ("from", "join")
            continue
        elif p == "(" and out and out[-1] == "concat_ws('', ":
            continue
        else:
            out.append(p)
        if p.strip():
            expects = False
    return "".join(out)
