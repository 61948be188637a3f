"""Display templates to string columns.

``{a.b}`` stands for a value, ``{a}[i]`` for one of its characters, ``{a}[i..j]`` for a half-open range of them, and
``{? condition ? then : else}`` for a choice whose branches are templates again. What doesn't parse stays as it is.
A template is parsed once and compiled to native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A path to its column and type, or None.
Lookup = Callable[[str], "tuple[Column, T.DataType] | None"]

_TOKEN = re.compile(r"\{([A-Za-z0-9_.]+)\}(?:\[(\d+)(?:\.\.(\d+))?\])?")
_COMPARE = re.compile(r"\s*(==|!=|>=|<=|=|>|<)\s*")


@dataclass(frozen=True)
class Token:
    path: str
    start: int | None = None
    stop: int | None = None


@dataclass(frozen=True)
class Choice:
    left: str
    operator: str  # empty: is the value true?
    right: object
    then: tuple
    otherwise: tuple


def _outside(text: str) -> Iterator[tuple[int, str, int]]:
    """Place, character and depth of braces of what stands outside of quotes."""
    quote, depth = "", 0
    for at, c in enumerate(text):
        if quote:
            if c == quote and text[at - 1] != "\\":
                quote = ""
        elif c in "\"'":
            quote = c
        else:
            if c == "}":
                depth -= 1
            yield at, c, depth
            if c == "{":
                depth += 1


def _closing(text: str) -> int | None:
    return next((at for at, c, depth in _outside(text) if c == "}" and depth < 0), None)


def parse(text: str) -> tuple:
    """Strings, tokens and choices, in order."""
    out: list = []
    while (begin := text.find("{?")) >= 0:
        end = _closing(text[begin + 2 :])
        if end is None:
            break
        body = text[begin + 2 : begin + 2 + end]
        out += _tokens(text[:begin])
        out.append(_choice(body) or "{?" + body + "}")
        text = text[begin + 3 + end :]
    return tuple(out + _tokens(text))


def _tokens(text: str) -> list:
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        out += [text[at : m.start()], Token(m[1], None if m[2] is None else int(m[2]), None if m[3] is None else int(m[3]))]
        at = m.end()
    return [x for x in [*out, text[at:]] if x != ""]


def _choice(body: str) -> Choice | None:
    marks = [(at, c) for at, c, depth in _outside(body) if depth == 0 and c in "?:"]
    ask = next((at for at, c in marks if c == "?"), None)
    if ask is None:
        return None
    colon = next((at for at, c in marks if c == ":" and at > ask), None)
    if colon is None:
        return None
    condition, branches = body[:ask].strip(), []
    for branch in (body[ask + 1 : colon].strip(), body[colon + 1 :].strip()):
        branches.append(() if branch.lower() == "null" else parse(_unquoted(branch)))
    m = _COMPARE.search(condition)
    if not m:
        return Choice(condition, "", None, *branches)
    operator = "==" if m[1] == "=" else m[1]
    return Choice(condition[: m.start()].strip(), operator, literal(condition[m.end() :].strip()), *branches)


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def literal(text: str) -> object:
    lower = text.lower()
    if lower in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[lower]
    if _unquoted(text) != text:
        return _unquoted(text)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def references(parts: tuple) -> list[str]:
    """All paths that the parts mention, in order."""
    out: list[str] = []
    for p in parts:
        if isinstance(p, Token):
            out.append(p.path)
        elif isinstance(p, Choice):
            out += [p.left, *references(p.then), *references(p.otherwise)]
    return list(dict.fromkeys(out))


def to_text(value: Column, kind: T.DataType) -> Column:
    """Whole floating-point numbers without a fraction; dates in ISO form; all else as Spark casts it."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def compile(parts: tuple, lookup: Lookup) -> Column:
    pieces = [_piece(p, lookup) for p in parts]
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces) if pieces else F.lit("")


def _piece(part, lookup: Lookup) -> Column:
    if isinstance(part, str):
        return F.lit(part)
    if isinstance(part, Choice):
        return F.when(_condition(part, lookup), compile(part.then, lookup)).otherwise(compile(part.otherwise, lookup))
    found = lookup(part.path)
    if found is None:
        return F.lit("")
    text = F.coalesce(to_text(*found), F.lit(""))
    if part.start is None:
        return text
    length = 1 if part.stop is None else max(0, part.stop - part.start)
    return F.substring(text, part.start + 1, length)


def _numeric(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except ValueError:
        return None


def _compare(a: Column, operator: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[operator]


def _condition(choice: Choice, lookup: Lookup) -> Column:
    """Numbers compare as numbers if both sides are, booleans as booleans, all else as text, where null is empty."""
    found = lookup(choice.left)
    if found is None:
        found = F.lit(None).cast("string"), T.StringType()
    value, kind = found
    if not choice.operator:
        if isinstance(kind, T.BooleanType):
            true = value
        elif isinstance(kind, T.StringType):
            true = value != ""
        elif isinstance(kind, T.NumericType):
            true = value != 0
        else:
            true = value.isNotNull()
        return F.coalesce(true, F.lit(False))
    right = choice.right
    if isinstance(right, bool):
        said = "true" if right else "false"
    else:
        said = "" if right is None else str(right)
    as_text = _compare(F.coalesce(to_text(value, kind), F.lit("")), choice.operator, F.lit(said))
    number = _numeric(right)
    if number is not None and isinstance(kind, T.NumericType):
        return F.when(value.isNull(), as_text).otherwise(_compare(value.cast("double"), choice.operator, F.lit(number)))
    if number is not None and isinstance(kind, T.StringType):
        tried = value.try_cast("double")
        return F.when(tried.isNull(), as_text).otherwise(_compare(tried, choice.operator, F.lit(number)))
    if isinstance(right, bool) and isinstance(kind, T.BooleanType):
        known = _compare(value, choice.operator, F.lit(right)) if choice.operator in ("==", "!=") else F.lit(False)
        return F.when(value.isNull(), as_text).otherwise(known)
    return as_text
