"""Templates against a table of rows and texts, and random ones against a plain evaluator."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presetlake.functions import formatter

BOAT = {"boat": {"call": "Möwe", "port": "Kiel"}, "crew": 5, "draft": 1.5, "length": 12.0, "moored": True, "sold": False, "flag": None, "note": ""}
CASES = [
    # Tokens, indexes, ranges
    ("{boat.call} of {boat.port}", "Möwe of Kiel"),
    ("{boat.call}[1]", "ö"),
    ("{boat.call}[0..2]|{boat.call}[2..9]|{boat.call}[9]", "Mö|we|"),
    ("{boat.port}[3..3]{boat.port}[3..2].", "."),
    ("{crew} hands, {draft} m deep, {length} m long", "5 hands, 1.5 m deep, 12 m long"),
    ("<{flag}><{none.such}><{note}>", "<><><>"),
    ("{crew} {open", "5 {open"),
    ("{? crew }", "{? crew }"),
    # Conditions
    ("{? moored ? in : out}/{? sold ? in : out}", "in/out"),
    ("{? crew > 4 ? 1 : 0}{? crew >= 6 ? 1 : 0}{? crew < 5 ? 1 : 0}{? crew <= 5 ? 1 : 0}", "1001"),
    ('{? boat.port == "Kiel" ? "home" : "away"}', "home"),
    ("{? boat.port = Kiel ? home : away} {? boat.port != 'Kiel' ? 'far' : 'near'}", "home near"),
    ("{? moored == true ? true : false}{? moored == \"true\" ? 'T' : 'F'}{? sold == true ? 'T' : 'F'}", "trueTF"),
    ('{? flag != null ? "{flag}" : null}{? flag ? "some" : "no"} flag', "no flag"),
    ('{? note == "" ? null : "{note}[0]."}{? note ? "N" : "-"}', "-"),
    ('{? boat.call == "" ? null : "{boat.call}[0]."}', "M."),
    ('{? crew ? "manned" : "empty"} {? crew >= "5" ? "full" : "short"}', "manned full"),
    ('{? boat.call > 9 ? "text" : "number"}', "text"),
    ('{? moored ? "{? crew > 8 ? "large" : "small"}" : "gone"}, {? sold ? "{? crew > 8 ? "a" : "b"}" : "kept"}', "small, kept"),
    ('{? moored ? "⚓" : "⛵"} {boat.call}[0] {? draft > 1 ? "(deep)" : ""}', "⚓ M (deep)"),
]
KINDS = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}


def schema(row):
    return ", ".join(f"{k} struct<{schema(v).replace(' ', ':').replace(',:', ',')}>" if isinstance(v, dict) else f"{k} {KINDS[type(v)]}" for k, v in row.items())


def lookup_in(df):
    def lookup(path):
        kind = df.schema
        for step in path.split("."):
            if not hasattr(kind, "names") or step not in kind.names:
                return None
            kind = kind[step].dataType
        return F.col(path), kind

    return lookup


def texts(spark, row, templates):
    df = spark.createDataFrame([row], schema(row))
    made = df.select(*(formatter.compile(formatter.parse(t), lookup_in(df)).alias(f"t{n}") for n, t in enumerate(templates)))
    return list(made.first())


def test_templates(spark):
    got = texts(spark, BOAT, [t for t, _ in CASES])
    for (template, want), text in zip(CASES, got):
        assert text == want, template


def test_a_zero_is_false_and_a_text_that_is_no_number_is_larger(spark):
    assert texts(spark, {"n": 0, "s": "10", "x": "x"}, ['{? n ? "A" : "B"}', '{? s > 9 ? "A" : "B"}', '{? x > 9 ? "A" : "B"}']) == ["B", "A", "A"]


@st.composite
def template(draw):
    """A template and its text for the row of ``test_random_templates``, put together from parts."""
    row, text, want = {"a": "héllo", "b": "xyz", "n": 7}, "", ""
    for _ in range(draw(st.integers(1, 5))):
        kind, key = draw(st.integers(0, 4)), draw(st.sampled_from(sorted(row)))
        value, i, j = str(row[key]), draw(st.integers(0, 6)), draw(st.integers(0, 6))
        word = draw(st.text("pqr .-", min_size=1, max_size=3))
        limit = draw(st.integers(0, 12))
        parts = {
            0: (word, word),
            1: (f"{{{key}}}", value),
            2: (f"{{{key}}}[{i}]", value[i : i + 1]),
            3: (f"{{{key}}}[{i}..{j}]", value[i:j] if i < j else ""),
            4: (f'{{? n > {limit} ? "{{{key}}}[{i}]" : "{word.strip()}"}}', value[i : i + 1] if row["n"] > limit else word.strip()),
        }[kind]
        text, want = text + parts[0], want + parts[1]
    return text, want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(template(), min_size=20, max_size=20))
def test_random_templates(spark, made):
    assert texts(spark, {"a": "héllo", "b": "xyz", "n": 7}, [t for t, _ in made]) == [want for _, want in made]


def test_a_full_key_comes_before_a_walk():
    from pyspark.sql import types as T

    from presetlake.plans.shape import Shown, _find

    inner = Shown(None, T.StringType())
    shown = {"boat.call": Shown(None, T.LongType()), "boat": Shown(None, T.StructType(), {"call": inner})}
    assert isinstance(_find(shown, "boat.call").type, T.LongType) and _find({"boat": shown["boat"]}, "boat.call") is inner


@pytest.mark.parametrize("template, paths", [("{a.b} {? c > 1 ? '{d}' : e}", ["a.b", "c", "d"]), ("{p[0].x}", [])])
def test_references(template, paths):
    assert formatter.references(formatter.parse(template)) == paths
