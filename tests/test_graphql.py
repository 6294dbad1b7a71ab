"""GraphQL schemas from recorded calls."""

import json

import pytest

from quillspan.operators import graphql


def test_documents():
    said = graphql._Document('query Q($id: ID!, $n: [Int!] = [3]) @x(a: 1) { user(id: $id, o: {x: [1]}) { id name: full ...F ... on Admin { level } } } # c } \n fragment F on User { email ...F }')
    root = said.operations[0]["selections"][0]
    assert (root.name, root.args) == ("user", [("id", ("variable", "id")), ("o", ("object", [("x", ("list", [("Int", None)]))]))])
    assert [(n.name, n.keys) for n in said.nodes(root.inner).values()] == [("id", ["id"]), ("full", ["name"]), ("email", ["email"]), ("level", ["level"])]
    assert {k: [s.name for s in v] for k, v in said.members(root.inner).items()} == {"User": ["email", "F"], "Admin": ["level"]}
    for broken in ("{", "query {", "type A { x: Int }", "{ a(", "{ ... on }", "{ a }}", "{ a {} }", "{a" * 80 + "}" * 80):
        with pytest.raises(ValueError):
            graphql._Document(broken)


def _sdl(spark, *calls):
    """Calls (query, variables, data) as a schema's text."""
    rows = [(i, json.dumps({"query": q, "variables": v}).encode(), (json.dumps({"data": d}).encode(),)) for i, (q, v, d) in enumerate(calls)]
    return graphql.document(graphql.schema(graphql.observe(spark.createDataFrame(rows, "seq long, body binary, response struct<body:binary>")))).collect()[0]["sdl"]


def test_types_are_named_by_place_and_first_kinds_stay(spark):
    """Unrelated items stay apart; Int stays against a later Float and takes the place of a text; ids are what they are."""
    got = _sdl(
        spark,
        ("{ u { items { p } id x } }", {}, {"u": {"items": [{"p": 1}], "id": "a", "x": None}}),
        ("{ w { items { z } } }", {}, {"w": {"items": {"z": True}}}),
        ("query Again { u { x id extra } }", {}, {"u": {"x": 2, "id": 7, "extra": 1.5}}),
        ("query Late { u { x } }", {}, {"u": {"x": 2.5}}),
    )
    assert got.split("\n\n")[1:] == [
        "type Query {\n  u: UResponse\n  w: WResponse\n}",
        "type UResponse {\n  extra: Float\n  id: Int\n  items: [U_ItemsResponse]\n  x: Int\n}",
        "type U_ItemsResponse {\n  p: Int\n}",
        "type WResponse {\n  items: W_ItemsResponse\n}",
        "type W_ItemsResponse {\n  z: Boolean\n}\n",
    ]


def test_alike_calls_count_once_in_whatever_order_they_select(spark):
    assert "b: Int" in _sdl(spark, ("{ q { a b } }", {}, {"q": {"a": 1, "b": 1}}), ("{ q { b a } }", {}, {"q": {"b": 1.5, "a": "x"}}))


def test_unions_take_over_plain_types(spark):
    got = _sdl(spark, ("{ q { a b } }", {}, {"q": {"a": 1, "b": "x"}}), ("{ q { own ... on A { a } ... on B { c } } }", {}, {"q": [{"own": 1, "a": None, "c": 2}]}))
    assert "union QResult = A | B" in got and "QResponse" not in got and "q: [QResult]" in got
    assert "type A {\n  a: String\n  b: String\n  own: Int\n}" in got and "type B {\n  c: Int\n  own: Int\n}" in got


def test_like_types_tell_each_other(spark):
    got = _sdl(spark, ("{ a { x y z w } }", {}, {"a": {"x": None, "y": 1, "z": True, "w": 1}}), ("{ b { x y z } }", {}, {"b": {"x": 5, "y": None, "z": None}}), ("{ c { x q r } }", {}, {"c": {"x": None, "q": 1, "r": 1}}))
    assert "type AResponse {\n  w: Int\n  x: Int\n  y: Int\n  z: Boolean\n}" in got and "type BResponse {\n  x: Int\n  y: Int\n  z: Boolean\n}" in got and "type CResponse {\n  q: Int\n  r: Int\n  x: String\n}" in got


def test_arguments_enums_scalars_and_what_cannot_be_read(spark):
    call = "query Q($i: In!, $e: [E!]!, $d: Date, $u: [Un]) { q(i: $i, e: $e, d: $d, u: $u, n: null, l: [[1.5]], o: {p: {q: $d}}) }"
    got = _sdl(spark, (call, {"i": [{"a": [], "b": [{"c": 1}]}], "e": ["Y", "X"], "d": None}, {"q": "text"}), ("{", {}, {}), ("fragment F on A { a }", {}, {}))
    assert "q(d: Date, e: [E!]!, i: In!, l: [[Float]], n: String, o: Q_OInput, u: [Un]): String" in got
    assert "input In {\n  a: [String]\n  b: [In_B]\n}" in got and "input Q_OInput_P {\n  q: Date\n}" in got
    assert "enum E {\n  X\n  Y\n}" in got and "scalar Date\n" in got and "scalar Un\n" in got
    assert _sdl(spark, ("{", {}, {})) == "# Inferred from observed traffic\n"
