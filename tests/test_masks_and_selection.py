"""Masks as intervals, order statistics, and compiled schemas, each against a plain version."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.functions import validation as V
from tessera.operators import packing as P
from tessera.operators import scoring as S


@pytest.mark.parametrize("window,sinks", [(1, []), (8, [0, 1, 30]), (5, [3, 4, 5, 9]), (100, [0]), (3, [63, 2, 2])])
def test_window_masks(spark, window, sinks):
    rows = spark.range(64).select(F.col("id").alias("q"), P.window_keys(F.col("id"), window, sinks).alias("m"))
    rows = rows.select("q", "m", P.n_keys(F.col("m")).alias("n"), P.holds(F.col("m"), F.lit(2)).alias("two"), P.both_keys(F.col("m"), P.keys_up_to(F.lit(10), F.col("q"))).alias("part"))
    for r in rows.collect():
        want = {k for k in range(r.q + 1) if r.q - k < window or k in sinks}
        got = [k for i in r.m for k in range(i.lo, i.hi + 1)]
        assert got == sorted(want) and r.n == len(want) and r.two == (2 in want)
        assert [k for i in r.part for k in range(i.lo, i.hi + 1)] == sorted(k for k in want if k >= 10)
    edges = {(e["query"], e["key"]) for e in P.window_edges(64, window, sinks, spark).collect()}
    assert edges == {(q, k) for q in range(64) for k in range(q + 1) if q - k < window or k in sinks}


def test_packing_masks_equal_the_listed_edges(spark):
    spans = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 5, 6), (1, 3, 0, 9)], "row_id long, seg int, lo int, hi int")
    got = {(r.row_id, r["query"], k) for r in P.packing_keys(spans).collect() for i in r["keys"] for k in range(i.lo, i.hi + 1)}
    places = spans.select("row_id", "seg", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    assert got == {tuple(r) for r in P.packing_edges(places, "row_id", "pos", "seg").collect()}


@pytest.mark.parametrize("make", ["spread", "ties", "huge", "few"])
def test_order_statistics(spark, make):
    r = np.random.default_rng(3)
    x = {"spread": r.standard_normal(5000), "ties": r.integers(0, 6, 5000).astype(float), "huge": 10.0 ** r.integers(-300, 300, 3000), "few": np.array([2.0, 1.0])}[make]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    s, places = np.sort(x), [0, 1, len(x) // 3, len(x) - 1]
    assert S.order_statistics(df, "v", places, at_once=50) == {p: s[p] for p in places}
    for share in (0.0, 0.8, 0.999, 1.0):
        assert S.percentile(df, "v", share) == pytest.approx(np.quantile(x, share), rel=1e-12)
    with pytest.raises(ValueError):
        S.order_statistics(df, "v", [len(x)])
    assert S.percentile(df.filter("v IS NULL"), "v", 0.5) is None


def test_order_statistics_survive_a_poor_sketch(spark, monkeypatch):
    """The sketch steers and doesn't decide: bounds that miss the place leave the result right."""
    x = list(range(500))
    random.Random(1).shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    r = random.Random(2)
    monkeypatch.setattr(S.F, "percentile_approx", lambda *a: F.array(*[F.lit(float(v)) for v in sorted(r.sample(range(500), 2))]))
    assert S.order_statistics(df, "v", [7, 250, 499], at_once=5) == {7: 7.0, 250: 250.0, 499: 499.0}


def plain(v, s, path=""):
    """The checks of a schema, value by value."""
    out, at = [], lambda k: f"{path}.{k}" if path else k
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type") or []
    fits = lambda t: v is None if t == "null" else isinstance(v, kinds[t]) and (t == "boolean") == isinstance(v, bool) or t == "integer" and isinstance(v, float) and v == int(v)
    if types and not any(map(fits, types)):
        out.append(f"{path}: is not {' or '.join(types)}")
    if "enum" in s and v not in s["enum"]:
        out.append(f"{path}: is not one of the choices")
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    rules = {"minimum": lambda b: not number or v >= b, "maximum": lambda b: not number or v <= b, "exclusiveMinimum": lambda b: not number or v > b, "exclusiveMaximum": lambda b: not number or v < b, "multipleOf": lambda b: not number or v % b == 0, "minLength": lambda b: not isinstance(v, str) or len(v) >= b, "maxLength": lambda b: not isinstance(v, str) or len(v) <= b, "minItems": lambda b: not isinstance(v, list) or len(v) >= b, "maxItems": lambda b: not isinstance(v, list) or len(v) <= b}
    out += [f"{path}: {k} {s[k]}" for k, ok in rules.items() if k in s and not ok(s[k])]
    if isinstance(v, list) and "items" in s:
        out += [p for i, x in enumerate(v) for p in plain(x, s["items"], f"{path}[{i}]")]
    if isinstance(v, dict) and s.get("properties"):
        for k, inner in s["properties"].items():
            out += plain(v[k], inner, at(k)) if k in v else [f"{at(k)}: is missing"] if k in s.get("required", []) else []
        out += [f"{at(k)}: is not declared" for k in sorted(set(v) - set(s["properties"]))]
    return out


SCHEMA = {
    "type": "object", "required": ["a", "b"],
    "properties": {
        "a": {"type": "integer", "minimum": 0, "exclusiveMaximum": 10, "multipleOf": 2}, "b": {"type": "string", "minLength": 1, "maxLength": 3, "enum": ["x", "yy", "zzzz"]}, "c": {"type": ["number", "null"], "maximum": 5},
        "d": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "boolean"}}, "it's": {"type": "object", "properties": {"k": {"type": "integer", "description": "deep"}}, "required": ["k"]},
    },
}


def test_violations_and_types(spark):
    r = random.Random(5)
    values = [None, True, 0, 2, 3, 10, 2.0, 2.5, -1, "x", "", "yy", "zzzz", [], [True], [1, None], [True, False, True], {}, {"k": 1}, {"k": "1", "z": 2}]
    rows = [{k: r.choice(values) for k in [*SCHEMA["properties"], "e"] if r.random() < 0.7} for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)] + [(-1, "[1]"), (-2, None), (-3, "{bad")], "i int, t string")
    a = F.try_parse_json("t")
    got = {x.i: (x.p, x.v) for x in df.select("i", V.violations(a, SCHEMA).alias("p"), V.typed(a, SCHEMA).alias("v")).collect()}
    for i, x in enumerate(rows):
        assert got[i][0] == plain(x, SCHEMA), x
        assert got[i][1].b == (x["b"] if isinstance(x.get("b"), str) else got[i][1].b)
    assert all(got[i][0] == ["the arguments are not an object"] for i in (-1, -2, -3))
    assert V.struct_type(SCHEMA).simpleString() == "struct<a:bigint,b:string,c:double,d:array<boolean>,it's:struct<k:bigint>>"
    assert [f.nullable for f in V.struct_type(SCHEMA).fields] == [False, False, True, True, True]


def test_calls_to_several_tools(spark):
    def go(where: str, far: int = 3): ...
    def stop(): ...

    tools = [R.build_schema(go), R.build_schema(stop)]
    df = spark.createDataFrame([("go", '{"where": "n"}'), ("go", '{"far": "x"}'), ("stop", "{}"), ("jump", "{}"), (None, "{}")], "n string, a string")
    got = [r.p for r in df.select(V.checked(F.col("n"), F.try_parse_json("a"), tools).alias("p")).collect()]
    assert got == [[], ["where: is missing", "far: is not integer"], [], ["no tool jump"], ["no tool null"]]
    assert df.select(V.typed(F.try_parse_json("a"), tools[0]["parameters"]).alias("v")).first().v == ("n", 3)
