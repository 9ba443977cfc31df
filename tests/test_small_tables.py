import pytest
from pyspark.sql import functions as F

from tessera.operators import names as N
from tessera.operators import retrieval as Q
from tessera.operators import suite as U


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_leaf_rules(spark):
    df = spark.createDataFrame([("attn.out.kernel", [2, 3, 4], [0.0, 1.0]), ("head_a.q.kernel", [2], [1.0]), ("attn.q.kernel", [2], [0.0]), ("attn.q.bias", [1], [1.0]), ("memory.table.kernel", [1, 1, 1], [1.0])], "name string, shape array<int>, values array<double>")
    assert rows(N.adapter_targets(df, ["out", "q"], "attn", ["head"])) == [("attn.out.kernel",)]
    with pytest.raises(ValueError):
        N.adapter_targets(df, ["nope"], "attn", [])
    got = df.select("name", N.is_matrix(F.col("name"), F.col("shape"), ["table"]), N.in_families(F.col("name"), ["head"]))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {"attn.out.kernel": (True, False), "head_a.q.kernel": (False, True), "attn.q.kernel": (False, False), "attn.q.bias": (False, False), "memory.table.kernel": (False, False)}
    paths = spark.createDataFrame([("net/attn/out/kernel",), ("net/out/attn",), ("x",)], "path string")
    names = spark.createDataFrame([("attn.out",), ("attn",), ("out.kernel",)], "name string")
    assert rows(N.match_runs(paths, names)) == [("net/attn/out/kernel", "out.kernel"), ("net/out/attn", "attn")]


def test_gather_restack_pairs_and_markers(spark):
    mem = spark.createDataFrame([(0, 5, [1.0]), (1, 7, [2.0, 3.0])], "table int, slot int, values array<double>")
    asked = spark.createDataFrame([(9, 1, 7), (9, 0, 5)], "pos int, table int, slot int")
    assert rows(N.gather(asked, mem, ["pos"])) == [(9, [1.0, 2.0, 3.0])]
    lay = spark.createDataFrame([("a", 1, [2.0]), ("a", 0, [1.0]), ("b", -1, [5.0])], "name string, layer int, values array<double>")
    assert rows(N.restack(lay)) == [("a", [1.0, 2.0]), ("b", [5.0])]
    a, b = spark.createDataFrame([(10, "x"), (30, "y")], "o long, p string"), spark.createDataFrame([(5, "u"), (7, "v")], "o long, q string")
    assert [(r.p, r.q) for r in N.positional(a, b, "o").orderBy("ix").collect()] == [("x", "u"), ("y", "v")]
    with pytest.raises(ValueError):
        N.positional(a, b.limit(1), "o")
    from tessera.functions.text import MARKERS

    v = spark.createDataFrame([(i + 4, m) for i, m in enumerate(MARKERS)] + [(14, "a")], "id int, piece string")
    assert N.check_markers(v).count() == 11
    with pytest.raises(Exception, match="out of place"):
        N.check_markers(v.withColumn("piece", F.lit("x"))).collect()
    assert N.constrained_fraction(spark.createDataFrame([(True,), (False,)], "m boolean"), "m").first()[0] == 0.5


TOOLS = [
    ("set_timer", "phone", False, ["minutes", "label"], ["set a {minutes} minute timer called {label}", "{label} timer for {minutes} minutes"]),
    ("set_alarm", "phone", True, ["hour", "label"], ["wake me at {hour} for {label}", "alarm at {hour}, {label}"]),
    ("send_text", "phone", False, ["name", "label"], ["text {name} about {label}"]),
    ("start_run", "wearable", False, ["minutes"], ["start a {minutes} minute run"]),
    ("log_water", "wearable", True, ["glasses"], ["log {glasses} glasses of water"]),
    ("lock_door", "smart home", False, ["door"], ["lock the {door} door", "please lock the {door} door now"]),
    ("open_door", "smart home", True, ["door"], ["open the {door} door"]),
    ("move_arm", "robot", False, ["pose", "object"], ["move the arm to {pose} and take the {object}"]),
    ("drop_object", "robot", True, ["object"], ["drop the {object}"]),
]
POOLS = {"minutes": ["5", "10", "twenty five", "40"], "label": ["tea", "the big meeting", "yoga"], "hour": ["six", "seven", "half past nine"], "name": ["Ann", "Bo", "Mary Lou"], "glasses": ["2", "3", "four"], "door": ["front", "back", "garden", "cellar side"], "pose": ["home", "far left"], "object": ["red cup", "bolt", "small green box"]}
SLOTS = [(n, k, s, o, v) for n, _, _, keys, _ in TOOLS for s, k in enumerate(keys) for o, v in enumerate(POOLS[k])]
SMALL = [("phone", 14), ("wearable", 5), ("smart home", 8), ("robot", 6)]


def catalogue(spark):
    t = spark.createDataFrame(TOOLS, "name string, family string, held_out boolean, keys array<string>, phrasings array<string>")
    return t, spark.createDataFrame(SLOTS, "name string, key string, slot int, ord int, value string")


def test_suite(spark, tmp_path):
    tools, values = catalogue(spark)
    s = U.build_suite(tools, values, families=SMALL, held_out=11)
    got = s.collect()
    assert len(got) == 30 and len({r.query for r in got}) == 30 and sum(r.held_out for r in got) == 11
    for r in got:
        assert all(v in r.query for v in r["values"].values())
        if r.twin:
            assert sum(r.twin["values"][k] != v for k, v in r["values"].items()) == 1 and r.twin["query"] != r.query
    assert U.twin_requests(s).count() == sum(r.twin is not None for r in got)
    with pytest.raises(ValueError, match="can produce"):
        U.build_suite(tools, values, families=[("phone", 500)], held_out=100).collect()
    d = U.declare(s, Q.tool_neighbours(tools)).collect()
    target = {r.id: r.name for r in got}
    assert len(d) == 30 and all(target[r.id] in r.names and 3 <= len(set(r.names)) <= 5 for r in d)
    two = U.two_call_requests(tools, values, ("set_timer", "start_run"), ["time {minutes} for {label} and run as long"], {"minutes": "minutes"}, 5).collect()
    assert len(two) == 5 and all(r["second"]["minutes"] == r["first"]["minutes"] and "label" in r["first"] for r in two)
    c = U.copy_rows(spark, 50).collect()
    assert all(4 <= len(r.prompt) <= 24 and r.prompt == r.target for r in c) and len({tuple(r.prompt) for r in c}) == 50
    N.save_report({"summary": U.summary(s)}, str(tmp_path / "r"))
    assert N.load_report(spark, str(tmp_path / "r"))["summary"][0]["requests"] == 30


def test_build_corpus(spark):
    long = "some words that go on and on for quite a while in this text "
    docs = spark.createDataFrame([(s, i, f"{long * 4} {s} {i // 2}") for s in ("a", "b") for i in range(40)], "source string, doc_id long, text string")
    spans = N.build_corpus(docs, [("a", 0.75), ("b", 0.25)], 1200, 100, F.size(F.split("text", " "))).collect()
    by = {}
    for r in spans:
        by.setdefault(r.row_id, []).append(r)
    assert max(by) <= 11 and all(sum(r.hi - r.lo for r in v) == 100 for k, v in by.items() if k < max(by))
    assert all(sorted(r.seg for r in v) == list(range(1, len(v) + 1)) for v in by.values())
    n = {s: sum(r.hi - r.lo for r in spans if r.source == s) for s in "ab"}
    assert 0.6 < n["a"] / (n["a"] + n["b"]) < 0.9
    with pytest.raises(ValueError):
        N.build_corpus(docs, [("a", 1.0)], 50, 100, F.lit(1))


def test_columns_of_any_name_stay(spark):
    """Operators that keep a table's columns work beside columns named like their own."""
    from tessera.operators import corpus as C

    odd = ["bucket", "_bucket", "total", "start", "here", "at", "one", "_one", "o", "_o", "n", "place", "nth", "key", "up"]
    df = spark.range(40).withColumns({c: F.lit(c) for c in odd}).withColumn("v", F.lit(1))
    for out in (
        C.running_total(df, "v", ["id"]), C.first_of(df, ["id"], ["id"]), U.split_holdout(df, "id", 0.5), U.sample_per_group(df.withColumn("g", F.col("id") % 4), ["g"], "id", 10),
        C.interleave({"a": df.drop("place")}, "id").withColumn("place", F.lit("place")), N.positional(df.drop("ix"), spark.range(40), "id"),
    ):
        got = out.collect()
        assert len(got) == 40 and all(r[c] == c for r in got for c in odd)


def test_running_totals_of_clustered_numbers(spark):
    """A thousand ids in a corner, one far away: the totals are right and the ids don't share a bucket."""
    from tessera.operators import corpus as C

    df = spark.createDataFrame([(i, 1.0) for i in range(1000)] + [(10**12, 5.0), (None, 3.0)], "id long, v double")
    assert {r.id: r.before for r in C.running_total(df, "v", ["id"]).collect()} == {None: 0.0, **{i: i + 3.0 for i in range(1000)}, 10**12: 1003.0}
    assert C.even_buckets(df, "id", "b").select("b").distinct().count() > 500


def test_holdout_ends_at_a_share_or_at_a_whole_row(spark):
    df = spark.range(52)  # a tenth is 5.2 rows
    held = lambda **how: sorted(r.id for r in U.split_holdout(df, "id", 0.1, 5, **how).filter("held_out").collect())
    assert len(held()) == 5 and len(held(whole=False)) == 6 and set(held()) < set(held(whole=False))
    assert U.split_holdout(spark.range(30), "id", 0.1, whole=False).filter("held_out").count() == 3


def test_runs_are_joined_whole(spark):
    import time

    paths = spark.range(8000).select(F.concat(F.lit("a/b."), F.col("id"), F.lit(".a")).alias("path"))
    names = spark.range(8000).select(F.concat(F.lit("b."), F.col("id")).alias("name")).unionByName(spark.createDataFrame([("a",), ("a",), ("a.b",), ("b",), (None,), ("x/y",)], "name string"))
    started = time.time()
    got = N.match_runs(paths.unionByName(spark.createDataFrame([(None,), ("b/c",), ("c",), ("b..",)], "path string")), names).collect()
    assert time.time() - started < 40  # pairs of all that share a first component would take minutes
    want = {f"a/b.{i}.a": f"b.{i}" for i in range(8000)} | {"b/c": "b", "b..": "b"}
    assert {r.path: r.name for r in got} == want and len(got) == len(want)


def test_twins_among_alike_values_equal_all_values(spark):
    """The few values that a twin can need give the twins of all values: shared, own, repeated and no words, values that are filled themselves, placeholders within words."""
    import random
    import re
    from collections import Counter

    r = random.Random(8)
    phrases = {"a": ["take {x} to {y}", "{y}: {x}, now or ann"], "b": ["pre{x} {y}"], "c": ["say {x}{y}"], "d": ["go {x} by {y}"]}
    pool = ["ann", "bo", "ann bo", "bo ann", "c 1 d", "c 2 d", "c 3 e", "c 4 e", "now", "", "-", "zed", "X 5", "x 6 7", "ann"]
    slots = [(n, k, i, o, v) for n in phrases for i, k in enumerate("xy") for o, v in enumerate(r.sample(pool, 9) + (["{y} q"] if n == "d" and k == "x" else []))]
    values = spark.createDataFrame(slots, "name string, key string, slot int, ord int, value string")
    tools = spark.createDataFrame([(n, p) for n, p in phrases.items()], "name string, phrasings array<string>")
    rows = U.assignments(tools, values).select("name", "phrasing", "values", "query", "place").withColumn("target", F.element_at(F.array(*map(F.lit, (0.6, 0.75, 0.9))), (F.col("place") % 3 + 1).cast("int")))
    rows = spark.createDataFrame(rows.collect(), rows.schema).withColumn("id", F.monotonically_increasing_id())
    fill = lambda p, v: [p := p.replace("{%s}" % k, v[k]) for k in v][-1]
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    want = {}
    for q in rows.collect():
        x = words(q["query"])
        for n, k, i, o, v in slots:
            if n == q.name and q["values"][k] != v:
                t = fill(q.phrasing, {**q["values"], k: v})
                ov = len(x & words(t)) / len(x | words(t)) if x | words(t) else 1.0
                want[q.id] = min(want.get(q.id, (9,)), (round(abs(ov - q.target), 9), i, o, t, k))
    assert {t.id: (t.twin["query"], t.twin.differs) for t in U.twins(rows, values, ["id"]).collect()} == {i: w[3:] for i, w in want.items()}
    kept = Counter((n, k) for n, k, *_ in U.alike(rows, values.union(spark.createDataFrame([("a", "x", 0, 100 + i, f"c {100 + i} d") for i in range(50)], values.schema))).collect())
    assert kept["a", "x"] < 20 and kept["d", "x"] == 10


def test_first_ids_are_one_aggregate(spark):
    from tessera.operators import corpus as C

    df = spark.createDataFrame([("a", "x", 3), ("a", "x", 1), ("a", "x", None), ("b", "x", 2), ("b", None, None)], "source string, key string, doc_id long")
    out = C.first_ids(df, ["source", "key"], "doc_id")
    assert rows(out) == sorted([("a", "x", 1, 3), ("b", "x", 2, 1), ("b", None, None, 1)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
