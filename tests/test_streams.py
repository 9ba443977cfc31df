"""Ordered state: turns that come in any order, more than once, over restarted queries, give what the whole table gives."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import state as S
from tessera.streaming.reading import Reading


def streamed(spark, where, rows, schema, made, files=4):
    """Rows in files, shuffled, some twice; a query of its own for each half of the files."""
    r = random.Random(7)
    rows = [*rows, *r.sample(rows, len(rows) // 5)]
    r.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.parquet(f"{where}/in/{k}")
        if k % 2:
            S.run(made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in/*")), where, "update")
    return S.latest(spark, where, "conv_id")


def conversations():
    r = random.Random(1)
    return [(c, t, r.choice(["user", "assistant", "assistant"]), r.randrange(3), r.choice([None, 0.05, 0.5, 0.9]), f"{c}:{t}") for c in range(12) for t in range(r.randrange(1, 9))]


def run_of(turns, most, threshold):
    steps = 0
    for n, (_, _, role, calls, sure, _) in enumerate(turns, 1):
        if role == "assistant":
            steps += 1
            reason = "escalate" if sure is not None and sure < threshold else "done" if calls == 0 else "max_steps" if steps >= most else ""
            if reason:
                return n, reason
    return len(turns), ""


SCHEMA = "conv_id long, turn long, role string, n_calls long, confidence double, text string"


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(r)
    return out


def test_runs(spark, tmp_path):
    rows = conversations()
    got = streamed(spark, str(tmp_path), rows, SCHEMA, lambda s: S.agent_runs(s, 3, 0.1))
    assert {r.conv_id: (r.turns, r.stop_reason) for r in got.collect()} == {c: run_of(t, 3, 0.1) for c, t in by_conversation(rows).items()}


def test_memory_keeps_the_first_and_the_last(spark, tmp_path):
    rows = conversations()
    got = streamed(spark, str(tmp_path), rows, SCHEMA, lambda s: S.memories(s, 2, 4))
    want = {c: [(x[1], x[5]) for i, x in enumerate(t) if i < 2 or i >= max(2, len(t) - 2)] for c, t in by_conversation(rows).items()}
    assert {r.conv_id: [(h["at"], h.payload) for h in r.held] for r in got.collect()} == want
    with pytest.raises(ValueError):
        S.memories(spark.createDataFrame([], SCHEMA), 2, 2)


def test_calls(spark, tmp_path):
    tools = [{"name": "lamp", "parameters": {"properties": {"room": {"enum": ["hall", "attic"]}}, "required": ["room"]}}]
    whole = ['<tool_call>[{"name": "lamp", "arguments": {"room": "at', "no call", "x</tool_call><tool_call>[{", '<tool_call>[{"name": "lamp"}]</tool_call>']
    rows = [(i, at, t[at * 2 : at * 2 + 2]) for i, t in enumerate(whole) for at in range((len(t) + 1) // 2)]
    import json

    got = streamed(spark, str(tmp_path), rows, "conv_id long, at long, piece string", lambda s: S.call_states(s, json.dumps(tools)))
    want = {i: Reading(tools).feed(t).report() for i, t in enumerate(whole)}
    assert {r.conv_id: (r.state, r.text, r.tool, r.forbids_close) for r in got.collect()} == {i: (w["state"], w["text"], w["tool"], w["forbids_close"]) for i, w in want.items()}


def test_a_turn_that_never_comes_holds_back_the_later_ones(spark, tmp_path):
    rows = [(1, 0, "user", 0, None, "a"), (1, 2, "assistant", 0, None, "c"), (2, 1, "assistant", 0, None, "b")]
    got = streamed(spark, str(tmp_path), rows, SCHEMA, lambda s: S.agent_runs(s), files=2)
    assert [tuple(r) for r in got.collect()] == [(1, 1, "")]


def test_texts_once_over_a_restart(spark, tmp_path):
    lines = [f"line {i} with words enough to pass the filter of short texts, " * 6 for i in range(40)]
    for k in range(2):
        spark.createDataFrame([(x,) for x in [*lines[: 25 + 15 * k], "short"]], "value string").repartition(3).write.text(str(tmp_path / f"in/{k}"))
        S.run(S.first_seen(S.text_stream(spark, str(tmp_path / "in/*")), "text"), str(tmp_path))
    out = spark.read.parquet(str(tmp_path / "out")).select(F.col("text"))
    assert sorted(r.text for r in out.collect()) == sorted(x.rstrip() for x in lines)


def test_trips_to_the_state_follow_batches_and_lots_not_rows():
    from pyspark.sql import Row

    class State(dict):
        trips = 0

        def __getattr__(self, name):
            def call(*x):
                State.trips += 1
                return {"get": lambda: self.get_(()), "getValue": self.get_, "update": lambda v: self.put_((), v), "updateValue": self.put_, "removeKey": lambda k: self.pop(k, None), "exists": lambda: () in self, "containsKey": lambda k: k in self, "clear": self.empty}[name](*x)

            return call

        get = property(lambda self: self.__getattr__("get"))
        clear = property(lambda self: self.__getattr__("clear"))
        update = property(lambda self: self.__getattr__("update"))

        def get_(self, k):
            return self[k] if k in self else None

        def put_(self, k, v):
            self[k] = v

        def empty(self):
            for k in list(self):
                del self[k]

    class Handle:
        getValueState = getMapState = lambda self, *_: State()

    def trips(n):
        text = '<tool_call>[{"name":"' + "x" * n
        p, State.trips = S.Calls("[]"), 0
        p.init(Handle())
        rows = [Row(conv_id=1, at=i, piece=c) for i, c in enumerate(text)]
        out = []
        for batch in (rows[1::2], rows[:1], rows[2::2], rows[:3]):
            out += p.handleInputRows((1,), iter(batch), None)
        assert (out[-1].state, out[-1].text) == ("name", "x" * n)
        return State.trips

    assert trips(200) == trips(20) < 25
    assert trips(2000) < trips(20) + 5 * (2000 // S.WAITING + 1)
