"""The token automaton against plain walks: a reader that goes character by character, and tries walked piece by piece."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import automaton as A
from tessera.streaming.reading import Reading

TOOLS = [
    {"name": "alarm", "parameters": {"properties": {"hour": {"type": "integer", "minimum": 0, "maximum": 23}, "label": {"type": "string"}, "tone": {"enum": ["loud", "low", "lower"]}, "n": {"enum": [1, 12, 2.5, True]}}, "required": ["hour", "label"]}},
    {"name": "open", "parameters": {"properties": {"what": {"type": "string"}}}},
    {"name": "alarms"},
]
WHOLE = [
    'ok <tool_call>[{"name":"alarm","arguments":{"hour": 7 , "label":"a \\" b","tone":"low","n":2.5}},{"name":"open","arguments":{"what":{"x":[1,"name",{"name":"q"}]}}}]</tool_call> and <tool_call>[{"name":"al',
    '<tool_call> [ { " name " : " alarm " , " arguments " : { " hour " : 77 , " tone " : " lo',
    '<tool_call>[{"name":"nope","arguments":{"z":1}}]</tool_call>y<tool_call>[{"arguments":{"a":1},"name":"open"',
    '<tool_call>"abc\\',
    '<tool_call>[{"name":"alarm","arguments":{"n":12,"n":true,"n":"1","n":3}}',
]
PARTS = ["{", "}", "[", "]", ",", ",", ":", '"name"', '"arguments"', '"hour"', '"tone"', '"loud"', '"lo', '"alarm"', '"open"', " ", "\n", "5", "99", "true", '"', "\\", "x", '"n"', "2.5", "<tool_call>", "</tool_call>"]


def texts():
    r = random.Random(1)
    out = [f[:n] for f in WHOLE for n in range(len(f) + 1)]
    return out + ["<tool_call>" + "".join(r.choice(PARTS) for _ in range(r.randrange(1, 18))) for _ in range(500)]


def test_batch_and_incremental_readers_agree(spark):
    """The fold of whole turns, and a reader fed in small pieces, saved and restored between any two."""
    r, all_ = random.Random(2), texts()
    df = spark.createDataFrame([(i, t, json.dumps(TOOLS)) for i, t in enumerate(all_)] + [(-1, None, None), (-2, "<tool_call>[", "no json")], "i long, t string, tools string")
    got = {x.i: {k: v for k, v in x.asDict().items() if k != "i"} for x in A.call_state(df, "i", "t", "tools").collect()}
    for i, t in enumerate(all_):
        saved, at = None, 0
        while at < len(t):
            reader = Reading(TOOLS, saved)
            n = r.randrange(1, 12)
            saved, at = reader.feed(t[at : at + n]).saved(), at + n
        assert got[i] == Reading(TOOLS, saved).report(), t
    assert got[-1]["state"] == "disarmed" and got[-2]["state"] == "free"


def walks(words, piece, prefix, bare):
    """What a trie does with a piece, character by character: the next prefix, None for an end, or False."""
    blank = " \t\n\x0b\f\r"
    ends = lambda c: c in ",}]" or c in blank if bare else c == '"'
    shown = piece.lstrip(blank)
    if not prefix or (not bare and shown.startswith('"')):
        piece = shown
    if not piece:
        return False
    for i, c in enumerate(piece):
        if ends(c):
            if bare and not prefix:
                return False
            return None if prefix in words else False
        prefix += c
        if not any(w.startswith(prefix) for w in words):
            return False
    return prefix


def test_steps_and_masks(spark):
    pieces = sorted({*"alrmosn12.5", "al", "ala", "arm", "arms", "alarm", 'm"', 'm",', 'arms"', ' "', '  "x', " al", " a", " ", "", "open", 'open"', "lo", "low", "lower", "w", "er", "2", "12", "1,", "2.5}", "2}", "true", "e]", ",", "12 ", "hour", "our", "ho"})
    vocabulary = spark.createDataFrame(list(enumerate(pieces)), "id long, piece string")
    tools = spark.createDataFrame([(json.dumps(TOOLS),)] * 3, "tools string")
    words = A.constraints(tools, "tools")
    held = {}
    for w in words.collect():
        held.setdefault((w.kind, w.tool, w.key), set()).add(w.word)
    assert held == {
        ("name", None, None): {"alarm", "open", "alarms"}, ("key", "alarm", None): {"hour", "label", "tone", "n"}, ("key", "open", None): {"what"},
        ("value", "alarm", "tone"): {"loud", "low", "lower"}, ("bare", "alarm", "n"): {"1", "12", "2.5", "true"},
    }
    table = A.transitions(words, vocabulary)
    got = {}
    for r in table.collect():
        assert got.setdefault((r.kind, r.tool, r.key, r.prefix, r.id), r.next) == r.next
    want = {}
    for (kind, tool, key), ws in held.items():
        for prefix in {w[:n] for w in ws for n in range(len(w) + 1)}:
            for i, p in enumerate(pieces):
                step = walks(ws, p, prefix, kind == "bare")
                if step is not False:
                    want[kind, tool, key, prefix, i] = step
    assert got == want
    masks = A.masks(table).crossJoin(F.broadcast(vocabulary)).select("kind", "tool", "key", "prefix", "id", A.allows(F.col("allowed"), F.col("id")).alias("on"))
    assert {(r.kind, r.tool, r.key, r.prefix, r.id) for r in masks.filter("on").collect()} == set(want)


def test_turns_are_looked_up(spark):
    r = random.Random(3)
    cut = re.compile(r"[a-z]{1,3}|.")
    turns = []
    for i in range(60):
        name, tone = r.choice(["alarm", "alarms", "open", "alert"]), r.choice(["low", "lower", "loud", "lost"])
        turns.append(cut.findall(f'<tool_call>[{{"name":"{name}","arguments":{{"tone":"{tone}","n":{r.choice(["1", "12", "3"])}}}}}]'))
    pieces = sorted({p for t in turns for p in t})
    vocabulary = spark.createDataFrame(list(enumerate(pieces)), "id long, piece string")
    df = spark.createDataFrame([(i, [(pieces.index(p), p) for p in t], json.dumps(TOOLS)) for i, t in enumerate(turns)], "turn long, pieces array<struct<id:long,piece:string>>, tools string")
    words = A.constraints(df, "tools")
    got = {(x.turn, x["at"]): (x.kind, x.prefix, x.fits) for x in A.positions(df, "turn", "pieces", "tools", words, A.transitions(words, vocabulary)).collect()}
    held = {}
    for w in words.collect():
        held.setdefault((w.kind, w.tool, w.key), set()).add(w.word)
    want = {}
    for i, t in enumerate(turns):
        for at, p in enumerate(t):
            s = Reading(TOOLS).feed("".join(t[:at])).report()
            kind = {"name": "name", "key": "key", "value": "value"}.get(s["state"])
            if kind == "value" and s["keys"][-1] == "n":
                kind = "bare"
            ws = held.get((kind, None if kind == "name" else s["tool"], s["keys"][-1] if kind in ("value", "bare") else None), set())
            if any(w.startswith(s["text"]) for w in ws):
                want[i, at] = (kind, s["text"], walks(ws, p, s["text"], kind == "bare") is not False)
    assert got == want


@pytest.mark.parametrize("text", ["", "[]", "[1, null, {}]", "{", '[{"name": 3}]'])
def test_odd_declarations(spark, text):
    df = spark.createDataFrame([(text,), (None,)], "tools string")
    assert A.constraints(df, "tools").filter("word <> '3'").count() == 0


def test_a_long_turn_is_cut_once(spark):
    import time

    from tessera.operators import automaton as A

    text = '<tool_call>[{"name":"lamp","arguments":{"room":[' + "1, " * 10_000
    rows = spark.createDataFrame([(1, text, '[{"name":"lamp","parameters":{"properties":{"room":{}},"required":["room","at"]}}]')], "i long, t string, d string")
    began = time.time()
    r = A.call_state(rows, "i", "t", "d").first()
    assert (r.state, r.tool, r["keys"], r.pending, r.forbids_close) == ("free", "lamp", ["room"], ["at"], False)
    assert time.time() - began < 20  # once per token it took minutes
