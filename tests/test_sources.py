import gzip
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import rows as W
from tessera.sources import shards as S
from tessera.sources import teacher as T
from tessera.streaming import state


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = data if isinstance(data, bytes) else data.encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)


def test_read_shards(spark, tmp_path):
    put(tmp_path / "s/a.jsonl", '{"text": "one"}\n\n"bare"\n{"text": "", "body": "two"}\n{"text": 5}\n')
    put(tmp_path / "s/deep/b.jsonl.gz", '{"code": "three"}\n')
    put(tmp_path / "s/c.json", '[{"content": "four"}, "five", 7]')
    put(tmp_path / "s/d.json", '{"document": "six"}')
    put(tmp_path / "s/e.txt", b"seven\n \nei\xffght\n")
    got = S.read_shards(spark, str(tmp_path / "s"), "src").orderBy("shard", "block", "row").collect()
    assert [r.text for r in got] == ["one", "bare", "two", "four", "five", "six", "three", "seven", "ei�ght"] and {r.source for r in got} == {"src"}
    put(tmp_path / "bad/a.jsonl", '{"text": "one"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.read_shards(spark, str(tmp_path / "bad"), "src").collect()


def test_source_documents_and_dirs(spark, tmp_path):
    long = "words enough to pass the filter of short texts " * 6
    put(tmp_path / "r/x/a.txt", f"{long}\nshort\n{long}\n{long}y\n")
    put(tmp_path / "r/x/b.txt", f"{long}\n")
    got = S.source_documents(spark, str(tmp_path / "r/x"), "x").collect()
    assert sorted((r.shard[-5:], r.text) for r in got) == sorted([("a.txt", long.rstrip()), ("a.txt", long + "y"), ("b.txt", long.rstrip())])
    assert S.source_dirs(spark, str(tmp_path / "r"), ["x"]) == {"x": f"{tmp_path}/r/x"}
    with pytest.raises(FileNotFoundError, match="y, z"):
        S.source_dirs(spark, str(tmp_path / "r"), ["x", "y", "z"])


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    assert S.write_jsonl(df, str(tmp_path / "o.jsonl")) == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o.jsonl")).collect()) == ['{"a":1,"b":"é"}', '{"a":2}']
    assert S.read_objects(spark, str(tmp_path / "o.jsonl"), "b").count() == 1
    put(tmp_path / "c.json", json.dumps([{"name": "set_x", "description": "sets", "parameters": {"properties": {"k": {}}}}, {"no": 1}]))
    c = S.catalogue(spark, str(tmp_path / "c.json")).collect()
    assert [(r.ix, r.name, r.text) for r in c] == [(0, "set_x", "sets k")]
    S.write_isolated(spark.createDataFrame([('{"a"}',)], "t string"), "t", str(tmp_path / "iso"))
    assert spark.read.text(str(tmp_path / "iso")).first().value == ' {  " a "  } '


def test_arrays_rows_and_containers(spark, tmp_path):
    buf = io.BytesIO()
    np.save(buf, np.arange(24, dtype=np.uint16).reshape(3, 4, 2))
    put(tmp_path / "a/x.npy", buf.getvalue())
    put(tmp_path / "a/flat.bin", np.arange(11, dtype="<u2").tobytes() + b"!")
    got = {(r.path[-5:], r.row): (r.tokens, r.segs) for r in W.read_arrays(spark, str(tmp_path / "a"), 4).collect()}
    assert got["x.npy", 1] == ([8, 10, 12, 14], [9, 11, 13, 15]) and got["t.bin", 1] == ([4, 5, 6, 7], None) and len(got) == 5
    with pytest.raises(Exception, match="asked for"):
        W.read_arrays(spark, str(tmp_path / "a/x.npy"), 5).collect()
    df = spark.createDataFrame([(0, [1, 2], [1, 1])], "row_id long, tokens array<int>, segs array<int>")
    W.write_rows(df, str(tmp_path / "rows"))
    assert W.load_rows(spark, str(tmp_path / "rows")).collect() == df.collect()
    data = W.container_bytes([("a", np.eye(3, dtype=np.float32)), ("b", np.arange(5, dtype=np.int16))], {"k": 1})
    put(tmp_path / "c/t.bin", data)
    t = {r.name: (r["shape"], r["values"]) for r in W.read_containers(spark, str(tmp_path / "c")).collect()}
    assert t["a"][0] == [3, 3] and t["b"][1] == [0, 1, 2, 3, 4]
    for bad in (data[:-1], b"XXXX" + data[4:], data[:-60] + b"?" + data[-59:], data[:10]):
        with pytest.raises(ValueError):
            list(W.container_tensors(bad))
    import hashlib

    assert W.digests(spark, str(tmp_path / "c")).first().sha256 == hashlib.sha256(data).hexdigest()
    a = spark.createDataFrame([("x", [1]), ("y", [2])], "name string, shape array<int>")
    b = spark.createDataFrame([("y", [3]), ("z", [1])], "name string, shape array<int>")
    assert {tuple(r) for r in W.aligned_leaves(a, b).collect()} == {("x", "only in the first"), ("y", "shapes differ"), ("z", "only in the second")}


TOOLS = json.dumps([{"name": "w", "parameters": {"properties": {"city": {"type": "string"}}, "required": ["city"]}}])


def test_teacher_replay(spark):
    def replay(body):
        if body["n"] == 2:
            raise OSError("down")
        q = {"query": f"weather in city{body['n'] % 2}", "answers": [{"name": "w", "arguments": {"city": f"city{body['n'] % 2}"}}]}
        return "Sure: " + json.dumps([q, {"query": "bye", "answers": []}, {"query": "x", "answers": [{"name": "w", "arguments": {"city": "none"}}]}])

    prompts = spark.createDataFrame([(i, json.dumps({"n": i})) for i in range(4)], "batch long, body string")
    replies = T.ask(prompts, replay).withColumn("tools", F.lit(TOOLS))
    made = T.examples(replies, "tools")
    assert made.filter("reason = ''").count() == 6 and made.count() == 9
    kept = T.generate(replies, "tools", 10)
    assert [(r.batch, r["pos"]) for r in kept.collect()] == [(0, 0), (0, 1), (1, 0)]
    r = T.generation_report(replies, made, kept).first()
    assert (r.failed, r.produced, r.kept, r.duplicates) == (1, 6, 3, 0.5) and r.refusal_share == pytest.approx(1 / 3)



def test_streams(spark, tmp_path):
    long = "words enough to pass the filter of short texts " * 6
    put(tmp_path / "in/a.txt", f"{long}\nshort\n{long}\n")
    q = state.first_seen(state.text_stream(spark, str(tmp_path / "in")), "text").writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    put(tmp_path / "in/b.txt", f"{long}\n{long}z\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("seen").collect()) == sorted([long.rstrip(), long + "z"])
    turns = [(1, 0, "user", 0, None), (1, 1, "assistant", 1, 0.9), (1, 2, "tool", 0, None), (1, 3, "assistant", 0, 0.8), (1, 4, "user", 0, None), (2, 0, "assistant", 0, 0.2), (3, 0, "assistant", 1, None), (3, 1, "assistant", 1, 0.9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, n_calls long, confidence double")
    df.write.parquet(str(tmp_path / "turns"))
    q = state.agent_runs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "turns")), 2, 0.5).writeStream.format("memory").queryName("runs").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("runs").collect())) == [(1, 4, "done"), (2, 1, "escalate"), (3, 2, "max_steps")]
    r = state.recent(df, 1, 3).collect()
    assert sorted(x.turn for x in r if x.conv_id == 1) == [0, 3, 4]


def test_states_of_calls_as_their_pieces_arrive(spark, tmp_path):
    tools = '[{"name": "lamp", "parameters": {"properties": {"room": {"enum": ["hall", "attic"]}}, "required": ["room"]}}]'
    first = [(1, 0, '<tool_call>[{"name": "la'), (2, 0, "no call")]
    second = [(1, 1, 'mp", "arguments": {'), (2, 1, " at all")]
    third = [(1, 3, 'om": "at'), (1, 2, '"ro')]
    df = spark.createDataFrame(first, "conv_id long, at long, piece string")
    where = str(tmp_path / "pieces")
    q = state.call_states(spark.readStream.schema(df.schema).parquet(where + "*"), tools).writeStream.format("memory").queryName("calls").outputMode("update")
    seen = []
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.parquet(f"{where}{k}")
        if k == 0:
            q = q.start()
        q.processAllAvailable()
        seen.append(spark.table("calls").count())
    q.stop()
    got = [tuple(r) for r in spark.table("calls").collect()]
    assert seen == [2, 4, 5]
    assert sorted(got[:2], key=str) == [(1, "name", "la", None, False), (2, "disarmed", "", None, False)]
    assert sorted(got[2:4], key=str) == [(1, "free", "", "lamp", True), (2, "disarmed", "", None, False)]
    assert got[4] == (1, "value", "at", "lamp", False)
