"""Array files, tensor parts, versions and verified copies."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays, files
from tessera.sources import rows as W
from tessera.sources import shards as S


def packed(spark, n, width=6):
    return spark.createDataFrame([([i % 60000, i // 60000, *range(width - 2)], [i % 7] * width) for i in range(n)], "tokens array<int>, segs array<int>")


@pytest.mark.parametrize("step", [17, 100, 128, 1 << 20])
def test_every_row_is_read_once_whatever_the_ranges(spark, tmp_path, step):
    where = str(tmp_path / "r")
    W.write_arrays(packed(spark, 300 if step > 17 else 30).repartition(3), where)
    got = W.read_arrays(spark, where, part_bytes=step).collect()
    n = 300 if step > 17 else 30
    assert sorted(r.row for r in got) == list(range(n)) and sorted(r.tokens[0] for r in got) == list(range(n))
    assert all(r.segs == [r.tokens[0] % 7] * 6 for r in got)
    for f in os.listdir(where):
        if f.endswith(".npy"):  # they are plain array files
            a = np.load(f"{where}/{f}")
            assert a.dtype == np.uint16 and a.shape[1:] == (6, 2)
    assert len({r.tokens[0] for r in W.read_arrays(spark, where, 4, step).collect()}) == n


def test_files_are_cut_and_lists_grow(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "r")
    W.write_arrays(packed(spark, 50).coalesce(1), where)
    W.write_arrays(packed(spark, 20).coalesce(1), where, "append")
    assert sorted(r.row for r in W.read_arrays(spark, where).collect()) == list(range(70))
    W.write_arrays(packed(spark, 5), where)
    assert W.read_arrays(spark, where).count() == 5
    monkeypatch.setattr(arrays, "FILE", 1)
    w = arrays.RowsWriter(str(tmp_path / "direct"), True)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"tokens": [[1, 2]], "segs": [[1, 1]]})] * 3
    done = w.write(iter(batches))
    w.commit([done, None])
    assert len(done.files) == 3 and W.read_arrays(spark, str(tmp_path / "direct")).count() == 3


def test_a_failed_write_is_not_seen(spark, tmp_path):
    where = str(tmp_path / "r")
    W.write_arrays(packed(spark, 9), where)
    bad = packed(spark, 30).repartition(3).unionByName(spark.createDataFrame([([70000] * 6, [1] * 6)], "tokens array<int>, segs array<int>"))
    with pytest.raises(Exception, match="16 bits"):
        W.write_arrays(bad, where)
    assert sorted(r.tokens[0] for r in W.read_arrays(spark, where).collect()) == list(range(9))
    with pytest.raises(Exception, match="length"):
        W.write_arrays(spark.createDataFrame([([1, 2], [1])], "tokens array<int>, segs array<int>"), str(tmp_path / "x"))
    W.write_arrays(packed(spark, 0), str(tmp_path / "none"))
    assert W.read_arrays(spark, str(tmp_path / "none")).count() == 0


def test_tensors(spark, tmp_path):
    where = str(tmp_path / "t")
    r = np.random.default_rng(0)
    made = {f"w{i}": r.standard_normal((i % 5, 7)).astype(np.float32) for i in range(60)}
    df = spark.createDataFrame([(n, list(a.shape), a.ravel().tolist()) for n, a in made.items()], "name string, shape array<int>, values array<float>").repartition(4)
    W.write_tensors(df, where)
    got = W.read_tensors(spark, where).collect()
    assert {x.name for x in got} == set(made) and all(np.array_equal(np.array(x["values"], np.float32).reshape(x["shape"]), made[x.name]) for x in got)
    assert all(x.offset % 64 == 0 for x in got) and len({x.offset for x in got if x["values"]}) == sum(a.size > 0 for a in made.values())
    part = next(f for f in sorted(os.listdir(where)) if f.endswith(".blobs") and os.path.getsize(f"{where}/{f}"))
    with open(f"{where}/{part}", "r+b") as f:
        f.write(b"?")
    with pytest.raises(Exception, match="damaged"):
        W.read_tensors(spark, where).collect()
    with open(f"{where}/{part}", "ab") as f:
        f.write(b"?")
    with pytest.raises(Exception, match="were committed"):
        W.read_tensors(spark, where).collect()
    with pytest.raises(Exception, match="never committed"):
        W.read_tensors(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="don't make"):
        W.write_tensors(spark.createDataFrame([("a", [2, 2], [1.0])], "name string, shape array<int>, values array<double>"), str(tmp_path / "bad"))


def test_a_checkpoint_survives_a_failed_save(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "c")
    leaves = lambda x: spark.createDataFrame([("w", [1], [x])], "name string, shape array<int>, values array<double>")
    with pytest.raises(FileNotFoundError):
        W.load_checkpoint(spark, where)
    W.save_checkpoint(leaves(1.0), where, {"d": 1}, 1)
    first = W.load_checkpoint(spark, where)[0]

    def fails(*_):
        raise OSError("the store is gone")

    with monkeypatch.context() as m:  # leaves and metadata are whole, the pointer isn't moved
        m.setattr(files, "publish", fails)
        with pytest.raises(OSError):
            W.save_checkpoint(leaves(2.0), where, {"d": 1}, 2)
    broken = leaves(3.0).withColumn("values", F.raise_error(F.lit("lost")).cast("array<double>"))
    with pytest.raises(Exception, match="lost"):
        W.save_checkpoint(broken, where, {"d": 1}, 3)
    got, step = W.load_checkpoint(spark, where, {"d": 1})
    assert (step, got.first()["values"]) == (1, [1.0])
    W.save_checkpoint(leaves(4.0), where, {"d": 1}, 4)
    got, step = W.load_checkpoint(spark, where)
    assert (step, got.first()["values"], first.first()["values"]) == (4, [4.0], [1.0])  # who has begun to read goes on
    with pytest.raises(ValueError, match="differs in d"):
        W.load_checkpoint(spark, where, {"d": 2})


def test_fetched(spark, tmp_path):
    os.makedirs(tmp_path / "from")
    data = {"a.bin": b"x" * 3_000_000, "b.bin": b"", "c.bin": b"c", "d.bin": b"d"}
    for n, d in data.items():
        (tmp_path / "from" / n).write_bytes(d)
    os.makedirs(tmp_path / "to")
    (tmp_path / "to/d.bin").write_bytes(b"here before")
    sha = {n: hashlib.sha256(d).hexdigest() for n, d in data.items()}
    want = spark.createDataFrame([(f"{tmp_path}/from/a.bin", sha["a.bin"].upper()), (f"file://{tmp_path}/from/b.bin", None), (f"{tmp_path}/from/c.bin", sha["a.bin"]), (f"{tmp_path}/from/d.bin", sha["d.bin"])], "path string, want string")
    got = {os.path.basename(r.path): r for r in files.fetched(want, str(tmp_path / "to")).collect()}
    assert {n: r.verdict for n, r in got.items()} == {"a.bin": "ok", "b.bin": "unchecked", "c.bin": "wrong digest", "d.bin": "cached"}
    assert sorted(os.listdir(tmp_path / "to")) == ["a.bin", "b.bin", "d.bin"] and (tmp_path / "to/a.bin").read_bytes() == data["a.bin"]
    assert got["c.bin"].target is None and got["a.bin"].sha256 == sha["a.bin"]
    again = {os.path.basename(r.path): r.verdict for r in files.fetched(want.filter("path like '%d.bin'"), str(tmp_path / "to"), force=True).collect()}
    assert again == {"d.bin": "ok"} and (tmp_path / "to/d.bin").read_bytes() == b"d"
    assert files.listed(spark, str(tmp_path / "from")).agg(F.sum("length")).first()[0] == 3_000_002


def test_a_catalogue_of_several_files_is_numbered_through(spark, tmp_path):
    tool = lambda n: {"name": n, "description": n, "parameters": {"properties": {}}}
    for name, tools in (("a.json", ["t0", "t1"]), ("b.json", ["t2"]), ("c.json", ["t3", "t4", "t5"])):
        os.makedirs(tmp_path / "w", exist_ok=True)
        (tmp_path / "w" / name).write_text(json.dumps([tool(t) for t in tools]))
    got = S.catalogue(spark, str(tmp_path / "w")).collect()
    assert sorted((r.ix, r.name) for r in got) == [(i, f"t{i}") for i in range(6)]
