import hashlib
import math
import os
import random
import struct
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, media


def plain_cuts(data: bytes) -> list[int]:
    """Chunk ends, byte by byte."""
    out, at, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
        n = i + 1 - at
        if n == media.HIGH or n >= media.LOW and h >> 32 - media.BITS == 0:
            out.append(i + 1)
            at = i + 1
    return out + [len(data)] * (at < len(data))


def test_cuts_equal_the_rolling_hash(monkeypatch):
    monkeypatch.setattr(media, "AT_ONCE", 5000)
    r = random.Random(1)
    values = [b"", b"a", bytes(64), bytes(40000), *[bytes(r.choices(range(256), k=n)) for n in (511, 512, 513, 8192, 30000)], ("word %d " * 4000).encode()]
    import pyarrow as pa

    column = pa.array([b"skipped", *values], pa.binary()).slice(1)
    for v, (whole, chunks) in zip(values, media.chunked(column)):
        assert bytes(whole) == v == b"".join(map(bytes, chunks))
        assert np.cumsum([len(c) for c in chunks]).tolist() == plain_cuts(v)


def brute(i, text):
    b = (text or "").encode()
    p = b + bytes(64 if not b else -len(b) % 64)
    w = b"RIFF" + struct.pack("<I", 36 + len(p)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(p)) + p
    with wave.open(BytesIO(w)) as f:
        assert f.readframes(f.getnframes()) == p
    s = [x - 128 for x in p]
    feature = f"{sum(s) // len(s)}:{math.isqrt(sum(x * x for x in s) // len(s))}:{max(map(abs, s))}:{sum((x >= 0) != (y >= 0) for x, y in zip(s, s[1:]))}"
    return i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest(), feature


def rows_of(n=400):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgäß字", k=r.randrange(2, 9)))
    shared = " ".join(word() for _ in range(3000))
    texts = [None, "", "x", "y" * 64, "z" * 65, "\x00" * 70, "a" * 300_000, shared * 20]
    texts += [" ".join(word() for _ in range(r.randrange(1, 900))) for _ in range(n)]
    texts += [" ".join(word() for _ in range(200)) + shared[: r.randrange(9000, 18000)] + word() for _ in range(60)]
    texts += [shared] * 200 + [texts[20]] * 3
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[30], (5, "again"), (5, "again")]


def order(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_read_back_equals_brute_force(spark, bits):
    """A bitmap of 64 bits is full: every chunk then goes through the chunk table, and nothing changes."""
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("x")).withColumn("key", F.lit(1)).withColumn("own", F.lit(2)).repartition(5)
    got = [tuple(r) for r in media.report(docs, bits).collect()]
    assert sorted(got, key=order) == sorted((brute(*r) for r in rows), key=order)


def test_each_chunk_is_stored_once(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string").repartition(7)
    values = docs.select("doc_id", media.wav(media.payload(F.col("text"))).alias("media"))
    where = common.shared_dir(spark)
    rows, chunks = media.store(values, where)
    names = [bytes(x) for r in rows.collect() for x, own in zip(r.recipe, r.own) if own is not None]
    common_names = [bytes(r.name) for r in chunks.collect()]
    recipes = [bytes(x) for r in rows.collect() for x in r.recipe]
    assert len(set(names)) == len(names) and len(set(common_names)) == len(common_names) and not set(names) & set(common_names)
    assert set(names) | set(common_names) == set(recipes)
    assert all(recipes.count(n) > 1 for n in common_names)
    held = sum(len(x) for r in rows.collect() for x in r.own if x is not None) + sum(len(r.bytes) for r in chunks.collect())
    total = values.agg(F.sum(F.octet_length("media"))).first()[0]
    assert held < 0.45 * total
    assert not [p for p in os.listdir(f"{where.removeprefix('file://')}/rows") if "shared" in p]


def test_the_values_themselves_come_back(spark):
    import pyarrow as pa

    values = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(["", "a" * 9000, "b", "a" * 9000])], "n long, media binary")
    rows, chunks = media.store(values, common.shared_dir(spark))
    back = media.restored(rows, chunks, lambda v: (v,), "value binary", [("value", pa.binary())])
    assert sorted((r.n, bytes(r.value)) for r in back.collect()) == sorted((r.n, bytes(r.media)) for r in values.collect())


def test_a_changed_chunk_is_noticed(spark):
    values = spark.createDataFrame([(i, b"a" * 9000) for i in range(3)], "n long, media binary")
    rows, chunks = media.store(values, common.shared_dir(spark))
    import pyarrow as pa

    bad = chunks.withColumn("bytes", F.concat("bytes", F.lit("!").cast("binary")))
    with pytest.raises(Exception, match="can't be rebuilt"):
        media.restored(rows, bad, lambda v: (v,), "value binary", [("value", pa.binary())]).collect()
    with pytest.raises(Exception, match="can't be rebuilt"):
        media.restored(rows, chunks.limit(1), lambda v: (v,), "value binary", [("value", pa.binary())]).collect()


def test_empty_table(spark):
    assert media.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
