import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, warc


def opened(data):
    return warc.Zip(pa.BufferReader(data))


@pytest.mark.parametrize("zip64", [False, True])
def test_own_archives_are_zip_files(zip64):
    data = warc.zip_bytes([("a/b", b"x" * 99), ("é", b"")], zip64)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.read("a/b") == b"x" * 99
    assert opened(data).read("a/b") == b"x" * 99 and opened(data).stored("é")[1] == 0


def test_foreign_archives(tmp_path):
    out = io.BytesIO()
    recs = [warc._gzip(warc.record(i, "u", b"p%d" % i, hashlib.sha1(b"p%d" % i).hexdigest(), None)) for i in range(5)]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
            f.write(b"".join(recs))
        z.writestr("note", "x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside" * 3
    z = opened(out.getvalue())
    assert [warc.result(r)[0] for r in warc.records(z)] == [0, 1, 2, 3, 4]  # no index: walked
    assert z.read("note") == b"x" * 100
    with pytest.raises(ValueError):
        z.stored("note")
    with pytest.raises(ValueError):
        opened(out.getvalue()[:50])


def brute(rows, floor=1000):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= floor and i is not None:
            best[p] = max(best.get(p, i), i)
    n = {}
    for _, _, h in rows:
        n[h or ""] = n.get(h or "", 0) + 1
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        b = best.get(p)
        rev = b is not None and n[h] > 1 and i != b
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if rev else "response", b if rev else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    r = random.Random(7)
    big = ["é" * 500, "x" * 999, "y" * 1000, "\r\n\r\n" * 400]
    rows = [(i, f"http://x/{i}", r.choice([*big, f"own {i}" * r.randrange(1, 900)])) for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (None, "u\nv", "y" * 1000), (199, "again", rows[199][2]), (None, None, "z" * 2000), (None, None, "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(1))
    got = warc.read(warc.write(pages.repartition(3), common.shared_dir(spark), archive_bytes=20000), at_once=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert warc.read(warc.write(pages.limit(0), common.shared_dir(spark))).count() == 0


def test_payloads_longer_than_an_archive(spark):
    r = random.Random(2)
    huge = ["".join(r.choice("abcdefghij") for _ in range(300_000)) for _ in range(3)]  # each longer, packed, than an archive of 20 kB
    rows = [(i, "u", huge[i % 3] if i < 5 else f"small {i}") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.write(pages.coalesce(1), common.shared_dir(spark), archive_bytes=20_000)
    assert made.count() >= 3
    assert sorted(map(tuple, warc.read(made).collect()), key=str) == brute(rows)
