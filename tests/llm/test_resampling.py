import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute(docs, target, percent=25, least=20, n=2, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t, rows = [0] * buckets, [0] * buckets, []
    for _, text in docs:
        for f in runs(text, n)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text, n)[1]:
            t[bucket(f)] += 1
    S, T = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((b + 1.0) * (S + buckets) / ((a + 1.0) * (T + buckets)))) for a, b in zip(s, t)]
    for i, text in docs:
        w, fs = runs(text, n)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(k)
    return [(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows]


def order(r):
    return tuple((x is None, x or 0) for x in r)


def texts(n, r):
    word = lambda: "".join(r.choices("abcdeABCDEÄß字9", k=r.randrange(1, 4)))
    out = ["".join(word() + r.choice(" ,.\n-") for _ in range(r.randrange(0, 80))) for _ in range(n)]
    return [None, "", " . ", "one", "Two WORDS", "\x00a\x00b c", "字" * 50, *out]


@pytest.mark.parametrize("n,at_once", [(2, 1_000_000), (3, 60), (1, 60)])
def test_equals_brute_force(spark, monkeypatch, n, at_once):
    r = random.Random(n)
    docs = [(i if i % 30 else None, t) for i, t in enumerate(texts(500, r))]
    docs += [(9, docs[100][1])] * 150 + [(None, docs[200][1])] * 40  # a third of all rows repeat
    target = texts(40, r)
    left = spark.createDataFrame(docs, "id long, text string").withColumn("score", F.lit("x")).repartition(5)
    right = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "id long, text string")
    if at_once == 60:
        monkeypatch.setattr(resampling, "AT_ONCE", 60)
        counted = {}
        c = resampling.Counter(n, 97)
        for _, t in docs:
            words, counts = c.long(t or "")
            counted[t] = words, counts.tolist()
        for t, (words, counts) in counted.items():
            w, fs = runs(t, n)
            assert words == len(w)
            assert counts == [sum(zlib.crc32(f.encode()) % 97 == b for f in fs) for b in range(97)]
    got = [tuple(x) for x in resampling.resample(left, right, n=n).collect()]
    assert sorted(got, key=order) == sorted(brute(docs, target, n=n), key=order)


def test_a_very_long_text(spark):
    r = random.Random(8)
    text = " ".join(r.choice(["alpha", "beta", "Gamma", "字"]) for _ in range(700_000))  # over three batches
    docs = [(1, text), (2, "alpha beta " * 30), (3, "x" * 2_500_000)]
    got = [tuple(x) for x in resampling.resample(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(1, "gamma")], "id long, text string"), percent=100).collect()]
    assert sorted(got, key=order) == sorted(brute(docs, ["gamma"], percent=100), key=order)


def test_the_draw_leans_to_the_target(spark):
    r = random.Random(4)
    some = lambda words: " ".join(r.choice(words) for _ in range(60))
    docs = [(i, some(["red", "green", "blue"] if i % 4 == 0 else ["one", "two", "three"])) for i in range(800)]
    target = spark.createDataFrame([(1, some(["red", "green", "blue"]))], "id long, text string")
    drawn = resampling.resample(spark.createDataFrame(docs, "id long, text string"), target).filter("rank IS NOT NULL")
    assert drawn.count() == 200 and drawn.filter("id % 4 = 0").count() > 150


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert resampling.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert [tuple(x) for x in resampling.resample(one, none).collect()] == brute([(1, "a b")], [])
