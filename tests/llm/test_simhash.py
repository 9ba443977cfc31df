import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, simhash, xxh64


def brute_print(text, size=4):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, d):
    left, comp = set(range(len(prints))), {}
    while left:
        stack, group = [left.pop()], []
        while stack:
            a = stack.pop()
            group.append(a)
            near = {b for b in left if bin(prints[a] ^ prints[b]).count("1") <= d}
            left -= near
            stack += near
        for a in group:
            comp[a] = min(group)
    return comp


def test_hash_of_slices_is_xxh64():
    r = random.Random(1)
    buf = bytes(r.randrange(256) for _ in range(5000))
    at = [(a, a + r.randrange(0, 200)) for a in range(0, 4700, 3)]
    got = xxh64.slices(buf, np.array([a for a, _ in at]), np.array([b for _, b in at]))
    assert got.tolist() == [xxhash.xxh64_intdigest(buf[a:b], 42) for a, b in at]


def test_fingerprints(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["Ab", "cé", "d\tE", "f\ng"]) for _ in range(r.randrange(0, 40))) for _ in range(60)] + [None, "", " \n", "x", "a " * 70000]
    got = simhash.fingerprints_of(texts)
    assert got.tolist() == [brute_print(t) for t in texts]


def links_of(spark, prints, **k):
    df = spark.createDataFrame([(common_signed(p),) for p in set(prints)], "fp long")
    where = common.shared_dir(spark)
    return simhash.components(simhash.links(df, 4, where, **k), f"{where}/cc")


def common_signed(x):
    return simhash._signed(x)


@pytest.mark.parametrize("run_limit", [16384, 3])
def test_components_equal_brute_force(spark, run_limit):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(30)] + [0, 1]
    for _ in range(150):
        p = r.choice(prints)
        for _ in range(r.randrange(1, 7)):
            p ^= 1 << r.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    want = brute_components(prints, 4)
    got = {a: b for a, b in links_of(spark, prints, run_limit=run_limit).collect()}
    by_root = {}
    for p in prints:
        by_root.setdefault(got.get(simhash._signed(p), simhash._signed(p)), set()).add(p)
    by_want = {}
    for i, p in enumerate(prints):
        by_want.setdefault(want[i], set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_long_runs_are_compared_as_forests():
    rng = np.random.default_rng(0)
    f = np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    f = np.unique(f)
    a, b = simhash._forest(f, 4)
    assert len(a) == len(f) - 1 and (np.bitwise_count(f[a] ^ f[b]) <= 4).all()


def test_near_duplicates_nulls_ties_and_extra_columns(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, None), (8, ""), (3, "A b c d e f"), (11, "quite other words stand here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (11, 11)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "A b c d e f"), (8, ""), (11, "quite other words stand here now")], key=str)


def test_one_of_each_takes_near_copies_and_leaves_others(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7)))
    base = [[word() for _ in range(300)] for _ in range(12)]
    rows, i = [], 0
    for w in base:
        for edits in (0, 0, 1, 3, 150):
            v = list(w)
            for k in r.sample(range(300), edits):
                v[k] = word()
            rows.append((i, " ".join(v)))
            i += 1
    kept = sorted(x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([5 * k for k in range(12)] + [5 * k + 4 for k in range(12)])


def words_of(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def edited(r, w, edits):
    """``w`` with words replaced, at places that share no shingle."""
    v = list(w)
    for k in r.sample(range(2, len(w) - 4, 5), edits):
        v[k] = words_of(r, 1)[0]
    return v


def brute_firsts(rows):
    """The first ids of the groups that all pairs of Jaccard similarity 0.8 or more join."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def kept_of(spark, rows):
    return sorted(x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


def test_a_large_group_is_compared_until_none_is_left(spark):
    r = random.Random(5)
    w = words_of(r, 300)  # each copy is 0.88 similar to it, two copies 0.77 to each other
    rows = [(i, " ".join(edited(r, w, 4))) for i in range(1000)] + [(1000, " ".join(w))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    assert all(len(s & sets[-1]) / len(s | sets[-1]) >= 0.8 for s in sets)
    assert sum(len(sets[0] & s) / len(sets[0] | s) >= 0.8 for s in sets[1:-1]) < 500
    assert kept_of(spark, rows) == [0]


def test_blocks_of_a_long_run_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3000)
    r = random.Random(6)
    w = words_of(r, 300)
    rows = [(i, " ".join(edited(r, w, 6))) for i in range(60)] + [(60, " ".join(w)), (61, " ".join(words_of(r, 300)))]
    assert kept_of(spark, rows) == brute_firsts(rows)


def test_texts_of_one_vocabulary_are_compared_with_each_other(spark):
    r = random.Random(7)
    w = words_of(r, 60)
    shuffled = [r.sample(w, 60) * 5 for _ in range(3)]  # one set of words, unlike in order
    rows = [(1, " ".join(shuffled[0])), (2, " ".join(shuffled[1])), (4, " ".join(shuffled[1] + w[:3])), (5, " ".join(shuffled[2])), (6, " ".join(w[:2] + shuffled[2]))]
    assert len(set(simhash.fingerprints_of([t for _, t in rows], 1, distinct=True).tolist())) == 1
    assert kept_of(spark, rows) == brute_firsts(rows) == [1, 2, 5]


def test_near_copies_with_a_block_more_are_found(spark):
    r = random.Random(8)
    rows = []
    for k in range(200):
        w = words_of(r, r.choice([60, 200, 600]))
        at = r.randrange(len(w))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:at] + words_of(r, len(w) // 5 - 9) + w[at:]))]
    want = brute_firsts(rows)
    assert len(want) < 210 and kept_of(spark, rows) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_rows_are_told_apart_by_id_and_text_and_columns_may_clash(spark):
    rows = [(1, "a"), (1, "b"), (2, "b"), (None, "a"), (None, "c"), (None, "c"), (3, "d"), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("text")) for c in ("_nth", "nth", "node", "key", "_key", "least", "n", "a.b")}).withColumn("at", F.monotonically_increasing_id())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text, r["_nth"], r["a.b"]) for r in kept.collect()]
    want = [(i, t, f"_nth{t}", f"a.b{t}") for i, t in [(1, "a"), (1, "b"), (None, "c"), (3, "d")]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_of_each_checks_what_simhash_links(spark, monkeypatch):
    """Without any band, a text with one word changed among many goes by its fingerprint's link; a linked text of other words stays."""
    words = [f"w{i}" for i in range(3000)]
    near = words[:1500] + ["other"] + words[1501:]
    rows = [(3, " ".join(words)), (5, " ".join(near)), (6, "a b c"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = simhash.bands(docs.withColumnRenamed("doc_id", "node"), 5).limit(0)
    monkeypatch.setattr(simhash, "bands", lambda docs, size: empty)
    a, b = simhash.fingerprints_of([rows[0][1], rows[1][1]], 5, True)
    assert bin(int(a) ^ int(b)).count("1") <= 4
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [3, 6, 7]
    real = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size=4, distinct=False: real(docs, size, distinct).withColumn("fp", simhash.F.lit(1).cast("long")))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [3, 6, 7]
