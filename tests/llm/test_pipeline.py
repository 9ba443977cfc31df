import random


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(30)) for k in range(5)]
    rows = [(i, line(r.randrange(40, 200)), r.choice(["en", "de"]), r.choice(["a", "b"]), 1) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(10)]  # copies
    rows += [(200 + i, line(60) + " " + items[i][1] + " " + line(60), "en", "b", 1) for i in range(5)]  # benchmark passages
    rows += [(300, items[0][1], "en", "a", 1), (301, None, "en", "a", None), (302, "12 34", "de", None, 5)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == names
        seen[name] = {x.doc_id: x for x in docs.collect()}
    assert {x[0] for x in rows} - set(seen["language"]) == {301, 302}
    assert all(100 + i not in seen["near_duplicates"] or i not in seen["language"] for i in range(10))
    assert set(seen["language"]) & set(range(80)) <= set(seen["near_duplicates"])
    clean = seen["decontamination"]
    assert 300 not in clean and all(items[i][1] not in clean[200 + i].text for i in range(5) if 200 + i in clean)
    assert set(seen["near_duplicates"]) - set(clean) == {300} & set(seen["near_duplicates"])
    assert 0 < len(seen["mixture"]) < len(clean)
    assert set(seen["shards"]) == set(seen["mixture"]) and {x.shard for x in seen["shards"].values()} <= set(range(24))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["shards"])


def staged(spark, docs, where):
    """Every stage's rows, each stage on what its predecessor kept, by their ``at`` column."""
    import corpus_pipeline

    seen, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, where)
        docs.write.parquet(f"{where}/s{k}")
        docs = spark.read.parquet(f"{where}/s{k}")
        if k < 4:
            assert docs.columns == columns
        seen[name] = docs.collect()
    return seen


def small_benchmark(spark, where, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    small_benchmark(spark, str(tmp_path), [])
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert not any(map(len, staged(spark, docs, str(tmp_path)).values()))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    same, long_ = line(80), line(60_000)
    rows = [(i, line(r.randrange(30, 90)), r.choice(["en", "de", None]), r.choice(["a", None])) for i in range(40)]
    rows += [(None, line(50), None, None), (None, None, "en", "a"), (50, "", "en", "a"), (7, line(40), "en", "a"), (7, rows[7][1], "de", "a"), (None, same, "en", "a"), (60, same, "en", "a"), (61, same + " end", "en", None), (62, long_, "en", "a"), (63, long_ + " and so on", "en", "a")]
    small_benchmark(spark, str(tmp_path), [(1, line(30)), (2, None)])
    clash = ["node", "key", "row", "found", "share", "cell", "nth", "size", "_p", "fp", "h", "tokens", "where", "t", "n", "a.b"]
    docs = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat_ws("-", F.lit(c), F.sha1(F.coalesce("text", F.lit("")))) for c in clash})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = staged(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    for stage in ("language", "near_duplicates", "mixture"):
        assert all(x["a.b"] == x["node"].replace("node", "a.b") and x["h"].startswith("h-") for x in seen[stage])
    assert len(seen["language"]) == len(rows) - 2  # the null and the empty text
    kept = [(x.doc_id, x.text) for x in seen["near_duplicates"]]
    texts = [t for _, t in kept]
    assert len(set(texts)) == len(texts) == len(seen["language"]) - 4
    assert (60, same) in kept and (7, rows[7][1]) in kept and (62, long_) in kept and (None, rows[40][1]) in kept
    assert len(seen["decontamination"]) == len(kept)
    assert {x.doc_id for x in seen["shards"]} <= {i for i, _ in kept}


def test_near_copies_recall_of_whole_tables(spark):
    """Over distinct texts of the smallest table, no pair of similarity 0.8 or more is kept on both sides, and nothing else goes."""
    import os

    import pytest

    from tessera.llm import simhash

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    words = {r.doc_id: simhash.common.words(r.text) for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() if len(ids) < 200 for k, b in enumerate(ids) for a in ids[:k]}
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    distinct = {p for p in near if words[p[0]] != words[p[1]]}
    assert len(distinct) >= 3 and not any(a in kept and b in kept for a, b in near)
    partners = {i for p in near for i in p}
    assert set(words) - kept <= partners | {i for i, w in words.items() if not w}
