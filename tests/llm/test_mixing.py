import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def docs_of(spark, n=600):
    r = random.Random(8)
    rows = []
    for i in range(n):
        s = r.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((i, "word " * r.choice([2, 90, 400]) + r.choice(["", "a | b"]), r.choice(["en", "en", "de", None]), s, 1))
    rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (None, "x y", "en", "hot", 3), (5, "twice", "en", "a", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute(cells, rounds=12, rate=0.5, temper=0.7):
    total, w = sum(cells.values()), dict(cells)
    shares = []
    for m in range(3):
        t = {}
        for c, n in cells.items():
            t[c[m]] = t.get(c[m], 0) + n
        s = {v: n**temper if n else 0 for v, n in t.items()}
        shares.append({v: x / sum(s.values()) for v, x in s.items()})
    for _ in range(rounds):
        for m in range(3):
            now = {}
            for c, x in w.items():
                now[c[m]] = now.get(c[m], 0) + x
            w = {c: min(x * shares[m][c[m]] * total / now[c[m]] if now[c[m]] else x, cells[c] / rate) for c, x in w.items()}
    return {c: min(1, rate * (w[c] / n if n else 1)) for c, n in cells.items()}, w, shares


def test_probabilities_equal_brute_force_and_meet_the_targets(spark):
    got = mixing.plan(docs_of(spark).withColumn("tokens", F.lit("x")).withColumn("_p", F.lit(0))).collect()
    cells = {}
    for r in got:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    p, w, shares = brute(cells)
    assert len(got) == 604
    for r in got:
        assert r.probability == pytest.approx(p[r.source, r.lang, r.topic], abs=2e-6)
    for m in (0, 1):
        for v, share in shares[m].items():
            assert sum(x for c, x in w.items() if c[m] == v) / sum(w.values()) == pytest.approx(share, abs=0.02)
    assert 0.3 < sum(r.kept for r in got) / len(got) < 0.8


def test_oracle_agrees(spark, tmp_path):
    docs = docs_of(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(mixing.oracle()).fetchall(), key=str)
    assert sorted(map(tuple, mixing.plan(docs).select("doc_id", "source", "lang", "topic", "tokens", "probability", "kept", "residual").collect()), key=str) == want


def test_sample_keeps_columns_and_takes_targets(spark):
    docs = docs_of(spark)
    out = mixing.sample(docs, rounds=4, targets={"source": spark.createDataFrame([("a", 0.9), ("hot", 0.05)], "value string, share double")})
    assert out.columns == docs.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["a"] > 40
    assert mixing.sample(docs.limit(0), rounds=1).count() == 0


def test_many_cells_are_raked_alike_by_grouped_sums(spark):
    docs = docs_of(spark)
    one, many = ({r.doc_id: r for r in mixing.plan(docs, rounds=6, one_task_cells=n).filter("doc_id is not null and doc_id <> 5").collect()} for n in (10**6, 3))
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert r.probability == pytest.approx(many[i].probability, abs=2e-6) and r.residual == pytest.approx(many[i].residual, abs=2e-6)


def test_the_residual_says_whether_targets_are_met(spark):
    docs = docs_of(spark)
    assert mixing.plan(docs, temper=0.95, rate=0.01).first().residual < 1e-4
    far = {"source": spark.createDataFrame([("a", 0.99)], "value string, share double")}
    assert mixing.plan(docs, targets=far).first().residual > 0.1


def test_columns_that_clash_come_back_as_they_were(spark):
    docs = docs_of(spark).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("_p", "_source", "_lang", "_topic", "p", "cell", "_cell", "share", "tokens", "topic", "w", "total", "a.b")})
    out = mixing.sample(docs, rounds=2)
    assert out.columns == docs.columns
    keep = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= keep


def test_no_python_in_the_plan(spark):
    plan = mixing.sample(docs_of(spark), rounds=1)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_very_long_texts_and_empty_margins(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "en", "a"), (2, "x y", "en", "a"), (3, "x y", "de", "b")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.tokens, r.topic) for r in mixing.plan(docs, rounds=2).collect()}
    assert got == {1: (400_000, "long"), 2: (2, "short"), 3: (2, "short")}
    none = spark.createDataFrame([(1, None, None, None), (2, "", None, None)], "doc_id long, text string, lang string, source string")
    assert [r.probability for r in mixing.plan(none, rounds=2).collect()] == [0.5, 0.5]
