import random
import re

from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import decontaminate as d


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = split(text), set(), set()
    for name, item in items:
        v = split(item)
        size = min(window, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1) if v else ():
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(name)
    return len(w), len(hit), sorted(found)


def cases(seed, letters, n_items, short):
    r = random.Random(seed)
    line = lambda lo, hi: " ".join(r.choice(letters) for _ in range(r.randrange(lo, hi)))
    items = [(str(i), line(1 if short else 5, 20)) for i in range(n_items)]
    docs = [line(0, 60) + ". " + r.choice(items)[1].upper() + "- " + line(0, 30) for _ in range(60)]
    docs += [i[1] for i in items] + [a[1] + " " + b[1] for a, b in zip(items, items[1:])]
    return items, docs


def test_matches_equal_brute_force(spark):
    for seed, letters, n, short in ((1, "abc", 12, True), (2, "abcdé", 30, False), (3, "ab", 8, False), (4, "abcdefghij", 20, True)):
        items, docs = cases(seed, letters, n, short)
        items += [("x1", None), ("x2", " .,"), ("x3", items[0][1])]
        (path,) = d.automata(spark.createDataFrame(items, "item_id string, text string"), common.shared_dir(spark), 5, 10_000)
        model = d._automaton(path)
        hit, names = d._hits(model, [d.words(t) for t in docs])
        got = [(len(d.words(t)), sum(y - x for x, y in h), sorted(n)) for t, h, n in zip(docs, hit, names)]
        assert got == [brute(t, items, 5) for t in docs]


def test_several_automata_give_the_same(spark):
    items, docs = cases(5, "abcd", 25, True)
    df = spark.createDataFrame(items, "item_id string, text string")
    assert len(d.automata(df, common.shared_dir(spark), 6, 10**6)) == 1 and len(d.automata(df, common.shared_dir(spark), 6, 20)) > d.HELD
    rows = spark.createDataFrame([*enumerate(docs), (None, None), (None, "a b c")], "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("found", F.lit("x")).withColumn("n_chars", F.length("text"))
    one, many = (sorted(map(tuple, d.matches(rows, df, 6, n).collect()), key=str) for n in (10**6, 20))
    assert one == many and sum(x[2] > 0 for x in one) > 20
    one, many = (sorted(map(tuple, d.clean(rows, df, 6, 0.9, n).collect()), key=str) for n in (10**6, 20))
    assert one == many and 0 < len(one) < rows.count()


def test_a_very_long_text(spark):
    items = [("7", "one two three four five six")]
    text = "a b " * 200_000 + "one two three four five six " + "c " * 100_000 + "one two three four five"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = d.matches(docs, spark.createDataFrame(items, "item_id string, text string"), 5).first()
    assert (r.n_words, r.n_hit) == (500_011, 11)


def test_rows_nulls_and_empty_tables(spark):
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven"), (8, None)], "item_id long, text string")
    rows = [(1, "x One two; three four five six seven eight nine TEN y"), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(0))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.matches(docs, items).collect()), key=str)
    assert got == sorted([(1, 12, 10, ["7"]), (None, 0, 0, []), (2, 0, 0, []), (2, 0, 0, [])], key=str)
    assert d.matches(docs.limit(0), items).count() == 0
    assert d.matches(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_clean_cuts_spans_and_drops_covered_documents(spark):
    ten = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(7, ten)], "item_id long, text string")
    tail = "then other words go on and on after that for a good while"
    rows = [(1, f"Before. {ten.upper()}! {tail}", 9), (2, ten + " x", 9), (3, tail, 9), (4, None, None), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = d.clean(docs, items)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (f"Before. ! {tail}", len(f"Before. ! {tail}")), 3: (tail, 9), 4: (None, None), None: ("", 0)}
