import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, katz


def tokens(t):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").replace("\n", " ").split(" ") if w] + [None]


class Brute:
    """Counts in dictionaries, probabilities by the recursion of the module's docstring."""

    def __init__(self, texts, order, freed=katz.FREED):
        self.order, self.freed = order, freed
        self.c = {k: Counter() for k in range(1, order + 1)}
        self.h = {k: Counter() for k in range(2, order + 1)}
        for t in texts:
            w = tokens(t)
            for i, x in enumerate(w):
                self.c[1][x] += 1
                for k in range(2, order + 1):
                    if i >= k - 2:
                        g = tuple(["<s>", *w][i + 2 - k : i + 1])
                        self.c[k][g, x] += 1
                        self.h[k][g] += 1
        nr = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, 7)]
        self.d = {k: katz.discounts(nr(c)) for k, c in self.c.items()}
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])
        self.m1 = {w: (self.d[1][c] if c <= 5 else 1) * c for w, c in self.c[1].items()}
        self.total, self.unknown = self.n, 1 - sum(self.m1.values()) / self.n
        if self.unknown <= 1e-12:
            self.total, self.unknown = self.n + 1, 1 / (self.n + 1)
        self.follow = {k: {} for k in self.h}
        for k in self.h:
            for g, x in self.c[k]:
                self.follow[k].setdefault(g, []).append(x)

    def mass(self, k, g, x):
        c = self.c[k][g, x]
        return max(min((self.d[k][c] if c <= 5 else 1) * c, c - self.freed), 0)

    def p(self, g, x):
        if not g:
            return self.m1[x] / self.total if x in self.m1 else self.unknown
        k = len(g) + 1
        if not self.h[k][g]:
            return self.p(g[1:], x)
        if self.c[k][g, x]:
            return self.mass(k, g, x) / self.h[k][g]
        seen = self.follow[k][g]
        return (1 - sum(self.mass(k, g, y) for y in seen) / self.h[k][g]) / (1 - sum(self.p(g[1:], y) for y in seen)) * self.p(g[1:], x)

    def row(self, i, held, t):
        w = tokens(t)
        before = lambda j: tuple(["<s>", *w][max(0, j + 2 - self.order) : j + 1])
        score = sum(math.log10(self.p(before(j), x)) for j, x in enumerate(w))
        return i, held, len(w), sum(self.c[1][x] > 0 for x in w), self.n, sum(math.log10((self.c[1][x] + 1) / (self.n + self.v + 1)) for x in w), score


def held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def some_rows():
    r = random.Random(9)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["Hot"] * 200
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 40)))) for i in range(120)]
    return rows + [(None, "hot hot\nnews"), (200, None), (201, ""), (7, rows[7][1]), (202, "unheard of " * 50)]


def same(got, want):
    key = lambda x: (str(x[0]), x[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order,batch_tokens,hot", [(3, 60, 20), (3, 10**6, None), (2, 200, 15), (4, 300, 30), (1, 100, None)])
def test_scores_equal_brute_force(spark, order, batch_tokens, hot):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("score", F.lit(1)).withColumn("part", F.lit("x"))
    b = Brute([t for i, t in rows if not held_out(i)], order)
    if order > 1:
        for g in list(b.h[order])[:15] + [("hot",), ("never met",)][: 2 if order == 2 else 0]:
            assert sum(b.p(g, x) for x in [*b.c[1], "never met either"]) == pytest.approx(1)
    got = katz.score(docs, common.crc_of_id() % 7 == 2, batch_tokens, parts=3, order=order, hot=hot).collect()
    same(got, [b.row(i, held_out(i), t) for i, t in rows])


def test_kept_model_scores_other_texts(spark):
    rows = some_rows()
    train, other = [x for x in rows if not held_out(x[0])], [x for x in rows if held_out(x[0])] + [(300, "hot hot hot w1 w2"), (301, "")]
    where = common.shared_dir(spark)
    kept = katz.score(spark.createDataFrame(train, "doc_id long, text string"), F.lit(False), 100, parts=3, hot=20, keep=where)
    assert kept.count() == len(train)
    got = katz.score_with(spark.createDataFrame(other, "doc_id long, text string"), katz.load(spark, where), 50).collect()
    b = Brute([t for _, t in train], 3)
    same(got, [b.row(i, True, t) for i, t in other])


def test_without_the_least_discount_a_text_would_be_impossible():
    b = Brute(["a b"] * 8, 2, freed=0)
    assert b.p(("a",), "b") == 1 and b.p(("a",), "c") == 0
    b = Brute(["a b"] * 8, 2)
    assert 0 < b.p(("a",), "c") < b.p(("a",), "b") < 1


def test_discounts():
    d = katz.discounts([0, 1000, 400, 200, 120, 80, 60])
    assert all(0 < x <= 1 for x in d) and d[1] < d[5]
    assert katz.discounts([0] * 7).tolist() == [1] * 6


def test_empty_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert katz.score(docs.limit(0), F.lit(False)).count() == 0
    r = katz.score(docs, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_a_very_long_text(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(r.choice(words) for _ in range(60_000))), (2, "x" * 400_000 + " w1 w2"), (3, "w1 w2 w3")]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string"), common.crc_of_id() % 7 == 2, 5_000, parts=3, order=2).collect()
    b = Brute([t for i, t in rows if not held_out(i)], 2)
    same(got, [b.row(i, held_out(i), t) for i, t in rows])
