import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid as l


def brute(word, prob):
    total = 0.0
    n = len(word)
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
        at = [0, *cuts, n]
        p = 1.0
        for a, b in zip(at, at[1:]):
            p *= prob.get(word[a:b], l.UNKNOWN if b - a == 1 else 0.0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "bab", "▁", "▁a"]
    p = np.array([[0.1, 0.3], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.1]])
    lattice = l.Lattice(pieces)
    for w in ("▁abab", "▁babba", "▁xbab"):
        got = lattice.log_forward([w, w], lattice.table(p))
        for k in range(2):
            assert np.allclose(np.exp(got[:, k]), brute(w, dict(zip(pieces, p[:, k]))))


def logs(word, prob):
    """The log of the same sum by a recursion in logarithms."""
    a = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 4), j):
            p = prob.get(word[i:j], l.UNKNOWN if j - i == 1 else 0.0)
            a[j] = np.logaddexp(a[j], a[i] + np.log(p)) if p else a[j]
    return a[-1]


def test_long_words_are_summed_over_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "bab", "▁", "▁a"]
    p = np.array([[0.1, 0.3], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.1]])
    lattice, r = l.Lattice(pieces), random.Random(1)
    for n in (24, 25, 33, 400, 5000):
        w = "▁" + "".join(r.choice("abbax") for _ in range(n))
        got = lattice.log_forward([w, w], lattice.table(p))
        assert np.allclose(got, [[logs(w, dict(zip(pieces, p[:, k]))) for k in range(2)]] * 2, rtol=1e-12)
    n = lattice.expected(["▁" + "abba" * 300], np.array([[2.0, 1.0]]), lattice.table(p))
    size = np.array([len(x.replace("▁", "")) for x in pieces])
    assert np.allclose(size @ n, [2400, 1200])


def test_expected_counts_keep_every_character():
    pieces = ["a", "ab", "b", "ba", "▁"]
    lattice = l.Lattice(pieces)
    n = lattice.expected(["▁abab", "▁baba"], np.array([[2.0], [3.0]]), lattice.table(np.full((5, 1), 0.2)))
    assert np.isclose((n[:, 0] * [1, 2, 1, 2, 1]).sum(), 25)


WORDS = {"en": "the of and that with these words being thing under".split(), "de": "der die und nicht eine schön über ungeheuer keit weg".split(), "fr": "les des que pour cette être où garçon eau voilà".split()}


def texts(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy_and_defined_results(spark):
    r = random.Random(5)
    rows = [(i, texts(r, lang, r.randrange(4, 60)), lang) for i, lang in enumerate(r.choice(list(WORDS)) for _ in range(300))]
    rows += [(900, None, "en"), (901, "12 34 !", "de"), (902, "", None), (None, "und die", None), (903, "x" * 5000, "en"), (903, "the of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = l.fit(docs, ~l.held_out(), sample_docs=60)
    got = l.predict(docs, model).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:300]}
    by = {x.doc_id: x for x in got}
    assert np.mean([by[i].lang_pred == truth[i] for i in truth]) > 0.98
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und"
    odd = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ³"), (3, "½ der und"), (4, "ª")], "doc_id long, text string")
    assert [x.lang_pred == "und" for x in sorted(l.predict(odd, model).collect())] == [True, True, False, False]
    assert by[None].lang_pred == "de" and all(0 <= x.score <= 1 for x in got)
    kept = l.known(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (900, 901, 902)").count() == 0 and kept.filter("doc_id < 300").count() >= 295


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert l.predict(docs, l.fit(docs, ~l.held_out())).first().lang_pred == "und"
    assert l.predict(docs.limit(0), l.fit(docs.limit(0), ~l.held_out())).count() == 0


def test_every_label_is_learned(spark):
    r = random.Random(9)
    own = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(7)) for _ in range(6)] for k in range(70)}
    rows = [(100 * k + i, " ".join(r.choice(own[lang]) for _ in range(30)), lang) for k, lang in enumerate(own) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = l.fit(docs, F.lit(True))
    assert model[0] == sorted(own) and model[2].shape == (len(model[1]), 70) and np.allclose(model[2].sum(0), 1)
    got = {x.doc_id: x.lang_pred for x in l.predict(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98


def test_rows_without_an_id_or_with_a_repeated_one_are_learned_from_like_others(spark):
    r = random.Random(2)
    rows = [(None, texts(r, "de", 20), "de") for _ in range(450)] + [(i, texts(r, "de", 20), "de") for i in range(1, 100)] + [(7, texts(r, "fr", 20), "fr") for _ in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, pieces, p = l.fit(docs, F.lit(True), sample_docs=50)
    assert langs == ["de", "fr"] and all(p[:, k].max() > 5 / len(pieces) for k in range(2))
    got = l.predict(docs, (langs, pieces, p)).collect()
    assert np.mean([x.lang_pred == lang for x, (_, _, lang) in zip(got, rows)]) > 0.98


def test_a_text_that_repeats_is_learned_once(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rest = [" ".join(word() for _ in range(8)) for _ in range(300)]
    rows = [(1, "the same text again", "x")] * 1000 + [(i, t, "x") for i, t in enumerate(rest)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    before = l._learned
    try:
        l._learned = lambda sample, *a: (seen.append([x.text for x in sample.collect()]), before(sample, *a))[1]
        l.fit(docs, F.lit(True), sample_docs=100)
        l.fit(docs, F.lit(True), sample_docs=400)
    finally:
        l._learned = before
    assert len(seen[0]) == len(set(seen[0])) == 100 and sorted(seen[1]) == sorted({t for _, t, _ in rows})


def test_a_very_long_word_takes_little_memory():
    import tracemalloc

    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    p = np.full((6, 4), 1 / 6)
    scorer = l.Scorer(pieces, p)
    tracemalloc.start()
    scorer([[b"ab" * 100_000]])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6
    assert max(map(len, l._parts("ab" * 50_000))) == l.LONG and sum(map(len, l._parts("ab" * 50_000))) == 100_001


def test_too_many_labels_and_empty_tables(spark, monkeypatch):
    import pytest

    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert l.predict(none, l.fit(none, F.lit(True))).count() == 0
    monkeypatch.setattr(l, "MOST_LABELS", 2)
    with pytest.raises(ValueError, match="3 labels"):
        l.fit(spark.createDataFrame([(1, "aa", "x"), (2, "bb", "y"), (3, "cc", "z")], "doc_id long, text string, lang string"), F.lit(True))


def test_fit_and_posterior_against_brute_force(spark):
    """Two rounds of expected counts over all segmentations, and the posterior, with plain loops over a few pieces."""
    r = random.Random(9)
    texts = [(i, " ".join(r.choice(["aba", "bab", "ab", "abba", "b"] if i % 2 else ["aa", "aab", "ca", "cab"]) for _ in range(6)), "xy"[i % 2]) for i in range(12)]
    pieces = ["a", "aa", "ab", "b", "ba", "c", "ca", "▁", "▁a"]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    before = l.vocabulary
    try:
        l.vocabulary = lambda path=None: pieces
        langs, _, p = l.fit(docs, F.lit(True))
        got = {x.doc_id: (x.lang_pred, x.score) for x in l.predict(docs, (langs, pieces, p)).collect()}
    finally:
        l.vocabulary = before

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in pieces or k == 1:
                for rest in cuts(word[k:]):
                    yield [word[:k], *rest]

    want = np.full((len(pieces), 2), 1 / len(pieces))
    for _ in range(2):
        n = np.zeros(want.shape)
        for _, text, lang in texts:
            k = "xy".index(lang)
            for word in text.split():
                ways = list(cuts("▁" + word))
                odds = np.array([np.prod([want[pieces.index(c), k] if c in pieces else l.UNKNOWN for c in way]) for way in ways])
                for way, o in zip(ways, odds / odds.sum()):
                    for c in way:
                        if c in pieces:
                            n[pieces.index(c), k] += o
        want = (n + 0.01) / (n.sum(0) + 0.01 * len(pieces))
    assert langs == ["x", "y"] and np.allclose(p, want, rtol=1e-9)
    for i, text, _ in texts:
        log = [sum(np.log(sum(np.prod([want[pieces.index(c), k] if c in pieces else l.UNKNOWN for c in way]) for way in cuts("▁" + w))) for w in text.split()) for k in range(2)]
        top = int(np.argmax(log))
        assert got[i][0] == "xy"[top] and np.isclose(got[i][1], 1 / sum(np.exp(x - max(log)) for x in log))
