"""Operator 7: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, which the forward algorithm gives; a text's is the product over its words.
The prediction is the language of largest posterior under equal priors, ties to the smaller name; the score is that
posterior.

Words are the runs of letters and other non-ASCII characters of the lower-cased text, with the vocabulary's word mark in
front, of any length: time is linear in it, sums are rescaled on the way, and only those of the last few places are kept. The words of a batch that aren't cached are
scored together, grouped by length. Caches are bounded, and outlive the tasks of a worker.

Fitting: expected piece counts (forward-backward) over a bounded sample of labelled texts, the ``sample_docs`` distinct
texts per language of the least hash, so that a text that repeats counts once; two rounds from equal probabilities. Every label is learned, ``at_once`` of them in one pass, so
that counts of at most the vocabulary times ``at_once`` reach the driver at a time. The model is one column per language.

Defined results: `und` with score 0 for null texts, texts without a letter (by Unicode's categories: ½ and ² are none), and
if nothing could be learned. Rows with
null or repeated ids come back one by one; extra columns are ignored by ``predict`` and kept by ``known``. Empty table: no
rows, and no language to learn. More than ``MOST_LABELS`` labels are an error, because the model would outgrow a broadcast.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

MARK = "▁"
#: ASCII letters and all bytes of other code points stay.
LETTERS = bytes(c if 97 <= c <= 122 or 65 <= c <= 90 or c > 127 else 32 for c in range(256))
HAS_LETTER = regex.compile(r"\p{L}")
#: The probability of a character that the vocabulary lacks.
UNKNOWN = 1e-7
#: Longer words are rescaled, every so many characters.
SHORT, STEP = 24, 8
#: Bounds of what is learned: characters of a word in one part, and labels (a column of 32 000 doubles each, broadcast).
LONG, MOST_LABELS = 4096, 1024


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public vocabulary, without control and byte pieces, lower-cased ones only."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(p.get_piece_size())
    found = {p.id_to_piece(i) for i in n if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    return sorted(x for x in found if x == x.lower() and x.strip(MARK) or x == MARK)


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()


class Lattice:
    """All segmentations of words into pieces, for many words of one length at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.number = {p: i for i, p in enumerate(pieces)}
        self.sizes = sorted({1, *map(len, pieces)})
        self.longest = self.sizes[-1]
        self.none, self.odd = len(pieces), len(pieces) + 1  # rows of no probability and of UNKNOWN

    def table(self, p: np.ndarray) -> np.ndarray:
        return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNKNOWN)])

    def cells(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        n, get, found = len(words[0]), self.number.get, {}
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                miss = self.odd if j - i == 1 else self.none
                ids = np.array([get(w[i:j], miss) for w in words])
                if (ids != self.none).any():
                    found[i, j] = ids
        return found

    def _swept(self, words, table, cells, back: bool = False):
        """(sums, logarithms of their scales) at each place, from the first on, or from the last on backwards."""
        n, shape = len(words[0]), (len(words), table.shape[1])
        a, scale = np.zeros((n + 1, *shape)), np.zeros((n + 1, *shape)) if n > SHORT else None
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), ids in cells.items():
            by.setdefault(n - i if back else j, []).append((n - j if back else i, ids))
        a[0] = 1
        now = np.zeros(shape)
        for j in range(1, n + 1):
            for i, ids in by.get(j, ()):
                a[j] += (a[i] if scale is None else a[i] * np.exp(scale[i] - now)) * table[ids]
            if scale is not None:
                scale[j] = now
                if j % STEP == 0:
                    now = now + np.log(a[j])
        return (a[::-1], None if scale is None else scale[::-1]) if back else (a, scale)

    def log_forward(self, words, table) -> np.ndarray:
        """The logarithm of each word's probability, summed over all segmentations.

        Only the sums of the last places, as many as the longest piece has characters, are kept, whatever the words' length."""
        n, kept, get = len(words[0]), self.longest + 1, self.number.get
        ring, scale = np.zeros((kept, len(words), table.shape[1])), 0.0
        ring[0] = 1
        for j in range(1, n + 1):
            now = np.zeros(ring.shape[1:])
            for size in self.sizes:
                if size > j:
                    break
                miss = self.odd if size == 1 else self.none
                ids = [get(w[j - size : j], miss) for w in words]
                if any(i != self.none for i in ids):
                    now += ring[(j - size) % kept] * table[ids]
            ring[j % kept] = now
            if n > SHORT and j % STEP == 0:
                ring /= now
                scale = scale + np.log(now)
        return np.log(ring[n % kept]) + scale

    def expected(self, words, weights, table):
        """Expected counts per piece and language of words that occur ``weights`` (words x languages) times."""
        cells, n = self.cells(words), len(words[0])
        (a, la), (b, lb) = self._swept(words, table, cells), self._swept(words, table, cells, True)
        share = weights / a[n]
        out = np.zeros((len(self.pieces) + 2, table.shape[1]))
        for (i, j), ids in cells.items():
            got = a[i] * table[ids] * b[j] * share
            if la is not None:
                got *= np.exp(la[i] + lb[j] - la[n])
            for k in range(table.shape[1]):
                out[:, k] += np.bincount(ids, got[:, k], len(out))
        return out[: len(self.pieces)]


def _marked(word: bytes) -> str:
    return MARK + word.decode("utf-8", "replace")


def _parts(text: str):
    """The words to learn from; a longer one than ``LONG`` characters is learned in parts, so that a lattice stays small."""
    for word in split(text):
        c = _marked(word)
        for i in range(0, len(c), LONG):
            yield c[i : i + LONG]


def _by_length(words, languages: int):
    """Words of one length, at most 4096 of them and fewer of long ones and for many languages, so that a lattice stays as large."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, g in groups.items():
        most = max(1, min(4096, 4096 * 64 * SHORT // (languages * n)))
        for i in range(0, len(g), most):
            yield g[i : i + most]


class Scorer:
    """Log probabilities of words per language, cached in one growing matrix of bounded height."""

    def __init__(self, pieces: list[str], p: np.ndarray, cache_size: int = 300_000):
        self.lattice, self.cache_size = Lattice(pieces), min(cache_size, cache_size * 64 // p.shape[1])
        self.table = self.lattice.table(p)
        self.row: dict[bytes, int] = {}
        self.log = np.empty((1024, p.shape[1]))

    def _learn(self, words: set[bytes]):
        if len(self.row) + len(words) > self.cache_size:
            self.row.clear()
        at = len(self.row)
        if at + len(words) > len(self.log):
            more = np.empty((max(2 * len(self.log), at + len(words)), self.log.shape[1]))
            more[:at] = self.log[:at]
            self.log = more
        whole: dict[str, list[bytes]] = {}
        for w in words:
            whole.setdefault(_marked(w), []).append(w)
        for g in _by_length(whole, self.log.shape[1]):
            for m, log in zip(g, self.lattice.log_forward(g, self.table)):
                for w in whole[m]:
                    self.log[at] = log
                    self.row[w] = at
                    at += 1

    def __call__(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log probabilities (texts x languages)."""
        flat = [w for t in texts for w in t]
        out = np.zeros((len(texts), self.log.shape[1]))
        if not flat:
            return out
        missing = set(flat) - self.row.keys()
        if missing:
            if len(self.row) + len(missing) > self.cache_size:
                missing = set(flat)
            self._learn(missing)
        rows = np.fromiter(map(self.row.__getitem__, flat), np.int64, len(flat))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        full = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[full]
        out[full] = np.add.reduceat(self.log[rows], start, axis=0)
        return out


def fit(docs: DataFrame, train: Column, vocabulary_path: str | None = None, sample_docs: int = 400, at_once: int = 64, rounds: int = 2):
    """(languages, pieces, probabilities) from the rows of ``docs`` where ``train`` holds."""
    pieces = vocabulary(vocabulary_path)
    labelled = docs.filter(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # texts are told apart by a hash: however often a text repeats, it has one place
    labelled = labelled.withColumn("key", F.xxhash64("text")).withColumn("h", F.pmod(F.xxhash64("key"), F.lit(1 << 40)))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return langs, pieces, np.full((len(pieces), 1), 1 / len(pieces))
    if len(langs) > MOST_LABELS:
        raise ValueError(f"{len(langs)} labels: the model is broadcast, and holds {MOST_LABELS} at most")
    # texts of small hash, four times as many as wanted, so that the ranking sees as many whatever the input
    share = docs.sparkSession.createDataFrame([(k, int((1 << 40) * min(1.0, (4 * sample_docs + 100) / max(1, counts[k])))) for k in langs], "lang string, share long")
    few = labelled.join(F.broadcast(share), "lang").filter("h <= share").dropDuplicates(["lang", "key"])
    w = Window.partitionBy("lang").orderBy("h", "key")
    ranked = few.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample_docs)
    where = common.shared_dir(docs.sparkSession)
    sample = common.written(ranked.select("lang", "text"), where)
    sample = sample.repartition(max(1, min(64, 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    parts = [langs[i : i + at_once] for i in range(0, len(langs), at_once)]
    p = np.hstack([_learned(sample if len(parts) == 1 else sample.filter(F.col("lang").isin(x)), x, pieces, rounds) for x in parts])
    common.removed(docs.sparkSession, where)
    return langs, pieces, p


def _learned(sample: DataFrame, langs: list[str], pieces: list[str], rounds: int) -> np.ndarray:
    """Probabilities (pieces x languages) from the texts of ``sample`` (lang, text); languages don't affect each other."""
    p, number = np.full((len(pieces), len(langs)), 1 / len(pieces)), {x: i for i, x in enumerate(langs)}
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast((pieces, p))

        def count(batches, shared=shared):
            pieces, p = shared.value
            lattice = Lattice(pieces)
            table, total = lattice.table(p), np.zeros(p.shape)
            for b in batches:
                n: dict[str, np.ndarray] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    k = number[lang]
                    for c in _parts(text):
                        if c not in n:
                            n[c] = np.zeros(p.shape[1])
                        n[c][k] += 1
                for g in _by_length(n, p.shape[1]):
                    total += lattice.expected(g, np.array([n[c] for c in g]), table)
            at = np.argwhere(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(total[at[:, 0], at[:, 1]])], names=["piece", "k", "n"])

        got = sample.mapInArrow(count, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).orderBy("piece", "k").collect()
        n = np.zeros(p.shape)
        for r in got:
            n[r.piece, r.k] = r.n
        # a piece never seen keeps a small share, the same for all languages
        p = (n + 0.01) / (n.sum(0) + 0.01 * len(pieces))
        shared.unpersist()
    return p


def _predict(scorer: Scorer, langs: list[str], texts: list):
    """(languages, scores) of texts."""
    ok = [bool(t) and HAS_LETTER.search(t) is not None for t in texts]
    log = scorer([split(t) if o else [] for t, o in zip(texts, ok)])
    best = log.argmax(1)  # the first of equals: names are sorted
    top = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
    return [langs[b] if o and langs else "und" for b, o in zip(best, ok)], [float(s) if o and langs else 0.0 for s, o in zip(top, ok)]


#: The worker's scorer, by the name of its model: one at a time, kept from task to task.
_KEPT: dict[str, Scorer] = {}


def _scorer(name: str, shared) -> Scorer:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Scorer(*shared.value)
    return _KEPT[name]


def predict(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``; only the text is looked at."""
    langs, *rest = model
    shared, name = docs.sparkSession.sparkContext.broadcast(rest), uuid.uuid4().hex

    def run(batches):
        scorer = _scorer(name, shared)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lang, score = _predict(scorer, langs, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with a score of ``least`` or more."""
    langs, *rest = model
    shared, name, at = docs.sparkSession.sparkContext.broadcast(rest), uuid.uuid4().hex, docs.columns.index("text")

    def run(batches):
        scorer = _scorer(name, shared)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lang, score = _predict(scorer, langs, part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    rows = common.plain(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def held_out() -> Column:
    return common.crc_of_id() % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id hash isn't held out."""
    docs = common.documents(spark, sf_dir)
    found = predict(docs, fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
