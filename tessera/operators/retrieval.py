"""Retrieval and overlap.

Texts and vectors are scored in blocks: each block of queries meets every block of the catalogue, and keeps what can rank
before the last ranking. Within a block of texts, an inverted index counts the words.
Nothing is broadcast, and no task holds the whole product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def in_blocks(queries: DataFrame, catalogue: DataFrame, block_rows: int = 2048, ix: str = "ix") -> DataFrame:
    """Every query with every catalogue row, dealt out by catalogue block."""
    n = catalogue.count()
    blocks = max(1, -(-n // block_rows))
    left = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(catalogue.withColumn("_block", F.pmod(F.xxhash64(ix), F.lit(blocks)).cast("int")), "_block")


def top(df: DataFrame, query: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of best score per query, ties to the smaller ``tie``, with their rank."""
    w = Window.partitionBy(*query).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length, which counts as 1e-12 at least."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


#: Rows of a block of queries and of a block of the catalogue, and the queries that a task scores at once.
QUERIES, ROWS, AT_ONCE = 2048, 4096, 64


def unit_rows(vectors: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Each vector's length, -1 if it is null or holds a null, and by length the places and unit vectors."""
    lists = pa.concat_arrays(vectors.chunks)
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), -1)).copy()
    at, flat = np.repeat(np.arange(len(lists)), np.maximum(size, 0)), lists.flatten()
    size[at[np.asarray(flat.is_null())]] = -1
    flat, by = np.asarray(flat.cast(pa.float64()).fill_null(0.0)), {}
    for n in set(size[size >= 0].tolist()):
        m, square = flat[size[at] == n].reshape(-1, n) if n else np.zeros((int((size == 0).sum()), 0)), 0.0
        for i in range(n):
            square = square + m[:, i] * m[:, i]
        by[n] = np.flatnonzero(size == n), m / np.maximum(np.sqrt(square), 1e-12).reshape(-1, 1)
    return size, by


def contenders(scores: np.ndarray, k: int, near: float) -> np.ndarray:
    """The places whose scores, NaN first, can be among the k best once rounded; of equal scores the first k."""
    s = np.where(np.isnan(scores), np.inf, scores)
    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - near) if len(s) > k else np.arange(len(s))
    some = some[np.argsort(-s[some], kind="stable")]
    return some[np.arange(len(some)) - np.searchsorted(-s[some], -s[some]) < k]


def score_blocks(k: int, near: float):
    """A function over a block of queries (qid, q) and one of the catalogue (ix, v): (qid, ix, score) of the contenders."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("ix")
        (sizes, asked), (widths, held) = unit_rows(q["q"]), unit_rows(c["v"])
        found = []
        for n, (at, m) in asked.items():
            to, t = held.get(n, (np.array([], int), np.zeros((0, n))))
            t = np.ascontiguousarray(t.T)
            for lo in range(0, len(m) if len(to) else 0, AT_ONCE):
                x = m[lo : lo + AT_ONCE]
                s = np.zeros((len(x), len(to)))
                for i in range(n):  # in the order of the components, as an aggregate adds them
                    s += x[:, i, None] * t[i]
                for j, row in zip(at[lo:], s):
                    some = contenders(row, k, near)
                    found.append((np.full(len(some), j), to[some], row[some], np.zeros(len(some), bool)))
        for n in set(sizes.tolist()):  # pairs without a score can only fill up a ranking
            none = np.flatnonzero((widths != n) | (n < 0))[:k]
            at = np.flatnonzero(sizes == n)
            found.append((np.repeat(at, len(none)), np.tile(none, len(at)), np.zeros(len(at) * len(none)), np.ones(len(at) * len(none), bool)))
        rows, cols, scores, void = map(np.concatenate, zip(*found))
        return pa.table({"qid": q["qid"].take(pa.array(rows)), "ix": c["ix"].take(pa.array(cols)), "score": pa.array(scores, pa.float64(), mask=void)})

    return run


def each_with_each(queries: DataFrame, catalogue: DataFrame, rows: int, score) -> DataFrame:
    """(qid, ix, score) of what ``score`` finds in each block of queries (qid, ...) with each of the catalogue (ix, ...)."""
    left, right = (max(1, -(-d.count() // n)) for d, n in ((queries, QUERIES), (catalogue, rows)))
    mine = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(mine("qid", left).alias("_i"), each(right).alias("_j"), *queries.columns)
    c = catalogue.select(each(left).alias("_i"), mine("ix", right).alias("_j"), *catalogue.columns)
    kinds = ", ".join(f"{n} {d.schema[n].dataType.simpleString()}" for d, n in ((queries, "qid"), (catalogue, "ix")))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return score(a, b)
        return pa.table({"qid": a["qid"].slice(0, 0), "ix": b["ix"].slice(0, 0), "score": pa.array([], pa.float64())})

    return q.groupBy("_i", "_j").cogroup(c.groupBy("_i", "_j")).applyInArrow(run, f"{kinds}, score double")


def vector_topk(queries: DataFrame, catalogue: DataFrame, k: int, places: int = 6) -> DataFrame:
    """Queries (qid, q) against a catalogue (ix, v): dot products of unit vectors, rounded before ranking.

    Blocks of queries meet blocks of the catalogue, all with all; each pair of blocks is scored in one go and keeps what can be
    among the k best. Vectors that are null, hold a null or differ in length have a null score, which comes last.
    """
    found = each_with_each(queries.select("qid", "q"), catalogue.select("ix", "v"), ROWS, score_blocks(k, 1.01 * 10.0**-places))
    return top(found.withColumn("score", F.round("score", places)), ["qid"], "score", "ix", k)


#: Rows of a block of texts, and the words' pairs of query and text that a task counts at once.
TEXTS, PAIRS = 1024, 1 << 20


def words_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The words of texts that are words joined by spaces: the text's place and the word."""
    lists = pc.split_pattern(pa.concat_arrays(texts.chunks), " ")
    return np.asarray(pc.list_parent_indices(lists)), lists.flatten()


def score_texts(k: int, near: float):
    """A function over a block of queries (qid, h) and one of texts (ix, t, n, s): (qid, ix, score) of the contenders.

    ``h`` are a query's words, ``t`` the n distinct ones of a text, ``s`` its name as a request spells it.
    """

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("ix")
        rows, cols = q.num_rows, c.num_rows
        at, word = words_of(q["h"])
        words = word.filter(pc.not_equal(word, "")).unique()
        code = pc.index_in(word, words)
        at, code = at[np.asarray(code.is_valid())], np.asarray(code.drop_null())
        code, at = np.divmod(np.unique(code.astype(np.int64) * rows + at), rows)  # each word of a query once, by words
        many = np.bincount(code, minlength=len(words))
        first = np.cumsum(many) - many
        to, word = words_of(c["t"])
        code = pc.index_in(word, words)
        to, code = to[np.asarray(code.is_valid())], np.asarray(code.drop_null())
        ends, shared = np.cumsum(many[code]), np.zeros(rows * cols)
        cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)) + 1 if len(ends) else []
        for of, t in zip(np.split(code, cuts), np.split(to, cuts)):
            n = many[of]
            who = at[np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            shared += np.bincount(who * cols + np.repeat(t, n), minlength=rows * cols)
        n = np.asarray(c["n"])
        scores = shared.reshape(rows, cols) / np.sqrt(np.maximum(n, 1))
        names = c["s"].combine_chunks().dictionary_encode()
        of, asked = np.asarray(pc.fill_null(names.indices, -1)), pa.concat_arrays(q["h"].chunks)
        text = "\n".join(filter(None, asked.to_pylist()))
        for i, name in enumerate(names.dictionary.to_pylist()):
            if name and name in text:
                says = np.asarray(pc.fill_null(pc.match_substring(asked, name), False))
                scores[np.ix_(says, (of == i) & (n > 0))] += 1.0
        some = [contenders(row, k, near) for row in scores]
        who, which = np.repeat(np.arange(rows), list(map(len, some))), np.concatenate(some)
        return pa.table({"qid": q["qid"].take(pa.array(who)), "ix": c["ix"].take(pa.array(which)), "score": scores[who, which]})

    return run


def lexical_topk(queries: DataFrame, catalogue: DataFrame, k: int, places: int = 6) -> DataFrame:
    """Requests (qid, query) against tools (ix, name, text).

    Blocks of requests meet blocks of tools, all with all. Shared words are counted in a block over an inverted index of its
    requests, and each pair of blocks keeps what can be among the k best, so that no pair of request and tool leaves its block.
    """
    words = F.array_distinct(T.words(F.concat_ws(" ", "name", "text")))
    t = catalogue.select("ix", words.alias("_t"), F.regexp_replace(F.lower("name"), "_", " ").alias("s"))
    t = t.select("ix", F.array_join("_t", " ").alias("t"), F.size("_t").alias("n"), "s")
    q = queries.select("qid", T.normalise(F.col("query")).alias("h"))
    found = each_with_each(q, t, TEXTS, score_texts(k, 1.01 * 10.0**-places))
    return top(found.withColumn("score", F.round("score", places)), ["qid"], "score", "ix", k)


def choose_tools(scored: DataFrame, declared: DataFrame, room: int) -> DataFrame:
    """(qid, name, place): declared tools first in their order, then the catalogue by score, without declared names."""
    d = declared.select("qid", "name", F.lit(0).alias("_from"), F.col("ix"), F.lit(None).cast("double").alias("score"))
    c = scored.join(declared.select("qid", "name"), ["qid", "name"], "left_anti").select("qid", "name", F.lit(1).alias("_from"), "ix", "score")
    w = Window.partitionBy("qid").orderBy("_from", F.desc("score"), "ix")
    return d.unionByName(c).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= room).select("qid", "name", "place")


def recall_at_k(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of queries (qid, label) whose label is among their found rows."""
    hit = labels.join(found.select("qid", F.col("ix").alias("label"), F.lit(1).alias("_hit")), ["qid", "label"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))


def request_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two requests' words; two empty ones are alike."""
    return T.jaccard(F.array_distinct(T.words(a)), F.array_distinct(T.words(b)), 1.0)


def tool_tokens(name: Column, keys: Column) -> Column:
    """A tool's surface: its name and argument keys, cut at underscores."""
    return F.array_distinct(F.flatten(F.transform(F.concat(F.array(name), keys), lambda x: F.split(x, "_"))))


def tool_neighbours(tools: DataFrame, near: int = 2) -> DataFrame:
    """(name, other, overlap, place): tools by falling overlap; place <= near are the near ones."""
    t = tools.select("name", tool_tokens(F.col("name"), F.col("keys")).alias("t"))
    pairs = in_blocks(t, t.select(F.col("name").alias("other"), F.col("t").alias("u")), ix="other").filter("name <> other")
    scored = pairs.select("name", "other", T.jaccard(F.col("t"), F.col("u"), 0.0).alias("overlap"))
    w = Window.partitionBy("name").orderBy(F.desc("overlap"), "other")
    return scored.withColumn("place", F.row_number().over(w))
