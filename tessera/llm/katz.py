"""Operator 5: Katz backoff language model of any order, trigrams by default.

A text's tokens are its lower-cased words and one end; the first token's history is a start mark, no history reaches
behind it. With training counts c, Good-Turing discounts d per order for counts up to 5 (d = 1 above, or where counts of
counts give no proper discount), and base probabilities P1 of single tokens, likewise discounted, whose freed mass goes
to one unknown token, a token's probability after the history h is found recursively, h' being h without its first token:

    P(w | h) = d(c(h,w)) c(h,w) / c(h)   if c(h,w) > 0
             = alpha(h) P(w | h')        else, alpha(h) = (1 - sum of the first form over seen w) / (1 - sum of P(w | h') over seen w)
    P(w | h) = P(w | h')                 if c(h) = 0

so that the probabilities of all tokens after any history sum to 1 exactly. Every seen n-gram loses at least ``FREED`` of
its count, also where its discount is 1: a history met in frequent n-grams only would otherwise leave nothing to other
tokens, and a text with one of them would score minus infinity (a test shows it). The text's score is the sum of log10 P.

Everything is gathered from all training texts. Texts are read once into batches of about ``batch_tokens`` tokens (a
longer text is a batch of its own), each a file of the shared folder. Order by order, a batch sends its distinct n-grams
with their training counts to the parts of a count table, which add them up over the batches, number the n-grams they
hold, and send counts and numbers back in the order asked. An n-gram of order k is the pair (number of its first k - 1
tokens, number of its last), so that counts of n-grams are exact; words alone are told apart by 64-bit XXH64 hashes (ten
billion distinct words hold 3 equal pairs by expectation). A part holds all that follows a history, so that it also
sends back what alpha needs for the histories of held-out texts: how many seen n-grams have each count, and the sum over
them of the lower order's discounted counts. A history of more than ``hot`` tokens is dealt over several parts by its
last token, and its sums are added up by the batch. A hot token or n-gram costs one entry per batch. The number of parts
follows the number of tokens.

The tables stay in the folder of the returned :class:`Model` where ``keep`` is given: per order and part the n-grams, the
counts, and the lower counts whose sums the backoff weights are made of; :func:`score_with` scores other texts by them.

Defined results: a null text counts as empty: one token, the end. A text's share in training depends on its id alone;
null and repeated ids are rows like others. Without training texts all counts are 0 and the score is that of unknown
tokens. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import pack, pack_ints, unpack, unpack_ints

#: Numbers of what isn't a word: a question about a history, the end token, the start mark. Words come after them.
PROBE, END, START, FIRST = 0, 1, 2, 3
#: Counts above this aren't discounted.
K = 5
#: The least part of a count that a seen n-gram gives up.
FREED = 0.05
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A scattered 64-bit number for each number."""
    with np.errstate(over="ignore"):
        x = (x.astype(U64) ^ (x.astype(U64) >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def told_apart(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, each value's number): ``np.unique`` without its slower stable sort."""
    values, back = np.unique(x, return_inverse=True)
    back = back.ravel()
    at = np.empty(len(values), np.int64)
    at[back] = np.arange(len(x))
    return values, at, back


def discounts(nr: list[int]) -> np.ndarray:
    """Katz's discounts of counts 0 to K from the numbers nr[r] of types met r times (r to K + 1); 1 if improper."""
    d = np.ones(K + 1)
    if nr[1] > 0 and (common_part := (K + 1) * nr[K + 1] / nr[1]) < 1:
        for r in range(1, K + 1):
            if nr[r] > 0:
                x = ((r + 1) * nr[r + 1] / (r * nr[r]) - common_part) / (1 - common_part)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


@dataclass
class Model:
    """What all tasks need of the whole. ``nr[k]``: [sum, types, types met once, twice, ...] of order k, as far as counted; ``nr[0]``: [texts]."""

    where: str
    parts: int
    hot: int
    order: int
    nr: dict[int, list[int]]

    def __post_init__(self):
        self.nr = {int(k): v for k, v in self.nr.items()}
        self.d = {k: discounts([0, *v[2:]]) for k, v in self.nr.items() if k}
        self.n0, self.v = self.nr.get(1, [0, 0])[:2]
        r = np.arange(1, K + 1)
        met = np.array(self.nr.get(1, [0] * (K + 3))[2 : K + 2])
        self.n = self.n0
        self.unknown = float(((1 - self.d[1][1:]) * r * met).sum() / self.n) if self.n else 1.0
        if self.n and self.unknown <= 1e-12:  # nothing freed: the unknown token gets the share of one more token
            self.n, self.unknown = self.n + 1, 1 / (self.n + 1)

    def mass(self, k: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of order k."""
        m = np.where(c <= K, self.d[k][np.minimum(c, K)], 1.0) * c
        return m if k == 1 else np.maximum(np.minimum(m, c - FREED), 0)

    def p1(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.mass(1, c) / max(self.n, 1), self.unknown)

    def freed(self, k: int, classes: np.ndarray) -> np.ndarray:
        """What histories give up, from their numbers of n-grams of order k met once, twice, ... and over K times."""
        r = np.arange(1, K + 1)
        return classes @ np.append(r - self.mass(k, r), FREED)


# Texts to batches


class _Batch:
    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.null, self.train, self.size, self.stream, self.n = [], [], [], [], [], 0

    def add(self, doc_id, train: bool, text):
        w = common.words(text)
        number = self.number
        for x in set(w).difference(number):
            number[x] = len(number)
        self.stream.append(np.fromiter(map(number.__getitem__, w), np.uint32, len(w)))
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.train.append(train)
        self.size.append(len(w))
        self.n += len(w) + 1

    def saved(self, where: str):
        """(file, tokens, training texts). Word numbers follow the order of the hashes, so that these are stored as differences."""
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in self.number], U64)
        hashes, place = np.unique(h, return_inverse=True) if len(h) else (h, np.empty(0, np.int64))
        stream = place[np.concatenate(self.stream)] if self.stream else place
        docs = np.array([self.ids, self.null, self.train, self.size], np.int64)
        name = uuid.uuid4().hex
        common.put(f"{where}/{name}", [pack_ints(docs.ravel(), "<i8"), pack(stream), pack(np.diff(hashes, prepend=U64(0)))])
        return name, self.n, sum(self.train)


BATCH = pa.schema([("batch", pa.string()), ("tokens", pa.int64()), ("train", pa.int64())])


def batches_of(docs: DataFrame, held_out: Column, batch_tokens: int, where: str) -> DataFrame:
    """(batch, tokens, train): the files of batches; those of attempts that failed aren't named."""

    def run(batches):
        b = _Batch()
        for part in batches:
            for i in range(0, part.num_rows, 256):
                for doc_id, train, text in zip(*(c.to_pylist() for c in part.slice(i, 256).columns)):
                    b.add(doc_id, train, text)
                    if b.n >= batch_tokens:
                        yield common.batches_of([b.saved(where)], BATCH)
                        b = _Batch()
        if b.n:
            yield common.batches_of([b.saved(where)], BATCH)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out).alias("train"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "batch string, tokens long, train long")


# Questions of a batch


def pack_grams(ctx: np.ndarray, w: np.ndarray) -> list[bytes]:
    """Pairs in order: the distinct histories, how many tokens each has, and these."""
    start = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, np.int64)
    d = np.diff(w, prepend=w[:1])
    d[start] = w[start]
    return [pack(np.diff(ctx[start], prepend=ctx[:0].dtype.type(0))), pack(np.diff(np.append(start, len(ctx)))), pack(d)]


def unpack_grams(ctx: bytes, fan: bytes, w: bytes):
    """(distinct histories, tokens of each, tokens)."""
    fan, d = unpack(fan).astype(np.int64), unpack(w)
    total, start = np.cumsum(d, dtype=U64), np.cumsum(fan) - fan
    return np.cumsum(unpack(ctx), dtype=U64), fan, total - np.repeat(total[start] - d[start], fan)


class Questions:
    """A batch's n-grams, order by order as the answers come; ``ids`` and ``counts`` go by its distinct n-grams, -1 being none."""

    def __init__(self, model: Model, where: str, name: str, train_docs: int, answers: dict[int, list[dict]]):
        docs, stream, hashes = common.get(f"{where}/{name}")
        self.model = model
        self.doc_id, self.null, self.train, self.size = unpack_ints(docs, "<i8").reshape(4, -1)
        self.hashes = np.cumsum(unpack(hashes), dtype=U64)
        end, start, n = len(self.hashes), len(self.hashes) + 1, self.size + 1
        last = np.cumsum(n) - 1
        self.doc = np.repeat(np.arange(len(n)), n)
        self.token = np.full(int(n.sum()), end, np.int64)
        self.token[np.delete(np.arange(len(self.token)), last)] = unpack(stream)
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[last - self.size] = start
        self.at = np.arange(len(self.token)) - np.repeat(last - self.size, n)  # place in the text
        self.in_train = self.train[self.doc].astype(bool)
        self.extra = (END, START), train_docs
        self.gram, self.ids, self.counts, self.probes = {1: self.token}, {}, {}, {}
        for k in range(1, len(answers) + 1):
            self._take(k, answers[k])

    def ask(self, k: int):
        """(part, [history, token, training count, lower count]) of the distinct n-grams of order k, a row per part that is asked."""
        m = self.model
        if k == 1:
            part = ((self.hashes >> U64(32)) * U64(m.parts)) >> U64(32)
            n = np.bincount(self.token[self.in_train], minlength=len(self.hashes) + 1)[:-1] if len(self.token) else np.empty(0, np.int64)
            columns = np.zeros(len(self.hashes), U64), self.hashes, n, np.zeros(len(self.hashes), np.int64)
        else:
            part, columns = self._grams(k)
        cut = np.searchsorted(part, np.arange(m.parts + 1, dtype=part.dtype))
        for p, (i, j) in enumerate(zip(cut, cut[1:])):
            if i < j:
                c, w, n, low = (x[i:j] for x in columns)
                yield p, [*pack_grams(c, w), pack(n), pack(low)]

    def _grams(self, k: int):
        m, low = self.model, self.gram[k - 1]
        ctx = self.before if k == 2 else np.concatenate([[-1], low[:-1]])  # an n-gram of order k - 1 each, where there is one
        known, lower = self.counts[k - 1], self.counts[k - 1][low]
        there = (self.at >= k - 2) & (known[ctx] > 0)
        place = np.flatnonzero(there & (lower > 0))  # others can't have been seen
        asks = np.unique(ctx[there & ~self.in_train])  # histories of held-out tokens
        # ranks by number, so that one sort puts (part, history, token) in order
        words, pairs = np.argsort(self.ids[1]), np.argsort(self.ids[k - 1])
        rank_w, rank_c = np.empty(len(words), np.int64), np.empty(len(pairs), np.int64)
        rank_w[words], rank_c[pairs] = np.arange(1, len(words) + 1), np.arange(len(pairs))
        wide, high = len(words) + 1, max(1, len(pairs))
        parts_of = -(-known // m.hot)
        c, w = ctx[place], self.token[place]
        salt = np.where(parts_of[c] > 1, mixed(self.ids[1][w]) % np.maximum(parts_of[c], 1).astype(U64), U64(0))
        many = np.maximum(parts_of[asks], 1)
        c = np.concatenate([c, np.repeat(asks, many)])
        salt = np.concatenate([salt, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]).astype(U64)
        ask_w = np.concatenate([rank_w[w], np.zeros(int(many.sum()), np.int64)])
        part = (mixed(self.ids[k - 1][c].astype(U64) * U64(0x9E3779B97F4A7C15) + salt) % U64(m.parts)).astype(np.int64)
        code, at, back = told_apart((part * high + rank_c[c]) * wide + ask_w)
        self.gram[k] = np.full(len(self.token), -1)
        self.gram[k][place] = back[: len(place)]
        self.asked = asks, back[len(place) :], many
        n = np.bincount(back[: len(place)][self.in_train[place]], minlength=len(code))
        is_word = code % wide > 0
        below = np.zeros(len(code), np.int64)
        below[is_word] = lower[place[at[is_word]]]
        w_id = np.zeros(len(code), U64)
        w_id[is_word] = self.ids[1][words[code[is_word] % wide - 1]]
        c_id = self.ids[k - 1][pairs[code // wide % high]].astype(U64)
        return code // (wide * high), (c_id, w_id, n, below)

    def _take(self, k: int, rows: list[dict]):
        """The answers to the questions of order k."""
        m = self.model
        rows = sorted(rows, key=lambda r: r["part"])
        if k > 1:
            self._grams(k)
        counts = [unpack(r["counts"]).astype(np.int64) for r in rows]
        ids = []
        for r, c in zip(rows, counts):
            i = np.zeros(len(c), np.int64)
            i[c > 0] = np.cumsum(unpack(r["ranks"])).astype(np.int64) * m.parts + r["part"] + (FIRST if k == 1 else 0)
            ids.append(i)
        (extra, n) = self.extra if k == 1 else ((), 0)
        self.counts[k] = np.concatenate([*counts, [n] * len(extra), [0]]).astype(np.int64)  # the last stands for none
        self.ids[k] = np.concatenate([*ids, extra, [0]]).astype(np.int64)
        if k > 1:
            asks, back, many = self.asked
            classes, below = np.zeros((len(self.counts[k]), K + 1)), np.zeros(len(self.counts[k]))
            probe = np.zeros(len(self.counts[k]), bool)
            probe[back] = True
            got = [(unpack(r["classes"]).reshape(-1, K + 1), unpack(r["below"]).view(np.float64)) for r in rows]
            if got:
                classes[probe], below[probe] = np.concatenate([g for g, _ in got]), np.concatenate([b for _, b in got])
            # two shares of a history may have met in one part, which then has answered for both
            pair = np.unique(np.repeat(np.arange(len(asks)), many) * len(probe) + back)
            sums = np.zeros((len(asks), K + 2))
            np.add.at(sums, pair // len(probe), np.column_stack([classes, below])[pair % len(probe)])
            self.probes[k] = asks, sums

    def scores(self):
        """(known, base score, score) of each text."""
        m, n_docs = self.model, len(self.size)
        c1 = self.counts[1][self.token]
        base = np.bincount(self.doc, np.log10((c1 + 1) / (m.n0 + m.v + 1)), n_docs)
        p, prior = m.p1(c1), np.full(len(self.token), float(max(m.n, 1)))  # prior: the count of the lower order's history
        for k in range(2, m.order + 1):
            ctx = self.before if k == 2 else np.concatenate([[-1], self.gram[k - 1][:-1]])
            history = np.where(self.at >= k - 2, self.counts[k - 1][ctx], 0)
            c = self.counts[k][self.gram[k]]
            new = np.where(c > 0, m.mass(k, c) / np.maximum(history, 1), p)
            far = np.flatnonzero((c == 0) & (history > 0))
            asks, sums = self.probes[k]
            s = sums[np.searchsorted(asks, ctx[far])]
            new[far] = p[far] * (m.freed(k, s[:, :-1]) / history[far]) / (1 - s[:, -1] / prior[far])
            p, prior = new, history.astype(np.float64)
        return np.bincount(self.doc, c1 > 0, n_docs).astype(np.int64), base, np.bincount(self.doc, np.log10(p), n_docs)


# The count table

ASK = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("batch", pa.string()), ("ctx", pa.binary()), ("fan", pa.binary()), ("w", pa.binary()), ("n", pa.binary()), ("low", pa.binary())])
ASK_DDL = "level int, part int, batch string, ctx binary, fan binary, w binary, n binary, low binary"
#: kind "answer": to a batch; "sums": of a part; "table": the n-grams of a part.
ANSWER = pa.schema([("kind", pa.string()), *ASK, ("counts", pa.binary()), ("ranks", pa.binary()), ("classes", pa.binary()), ("below", pa.binary()), ("nr", pa.list_(pa.int64()))])
ANSWER_DDL = "kind string, " + ASK_DDL + ", counts binary, ranks binary, classes binary, below binary, nr array<long>"


def _add_up(model: Model, k: int):
    """Totals of one part, sent back to every batch in the order asked."""

    def run(key, table):
        part, names = key[0].as_py(), table["batch"].to_pylist()
        grams = [unpack_grams(*x) for x in zip(*(table[c].to_pylist() for c in ("ctx", "fan", "w")))]
        n, low = (np.concatenate([unpack(b).astype(np.int64) for b in table[c].to_pylist()]) for c in ("n", "low"))
        size = [len(w) for _, _, w in grams]
        ctx, at = np.unique(np.concatenate([c for c, _, _ in grams]), return_inverse=True)
        at = np.repeat(at.ravel(), np.concatenate([f for _, f, _ in grams]))
        w = np.concatenate([w for _, _, w in grams])
        wide = U64(0) if len(ctx) == 1 else w.max() + U64(1)
        if len(ctx) * int(wide) >= 1 << 64:
            raise ValueError("a part holds too many histories: raise the number of parts")
        code, first, back = told_apart(at.astype(U64) * wide + w)
        total = np.bincount(back, n, len(code)).astype(np.int64)
        seen = total > 0
        rank = np.cumsum(seen) - 1
        ctx_of, w_of, low_of = at[first], w[first], low[first]
        cls = np.bincount(ctx_of * (K + 2) + np.minimum(total, K + 1), minlength=len(ctx) * (K + 2)).reshape(-1, K + 2)[:, 1:]
        below = np.bincount(ctx_of[seen], model.mass(k - 1, low_of[seen]), len(ctx)) if k > 1 else None
        out, i = [], 0
        for name, s in zip(names, size):
            b = back[i : i + s]
            t, r = total[b], rank[b][seen[b]]
            probes = at[i : i + s][w[i : i + s] == PROBE] if k > 1 else []
            if name:
                out.append({"kind": "answer", "batch": name, "counts": pack(t), "ranks": pack(np.diff(r, prepend=0)), "classes": pack(cls[probes].ravel()), "below": pack(below[probes].view(U64)) if k > 1 else b""})
            i += s
        out.append({"kind": "sums", "nr": [int(total.sum()), int(seen.sum())] + [int((total == r).sum()) for r in range(1, K + 2)]})
        out.append({"kind": "table", "batch": "", **dict(zip(("ctx", "fan", "w"), pack_grams(ctx[ctx_of[seen]], w_of[seen]))), "n": pack(total[seen]), "low": pack(low_of[seen])})
        return pa.Table.from_pylist([{"level": k, "part": part} | r for r in out], schema=ANSWER)

    return run


def _asked(model: Model, where: str, train_docs: int, k: int):
    def run(key, table):
        name, answers = key[0].as_py(), {i: [] for i in range(1, k)}
        for r in table.filter(pc.is_valid(table["counts"])).to_pylist():
            answers[r["level"]].append(r)
        q = Questions(model, where, name, train_docs, answers)
        return pa.Table.from_batches([common.batches_of([(k, p, name, *blobs)], ASK) for p, blobs in q.ask(k)], schema=ASK)

    return run


OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(model: Model, where: str, train_docs: int):
    def run(key, table):
        answers = {i: [] for i in range(1, model.order + 1)}
        for r in table.filter(pc.is_valid(table["counts"])).to_pylist():
            answers[r["level"]].append(r)
        q = Questions(model, where, key[0].as_py(), train_docs, answers)
        known, base, score = q.scores()
        return pa.table({"doc_id": pa.array(q.doc_id, mask=q.null.astype(bool)), "held_out": q.train == 0, "n_tokens": q.size + 1, "n_known": known, "base_score": base, "score": score})

    return run


def _run(docs: DataFrame, held_out: Column, where: str, batch_tokens: int, parts: int | None, part_tokens: int, order: int, hot: int | None, given: Model | None) -> tuple[DataFrame, Model]:
    spark = docs.sparkSession
    files = common.written(batches_of(docs, held_out, batch_tokens, f"{where}/files"), f"{where}/batches")
    n_batches, tokens, train_docs = files.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    if given:
        model, end = Model(**asdict(given)), given.nr[0][0]
        known, model.where = {0: given.nr[0]}, where
    else:
        parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // part_tokens + 1)
        model, end = Model(where, parts, hot or max(part_tokens // 8, tokens // 65536, 1), order, {}), train_docs
        known = {0: [train_docs]}
    by_batch = max(1, min(n_batches, max(4 * spark.sparkContext.defaultParallelism, n_batches // 4)))
    names = files.select("batch", F.lit(None).cast("int").alias("level"), *[F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("counts", "binary"), ("ranks", "binary"), ("classes", "binary"), ("below", "binary"))])
    answers = names
    for k in range(1, model.order + 1):
        model = Model(where, model.parts, model.hot, model.order, known if not given else given.nr)
        ask = answers.repartition(by_batch, "batch").groupBy("batch").applyInArrow(_asked(model, f"{where}/files", end, k), ASK_DDL)
        if given:
            ask = ask.unionByName(spark.read.schema(ANSWER_DDL).parquet(f"{given.where}/{k}").filter("kind = 'table'").select(*ASK.names))
        totals = ask.repartition(model.parts, "part").groupBy("part").applyInArrow(_add_up(model, k), ANSWER_DDL)
        totals = common.written(totals, f"{where}/{k}", "kind")
        answers = answers.unionByName(totals.filter("kind = 'answer'").select(*names.columns))
        if not given:
            nr = totals.filter("kind = 'sums'").agg(*[F.coalesce(F.sum(F.get("nr", F.lit(i))), F.lit(0)) for i in range(K + 3)]).first()
            known[k] = [int(x) for x in nr]
            if k == 1 and train_docs:  # the end token
                known[1] = [x + y for x, y in zip(known[1], [train_docs, 1, *[int(train_docs == r) for r in range(1, K + 2)]])]
    model = Model(where, model.parts, model.hot, model.order, known if not given else given.nr)
    out = answers.repartition(by_batch, "batch").groupBy("batch").applyInArrow(_scored(model, f"{where}/files", end), OUT_DDL)
    out = common.written(out, f"{where}/scores")
    common.removed(spark, f"{where}/files", f"{where}/batches", *[f"{where}/{k}/kind={x}" for k in range(1, model.order + 1) for x in ("answer", "sums")])
    train_tokens = F.lit(model.n0).cast("long").alias("train_tokens")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens, "base_score", "score"), model


def score(docs: DataFrame, held_out: Column, batch_tokens: int = 1_000_000, parts: int | None = None, part_tokens: int = 1_500_000, order: int = 3, hot: int | None = None, keep: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    ``keep`` is a shared folder where the model stays, for :func:`load`; without it the tables go after use.
    """
    spark, where = docs.sparkSession, keep.rstrip("/") if keep else common.shared_dir(docs.sparkSession)
    out, model = _run(docs, held_out, where, batch_tokens, parts, part_tokens, order, hot, None)
    if keep:
        spark.createDataFrame([(json.dumps(asdict(model)),)], "model string").coalesce(1).write.parquet(f"{where}/model")
    else:
        common.removed(spark, *[f"{where}/{k}" for k in range(1, order + 1)])
    return out


def load(spark: SparkSession, where: str) -> Model:
    """The model that :func:`score` kept in ``where``."""
    return Model(**json.loads(spark.read.parquet(f"{where.rstrip('/')}/model").first().model) | {"where": where.rstrip("/")})


def score_with(docs: DataFrame, model: Model, batch_tokens: int = 1_000_000) -> DataFrame:
    """As :func:`score`, for texts that the model has not learned from; nothing is added to it."""
    where = common.shared_dir(docs.sparkSession)
    out, _ = _run(docs, F.lit(True), where, batch_tokens, None, 1, model.order, None, model)
    common.removed(docs.sparkSession, *[f"{where}/{k}" for k in range(1, model.order + 1)])
    return out


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents, learned from those whose id hash isn't held out (README: what trigrams cost)."""
    return score(common.documents(spark, sf_dir), common.crc_of_id() % 7 == 2, order=2)
