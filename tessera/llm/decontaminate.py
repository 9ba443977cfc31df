"""Operator 10: benchmark decontamination with a generalised suffix automaton of the normalised items.

The automaton holds every word sequence that occurs in an item. Each document is streamed through it: the state is the
longest sequence of items that ends at the current word, its length tracked, held to ``window`` words. Where the length
reaches the window, the last ``window`` words are hit and the state names the items that hold them; items shorter than
a window are states of their own.

Ahead of the walk, whole batches are reduced with numpy to runs in which each word, and each pair of neighbours, occurs
in some item; no window can lie outside such a run of its own length, so this leaves nothing out.

Items are dealt by a hash to automata of about ``max_item_words`` words (or one item), which are built in tasks and saved in
the shared folder under names that no other attempt uses; the driver sees their names. Documents are read once: a task
splits its texts once and walks them through one automaton after another, of which a worker holds ``HELD``, so that memory
stays bounded whatever the benchmark's size, and puts together what each has found.

Defined results: null and empty texts have no words (0 words, 0 hits, no items, not contaminated); null items and items
without words have no windows; equal items all count; rows with a null or repeated doc_id come back one by one; a very long
text is walked like any other. Extra
columns of documents are kept by ``clean`` and ignored by ``matches``. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Keeps 0-9, a-z and all bytes of code points over 0x7F, lower-cases A-Z, and makes a space of the rest.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SEP = set(range(128)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def spans_of_words(text: str) -> list[tuple[int, int]]:
    """Where each word of ``words(text)`` starts and ends, in code points."""
    out, start = [], None
    for i, c in enumerate(text):
        if ord(c) in SEP:
            if start is not None:
                out.append((start, i))
                start = None
        elif start is None:
            start = i
    if start is not None:
        out.append((start, len(text)))
    return out


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end at each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        pairs, whole = set(), []
        for k, (_, item) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number)) for w in item]
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._add(last, c)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add(k)
            if 0 < len(ids) < window:
                whole.append((k, ids))
        # a longer sequence's items also hold its suffixes; only states that span the window are asked for theirs
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                ends[self.link[s]] |= ends[s]
        self.items = {s: tuple(ends[s]) for s in range(1, len(self.next)) if self.length[s] >= window}
        self.short_at: dict[tuple[int, int], list[int]] = {}
        for k, ids in whole:
            s = 0
            for c in ids:
                s = self.next[s][c]
            self.short_at.setdefault((s, len(ids)), []).append(k)
        self.has_short = {s for s, _ in self.short_at}
        sizes = [min(window, len(i)) for _, i in items if i]
        self.least = min(sizes, default=window)
        self.base = max(1, len(self.number))
        self.pairs = np.sort(np.array([a * self.base + b for a, b in pairs], np.int64))

    def _copy(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[last] + 1 == self.length[q] else self._copy(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._copy(p, q, c)
        return new

    def walk(self, ids: list[int]):
        """(first word, end word, items) of every window, in order of their ends."""
        s = n = 0
        for i, c in enumerate(ids, 1):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            s = self.next[s].get(c, 0)
            n = n + 1 if s else 0
            while n > self.window or (s and self.length[self.link[s]] >= self.window):
                if self.length[self.link[s]] >= self.window:
                    s = self.link[s]
                n = min(n, self.window)
            if n == self.window:
                yield i - n, i, self.items[s]
            if self.has_short:
                t, m = s, n
                while t:
                    if t in self.has_short:
                        for size in range(min(m, self.window - 1), self.length[self.link[t]], -1):
                            if (t, size) in self.short_at:
                                yield i - size, i, self.short_at[t, size]
                    t = self.link[t]
                    m = self.length[t]

    def runs(self, ids: np.ndarray):
        """(start, end) of the runs that can hold a window."""
        known = ids >= 0
        if self.least >= 2:
            ok = known[:-1] & known[1:]
            at = np.flatnonzero(ok)
            code = ids[at].astype(np.int64) * self.base + ids[at + 1]
            found = np.searchsorted(self.pairs, code)
            ok[at] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == code
            need = self.least - 1
        else:
            ok, need = known, 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long_enough = end - start >= need
        return start[long_enough], end[long_enough] + (self.least >= 2)


MADE = pa.schema([("path", pa.string()), ("words", pa.int64())])


def automata(items: DataFrame, where: str, window: int, max_item_words: int) -> list[str]:
    """Files of the shared folder, an automaton of about ``max_item_words`` words in each, built in as many tasks."""
    size = F.regexp_count(F.col("t"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).withColumn("n", size).filter("n > 0")
    rows = common.written(rows, f"{where}/items")
    n = rows.agg(F.coalesce(F.ceil(F.sum("n") / F.lit(max_item_words)), F.lit(0))).first()[0]
    if not n:
        return []
    # items of any order and size are dealt evenly by a hash; one that is longer than an automaton's share has to be whole
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition(min(n, 4096), "part").sortWithinPartitions("part", "i", "t")

    def build(batches):
        part, held = None, []
        for b in batches:
            for i, t, k in zip(*(c.to_pylist() for c in b.columns)):
                if k != part and held:
                    yield made(held)
                    held = []
                part = k
                held.append((i, words(t)))
        if held:
            yield made(held)

    def made(held):
        path = f"{where}/automata/{uuid.uuid4().hex}"
        common.put(path, [pickle.dumps(Automaton(held, window))])
        return common.batches_of([(path, sum(len(w) for _, w in held))], MADE)

    files = common.written(dealt.select("i", "t", "part").mapInArrow(build, "path string, words long"), f"{where}/made")
    return sorted(r.path for r in files.select("path").toLocalIterator())  # a name per automaton


#: Automata that a worker has at hand, by file; the least recently used goes first.
_AT_HAND: OrderedDict[str, Automaton] = OrderedDict()
HELD = 4


def _automaton(path: str) -> Automaton:
    if path not in _AT_HAND:
        while len(_AT_HAND) >= HELD:
            _AT_HAND.popitem(last=False)
        _AT_HAND[path] = pickle.loads(common.get(path)[0])
    _AT_HAND.move_to_end(path)
    return _AT_HAND[path]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _hits(m: Automaton, docs: list[list[bytes]]):
    """For each document: sorted disjoint (first, end) word spans, and the set of item names."""
    hit: list[list[tuple[int, int]]] = [[] for _ in docs]
    names: list[set[str]] = [set() for _ in docs]
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = [w for d in docs for w in d]
    first = np.cumsum(size) - size
    ids = np.fromiter(map(m.number.get, flat, repeat(-1)), np.int64, len(flat))
    # a separator after each document would cost a copy: runs are cut at document bounds below
    for a, b in zip(*(x.tolist() for x in m.runs(ids))) if len(ids) else ():
        k = int(np.searchsorted(first, a, side="right")) - 1
        while a < b:
            while first[k] + size[k] <= a:
                k += 1
            end = min(b, int(first[k] + size[k]))
            if end - a >= m.least:
                for x, y, which in m.walk(ids[a:end].tolist()):
                    hit[k].append((a + x - int(first[k]), a + y - int(first[k])))
                    names[k].update(m.names[i] for i in which)
            a = end
    return [_merged(h) for h in hit], names


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
FOUND_DDL = "items array<string>, spans array<struct<first: long, end: long>>"


#: Characters of the texts that meet one automaton after another where there are more than a worker holds.
AT_ONCE = 16 << 20


def _found(docs: DataFrame, at: int, items: DataFrame, window: int, max_item_words: int, finish, ddl) -> DataFrame:
    """``finish(rows, words, spans, names)`` for batches of ``docs`` (texts in column ``at``), of which it makes batches of ``ddl``."""
    files = automata(items, common.shared_dir(docs.sparkSession), window, max_item_words)

    def sliced(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part, part.column(at).cast(pa.string()).to_pylist()

    def together(parts):
        """Slices, many at a time where automata have to be loaded for each lot."""
        lot, n = [], 0
        for part, texts in parts:
            lot.append((part, texts))
            n += sum(len(t or "") for t in texts)
            if len(files) <= HELD or n >= AT_ONCE:
                yield lot
                lot, n = [], 0
        if lot:
            yield lot

    def run(batches):
        for lot in together(sliced(batches)):
            split = [[words(t) for t in texts] for _, texts in lot]
            hits = [([[] for _ in s], [set() for _ in s]) for s in split]
            for path in files:
                model = _automaton(path)
                for s, (spans, names) in zip(split, hits):
                    for k, (h, who) in enumerate(zip(*_hits(model, s))):
                        if h:
                            spans[k] += h
                            names[k] |= who
            for (part, _), s, (spans, names) in zip(lot, split, hits):
                yield finish(part, s, [_merged(h) for h in spans], names)

    return docs.mapInArrow(run, ddl)


def matches(docs: DataFrame, items: DataFrame, window: int = 10, max_item_words: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) per row of ``docs``; spans are of words, end exclusive."""

    def finish(part, split, hit, names):
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(list(map(len, split)), pa.int64()),
                pa.array([sum(y - x for x, y in h) for h in hit], pa.int64()),
                pa.array([sorted(n) for n in names], pa.list_(pa.string())),
                pa.array([[{"first": x, "end": y} for x, y in h] for h in hit], SPANS),
            ],
            names=["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _found(docs, 1, items, window, max_item_words, finish, f"doc_id long, n_words long, n_hit long, {FOUND_DDL}")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, max_item_words: int = 200_000) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``; documents of which more than ``max_coverage`` is hit go.

    A cut takes the words of a span and what stands between them. All columns stay; ``n_chars``, where it exists,
    follows the new text.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(text, spans):
        where, out, last = spans_of_words(text), [], 0
        for x, y in spans:
            out.append(text[last : where[x][0]])
            last = where[y - 1][1]
        return "".join([*out, text[last:]])

    def finish(part, split, hit, names):
        keep = [sum(y - x for x, y in h) <= max_coverage * len(w) for h, w in zip(hit, split)]
        touched = [k for k, h in enumerate(hit) if h and keep[k]]
        if touched:
            cols, texts = part.columns, part.column(at).to_pylist()
            for k in touched:
                texts[k] = cut(texts[k], hit[k])
            cols[at] = pa.array(texts, part.schema.field(at).type)
            if chars is not None:
                n = part.column(chars).to_pylist()
                for k in touched:
                    n[k] = len(texts[k])
                cols[chars] = pa.array(n, part.schema.field(chars).type)
            part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
        return part.filter(pa.array(keep, pa.bool_()))

    rows = common.plain(docs)
    return _found(rows, at, items, window, max_item_words, finish, rows.schema).toDF(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against all benchmark items, windows of 10 words."""
    found = matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle(window: int = 10) -> str:
    """The same as DuckDB SQL."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])".replace("\\\\", "\\")
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
  b AS (SELECT item_id::VARCHAR AS item, {split} AS w FROM benchmark),
  s AS (SELECT *, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
  win AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
  dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
  m AS MATERIALIZED (SELECT r, i, dw.n AS n, item FROM dw JOIN win USING (n, key)),
  h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
  k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)"""
