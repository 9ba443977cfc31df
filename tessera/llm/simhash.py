"""Operator 1: SimHash near-dedup by pigeonhole blocks.

A fingerprint has 64 bits; two documents are linked if their fingerprints differ in at most ``max_distance`` bits. Cut
into B blocks, two such fingerprints agree on at least B - max_distance of them, so that every link is found among the
fingerprints that agree on some choice of k = B - max_distance blocks. The join on blocks is a sort by (choice, agreed
bits); runs are compared in place and only links leave the task, a spanning forest for the longer runs.

Work goes over distinct fingerprints. A run longer than ``run_limit`` isn't compared: its fingerprints take an exact
other way. Two fingerprints are at distance d or less (d even) exactly if some value lies within d/2 of both, so each
is sent to all values within d/2, and those that meet at a value are linked to the least of them. At most 2081 (d = 4)
can meet at one value, whatever the data.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any other. Rows with a null
doc_id keep it and take part; their component_id is null only if no row of the component has an id. Repeated rows
come back repeated. Extra columns are ignored by ``near_duplicates``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, xxh64

BITS = 64
SEED = 42


#: A byte as eight lanes of one byte each, one per bit.
LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)

#: Shingles that are hashed at once.
CHUNK = 1 << 16


def _cuts(words: list[bytes], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined words and where each shingle starts and ends in them."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = max(1, len(words) - size + 1)
    return b" ".join(words), (end - length)[:n], end[-n:]


def _counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set."""
    total, b = np.zeros(BITS, np.int64), h.view(np.uint8).reshape(-1, 8)
    for i in range(0, len(h), 255):  # so many fit a lane
        total += LANES[b[i : i + 255]].sum(0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprints_of(texts, size: int = 4, distinct: bool = False) -> np.ndarray:
    """Fingerprints of texts; ``distinct`` counts a repeated shingle once."""
    out, waiting, n = np.zeros((len(texts), BITS), np.uint8), [], 0

    def flush():
        buffer = b"".join(j for _, j, _, _ in waiting)
        shift = np.cumsum([0] + [len(j) for _, j, _, _ in waiting])
        h = xxh64.slices(buffer, np.concatenate([s + o for (_, _, s, _), o in zip(waiting, shift)]), np.concatenate([e + o for (_, _, _, e), o in zip(waiting, shift)]), SEED)
        at = 0
        for i, _, s, _ in waiting:
            own = h[at : at + len(s)]
            at += len(s)
            own = np.unique(own) if distinct else own
            out[i] = _counts(own) * 2 > len(own)
        waiting.clear()

    for i, text in enumerate(texts):
        w = common.words(text)
        if not w:
            continue
        joined, start, end = _cuts(w, size)
        if len(start) > CHUNK:  # a very long text is counted piece by piece
            h = [xxh64.slices(joined, start[k : k + CHUNK], end[k : k + CHUNK], SEED) for k in range(0, len(start), CHUNK)]
            h = np.unique(np.concatenate(h)) if distinct else np.concatenate(h)
            out[i] = _counts(h) * 2 > len(h)
            continue
        waiting.append((i, joined, start, end))
        n += len(start)
        if n >= CHUNK:
            flush()
            n = 0
    if waiting:
        flush()
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, size: int = 4, distinct: bool = False) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                fp = fingerprints_of(part.column(1).to_pylist(), size, distinct)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def blocks(n: int) -> list[tuple[int, int]]:
    """The (first bit, width) of n nearly equal blocks."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def scheme(rows: int, max_distance: int) -> tuple[int, int]:
    """(blocks, blocks to agree on) of least expected work for so many fingerprints; every choice finds all links."""

    def cost(k: int) -> float:
        tables, least = comb(max_distance + k, k), k * (BITS // (max_distance + k))
        return tables * rows * (1 + 0.05 * rows / 2.0**least)

    k = min(range(1, 9), key=cost)
    return max_distance + k, k


def _masks(max_distance: int, rows: int) -> list[int]:
    total, k = scheme(rows, max_distance)
    parts = [((1 << w) - 1) << a for a, w in blocks(total)]
    return [sum(chosen) for chosen in combinations(parts, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(f: np.ndarray, d: int):
    """Edges of a spanning forest of the links among the distinct fingerprints ``f``."""
    rest = np.arange(1, len(f))
    stack, a, b = [0], [], []
    while len(rest) or stack:
        if not stack:
            stack.append(int(rest[0]))
            rest = rest[1:]
        at = stack.pop()
        near = np.bitwise_count(f[rest] ^ f[at]) <= d
        found = rest[near]
        if len(found):
            a.append(np.full(len(found), at))
            b.append(found)
            stack.extend(found.tolist())
            rest = rest[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _scan(max_distance: int, run_limit: int, all_pairs: int = 64):
    """Reads (choice, key, fp) in order and yields links; fingerprints of runs over run_limit come with b = null."""

    def links(t, k, f):
        """Links of whole runs."""
        new = np.ones(len(f), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        run, start = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(start, len(f)))
        small = np.flatnonzero(size[run] <= all_pairs)
        small = small[size[run[small]] > 1]
        left = (start + size)[run[small]] - small  # rows of the run from this one on
        for lag in range(1, all_pairs):
            small, left = small[left > lag], left[left > lag]
            if not len(small):
                break
            ok = np.bitwise_count(f[small] ^ f[small + lag]) <= max_distance
            if ok.any():
                yield f[small[ok]], f[small[ok] + lag]
        for r in np.flatnonzero(size > all_pairs):
            g = f[start[r] : start[r] + size[r]]
            a, b = _forest(g, max_distance)
            if len(a):
                yield g[a], g[b]

    def out(a, b):
        lo, hi = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    def over(f):
        return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.nulls(len(f), pa.int64())], names=["a", "b"])

    def run(batches):
        t, k, f = (np.empty(0, d) for d in (np.int32, np.int64, np.uint64))
        long_run = None
        for b in batches:
            bt, bk, bf = (np.asarray(b.column(i)) for i in range(3))
            t, k, f = np.concatenate([t, bt]), np.concatenate([k, bk]), np.concatenate([f, bf.view(np.uint64)])
            if not len(f):
                continue
            if long_run:
                same = (t == long_run[0]) & (k == long_run[1])
                if same.any():
                    yield over(f[same])
                    t, k, f = t[~same], k[~same], f[~same]
                    if not len(f):
                        continue
                long_run = None
            last = np.flatnonzero((t != t[-1]) | (k != k[-1]))
            cut = last[-1] + 1 if len(last) else 0
            for x, y in links(t[:cut], k[:cut], f[:cut]) if cut else ():
                yield out(x, y)
            t, k, f = t[cut:], k[cut:], f[cut:]
            if len(f) > run_limit:
                long_run = (t[0], k[0])
                yield over(f)
                t, k, f = t[:0], k[:0], f[:0]
        if len(f):
            for x, y in links(t, k, f):
                yield out(x, y)

    return run


def _near_values(radius: int):
    masks = np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BITS), r)], np.uint64)

    def run(batches):
        for b in batches:
            f = np.asarray(b.column(0)).view(np.uint64)
            for i in range(0, len(f), 64):
                g = f[i : i + 64]
                z = (g[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(g, len(masks)).view(np.int64))], names=["z", "fp"])

    return run


def links(fps: DataFrame, max_distance: int, where: str, run_limit: int = 16384) -> DataFrame:
    """(a, b), a < b: links among the distinct fingerprints ``fps`` that join the same ones as all links do.

    ``max_distance`` is even; ``where`` is a shared folder for intermediate tables.
    """
    if max_distance % 2:
        raise ValueError("max_distance must be even")
    n = fps.count()
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).cast("long").alias("m")) for i, m in enumerate(_masks(max_distance, max(n, 1)))])
    keyed = fps.select("fp", F.explode(masks).alias("x")).select(F.col("x.t").cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    found = common.written(keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(_scan(max_distance, run_limit), "a long, b long"), f"{where}/found")
    # nobody meets more than a bounded number of others at one value
    over = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    meet = over.mapInArrow(_near_values(max_distance // 2), "z long, fp long")
    least = meet.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a < most").select("z", "a")
    rest = meet.join(least, "z").filter("fp > a").select("a", F.col("fp").alias("b"))
    return found.filter("b is not null").unionByName(rest).distinct()


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, root) of every node with an edge (a, b), by alternating large and small stars until nothing changes.

    Each round is written to the shared folder, so that a lost executor repeats one round at most.
    """
    spark = edges.sparkSession
    edges = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{where}/e0")
    seen, i = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, f"{where}/l{i}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        small = small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).filter("u > v").distinct()
        i += 1
        edges = common.written(small, f"{where}/e{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.removed(spark, f"{where}/e{i - 1}", f"{where}/l{i - 1}")
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 4, max_distance: int = 4, distinct: bool = False, run_limit: int = 16384) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    where = common.shared_dir(spark)
    prints = common.written(fingerprints(docs, size, distinct), f"{where}/prints")
    ids = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), f"{where}/ids")
    found = components(links(ids.select("fp"), max_distance, where, run_limit), f"{where}/cc")
    roots = ids.join(found, ids.fp == found.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    roots = common.written(roots, f"{where}/roots")
    common.removed(spark, *[f"{where}/{x}" for x in ("ids", "found", "cc")])
    of_root = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = roots.join(of_root, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


#: Bands of minima and minima per band: a pair of similarity 0.8 shares no band in 3 of a million cases.
BANDS, ROWS = 24, 4


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` hash functions, the same in every process."""
    r = np.random.default_rng(SEED).integers(0, 1 << 64, (2, n), np.uint64)
    return r[0] | np.uint64(1), r[1]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; none for a text without words."""
    w = common.words(text)
    return np.unique(xxh64.slices(*_cuts(w, size), SEED)) if w else np.empty(0, np.uint64)


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key per band of the set ``h``: two sets share that of a band with probability similarity ** ROWS."""
    factor, summand = _factors(BANDS * ROWS)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        least = np.minimum(least, (h[None, i : i + 4096] * factor[:, None] + summand[:, None]).min(1))
    mixed, (factor, summand) = least.reshape(BANDS, ROWS), _factors(ROWS + 1)
    key = np.arange(BANDS, dtype=np.uint64) * factor[ROWS]
    for k in range(ROWS):
        key = (key ^ mixed[:, k]) * factor[k]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def bands(docs: DataFrame, size: int) -> DataFrame:
    """(node, t, key): the key of each band t of the texts of ``docs`` (node, text)."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                keys = [band_keys(shingle_set(text, size)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    kind = docs.schema["node"].dataType.simpleString()
    return docs.mapInArrow(run, f"node {kind}, keys array<long>").select("node", F.posexplode("keys").alias("t", "key"))


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (node, text) with the distinct hashes of each text's shingles, h, in place of the text."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingle_set(text, size).view(np.int64) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "h"])

    return docs.mapInArrow(run, f"node {docs.schema['node'].dataType.simpleString()}, h array<long>")


def _similarity(a: str, b: str):
    """Jaccard similarity of two sets; that of two empty ones is 1."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(all_ == 0, 1.0).otherwise(both / (all_ - both))


def _joins(h: pa.ListArray, label: np.ndarray, asks: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that join the labels as all similar pairs (one asks, any) do."""
    flat = np.asarray(h.flatten())
    size = np.diff(np.asarray(h.offsets))
    start, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    post, many = owner[order], np.bincount(number)
    at, label, out = np.cumsum(many) - many, label.copy(), []
    for d in np.flatnonzero(asks):
        ids = number[start[d] : start[d] + size[d]]
        n = many[ids]
        # the sets that hold each of the ids, one slice after another
        both = np.bincount(post[np.arange(n.sum()) + np.repeat(at[ids] - (np.cumsum(n) - n), n)], minlength=len(size))
        all_ = size + size[d] - both
        near = np.flatnonzero((both / np.maximum(all_, 1) >= np.where(all_ > 0, similarity, 0)) & (label != label[d]))
        new, which = np.unique(label[near], return_index=True)
        if len(new):
            out += [(d, e) for e in near[which]]
            label[np.isin(label, new)] = label[d]
            if (label == label[0]).all():
                break
    return out


def _compare(similarity: float):
    """Reads (key, i, j, asks, node, root, h), block after block (key, i, j), and yields the pairs of ``_joins``."""

    def run(batches):
        def joined(rows: pa.Table):
            root = rows["root"].combine_chunks()
            pairs = _joins(rows["h"].combine_chunks(), np.asarray(root.dictionary_encode().indices), np.asarray(rows["asks"].combine_chunks()), similarity)
            node = rows["node"].combine_chunks()
            a, b = (node.take(pa.array([int(x[k]) for x in pairs], pa.int64())) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        waiting, block = [], None
        for b in batches:
            at = [np.asarray(b.column(k)) for k in range(3)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                now = tuple(int(x[lo]) for x in at)
                if waiting and now != block:
                    yield joined(pa.Table.from_batches(waiting))
                    waiting = []
                block = now
                waiting.append(b.slice(lo, hi - lo))
        if waiting:
            yield joined(pa.Table.from_batches(waiting))

    return run


def _left(members: DataFrame, sets: DataFrame, labels: DataFrame, where: str, similarity: float) -> DataFrame | None:
    """(a, b): similar pairs among the members of each key that no ``labels`` join yet and that aren't with its head.

    Members outside the head's group ask all others. They meet in blocks of bounded size: each asking part meets each
    part of all. None if nothing is left.
    """
    rows = members.filter("node <> head").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.join(labels.select(F.col("node").alias("head"), F.col("root").alias("of_head")), "head", "left")
    rows = rows.withColumn("asks", F.col("root") != F.coalesce("of_head", "head")).select("key", "node", "root", "asks")
    open_ = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rows = common.written(rows.join(open_, "key", "left_semi"), f"{where}/open")
    if rows.isEmpty():
        return None
    sized = rows.join(sets.select("node", F.size("h").alias("n")), "node")
    parts = sized.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK) + F.lit(1e-9)).alias("all_"), F.ceil(F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)) / F.lit(BLOCK // 2) + F.lit(1e-9)).alias("some"))
    # dealt by a share of the node too, so that a key of very many rows isn't one task
    share = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SHARES)).cast("int")
    rows = rows.withColumn("share", share).join(parts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["key", "share"]).drop("share")
    mine = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    asking = rows.filter("asks").select("key", mine("some", 1).alias("i"), each("all_").alias("j"), "asks", "node", "root")
    asked = rows.select("key", each("some").alias("i"), mine("all_", 2).alias("j"), F.lit(False).alias("asks"), "node", "root")
    block = asking.unionByName(asked).join(sets, "node").select("key", "i", "j", "asks", "node", "root", "h")
    block = block.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    kind = members.schema["node"].dataType.simpleString()
    return common.written(block.mapInArrow(_compare(similarity), f"a {kind}, b {kind}"), f"{where}/joins")


#: Shingles of a block that are compared at once, and the shares that the rows of a key are dealt in.
BLOCK, SHARES = 1 << 20, 16


def _linked(fps: DataFrame, where: str, max_distance: int = 4) -> DataFrame:
    """(x, y): pairs of nodes to be checked, of texts (node, fp): all of a fingerprint with its least node, and the least
    nodes of linked fingerprints."""
    heads = common.written(fps.groupBy("fp").agg(F.min("node").alias("x"), F.count("*").alias("n")), f"{where}/heads")
    found = links(heads.select("fp"), max_distance, where)
    of = lambda a, x: heads.select(F.col("fp").alias(a), F.col("x").alias(x))
    across = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    within = fps.join(heads.filter("n > 1").select("fp", "x"), "fp").filter("node <> x").select("x", F.col("node").alias("y"))
    return across.unionByName(within)


def _copies(texts: Callable[[DataFrame | None], DataFrame], where: str, size: int, similarity: float) -> DataFrame:
    """(node) of texts that aren't the first of their group: the groups join all pairs that are linked by SimHash or share a
    key of ``bands``, and are similar enough. ``texts`` gives (node, text) of some nodes, or of all."""
    prints = texts(None).withColumnRenamed("node", "doc_id")
    prints = common.written(fingerprints(prints, size, True).select(F.col("doc_id").alias("node"), "fp"), f"{where}/prints")
    linked = common.written(_linked(prints, f"{where}/simhash"), f"{where}/linked")
    keys = common.written(bands(texts(None), size), f"{where}/bands")
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    members = common.written(keys.join(heads, "key").select("t", "key", "head", "node"), f"{where}/members")
    common.removed(keys.sparkSession, f"{where}/bands")
    banded = members.filter("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    pairs = common.written(banded.unionByName(linked).distinct(), f"{where}/pairs")
    asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    sets = common.written(shingle_sets(texts(asked), size), f"{where}/sets")
    near = pairs.join(sets.select(F.col("node").alias("x"), F.col("h").alias("g")), "x").join(sets.select(F.col("node").alias("y"), "h"), "y")
    near = common.written(near.filter(_similarity("g", "h") >= similarity).select(F.col("x").alias("a"), F.col("y").alias("b")), f"{where}/near")
    labels = common.written(components(near, f"{where}/cc"), f"{where}/labels")
    # what the first band joins needn't be compared in the others
    for k, some in enumerate(("t = 0", "t > 0")):
        more = _left(members.filter(some), sets, labels, f"{where}/left{k}", similarity)
        if more is not None:
            near = near.unionByName(more)
            labels = common.written(components(near, f"{where}/cc{k}"), f"{where}/labels{k}")
    return labels.filter("node <> root").select("node")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` per group of copies and near copies, that of the smallest doc_id; all columns stay.

    Texts of Jaccard similarity ``similarity`` or more, by their sets of ``size``-word shingles, form a group. They are
    looked for by the fingerprints' links and, because many of that similarity lie further apart than four bits, by
    minima of hashes; each one found is checked exactly. In a run of equal keys all are held against the first; whoever that leaves in another group is
    held against all others.

    Every row is a document: rows that share a doc_id but not the text are told apart, of rows that repeat both one
    stays, and rows without a doc_id come after all others. Null and empty texts are copies of each other.
    """
    spark = docs.sparkSession
    where = common.shared_dir(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, least, n, node, nth = common.fresh(docs, "key", "least", "n", "node", "nth")
    marked = docs.withColumn(key, F.unhex(F.sha2(text.cast("binary"), 256)))
    # of each text the smallest id, and how many rows have both; numbers in the order of the ids
    counted = marked.select("doc_id", F.col(key).alias("key")).groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    distinct = counted.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("x")).select("key", "x.*")
    distinct = common.written(distinct, f"{where}/distinct").repartitionByRange("none", "doc_id").sortWithinPartitions("none", "doc_id", "key")
    distinct = common.written(distinct.select(F.col("key").alias(f"{key}_"), F.col("doc_id").alias(least), F.col("n").alias(n), F.monotonically_increasing_id().alias(node)), f"{where}/numbered")

    def rows(some: DataFrame) -> DataFrame:
        """The rows of ``docs`` that ``some`` of the distinct texts stand for, with their number."""
        # the id is part of the join, so that a text of very many rows isn't one key
        return marked.join(some, (F.col(key) == F.col(f"{key}_")) & F.col("doc_id").eqNullSafe(F.col(least)))

    def texts(nodes: DataFrame | None) -> DataFrame:
        some = distinct if nodes is None else distinct.join(nodes.withColumnRenamed("node", node), node, "left_semi")
        found = rows(some).select(F.col(node).alias("node"), text.alias("text"), F.col(n).alias("n"))
        return found.filter("n = 1").select("node", "text").unionByName(found.filter("n > 1").groupBy("node").agg(F.first("text").alias("text")))

    gone = common.written(_copies(texts, f"{where}/copies", size, similarity), f"{where}/gone")
    common.removed(spark, f"{where}/distinct", f"{where}/copies")
    kept = rows(distinct.join(gone.withColumnRenamed("node", node), node, "left_anti"))
    first = F.row_number().over(Window.partitionBy(node).orderBy(F.to_json(F.struct(*common.columns(docs)))))
    repeated = kept.filter(F.col(n) > 1).withColumn(nth, first).filter(F.col(nth) == 1)
    return kept.filter(F.col(n) == 1).select(common.columns(docs)).unionByName(repeated.select(common.columns(docs)))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by 4-word shingles at 4 bits."""
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
