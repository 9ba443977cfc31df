"""Operator 3: approximate nearest neighbours by few stable projections and a kd-tree.

Vectors are brought to unit length, so that the largest cosine is the smallest Euclidean distance d, and projected on
``projections`` Gaussian directions. Over the square of the true distance, that of the projected one follows a
chi-square law of as many degrees of freedom, so that a vector nearer than a query's k-th best would stand beyond the
projected distance b with probability 1 - chi2_cdf(b^2 / d_k^2) at most: what lies further off than where that falls
under 1 - ``confidence`` isn't verified.

One kd-tree spans all rows. Its upper levels are fitted to a bounded sample of projected points (``SAMPLE`` rows,
``CELLS`` cells at most) and deal every row to a cell of about ``block_rows``; inside a cell the tree goes on to its
leaves. Where the table has outgrown ``CELLS`` cells, a cell is held in shares of about ``cell_rows`` rows, each a task's work with a
tree of its own, so that memory stays bounded and no row is left out. A query first visits the nearest ``first`` cells, leaf by leaf in order of distance, verifying vectors until the
test stops it. What it has found by then bounds the cells it still has to visit, and it is sent to those alone. On
vectors without structure, whose nearest are hardly nearer than the rest, no projection can exclude much, and queries
meet most cells (README).

Equal vectors are one candidate with their k + 1 smallest ids, and equal queries are one query, so that a hot vector is
no hot group. Where many queries meet in one cell, they are dealt into parts of ``query_rows``, each with the cell's rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do
null ids; vectors of another length than the query's aren't its candidates; ties go to the smaller id; a row that repeats
an id, or a whole row, is a query and a candidate of its own, so that a query leaves out its own row only. Extra columns
are ignored. Empty table: no rows.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

SEED = 7
LEAF = 64
#: Bounds of what the driver fits the cells to, and of their number.
SAMPLE, CELLS = 1 << 17, 1 << 13


def chi2_cdf(x: np.ndarray, dof: int) -> np.ndarray:
    """The chi-square distribution for an even number of degrees of freedom."""
    h = np.minimum(x / 2, 700)
    return 1 - np.exp(-h) * sum(h**i / factorial(i) for i in range(dof // 2))


def leaves_of(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree: halved at the median of the widest side until ``leaf`` points are left."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        p = points[rows]
        side = int(np.argmax(p.max(0) - p.min(0)))
        half = len(rows) // 2
        order = np.argpartition(p[:, side], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def axes(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, projections))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def outside(lo: np.ndarray, hi: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances (points x boxes)."""
    out = np.zeros((len(points), len(lo)))
    for j in range(points.shape[1]):
        gap = np.maximum(np.maximum(lo[:, j] - points[:, j, None], points[:, j, None] - hi[:, j]), 0)
        out += gap * gap
    return out


class Cells:
    """The upper levels of the kd-tree: a full binary tree of split planes, and the boxes they cut."""

    def __init__(self, points: np.ndarray, depth: int):
        n, m = 2**depth - 1, points.shape[1]
        self.depth, self.axis, self.at = depth, np.zeros(n, np.int64), np.zeros(n)
        lo, hi, rows = [np.full(m, -np.inf)], [np.full(m, np.inf)], [np.arange(len(points))]
        for node in range(n):
            p = points[rows[node]]
            side = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            self.axis[node], self.at[node] = side, np.median(p[:, side]) if len(p) else 0.0
            left, right = hi[node].copy(), lo[node].copy()
            left[side], right[side] = min(self.at[node], left[side]), max(self.at[node], right[side])
            lo += [lo[node], right]
            hi += [left, hi[node]]
            below = p[:, side] <= self.at[node]
            rows += [rows[node][below], rows[node][~below]]
        self.lo, self.hi = np.array(lo[n:]), np.array(hi[n:])

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)


class Cell:
    """Distinct vectors under one cell: the tree's lower levels."""

    def __init__(self, x: np.ndarray, ids: list, projections: int, leaf: int = LEAF):
        self.x, self.ids, self.unit = x, ids, unit(x)
        self.axes = axes(x.shape[1], projections)
        p = self.unit @ self.axes
        self.leaves = leaves_of(p, leaf)
        self.lo, self.hi = np.array([p[r].min(0) for r in self.leaves]), np.array([p[r].max(0) for r in self.leaves])

    def search(self, q: np.ndarray, k: int, bound: np.ndarray, confidence: float):
        """(query row, id, score, whether the vectors are equal) of up to ``k`` near ones of each; ``bound``: k-th best cosines so far."""
        q_unit, projections = unit(q), self.axes.shape[1]
        box = outside(self.lo, self.hi, q_unit @ self.axes)
        visit = np.argsort(box, axis=1, kind="stable")
        wide = min(k + 8, len(self.x))  # some more than asked for, so that rounding here can't decide between near equals
        best, who = np.full((len(q), wide), -np.inf), np.full((len(q), wide), -1)
        active = np.arange(len(q))
        for r in range(len(self.leaves)):
            at = visit[active, r]
            kth = np.maximum(best[active, min(k, wide) - 1], bound[active])
            far = np.maximum(2 - 2 * kth, 1e-300)
            stop = np.isfinite(kth) & (chi2_cdf(box[active, at] / far, projections) >= confidence)
            active, at = active[~stop], at[~stop]
            if not len(active):
                break
            by = np.argsort(at, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                rows, qs = self.leaves[at[part[0]]], active[part]
                s = np.hstack([best[qs], q_unit[qs] @ self.unit[rows].T])
                w = np.hstack([who[qs], np.broadcast_to(rows, (len(qs), len(rows)))])
                top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                s, w = np.take_along_axis(s, top, 1), np.take_along_axis(w, top, 1)
                down = np.argsort(-s, axis=1)
                best[qs], who[qs] = np.take_along_axis(s, down, 1), np.take_along_axis(w, down, 1)
        for i in range(len(q)):
            found = []
            for u in who[i][who[i] >= 0]:
                v = self.x[u]
                score = float((q[i] * v).sum() / (np.sqrt((q[i] * q[i]).sum()) * np.sqrt((v * v).sum())))
                found += [(-score, int(a), u) for a in self.ids[u]]
            for s, a, u in sorted(found)[:k]:
                yield i, a, -s, bool((self.x[u] == q[i]).all())


def usable(column: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(column)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda e: e != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_dim(column: pa.Array):
    """(places, matrix) of the vectors of each length."""
    size = np.asarray(column.value_lengths())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, _matrix(column.take(pa.array(at)))


def _projected(projections: int):
    """Rows (v) to their projected points."""

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, projections))
            for at, x in _by_dim(b.column(0)):
                out[at] = unit(x) @ axes(x.shape[1], projections)
            ends = pa.array(np.arange(0, (b.num_rows + 1) * projections, projections), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["p"])

    return run


def _dealt(cells: Cells, projections: int):
    """Adds to rows (v, ids) the cell they belong to."""

    def run(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            for at, x in _by_dim(b.column(0)):
                cell[at] = cells.of(unit(x) @ axes(x.shape[1], projections))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def _routed(cells: Cells, projections: int, first: int, confidence: float):
    """Reads (q, v, bound) and yields (q, v, bound, cell): without a bound the nearest cells, else the others that the test can't exclude."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                bound = np.asarray(part.column(2).fill_null(-np.inf)).astype(np.float64)
                for at, x in _by_dim(part.column(1)):
                    box = outside(cells.lo, cells.hi, unit(x) @ axes(x.shape[1], projections))
                    rank = np.argsort(np.argsort(box, axis=1, kind="stable"), axis=1)
                    s = bound[at]
                    none = np.isneginf(s)
                    far = np.maximum(2 - 2 * s, 1e-300)
                    with np.errstate(invalid="ignore"):
                        near = none[:, None] | (chi2_cdf(box / far[:, None], projections) < confidence)
                    # a negative bound marks the second visit of a query that has found too few
                    go = np.where((np.asarray(part.column(2).is_valid())[at])[:, None], near & (rank >= first), rank < first)
                    row, cell = np.nonzero(go)
                    rows = part.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32))], names=["q", "v", "bound", "cell"])

    return run


def _verify(k: int, projections: int, confidence: float):
    """Reads (dim, cell, salt, q, v, ids, bound), a cell's rows (no q) before its queries, and yields what is found."""

    def run(batches):
        now, x, ids, cell = None, [], [], None
        for b in batches:
            key = [np.asarray(b.column(j)) for j in range(3)]
            asks = np.asarray(b.column(3).is_valid())
            new = np.any([a[1:] != a[:-1] for a in [*key, asks]], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [b.num_rows]])
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                at, part = tuple(int(a[lo]) for a in key), b.slice(lo, hi - lo)
                if at != now:
                    now, x, ids, cell = at, [], [], None
                if not asks[lo]:
                    x.append(_matrix(part.column(4)))
                    ids += part.column(5).to_pylist()
                    continue
                if not x:
                    continue
                cell = cell or Cell(np.concatenate(x), ids, projections)
                q = np.asarray(part.column(3))
                bound = np.asarray(part.column(6).fill_null(-np.inf)).astype(np.float64)
                got = list(cell.search(_matrix(part.column(4)), k, bound, confidence))
                if got:
                    i, a, s, same = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(q[list(i)]), pa.array(a, pa.int64()), pa.array(s, pa.float64()), pa.array(same)], names=["q", "vec_id", "score", "same"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, block_rows: int = 2048, cell_rows: int = 8192, query_rows: int = 65536, projections: int = 8, confidence: float = 0.98, first: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` neighbours of the rows of ``vectors`` where ``queries`` holds."""
    spark = vectors.sparkSession
    where = common.shared_dir(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    v = v.filter(F.col("vec_id").isNotNull() & usable("v"))
    vector = v.schema["v"].dataType.simpleString()
    few = v.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    rows = common.written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), f"{where}/rows")
    asked = common.written(v.filter(queries).select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v"), f"{where}/asked")
    n = rows.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(CELLS, n / block_rows))))))
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    # vectors are projected where they are: what comes to the driver is a few numbers for each of a bounded number of rows
    some = [r.p for r in rows.filter(share).select("v").mapInArrow(_projected(projections), "p array<double>").limit(2 * SAMPLE).toLocalIterator()] if depth else []
    cells = Cells(np.array(some) if some else np.zeros((0, projections)), depth if some else 0)
    rows = rows.mapInArrow(_dealt(cells, projections), f"v {vector}, ids array<long>, cell int").withColumn("dim", F.size("v"))
    rows = common.written(rows, f"{where}/dealt")
    # a cell that has outgrown a task's memory is held in shares, each with a tree of its own, and its queries go to all of them
    subs = common.written(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("subs")), f"{where}/subs")
    rows = rows.join(subs, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("v"), F.col("subs")).cast("int")).drop("subs")

    def visited(asks: DataFrame, name: str) -> DataFrame:
        """(q, vec_id, score, same) of what the queries (q, v, bound) find in the cells that they are sent to."""
        sent = common.written(asks.mapInArrow(_routed(cells, projections, first, confidence), f"q long, v {vector}, bound double, cell int").withColumn("dim", F.size("v")), f"{where}/{name}-sent")
        sent = sent.join(subs, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
        parts = sent.groupBy("dim", "cell", "sub").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("parts"))
        sent = sent.join(parts, ["dim", "cell", "sub"])
        salt = lambda c: (F.col("sub").cast("long") * (1 << 32) + c).alias("salt")
        sent = sent.select("dim", "cell", salt(F.pmod(F.xxhash64("q"), F.col("parts"))), "q", "v", F.lit(None).cast("array<long>").alias("ids"), "bound")
        held = rows.join(parts, ["dim", "cell", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = held.select("dim", "cell", salt(F.col("part")), F.lit(None).cast("long").alias("q"), "v", "ids", F.lit(None).cast("double").alias("bound"))
        # a stated number of tasks: the work follows the pairs of vectors, not the bytes that Spark would go by
        both = held.unionByName(sent).repartition(max(1, min(int(np.ceil(n / block_rows)), 4096)), "dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", "q")
        return common.written(both.mapInArrow(_verify(k + 1, projections, confidence), "q long, vec_id long, score double, same boolean"), f"{where}/{name}")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    found = visited(asked.withColumn("bound", F.lit(None).cast("double")), "near")
    kth = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k + 1).select("q", F.col("score").alias("bound"))
    if 2**cells.depth > first:
        found = found.unionByName(visited(asked.join(kth, "q", "left").select("q", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")), "far"))
    common.removed(spark, *[f"{where}/{x}" for x in ("rows", "dealt", "subs", "near-sent", "far-sent")])
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("found")).join(asked, "q").select("v", "found")
    # each row leaves itself out: the first of its id with an equal vector
    own = F.array_min(F.transform(F.filter("found", lambda x: x["same"] & (x["vec_id"] == F.col("vec_id"))), lambda x: x["n"]))
    each = v.filter(queries).select("vec_id", "v").join(lists, "v").withColumn("own", own)
    kept = F.slice(F.filter("found", lambda x: ~x["n"].eqNullSafe(F.col("own"))), 1, k)
    out = each.select(F.col("vec_id").alias("query_id"), F.posexplode(kept).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th embedding among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
