"""Operator 13: centroid clustering by Exponion search, in whole numbers.

Vectors become integers, so that distances, sums and means are exact and a ball test never decides a tie by rounding.
Every vector carries its centroid, an upper bound on its distance to it and a lower bound on that to any other. When
centroids move, the bounds move with them; a vector whose upper bound stays under the lower one, or under half the gap
between its centroid and the next, keeps its centroid unseen. Any other scans the centroids inside the ball of radius
2u + gap around its current centroid: a prefix of that centroid's list of the others, sorted by distance. All bounds are
widened by more than doubles can round, and the radius is inclusive, so that every centroid as near as the best is scanned
and the smaller number wins.

Spark holds the vectors in blocks (a row per ``BLOCK`` vectors: ids, integers, bounds, and the sums of each cluster), so
that a round is one pass of array arithmetic over a written table; the sums are added up by Spark, and only ``k`` centroids
of ``dim`` numbers come to the driver and go out with the next pass.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part, nor do
those with a component so large that a squared distance could pass a long (2^21 at 64 components). Fewer vectors than
``k`` give as many centroids. A null id is hashed as empty text; rows that repeat are vectors of their own, and where their
hashes tie for a start, the smaller vector comes first. Equal centroids: the smaller number. A centroid without vectors
stays. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BLOCK = 4096
#: More than the relative error of any bound here, and far less than matters to pruning.
SLACK = 1e-9


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def kept(vectors: DataFrame, dim: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    v, most = F.col(column), isqrt((1 << 63) // dim) // 2 - 1
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= F.lit(float(most // scale)))
    rows = vectors.filter(v.isNotNull() & (F.size(v) == dim) & F.forall(v, fine))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole(v, scale).alias("x"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes, in their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.x for r in rows.withColumn("h", h).orderBy("h", "x").limit(k).collect()], np.int64)


class Ball:
    """Centroids with their sorted distance lists, and how far each came since the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        gaps = np.sqrt(squares(now[:, None], now[None]).astype(np.float64))
        self.now, self.order = now, np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1) * (1 - SLACK)
        apart = np.where(np.eye(len(now), dtype=bool), np.inf, gaps).min(1)
        self.gap = apart
        self.moved = None if before is None else np.sqrt(squares(now, before).astype(np.float64)) * (1 + SLACK)
        if before is not None:
            far = np.argsort(-self.moved)[:2]
            self.others = np.full(len(now), self.moved[far[0]])
            if len(far) > 1:
                self.others[far[0]] = self.moved[far[1]]
            else:
                self.others[:] = 0.0


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def search(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, ball: Ball) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids, the bounds on them, and how many distances it took."""
    a, u, low, scanned = a.copy(), u.copy(), low.copy(), 0
    if ball.moved is not None:
        u = (u + ball.moved[a]) * (1 + SLACK)
        low = np.maximum(low - ball.others[a] * (1 + SLACK), 0.0) * (1 - SLACK)
    near = lambda r: u[r] < np.maximum(low[r], ball.gap[a[r]] / 2 * (1 - SLACK))
    open_ = np.flatnonzero(~near(np.arange(len(x))))
    own = squares(x[open_], ball.now[a[open_]])
    scanned += len(open_)
    u[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    still = ~near(open_)
    open_, own = open_[still], own[still]
    at = a[open_]
    for c in np.unique(at):
        mine = at == c
        rows, best = open_[mine], own[mine]
        number, second = np.full(len(rows), c), np.full(len(rows), np.inf)
        radius = (2 * u[rows] + np.where(np.isinf(ball.gap[c]), 0.0, ball.gap[c])) * (1 + SLACK)
        inside = np.searchsorted(ball.gaps[c], radius, side="right")
        for q, j in enumerate(ball.order[c]):
            if j == c:
                continue
            hit = np.flatnonzero(inside > q)
            if not len(hit):
                break
            scanned += len(hit)
            d = squares(x[rows[hit]], ball.now[j])
            better = (d < best[hit]) | ((d == best[hit]) & (j < number[hit]))
            second[hit] = np.minimum(second[hit], np.sqrt(np.where(better, best[hit], d).astype(np.float64)))
            best[hit[better]], number[hit[better]] = d[better], j
        a[rows], u[rows], low[rows] = number, np.sqrt(best.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)
    return a, u, low, scanned


FIELDS = "ids array<long>, x binary, a binary, u binary, low binary, scanned long, parts array<struct<cluster:int,n:long,sums:array<long>>>"
SCHEMA = pa.schema(
    [("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("x", "a", "u", "low")], ("scanned", pa.int64()), ("parts", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))]
)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them; the width goes first."""
    for width in (1, 2, 4, 8):
        if width == 8 or (len(x) == 0 or max(-int(x.min()) - 1, int(x.max())) < 1 << (8 * width - 1)):
            return bytes([width]) + x.astype(f"<i{width}").tobytes()
    raise AssertionError


def _wide(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def _block(ids: pa.Array, x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, ball: Ball) -> pa.RecordBatch:
    a, u, low, scanned = search(x, a, u, low, ball)
    parts = []
    for c in np.unique(a):
        mine = x[a == c]
        parts.append({"cluster": int(c), "n": len(mine), "sums": mine.sum(0).tolist()})
    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    rest = [[_narrow(x)], [a.astype("<i4").tobytes()], [u.astype("<f8").tobytes()], [low.astype("<f8").tobytes()], [scanned], [parts]]
    return pa.RecordBatch.from_arrays([own, *[pa.array(v, f.type) for v, f in zip(rest, list(SCHEMA)[1:])]], schema=SCHEMA)


def _first(now: np.ndarray):
    def run(batches):
        ball = Ball(now, None)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                n = len(x)
                yield _block(pa.concat_arrays([b.column(0)]), x, np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), ball)

    return run


def _unblocked(row: dict, dim: int):
    return _wide(row["x"], dim), np.frombuffer(row["a"], "<i4").astype(np.int64), np.frombuffer(row["u"], "<f8"), np.frombuffer(row["low"], "<f8")


def _next(now: np.ndarray, before: np.ndarray):
    def run(batches):
        ball = Ball(now, before)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                row = b.drop_columns(["ids"]).to_pylist()[0]
                yield _block(b.column("ids").flatten(), *_unblocked(row, now.shape[1]), ball)

    return run


def _assigned(now: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                x, a, _, _ = _unblocked(b.drop_columns(["ids"]).to_pylist()[0], now.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("ids").flatten(), pa.array(a.astype(np.int32)), pa.array(squares(x, now[a]))], names=["vec_id", "cluster", "distance"])

    return run


def _summed(batches):
    """(cluster, n, sums) of all blocks of a task."""
    total: dict[int, list] = {}
    for batch in batches:
        for parts in batch.column(0).to_pylist():
            for p in parts:
                n, sums = total.get(p["cluster"], (0, 0))
                total[p["cluster"]] = n + p["n"], sums + np.array(p["sums"], np.int64)
    rows = [(c, n, sums.tolist()) for c, (n, sums) in total.items()]
    yield common.batches_of(rows, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def moved(blocks: DataFrame, now: np.ndarray) -> np.ndarray:
    """The means, rounded down, of what each centroid was given: added up in each task, then by Spark."""
    each = blocks.select("parts").mapInArrow(_summed, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    out = now.copy()
    for r in each.groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # k x dim rows
        out[r["cluster"], r["at"]] = r["s"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, column: str = "embedding") -> tuple[DataFrame, np.ndarray, int]:
    """((vec_id, cluster, distance) rows, the final centroids, the number of distances computed)."""
    spark = vectors.sparkSession
    where, rows = common.shared_dir(spark), kept(vectors, dim, scale, column)
    now, before, scanned = starts(rows, k, seed), None, 0
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), now.reshape(0, dim), 0
    blocks = rows.mapInArrow(_first(now), FIELDS)
    for r in range(rounds + 1):
        blocks = common.written(blocks, f"{where}/round{r}")
        common.removed(spark, f"{where}/round{r - 1}")
        scanned += blocks.agg(F.sum("scanned")).first()[0]
        if r < rounds:
            before, now = now, moved(blocks, now)
            blocks = blocks.drop("scanned", "parts").mapInArrow(_next(now, before), FIELDS)
    return blocks.select("ids", "x", "a", "u", "low").mapInArrow(_assigned(now), "vec_id long, cluster int, distance long"), now, scanned


def report(vectors: DataFrame, **settings) -> DataFrame:
    """Per vector its cluster and distance, the inertia of its cluster and of all, and its centroid's digest."""
    rows, centroids, _ = cluster(vectors, **settings)
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    facts = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same as DuckDB SQL, every vector against every centroid."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        d = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.x AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, vec_id, v.x AS x, c.c AS c, {d} AS d FROM v, c{i} c) v GROUP BY r, vec_id, v.x)")
        if i < rounds:
            means = f"SELECT c, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(x) AS y FROM a{i}) GROUP BY c, i"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c AS c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list(m::BIGINT ORDER BY i) AS x FROM ({means}) GROUP BY c) m USING (c))")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)} SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON a.c = c.c"""
