"""Operator 8: sharding by longest-processing-time scheduling.

Rows of one group stay together. Groups go by size, largest first, each to the least-loaded shard, which a heap gives;
ties go to the lower shard. Groups of one size differ in name only, so that the heap works on (size, number of groups)
and deals a long run of equal groups at once: the schedule picks the m smallest of the loads at which an item could
start, {load of shard + j * size}. The result is that of the one-by-one schedule.

The schedule is one walk over the distinct sizes, in one task that holds nothing but the loads: it reads (size, groups)
in order and writes ranges of ranks as it goes, so that neither side has to fit into memory. Sizes are at least
``size_floor`` and their sum is the data's, so that S distinct ones need S * S / 2 units at least: 100 TB have under
15 million. Groups are numbered within their size over (size, hash bucket) windows with the buckets' counts added up, so
that neither a hot group nor a hot size nor one shard has to pass through one task; the buckets follow the rows, each of
which has a number of its own, so that rows that repeat fall into all of them. Ties: groups of one size go by their hash, rows
of a shard by id, checksum, size and number.

Law: ``bytes``. Defined results: a null text counts no bytes, has the checksum of the empty text, and all null texts are
one group, apart from the group of empty texts; rows with null or repeated doc_ids are rows like others; extra columns
are ignored by ``assign``. An empty table gives an empty result; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Rows of a hash bucket, by expectation, in the windows that number groups of one size and rows of one shard.
BUCKET_ROWS = 100_000


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, first rank, end rank, shard) for (size, number of groups) from the largest size down, a range per size and shard."""
    heap = [(0, k) for k in range(shards)]
    for size, m in sizes:
        dealt: dict[int, int] = {}
        rank = 0
        if m > 4 * shards and size > 0:
            loads = dict((k, load) for load, k in heap)
            # the largest threshold at or under which at most m items start
            lo, hi = min(loads.values()) - 1, max(loads.values()) + size * m
            count = lambda t: sum((t - x) // size + 1 for x in loads.values() if x <= t)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if count(mid) <= m:
                    lo = mid
                else:
                    hi = mid - 1
            for k, load in loads.items():
                n = (lo - load) // size + 1 if load <= lo else 0
                if n:
                    dealt[k] = n
                    rank += n
                    loads[k] = load + n * size
            heap = [(load, k) for k, load in loads.items()]
            heapq.heapify(heap)
        while rank < m:
            load, k = heapq.heappop(heap)
            dealt[k] = dealt.get(k, 0) + 1
            heapq.heappush(heap, (load + size, k))
            rank += 1
        at = 0
        for k, n in dealt.items():
            yield size, at, at + n, k
            at += n


PLAN = pa.schema([("gsize", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("shard", pa.int32())])


def _planned(shards: int):
    def run(batches):
        sizes = ((size, n) for b in batches for size, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        plan = schedule(sizes, shards)
        while rows := list(itertools.islice(plan, 10_000)):
            yield common.batches_of(rows, PLAN)

    return run


def _numbered(df: DataFrame, key: str, tie: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with a gapless number from 0 within ``key``, without a window over a whole key."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)))
    counts = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*tie))
    return df.withColumn("_i", within).join(starts, [key, "_b"]).withColumn(name, F.col("_from") + F.col("_i") - 1).drop("_b", "_i", "_from")


def assign(docs: DataFrame, shards: int = 24, size: Column | None = None, size_floor: int = 8, group: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row; groups are equal texts unless ``group`` says otherwise."""
    spark = docs.sparkSession
    where = common.shared_dir(spark)
    text = F.col("text").cast("string")
    size = size if size is not None else F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + size_floor
    group = group if group is not None else F.sha2(text.cast("binary"), 256)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.unhex(group), F.lit(b"")).alias("g")
    )
    # rows that repeat have a number of their own, so that they too fall into all buckets
    rows = common.written(rows.withColumn("at", F.monotonically_increasing_id()), f"{where}/rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("gsize"), F.count("*").alias("rows"))
    groups = common.written(groups.select("g", "gsize"), f"{where}/groups")
    sizes = groups.groupBy("gsize").agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions(F.desc("gsize"))
    plan = common.written(sizes.mapInArrow(_planned(shards), "gsize long, a long, b long, shard int"), f"{where}/plan")
    buckets = max(64, rows.count() // BUCKET_ROWS)
    ranked = _numbered(groups, "gsize", ["g"], "rank", buckets)
    placed = ranked.join(plan, "gsize").filter("rank >= a and rank < b").select("g", "shard")
    sharded = common.written(rows.join(placed, "g").drop("g"), f"{where}/sharded")
    common.removed(spark, f"{where}/rows", f"{where}/groups", f"{where}/plan")
    return _numbered(sharded, "shard", ["doc_id", "text_crc32", "size", "at"], "slot", buckets).select("doc_id", "size", "text_crc32", "shard", "slot")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    return assign(common.documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
