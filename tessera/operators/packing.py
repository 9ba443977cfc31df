"""Packing and sequences: fixed rows, segments, batches, n-gram hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators.corpus import DIGITS, running_total, seeded

PAD, EOS, BOS, UNK = 0, 1, 2, 3
#: Fixed values of the n-gram hash.
SEED, PRIME, MASK = 0x9E3779B9, 0x01000193, 0xFFFFFFFF


def spans(docs: DataFrame, n: str, order: str | list[str], seq_len: int, bucket: Column | None = None) -> DataFrame:
    """(row_id, seg, order..., lo, hi): where each document of ``n`` tokens (end included) lies in rows of seq_len.

    Documents of no tokens have no span; a document cut at a row's end continues under a new segment. ``bucket`` is that of
    ``running_total``."""
    if seq_len < 2:
        raise ValueError("seq_len must be at least 2")
    order = [order] if isinstance(order, str) else order
    df = running_total(docs.filter(F.col(n) > 0), n, order, bucket, name="start_of_doc").withColumn("end_of_doc", F.col("start_of_doc") + F.col(n))
    s, e = F.col("start_of_doc"), F.col("end_of_doc")
    rows = F.sequence(F.floor(s / seq_len), F.floor((e - 1) / seq_len))
    df = df.select(*order, s, e, F.explode(rows).alias("row_id"))
    lo, hi = F.greatest(F.lit(0), s - F.col("row_id") * seq_len), F.least(F.lit(seq_len), e - F.col("row_id") * seq_len)
    seg = F.row_number().over(Window.partitionBy("row_id").orderBy("lo"))
    return df.select("row_id", *order, lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).withColumn("seg", seg)


def segments_from_eos(tokens: Column) -> Column:
    """1 + ends strictly before, per token of an array; padding is 0."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == EOS, i + 1)), lambda i: i.isNotNull())
    cuts = F.concat(F.array(F.lit(0)), at, F.array(F.size(tokens)))

    def runs(cuts):
        """Each segment's number, as often as it has tokens: no token looks at the others."""
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.array_repeat(k, F.get(cuts, k) - F.get(cuts, k - 1))))

    return F.zip_with(tokens, let(cuts, runs), lambda t, n: F.when(t == PAD, 0).otherwise(n))


def loss_mask(df: DataFrame, row: str = "row_id", pos: str = "pos", seg: str = "seg") -> DataFrame:
    """next (n + 1) and next but one (n + 2) tokens that lie in the same document."""
    w = Window.partitionBy(row).orderBy(pos)
    same = lambda k: F.coalesce((F.lead(seg, k).over(w) == F.col(seg)) & (F.col(seg) > 0), F.lit(False))
    return df.withColumn("mask1", same(1)).withColumn("mask2", same(2))


def batches(df: DataFrame, key: str, size: int, seed: int = 0, epochs: int = 1) -> DataFrame:
    """(epoch, batch, key): rows in seeded order per epoch, whole batches only.

    The place in the order comes from hash buckets, not from one sort.
    """
    df = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    df = df.withColumn("_o", seeded(seed, F.col("epoch"), F.col(key))).withColumn("_one", F.lit(1))
    df = running_total(df, "_one", ["_o", key], F.substring("_o", 1, DIGITS), ["epoch"], "place")
    n = df.groupBy("epoch").agg(F.count("*").alias("_n"))
    df = df.join(n, "epoch").withColumn("batch", F.floor(F.col("place") / size))
    return df.filter((F.col("batch") + 1) * size <= F.col("_n")).select("epoch", "batch", key)


def shift_right(df: DataFrame, column: str, n: int, part: list[str], order: str) -> Column:
    """The value n before, 0 where there is none."""
    return F.lag(column, n, 0).over(Window.partitionBy(*part).orderBy(order))


def ngram_hash(column: str, n: int, table: int, slots: int, part: list[str], order: str) -> Column:
    """FNV-1a of the n-gram that ends here, newest token first, in the row of hash table ``table`` (from 0)."""
    w = Window.partitionBy(*part).orderBy(order)
    acc = F.lit((SEED * (table + 1)) & MASK).cast("long")
    for j in range(n):
        token = F.lag(column, j, 0).over(w).cast("long") if j else F.col(column).cast("long")
        acc = (acc.bitwiseXOR(token.bitwiseAND(F.lit(MASK))) * F.lit(PRIME)).bitwiseAND(F.lit(MASK).cast("long"))
    return acc.bitwiseXOR(F.shiftrightunsigned(acc, 15)) % slots


def taps(values: str, weights: list[float], dilation: int, part: list[str], order: str) -> Column:
    """Weighted sum of the values 0, d, 2d... before."""
    w = Window.partitionBy(*part).orderBy(order)
    return sum((F.lit(t) * F.coalesce(F.lag(values, j * dilation).over(w), F.lit(0.0)) for j, t in enumerate(weights)), F.lit(0.0))


def packing_edges(df: DataFrame, row: str, pos: str, seg: str) -> DataFrame:
    """(row, query, key) pairs of one segment with key at or before query."""
    k = df.select(F.col(row), F.col(seg), F.col(pos).alias("key"))
    return df.filter(F.col(seg) > 0).select(row, seg, F.col(pos).alias("query")).join(k, [row, seg]).filter("key <= query").select(row, "query", "key")


def window_edges(n: int, window: int, sinks: list[int], spark) -> DataFrame:
    """(query, key) pairs: the last ``window`` keys, and the pinned ones, at or before the query."""
    q = spark.range(n).select(F.col("id").alias("query"))
    recent = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("query") - window + 1), F.col("query"))
    pinned = F.filter(F.array(*[F.lit(s).cast("long") for s in sinks]).cast("array<bigint>"), lambda s: s <= F.col("query"))
    return q.select("query", F.explode(F.array_union(recent, pinned)).alias("key"))


KEYS = "array<struct<lo:long,hi:long>>"


def keys_up_to(lo: Column, query: Column) -> Column:
    """The keys from ``lo`` (0, or where the query's segment starts) to the query, as a list of one interval."""
    return F.array(F.struct(lo.cast("long").alias("lo"), query.cast("long").alias("hi"))).cast(KEYS)


def window_keys(query: Column, window: int, sinks: list[int]) -> Column:
    """The last ``window`` keys and the pinned ones at or before the query, as disjoint intervals in order."""
    q = query.cast("long")
    recent = F.greatest(F.lit(0).cast("long"), q - window + 1)
    runs, out = [], []
    for s in sorted(set(sinks)):
        runs[-1:] = [(runs[-1][0], s)] if runs and runs[-1][1] == s - 1 else [*runs[-1:], (s, s)]
    for lo, hi in runs:
        out.append(F.struct(F.lit(lo).cast("long").alias("lo"), F.least(F.lit(hi).cast("long"), recent - 1).alias("hi")))
    pinned = F.filter(F.array(*out).cast(KEYS), lambda i: i["lo"] <= i["hi"]) if out else F.array().cast(KEYS)
    return F.concat(pinned, F.array(F.struct(recent.alias("lo"), q.alias("hi")))).cast(KEYS)


def both_keys(a: Column, b: Column) -> Column:
    """The keys that two masks share: at most as many intervals as both have together, and no key is listed."""
    meet = lambda x: F.filter(F.transform(b, lambda y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi"))), lambda i: i["lo"] <= i["hi"])
    return F.flatten(F.transform(a, meet)).cast(KEYS)


def n_keys(mask: Column) -> Column:
    """How many keys a mask of disjoint intervals holds."""
    return F.aggregate(mask, F.lit(0).cast("long"), lambda n, i: n + i["hi"] - i["lo"] + 1)


def holds(mask: Column, key: Column) -> Column:
    return F.exists(mask, lambda i: key.between(i["lo"], i["hi"]))


def packing_keys(spans: DataFrame, row: str = "row_id", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(row, query, keys) for each place of packed spans [lo, hi): its segment's keys up to itself. Nothing is joined."""
    q = spans.select(row, F.col(lo).alias("start"), F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("query"))
    return q.select(row, "query", keys_up_to(F.col("start"), F.col("query")).alias("keys"))


def ring_slot(pos: Column, pinned: int, size: int) -> Column:
    """Pinned positions stay, the others rotate through the rest."""
    return F.when(pos < pinned, pos).otherwise(F.lit(pinned) + (pos - pinned) % F.lit(size - pinned))


def bucket_length(longest: Column, cap: int, floor: int = 128) -> Column:
    """The power of two at or above ``longest``, at least ``floor``, at most ``cap``."""
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.pow(F.lit(2.0), F.ceil(F.log2(longest.cast("double")))).cast("int")))


def pad_to(ids: Column, length: int, fill) -> Column:
    """Right-padded; refuses to cut."""
    short = F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))
    return F.when(F.size(ids) > length, F.raise_error(F.lit("the sequence is longer than the row"))).otherwise(short)


def encode_example(prompt: Column, target: Column, max_len: int) -> Column:
    """struct(ids, weights): start, the prompt's tail, the target and its end; weight 1 on target and end.

    Null where the target alone does not fit (F17 drops those).
    """
    room = F.lit(max_len - 2) - F.size(target)
    tail = F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), F.greatest(F.least(room, F.size(prompt)), F.lit(0)))
    ids = F.concat(F.array(F.lit(BOS)), tail, target, F.array(F.lit(EOS)))
    fill = F.lit(max_len) - F.size(ids)
    weights = F.concat(F.array_repeat(F.lit(0.0), F.size(tail) + 1), F.array_repeat(F.lit(1.0), F.size(target) + 1), F.array_repeat(F.lit(0.0), fill))
    return F.when(room >= 0, F.struct(F.concat(ids, F.array_repeat(F.lit(PAD), fill)).alias("ids"), weights.alias("weights")))


def nucleus(df: DataFrame, part: list[str], p: str, tie: str, top_p: float) -> DataFrame:
    """The likeliest rows whose predecessors sum to less than top_p."""
    w = Window.partitionBy(*part).orderBy(F.desc(p), tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(p).over(w), F.lit(0.0))).filter(F.col("before") < top_p)


def dataset(rows: DataFrame, prompt: str, target: str, max_len: int) -> DataFrame:
    """``rows`` with example (ids, weights); rows whose target alone is too long go, and if none is left the job fails."""
    d = rows.withColumn("example", encode_example(F.col(prompt), F.col(target), max_len)).filter("example is not null")
    none = F.when(F.col("left") == 0, F.raise_error(F.lit(f"no row fits {max_len} tokens")).cast("boolean")).otherwise(False)
    guard = d.agg(F.count("*").alias("left")).filter(none)  # one row, which is dropped or fails the job
    return d.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema]))


def ring(df: DataFrame, pos: str, value: str, pinned: int, size: int) -> DataFrame:
    """(slot, pos, value): the last writer of each slot of a ring with pinned places."""
    return df.groupBy(ring_slot(F.col(pos), pinned, size).alias("slot")).agg(F.max(pos).alias(pos), F.max_by(value, pos).alias(value))
