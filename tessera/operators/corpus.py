"""Corpus curation: filter, first-wins dedup, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Fixed thresholds of the filter.
MIN_CHARS, MAX_REPLACEMENT, MAX_NONPRINT, MIN_MEAN_LINE, MAX_DUPLICATE_LINES, MAX_DEPTH = 200, 0.002, 0.01, 12.0, 0.30, 64
#: The default mix, by share of the token budget, in declaration order.
MIX = [("fineweb-edu", 0.62), ("the-stack-v2", 0.18), ("schemas", 0.12), ("synth-tools", 0.08)]


def keep(cleaned: Column, prose: bool = True, structured: bool = False) -> Column:
    """F02-F08 on a cleaned text, the cheap tests first: CASE keeps that order."""
    lines = T.content_lines(cleaned)
    rule = F.when(cleaned.isNull() | (F.length(cleaned) < MIN_CHARS), False)
    rule = rule.when(T.replacement_ratio(cleaned) > MAX_REPLACEMENT, False).when(T.nonprint_ratio(cleaned) > MAX_NONPRINT, False)
    rule = rule.when(F.size(lines) == 0, False).when((F.size(lines) > 8) & (T.duplicate_ratio(lines) > MAX_DUPLICATE_LINES), False)
    if prose:
        rule = rule.when(T.mean_length(lines) < MIN_MEAN_LINE, False)
    if structured:
        rule = rule.when(~T.balanced(cleaned, MAX_DEPTH), False)
    return rule.otherwise(True)


def first_of(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key; the rows before the sort are cut down to one per key and task."""
    nth = T.unused(df, "nth")
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(nth) == 1).drop(nth)


def first_ids(df: DataFrame, key: list[str], id_: str) -> DataFrame:
    """(key..., id, copies): each key's least id and how many rows have the key; added up per task before the shuffle."""
    return df.groupBy(*key).agg(F.min(id_).alias(id_), F.count("*").alias("copies"))


def keep_report(docs: DataFrame) -> DataFrame:
    """Documents read, kept and dropped as duplicates, per source.

    The first of equal cleaned texts of a source is found by an aggregate over hashes, so that a text repeated in a
    third of all rows is added up before the shuffle.
    """
    c = docs.select("source", "doc_id", T.clean(F.col("text")).alias("c"))
    c = c.select("source", "doc_id", keep(F.col("c")).alias("keep"), F.sha2("c", 256).alias("key"))
    once = c.groupBy("source", F.when(F.col("keep"), F.col("key")).alias("key")).agg(F.count("*").alias("n"), F.count_if("keep").alias("good"))
    return once.groupBy("source").agg(
        F.sum("n").alias("n_read"), F.count_if(F.col("good") > 0).alias("n_kept"), F.sum(F.when(F.col("good") > 0, F.col("good") - 1).otherwise(0)).alias("n_duplicate")
    )


def mix_report(read: DataFrame, kept: DataFrame, budgets: DataFrame, source: str, tokens: str) -> DataFrame:
    """Per source what was read and kept, its share of all kept tokens, and how many tokens its budget lacks."""
    n = read.groupBy(source).agg(F.count("*").alias("n_read"))
    k = kept.groupBy(source).agg(F.count("*").alias("kept"), F.sum(tokens).alias("tokens"))
    r = budgets.select(source, F.col("tokens").alias("budget")).join(n, source, "left").join(k, source, "left").na.fill(0, ["n_read", "kept", "tokens"])
    total = F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1))  # a row per source
    return r.select(source, "n_read", "kept", "tokens", (F.col("tokens") / total).alias("share"), F.greatest(F.col("budget") - F.col("tokens"), F.lit(0)).alias("shortfall"))


def interleave(frames: dict[str, DataFrame], order: str, seed: int | None = None) -> DataFrame:
    """The union of several sources with ``source`` and ``place``, in turn by how far each is read.

    The i-th of n rows of a source stands at (i + 1/2) / n; ties go by source. With a seed, rows come in seeded order.
    """
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        one, i, n, o = T.unused(df, "one", "i", "n", "o")
        df = df.withColumn(one, F.lit(1))
        if seed is None:
            df = running_total(df, one, [order], name=i)
        else:
            df = running_total(df.withColumn(o, seeded(seed, F.col("source"), F.col(order))), one, [o, order], F.substring(o, 1, DIGITS), name=i).drop(o)
        count = df.agg(F.count("*").alias(n))  # one row
        df = df.crossJoin(F.broadcast(count)).withColumn("place", (F.col(i) + 0.5) / F.col(n)).drop(one, i, n)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def apportion(shares: DataFrame, total: int, name: str = "source", share: str = "share", order: str = "ord") -> DataFrame:
    """Largest remainder: parts of ``total`` by share that sum to it, ties in declaration order."""
    e, f, short = T.unused(shares, "e", "f", "short")
    exact = shares.withColumn(e, F.lit(float(total)) * F.col(share) / F.sum(share).over(Window.partitionBy()))  # a row per source
    exact = exact.withColumn(f, F.floor(e).cast("long")).withColumn(short, F.lit(total) - F.sum(f).over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col(e) - F.col(f), 9)), order))
    return exact.withColumn("tokens", F.col(f) + F.when(rank <= F.col(short), 1).otherwise(0)).drop(e, f, short)


def seeded(seed: int, *keys: Column) -> Column:
    """The deterministic order that stands for a random draw: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


#: Buckets of a running total (the ranges between quantiles, and equal steps in each), and the digits of a hash order that make as many.
RANGES, STEPS, DIGITS = 64, 64, 3


def even_buckets(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with a bucket that never falls with a number: its range between quantiles of the column, and its step in there.

    Quantiles follow the values wherever they cluster; they come from Spark's mergeable summary, as one row."""
    at = T.unused(df, "at")
    ends = df.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(i / RANGES) for i in range(RANGES + 1)]), F.lit(20 * RANGES)).alias(at))
    v, b = F.col(order).cast("double"), F.col(at)
    halves = F.array(*[F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())])
    place = F.aggregate(halves, F.lit(0), lambda q, k: F.when(F.get(b, q + k) <= v, q + k).otherwise(q))
    width = lambda q: F.get(b, q + 1) - F.get(b, q)
    step = lambda q: F.when(width(q) > 0, F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((v - F.get(b, q)) / width(q) * STEPS)))).otherwise(0)
    bucket = T.let(place, lambda q: q * STEPS + step(q))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(v.isNull() | b.isNull(), F.lit(-1)).otherwise(bucket).cast("long")).drop(at)


def running_total(df: DataFrame, value: str, order: list, bucket: Column | None = None, within: list[str] | None = None, name: str = "before") -> DataFrame:
    """Sum of ``value`` over all earlier rows, in two levels: ``bucket`` is a function of the order that never falls (by
    default the ranges of the first column of the order, a number), buckets are added up in a small window, rows
    within their bucket; no task sorts everything."""
    within = within or []
    at, total, start, here = T.unused(df, "bucket", "total", "start", "here")
    df = even_buckets(df, order[0], at) if bucket is None else df.withColumn(at, bucket)
    sums = df.groupBy(*within, at).agg(F.sum(value).alias(total))
    up_to = Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*within, at, F.coalesce(F.sum(total).over(up_to), F.lit(0)).alias(start))
    local = Window.partitionBy(*within, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(here, F.coalesce(F.sum(value).over(local), F.lit(0))).join(starts, [*within, at])
    return out.withColumn(name, F.col(start) + F.col(here)).drop(at, here, start)


def mix_draw(docs: DataFrame, budgets: DataFrame, source: str, tokens: str, key: str, seed: int = 0) -> DataFrame:
    """Documents in seeded order until each source's token budget is spent; the one that crosses it is kept.

    The order is a hash, whose first digits make even buckets of it.
    """
    o = T.unused(docs, "o")
    df = docs.withColumn(o, seeded(seed, F.col(key)))
    df = running_total(df, tokens, [o, key], F.substring(o, 1, DIGITS), [source])
    return df.join(budgets.select(F.col(source), F.col("tokens").alias("budget")), source).filter(F.col("before") < F.col("budget")).drop(o)
