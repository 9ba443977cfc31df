"""Small numeric operators: draws from logits, batches of distinct tools, rotations, balanced matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.corpus import DIGITS, running_total, seeded


def draw_tokens(logits: DataFrame, row: str, token: str, logit: str, temperature: float = 0.0, top_k: int = 0, top_p: float = 1.0, seed: int = 0) -> DataFrame:
    """(row, token): the likeliest at temperature 0; else a seeded draw after the top-k (ties kept) and nucleus cuts.

    A row whose logits are all masked (minus infinity) falls back to its likeliest.
    """
    best = logits.groupBy(row).agg(F.max_by(token, F.struct(F.col(logit), -F.col(token))).alias(token))
    if temperature <= 0:
        return best
    w = Window.partitionBy(row)
    x = logits.filter(F.col(logit) > float("-inf")).withColumn("s", F.col(logit) / temperature)
    if top_k:
        x = x.withColumn("_r", F.rank().over(w.orderBy(F.desc("s")))).filter(F.col("_r") <= top_k)
    x = x.withColumn("_e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("_e") / F.sum("_e").over(w))
    before = F.coalesce(F.sum("p").over(w.orderBy(F.desc("p"), token).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("_b", before)
    if 0 < top_p < 1:
        x = x.filter(F.col("_b") < top_p)
    u = F.conv(F.substring(seeded(seed, F.col(row)), 1, 8), 16, 10).cast("double") / 4294967296 * F.sum("p").over(w)
    drawn = x.withColumn("_u", u).filter(F.col("_b") <= F.col("_u")).groupBy(row).agg(F.max_by(token, "_b").alias("_t"))
    return best.join(drawn, row, "left").select(row, F.coalesce("_t", token).alias(token))


def unique_batches(rows: DataFrame, key: str, tool: str, size: int, seed: int = 0) -> DataFrame:
    """K07, as sets: (batch, key): no tool twice in a batch, whole batches only.

    The n-th row of each tool, in seeded order, goes to wave n; waves are cut into batches, and rows past the last whole
    batch of a wave are left out of the epoch.
    """
    r = rows.select(key, tool, seeded(seed, F.col(key)).alias("drawn"))
    r = r.withColumn("wave", F.row_number().over(Window.partitionBy(tool).orderBy("drawn", key))).withColumn("one", F.lit(1))
    # a wave holds a row of every tool: its places are counted in two levels, over the first digits of the order
    r = running_total(r, "one", ["drawn", key], F.substring("drawn", 1, DIGITS), ["wave"], "place")
    r = r.join(r.groupBy("wave").agg(F.count("*").alias("n")), "wave").withColumn("part", F.floor(F.col("place") / size))
    return r.filter((F.col("part") + 1) * size <= F.col("n")).select(F.struct("wave", "part").alias("batch"), key, tool)


def closings(tools: list, size: int) -> list[tuple[int, int]]:
    """For every place, and the end: how many batches the walk that starts there closes, and how many tools it then holds."""
    held, end, after = {}, len(tools), [(0, 0)] * (len(tools) + 1)
    for at in range(len(tools) - 1, -1, -1):
        held[tools[at]] = held.get(tools[at], 0) + 1
        while len(held) >= size:  # the batch ends behind the first row by which it has all its tools
            last = tools[end - 1]
            if held[last] == 1 and len(held) == size:
                break
            held[last] -= 1
            if not held[last]:
                del held[last]
            end -= 1
        after[at] = (after[end][0] + 1, after[end][1]) if len(held) == size else (0, len(held))
    return after


def greedy_batches(rows: DataFrame, key: str, tool: str, size: int, seed: int = 0, block_rows: int = 1 << 16) -> DataFrame:
    """(batch, key, tool) by one walk in seeded order: a row whose tool is in the open batch is left out of the epoch,
    and so is an unfinished last batch.

    What a batch takes depends on all rows before it, but only by how many tools the open batch holds: these are the tools
    met last. So each block of the order, cut by the hash, first tells its first tools, what the walk closes behind each of
    them, and its last tools; one task chains these few values a block; each block is then walked from its own start. No task
    holds more than a block.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    o = seeded(seed, F.col(key))
    at = F.floor(F.conv(F.substring(o, 1, 8), 16, 10).cast("double") / 4294967296 * blocks).cast("int")
    rows = rows.select(at.alias("_block"), o.alias("_o"), F.col(key).alias("_k"), F.col(tool).alias("_t"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("_k", "_t")}
    order = [("_o", "ascending"), ("_t", "ascending")]  # one hash, one key

    def tell(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        tools = t["_t"].to_pylist()
        after, firsts, lasts = closings(tools, size), {}, {}
        for i, x in enumerate(tools):
            if x not in firsts:
                firsts[x] = after[i + 1]
                if len(firsts) == size:
                    break
        for x in reversed(tools):
            if len(lasts) == size - 1:
                break
            lasts[x] = None
        first = pa.array([[{"tool": x, "n": n, "held": k} for x, (n, k) in firsts.items()]], pa.list_(pa.struct([("tool", t.schema.field("_t").type), ("n", pa.int64()), ("held", pa.int32())])))
        return pa.table({"_block": t["_block"].slice(0, 1), "_first": first, "_last": pa.array([[*lasts]], pa.list_(t.schema.field("_t").type))})

    def chain(batches):
        n, held, recent, ids, starts, opened, kinds = 0, 0, [], [], [], [], None
        for b in batches:
            kinds = b.schema.field("_last").type
            for block, first, last in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(block), starts.append(n), opened.append(recent[:held])
                for f in first:
                    if f["tool"] not in opened[-1]:
                        held += 1
                        if held == size:
                            n, held = n + 1 + f["n"], f["held"]
                            break
                recent = [*last, *(x for x in recent if x not in last)][: size - 1]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(starts, pa.int64()), pa.array(opened, kinds), pa.array([n] * len(ids), pa.int64())], names=["_block", "_start", "_open", "_all"])

    def walk(t: pa.Table, state: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        n, open_, all_ = (state[c][0].as_py() for c in ("_start", "_open", "_all"))
        held, taken, numbers = set(open_), [], []
        for i, x in enumerate(t["_t"].to_pylist()):
            if n == all_:
                break  # the last batch stays open
            if x not in held:
                held.add(x)
                taken.append(i), numbers.append(n)
                if len(held) == size:
                    n, held = n + 1, set()
        taken = pa.array(taken, pa.int64())
        return pa.table({"batch": pa.array(numbers, pa.int64()), key: t["_k"].take(taken), tool: t["_t"].take(taken)})

    told = rows.groupBy("_block").applyInArrow(tell, f"_block int, _first array<struct<tool:{kind['_t']},n:long,held:int>>, _last array<{kind['_t']}>")
    states = told.repartition(1).sortWithinPartitions("_block").mapInArrow(chain, f"_block int, _start long, _open array<{kind['_t']}>, _all long")
    return rows.groupBy("_block").cogroup(states.groupBy("_block")).applyInArrow(walk, f"batch long, {key} {kind['_k']}, {tool} {kind['_t']}")


def rotary(v: Column, pos: Column, theta: float = 1e5) -> Column:
    """Half-split rotation of a vector by its position."""
    half = (F.size(v) / 2).cast("int")

    def turn(i, sign):
        angle = pos.cast("double") / F.pow(F.lit(theta), i.cast("double") / half)
        a, b = F.get(v, i), F.get(v, i + half)
        return a * F.cos(angle) - b * F.sin(angle) if sign else b * F.cos(angle) + a * F.sin(angle)

    at = F.sequence(F.lit(0), half - 1)
    return F.concat(F.transform(at, lambda i: turn(i, True)), F.transform(at, lambda i: turn(i, False)))


def sinkhorn(df: DataFrame, key: str, matrix: str, rounds: int = 20) -> DataFrame:
    """(key, matrix): rows and columns of exp(logits) scaled to sum 1 by turns, columns last; square matrices, row by row."""

    def run(batches):
        for b in batches:
            flat = b.column(1)
            sizes, out = np.asarray(pc.list_value_length(flat)), [None] * b.num_rows
            for size in np.unique(sizes):  # matrices of one size are scaled together
                at = np.flatnonzero(sizes == size)
                n = math.isqrt(size)
                x = np.asarray(flat.take(pa.array(at)).flatten(), np.float64).reshape(-1, n, n)
                for _ in range(rounds):
                    for axis in (2, 1):
                        top = x.max(axis, keepdims=True)
                        x = x - top - np.log(np.exp(x - top).sum(axis, keepdims=True))
                for k, row in zip(at, np.exp(x).reshape(len(at), -1)):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "matrix"])

    return df.select(key, matrix).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, matrix array<double>")


def worst(df: DataFrame, score: str, k: int = 3) -> DataFrame:
    """The k rows of largest score."""
    return df.orderBy(F.desc(score)).limit(k)


def arm_summary(leaves: DataFrame, arm: str, size: str) -> DataFrame:
    """Tensors and parameters per optimiser arm."""
    return leaves.groupBy(arm).agg(F.count("*").alias("tensors"), F.sum(size).alias("params"))


def steps_for(rows: Column, batch: int) -> Column:
    """Whole or begun batches of an epoch, one at least."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(max(1, batch)))).cast("long")


def epochs_for(rows: Column, batch: int = 16, steps: int = 390, least: int = 10, most: int = 30) -> Column:
    """The epochs that come to about ``steps`` steps, within bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.lit(steps) / steps_for(rows, batch)))).cast("long")
