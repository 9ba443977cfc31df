"""Vector codec: Walsh rotation, codebooks, bit packing, widths and sizes.

Rotations and packing are expressions for narrow use; ``encode`` and ``decode`` work on Arrow batches of whole vectors.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

#: The three levels of the ternary book, the fit of the others (rounds, samples, seed).
TERNARY_BITS, TERNARY = 1.58, 1.2240064
FIT = (200, 400_000, 0)
WIDTHS = (1.58, 2, 3, 4, 16, 32)
VECTOR_SUFFIXES = ("norm", "gamma", "gate", "bias", "taps", "temp", "scale")
TABLE_HINTS = ("embedding", "table", "slot", "memory", "codebook")


@lru_cache
def walsh(n: int) -> np.ndarray:
    """The normalised Hadamard matrix, by the parity of the common bits of row and column."""
    if n < 1 or n & (n - 1):
        raise ValueError("a power of two is needed")
    i = np.arange(n)
    return np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2, -1.0, 1.0) / math.sqrt(n)


@lru_cache
def gaussian_levels(bits: float) -> tuple[float, ...]:
    """Lloyd's levels of a seeded normal sample; the ternary ones are constants."""
    if bits == TERNARY_BITS:
        return (-TERNARY, 0.0, TERNARY)
    rounds, samples, seed = FIT
    x = np.sort(np.random.RandomState(seed).randn(samples))
    total = np.concatenate([[0.0], np.cumsum(x)])
    n = 2 ** int(bits)
    level = x[((np.arange(n) + 0.5) / n * (samples - 1)).astype(int)]
    for _ in range(rounds):
        cut = np.concatenate([[0], np.searchsorted(x, (level[1:] + level[:-1]) / 2), [samples]])
        size = np.diff(cut)
        new = np.where(size > 0, (total[cut[1:]] - total[cut[:-1]]) / np.maximum(size, 1), level)
        done = np.abs(new - level).max() < 1e-9
        level = new
        if done:
            break
    return tuple(float(v) for v in np.sort(level))


def codebook(bits: float, group: int) -> np.ndarray:
    """The levels of a unit vector's rotated components."""
    return (np.array(gaussian_levels(float(bits))) / math.sqrt(group)).astype(np.float32)


def rotate(v: Column, n: int) -> Column:
    """C22 as an expression: the product with the Walsh matrix."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in walsh(n)])
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, v, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x))


def nearest(x: Column, levels) -> Column:
    """The place of the nearest level; a tie goes to the lower one."""
    mids = F.array(*[F.lit(float((a + b) / 2)) for a, b in zip(levels, levels[1:])])
    return F.size(F.filter(mids, lambda m: m < x))


def encode_vectors(rows: np.ndarray, bits: float, group: int):
    """(codes, norms) of rows cut into groups, the last one padded; norms go through half precision."""
    n, width = rows.shape
    pad = -width % group
    x = np.pad(rows, ((0, 0), (0, pad))).astype(np.float32).reshape(-1, group)
    r = x @ walsh(group).astype(np.float32)
    norm = np.sqrt((r * r).sum(1, keepdims=True))
    book = codebook(bits, group)
    mids = ((book[1:] + book[:-1]) * np.float32(0.5)).astype(np.float32)
    codes = np.searchsorted(mids, (r / np.maximum(norm, 1e-12)).ravel(), side="left")
    return codes.reshape(n, -1).astype(np.int32), norm.astype(np.float16).astype(np.float32).reshape(n, -1)


def decode_vectors(codes: np.ndarray, norm: np.ndarray, bits: float, group: int, width: int) -> np.ndarray:
    """The vectors that codes and norms stand for."""
    book = codebook(bits, group)
    if codes.size and codes.max() >= len(book):
        raise ValueError("a code lies outside the codebook")
    flat = book[codes.reshape(-1, group)] * norm.reshape(-1, 1)
    return (flat @ walsh(group).astype(np.float32)).reshape(len(codes), -1)[:, :width]


def quantise(df: DataFrame, key: str, vector: str, bits: float, group: int) -> DataFrame:
    """(key, codes, norm, back): every vector through the codec and back, batch by batch."""

    def run(batches):
        for b in batches:
            v = b.column(1).to_pylist()
            by: dict[int, list[int]] = {}
            for i, x in enumerate(v):
                by.setdefault(len(x or []), []).append(i)
            out = [(None, None, None)] * len(v)
            for width, rows in by.items():
                if width:
                    m = np.array([v[i] for i in rows], np.float32)
                    codes, norm = encode_vectors(m, bits, group)
                    back = decode_vectors(codes, norm, bits, group, width)
                    for j, i in enumerate(rows):
                        out[i] = (codes[j], norm[j], back[j])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float32())))]], names=[key, "codes", "norm", "back"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(run, f"{key} {kind}, codes array<int>, norm array<float>, back array<float>")


def pack_lsb(idx: Column, bits: int) -> Column:
    """Eight indices to ``bits`` bytes, the lowest bits first."""
    if not 1 <= bits <= 8:
        raise ValueError("1 to 8 bits")
    bad = (F.size(idx) % 8 != 0) | F.exists(idx, lambda v: (v < 0) | (v >= (1 << bits)))
    byte = lambda g, b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(part(F.get(idx, g * 8 + i), i, b)))

    def part(v, i, b):
        at = i * bits - b * 8  # where the index starts, seen from byte b
        v = v.cast("long")
        moved = F.when(at >= 0, v * F.pow(F.lit(2.0), F.least(at, F.lit(8))).cast("long")).otherwise(F.floor(v / F.pow(F.lit(2.0), F.least(-at, F.lit(62)))).cast("long"))
        return F.when((at >= 8) | (at <= -8), F.lit(0).cast("long")).otherwise(moved.bitwiseAND(F.lit(255).cast("long")))

    groups = F.sequence(F.lit(0), (F.size(idx) / 8).cast("int") - 1)
    packed = F.flatten(F.transform(groups, lambda g: F.array(*[byte(g, b).cast("int") for b in range(bits)])))
    return F.when(F.size(idx) == 0, F.array().cast("array<int>")).when(bad, F.raise_error(F.lit("indices must come in eights and fit the width"))).otherwise(packed)


def unpack_lsb(packed: Column, bits: int) -> Column:
    """The inverse of ``pack_lsb``."""

    def index(g, i):
        def bit(k):
            at = i * bits + k
            byte = F.get(packed, g * bits + at // 8)
            return F.shiftright(byte, at % 8).bitwiseAND(F.lit(1)) * (1 << k)

        return sum((bit(k) for k in range(bits)), F.lit(0))

    groups = F.sequence(F.lit(0), (F.size(packed) / bits).cast("int") - 1)
    return F.when(F.size(packed) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(groups, lambda g: F.array(*[index(g, i) for i in range(8)]))))


def mask_of(values: Column) -> Column:
    """A set of small numbers as bits."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(F.pow(F.lit(2.0), v).cast("long")))


def set_of(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.floor(mask / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1)


def parse_widths(spec: str) -> tuple[dict[str, float], float]:
    """A ``name=width`` list with its mandatory default."""
    table = {}
    for part in filter(str.strip, spec.split(",")):
        name, eq, width = part.partition("=")
        if not eq or not name.strip():
            raise ValueError(f"{part!r} is not name=width")
        if float(width) not in WIDTHS:
            raise ValueError(f"{width!r} is not one of {WIDTHS}")
        table[name.strip()] = float(width)
    if "default" not in table:
        raise ValueError("a default width is needed")
    return {k: v for k, v in table.items() if k != "default"}, table["default"]


def widths_for(df: DataFrame, name: str, spec: str) -> DataFrame:
    """``df`` with bits: the width of the longest prefix of the name, or the default."""
    table, default = parse_widths(spec)
    bits = F.lit(default)
    for k in sorted(table, key=len):  # longer prefixes are tested first
        bits = F.when(F.col(name).startswith(k), F.lit(table[k])).otherwise(bits)
    return df.withColumn("bits", bits)


def is_quantised(name: Column, shape: Column, group: int, heads=("head",)) -> Column:
    """no vectors, no heads, no per-channel scales, no axis shorter than a group."""
    last = F.substring_index(name, ".", -1)
    vector = F.lit(False)
    for s in VECTOR_SUFFIXES:
        vector = vector | last.endswith(s)
    head = F.lit(False)
    for h in heads:
        head = head | name.startswith(h)
    return (F.size(shape) >= 2) & ~head & ~vector & (F.get(shape, axis_of(name, shape)) >= group)


def axis_of(name: Column, shape: Column) -> Column:
    """The axis that groups run along: the last of tables, else the last but one."""
    table = F.lit(False)
    for h in TABLE_HINTS:
        table = table | name.contains(h)
    return F.when(table, F.size(shape) - 1).otherwise(F.greatest(F.size(shape) - 2, F.lit(0)))


def leaf_bytes(name: Column, shape: Column, bits: Column, group: int, heads=("head",)) -> Column:
    """What a tensor weighs: codes and half-precision norms, or plain floats."""
    n = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    along = F.get(shape, axis_of(name, shape))
    padded = F.ceil(along / group) * group
    coded = n / along * (padded * bits / 8.0 + F.floor(padded / group) * 2)
    return F.when(~is_quantised(name, shape, group, heads) | (bits >= 32), n * F.when(bits >= 32, 4).otherwise(2)).when(bits >= 16, n * 2).otherwise(coded).cast("double")


def size_report(tensors: DataFrame, spec: str, group: int, heads=("head",)) -> DataFrame:
    """Bytes, parameters, coded and stored ones, mean width of the coded, over (name, shape) rows."""
    name, shape = F.col("name"), F.col("shape")
    t = widths_for(tensors, "name", spec)
    n = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    coded = is_quantised(name, shape, group, heads) & (F.col("bits") < 16)
    one = t.select(leaf_bytes(name, shape, F.col("bits"), group, heads).alias("b"), n.alias("n"), coded.alias("c"), "bits")
    return one.agg(
        F.round(F.sum("b")).cast("long").alias("bytes"), F.sum("n").alias("params"), F.coalesce(F.sum(F.when(F.col("c"), F.col("n"))), F.lit(0)).alias("quantised"), F.coalesce(F.sum(F.when(~F.col("c"), F.col("n"))), F.lit(0)).alias("stored"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("c"), F.col("n") * F.col("bits"))), F.sum(F.when(F.col("c"), F.col("n")))), F.lit(0.0)).alias("mean_bits"),
    )


def offsets(tensors: DataFrame, order: str, size: str, align: int = 64) -> DataFrame:
    """Where each blob starts when every blob starts at a multiple of ``align``."""
    from tessera.functions.text import unused
    from tessera.operators.corpus import running_total

    up = F.ceil(F.col(size) / align) * align
    name = unused(tensors, "up")
    return running_total(tensors.withColumn(name, up.cast("long")), name, [order], name="offset").drop(name)


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The element-wise mean per key, in element order."""
    e = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def _halved(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with a vector's values rounded to half precision."""
    at = df.columns.index(vector)

    def run(batches):
        for b in batches:
            cols = b.columns
            v = cols[at]
            half = np.asarray(v.flatten()).astype(np.float32).astype(np.float16).astype(np.float64)
            size = pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.coalesce(pc.list_value_length(v), 0)))]), pa.int32())
            cols[at] = pa.ListArray.from_arrays(size, pa.array(half, pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(run, df.withColumn(vector, F.col(vector).cast("array<double>")).schema)


def average_checkpoints(leaves: DataFrame, key: str = "name", values: str = "values", integer: str = "integer") -> DataFrame:
    """(key, mean): floats averaged element by element and rounded to half precision; integers must agree, or the job fails."""
    e = leaves.select(key, integer, F.posexplode(values).alias("i", "x"))
    g = e.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max(integer).alias("int"))
    one = F.when(F.col("int") & (F.col("lo") != F.col("hi")), F.raise_error(F.concat(F.lit("integer leaves differ: "), F.col(key)))).otherwise(F.col("m"))
    m = g.select(key, "i", "int", one.alias("m")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.max("int").alias("int"))
    floats = _halved(m.filter(~F.col("int")).select(key, "mean"), "mean")
    return floats.unionByName(m.filter("int").select(key, "mean"))


def mixed_quantise(leaves: DataFrame, spec: str, group: int, name: str = "name", values: str = "values") -> DataFrame:
    """(name, bits, back): each leaf's rows of ``group`` values at its family's width; 16 bits and more through half precision."""
    t = widths_for(leaves.select(name, F.col(values).cast("array<double>").alias(values)), name, spec)
    table, default = parse_widths(spec)
    parts = []
    for bits in sorted({*table.values(), default}):
        some = t.filter(F.col("bits") == bits)
        if bits >= 16:
            parts.append(_halved(some.select(name, "bits", F.col(values).alias("back")), "back") if bits < 32 else some.select(name, "bits", F.col(values).alias("back")))
        else:
            parts.append(quantise(some, name, values, bits, group).select(name, F.lit(bits).alias("bits"), F.col("back").cast("array<double>").alias("back")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def least_error(v: Column, bits: float, group: int) -> Column:
    """The least share of a group's squared length that its nearest levels lose; a zero group loses nothing."""
    levels = F.array(*[F.lit(float(x)) for x in codebook(bits, group)])
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    lost = lambda r, n: F.aggregate(r, F.lit(0.0), lambda s, x: s + F.pow(F.array_min(F.transform(levels, lambda y: F.abs(x / n - y))), 2))
    return let(rotate(v, group), lambda r: let(F.sqrt(squares(r)), lambda n: F.when(n == 0, 0.0).otherwise(lost(r, n))))


def rms_error(df: DataFrame, by: str, original: str, back: str) -> DataFrame:
    """The root of the mean squared error per group of vectors."""
    sq = F.aggregate(F.zip_with(original, back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.groupBy(by).agg(F.sqrt(F.sum(sq) / F.sum(F.size(original))).alias("rms"))
