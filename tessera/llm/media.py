"""Operator 11: media columns stored as content-defined chunks, each distinct chunk once.

A gear hash rolls over each media value; where its upper ``BITS`` bits are zero a chunk ends, no sooner than ``LOW``
and no later than ``HIGH`` bytes after it began. So equal passages give equal chunks wherever they stand, and an edit
changes the chunks around it alone. A chunk's name is its SHA-256, a value's name that of the whole; the ordered list of
chunk names, the recipe, rebuilds the value, and nothing is given back whose digest isn't its name.

Only names are shuffled to find what is held twice. They are counted by a hash; the hashes met more than once set bits in
a bitmap of a stated size (built by Spark's bitmap aggregate, ``FILTER`` bits, whatever the table's size). In the second
scan a chunk whose bit isn't set occurs once in the table and is written beside its recipe. The others, and the few that
share a bit with them, go once per task to a table that a Spark aggregate reduces to one row per name. So the payload that
occurs once, most of it, is never shuffled, and a full bitmap would cost shuffles, not results.

Reading: a value that holds all its chunks is put together in place; for others, each distinct value once, the recipe is
joined with the chunk table and gathered by the value's name; rows with equal values are joined back by that name. A
chunk, or a value, of a third of all rows is a row of the chunk table, and one restored value.

Defined results: a null text counts as empty, and its payload is 64 zero bytes; very long texts are cut in blocks, a
value has to fit in a row (2 GB); repeated rows and null ids come back one by one; extra columns are ignored. Empty
table: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from tessera.llm import common

LOW, BITS, HIGH = 512, 10, 8192
FILTER = 1 << 26
PAGE = 1 << 15  # bits of one bitmap of Spark's aggregate
AT_ONCE = 1 << 20
#: A number per byte value, from its SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)
RATE = 8000


# Chunks


def ends(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end. The hash of a place depends on the 32 bytes up to it."""
    found = []
    for at in range(0, len(data), AT_ONCE):
        start = max(0, at - 31)
        h = GEAR[data[start : at + AT_ONCE]]
        for s in (1, 2, 4, 8, 16):
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        hit = np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + start + 1
        found.append(hit[hit > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(places: list[int], start: int, stop: int) -> list[int]:
    """The ends of the chunks of data[start:stop]; ``places`` are all that ``ends`` gave. No hash there reaches back before ``start``."""
    out, at = [], start
    while stop - at > LOW:
        k = bisect_left(places, at + LOW)
        at = min(places[k] if k < len(places) else stop, at + HIGH, stop)
        out.append(at)
    if at < stop:
        out.append(stop)
    return out


def chunked(column: pa.Array):
    """(value, its chunks) for each value of a binary column."""
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    base = offsets[0]
    places, view = (ends(data[base : offsets[-1]]) + base).tolist(), memoryview(data)
    for a, b in zip(offsets, offsets[1:]):
        out, at = [], a
        for end in cuts(places, a, b):
            out.append(view[at:end])
            at = end
        yield view[a:b], out


def _counted(batches):
    """(h, n): hashes of chunk names and how often a batch has them."""
    for batch in batches:
        h = np.array([int.from_bytes(hashlib.sha256(c).digest()[:8], "little", signed=True) for _, chunks in chunked(batch.column(0)) for c in chunks], np.int64)
        h, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])


def repeated(media: DataFrame, column: str, bits: int = FILTER) -> bytes:
    """A bitmap with the slot of every chunk name that occurs more than once; ``bits`` at most, whatever the table."""
    names = media.select(column).mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    slot = F.pmod("h", F.lit(bits))
    pages = names.groupBy(F.floor(slot / PAGE).alias("page")).agg(F.bitmap_construct_agg(slot % PAGE).alias("b"))
    out = bytearray(max(bits, PAGE) // 8)
    for r in pages.toLocalIterator():
        out[r["page"] * (PAGE // 8) : (r["page"] + 1) * (PAGE // 8)] = r["b"]
    return bytes(out)


def _stored(bitmap: bytes, bits: int):
    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            carried = batch.drop_columns([batch.schema.names[-1]])
            kinds, keys, recipes, own, shared, names = [], [], [], [], [], []

            def rows():
                cols = [*carried.slice(done, len(kinds)).columns, *[pa.array(v, t) for v, t in ((kinds, pa.string()), (keys, pa.binary()), (recipes, pa.list_(pa.binary())), (own, pa.list_(pa.binary())))]]
                return pa.RecordBatch.from_arrays(cols, names=[*carried.schema.names, *TAIL])

            done, held = 0, 0
            for value, chunks in chunked(batch.column(batch.num_columns - 1)):
                recipe, mine = [hashlib.sha256(c).digest() for c in chunks], []
                for name, c in zip(recipe, chunks):
                    slot = int.from_bytes(name[:8], "little", signed=True) % bits
                    if not bitmap[slot >> 3] >> (slot & 7) & 1:
                        mine.append(bytes(c))
                        continue
                    mine.append(None)
                    if name not in met:
                        met.add(name)
                        names.append(name)
                        shared.append(bytes(c))
                kinds.append("part" if None in mine else "whole")
                keys.append(hashlib.sha256(value).digest())
                recipes.append(recipe)
                own.append(mine)
                held += len(value)
                if held >= 4 * AT_ONCE:
                    yield rows()
                    done, held = done + len(kinds), 0
                    kinds, keys, recipes, own = [], [], [], []
            if kinds:
                yield rows()
            if names:
                empty = [pa.nulls(1, f.type) for f in carried.schema]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(["shared"]), pa.nulls(1, pa.binary()), pa.array([names], pa.list_(pa.binary())), pa.array([shared], pa.list_(pa.binary()))], names=[*carried.schema.names, *TAIL])

    return run


TAIL = ["kind", "key", "recipe", "own"]
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def store(media: DataFrame, where: str, column: str = "media", bits: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """Writes ``media`` to the shared folder ``where``: (rows, chunks).

    ``rows`` has every row's other columns, kind, key, recipe (names in order) and own (its chunks that occur once, null for
    the others); ``chunks`` (name, bytes) has each of the others once. No column may be called as one of these."""
    spark = media.sparkSession
    media = media.select(*[c for c in media.columns if c != column], F.col(column).cast("binary").alias(column))
    bitmap = repeated(media, column, bits)
    schema = StructType([StructField(f.name, f.dataType) for f in media.schema.fields[:-1]]).add("kind", "string").add("key", "binary").add("recipe", ArrayType(BinaryType())).add("own", ArrayType(BinaryType()))
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, "3")  # a file for each kind, without a sort
    try:
        rows = common.written(media.mapInArrow(_stored(bitmap, bits), schema), f"{where}/rows", "kind", compression="zstd")
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)
    each = rows.filter("kind = 'shared'").select(F.inline(F.arrays_zip(F.col("recipe").alias("name"), F.col("own").alias("bytes"))))
    chunks = common.written(each.groupBy("name").agg(F.first("bytes").alias("bytes")), f"{where}/chunks", compression="zstd")
    common.removed(spark, f"{where}/rows/kind=shared")
    return rows.filter("kind <> 'shared'"), chunks


def _whole(of: Callable[[bytes], tuple], schema: pa.Schema):
    """From (carried columns, key, chunks) to (carried columns, what ``of`` gives for the value)."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 2
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for key, pieces in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                    value = b"".join(pieces)
                    if hashlib.sha256(value).digest() != key:
                        raise ValueError(f"the stored value {key.hex()} can't be rebuilt: a chunk is missing or changed")
                    out.append((key, *of(value)))
                made = common.batches_of(out, schema)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made.columns], names=[*b.schema.names[:n], *schema.names])

    return run


def restored(rows: DataFrame, chunks: DataFrame, of: Callable[[bytes], tuple], fields: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Every row of the store: its other columns, and what ``of`` gives for its rebuilt and verified value.

    ``fields`` (as DDL) and ``kinds`` name what ``of`` gives; it sees each distinct value once."""
    carried = [c for c in rows.columns if c not in TAIL]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in carried)
    task = _whole(of, pa.schema([("key", pa.binary()), *kinds]))
    whole = rows.filter("kind = 'whole'").select(*carried, "key", "own").mapInArrow(task, f"{head}key binary, {fields}")
    part = rows.filter("kind = 'part'")
    each = part.select("key", F.posexplode(F.arrays_zip("recipe", "own")).alias("at", "c")).select("key", "at", F.col("c.recipe").alias("name"), F.col("c.own").alias("bytes"))
    away = each.filter(F.col("bytes").isNull()).select("key", "at", "name").dropDuplicates(["key", "at"]).join(chunks, "name")
    pieces = each.filter(F.col("bytes").isNotNull()).select("key", "at", "bytes").unionByName(away.select("key", "at", "bytes"))
    values = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("c")).select("key", F.col("c.bytes").alias("own"))
    made = values.mapInArrow(task, f"key binary, {fields}")
    return whole.unionByName(part.select(*carried, "key").join(made, "key").select(*whole.columns))


# Media made of texts


def _little(n: Column) -> Column:
    """Four bytes, the smallest first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def payload(text: Column) -> Column:
    """The UTF-8 bytes of a text, and zeros up to a positive multiple of 64."""
    b = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(b)
    return F.concat(b, F.unhex(F.repeat(F.lit("00"), F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64))).cast("int"))))


def wav(samples: Column) -> Column:
    """A WAV file of 8-bit mono samples."""
    n, word = F.octet_length(samples).cast("long"), lambda s: F.lit(s).cast("binary")
    fixed = F.unhex(F.lit("".join(x.to_bytes(k, "little").hex() for x, k in ((16, 4), (1, 2), (1, 2), (RATE, 4), (RATE, 4), (1, 2), (8, 2)))))
    return F.concat(word("RIFF"), _little(n + 36), word("WAVEfmt "), fixed, word("data"), _little(n), samples)


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, found by its chunk headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    return media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")]


def feature(samples: bytes) -> str:
    """mean:rms:peak:crossings of the signal around its middle, 128; whole numbers, rounded down."""
    s = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    up = s >= 0
    return f"{int(s.sum()) // len(s)}:{isqrt(int((s * s).sum()) // len(s))}:{int(np.abs(s).max())}:{int((up[1:] != up[:-1]).sum())}"


def described(media: bytes) -> tuple:
    s = samples_of(media)
    return len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)


DESCRIBED = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def report(docs: DataFrame, bits: int = FILTER) -> DataFrame:
    """Texts as stored media, read back and described."""
    text = F.col("text").cast("string")
    media = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), wav(payload(text)).alias("media"))
    rows, chunks = store(media, common.shared_dir(docs.sparkSession), bits=bits)
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return restored(rows, chunks, described, fields, DESCRIBED).drop("key")


def op11_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunked media, read back and described."""
    return report(common.documents(spark, sf_dir))


def oracle() -> str:
    """The same as DuckDB SQL, without chunks."""
    size = "octet_length(b)"
    little = lambda n: "unhex(" + " || ".join(f"substr(printf('%08x', {n}), {k}, 2)" for k in (7, 5, 3, 1)) + ")"
    fixed = "".join(x.to_bytes(k, "little").hex() for x, k in ((16, 4), (1, 2), (1, 2), (RATE, 4), (RATE, 4), (1, 2), (8, 2)))
    s = "list_transform(list_transform(regexp_extract_all(hex(p), '..'), lambda x: ('0x' || x)::BIGINT), lambda x: x - 128)"
    return f"""WITH {common.crc_table()}, t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
  p AS (SELECT doc_id, {size}::BIGINT AS n, b || unhex(repeat('00', CASE WHEN {size} = 0 THEN 64 ELSE (64 - {size} % 64) % 64 END::INT)) AS p FROM t),
  m AS (SELECT *, octet_length(p)::BIGINT AS k, {s} AS s FROM p),
  w AS (SELECT *, 'RIFF'::BLOB || {little("k + 36")} || 'WAVEfmt '::BLOB || unhex('{fixed}') || 'data'::BLOB || {little("k")} || p AS w FROM m)
  SELECT doc_id, n AS n_bytes, k AS payload_bytes, sha256(p) AS payload_sha256, {common.crc_sql("list_transform(s[-64:], lambda x: x + 128)")} AS tail_crc32, octet_length(w)::BIGINT AS media_bytes, sha256(w) AS media_sha256,
    concat_ws(':', floor(list_sum(s) / k)::BIGINT, floor(sqrt(list_sum(list_transform(s, lambda x: x * x))::BIGINT // k))::BIGINT, list_max(list_transform(s, lambda x: abs(x))), len(list_filter(list_zip(s[2:], s[:-2]), lambda x: (x[1] >= 0) <> (x[2] >= 0)))) AS feature
  FROM w, crc"""
