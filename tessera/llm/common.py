"""Shared helpers: tables, words, folders that all executors see."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import remembered, table

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; one small file is dealt to all cores."""
    return table(spark, sf_dir, "documents")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words between the white space bytes 0x20 and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; ``tessera.session.clear`` deletes what this process has made.

    Where that is unset a local master, as in tests, gets a folder of its own; on a cluster it is an error, because executors
    would each write to a folder that nobody else sees.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_before.get() if set_before.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: the operators need a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return remembered(f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}")


#: Frees a query's shuffle files as soon as it has ended: what ``written`` returns is read from its table, never from them.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, *by: str, **options: str) -> DataFrame:
    """Cuts the lineage of ``df``: writes it to the shared ``path``, frees its shuffle files, and reads it back."""
    spark = df.sparkSession
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        writer = df.write.options(**options)
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(file system, path) of a shared folder or file, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def put(uri: str, blobs: list[bytes]) -> None:
    """Writes blobs as one shared file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        for b in blobs:
            f.write(len(b).to_bytes(8, "little") + b)


def get(uri: str) -> list[bytes]:
    """The blobs of a shared file."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        data, out, at = f.read(), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as keep them apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def plain(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: functions over Arrow batches can't take every name."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text, as an unsigned long; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def strings(column: pa.Array | pa.ChunkedArray) -> list:
    return column.to_pylist()


def batches_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from row tuples."""
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, one compressed plane per byte that the largest needs."""
    import zstandard

    v = np.ascontiguousarray(values).astype(np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_ints(values: np.ndarray, dtype: str = "<u4") -> bytes:
    """Small unsigned integers, one compressed plane per byte."""
    import zstandard

    v = np.ascontiguousarray(values.astype(dtype))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T).tobytes())


def unpack_ints(blob: bytes, dtype: str = "<u4") -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def crc_table() -> str:
    """A DuckDB common table ``crc`` of one row: ``crc_t``, the CRC-32 of each byte, computed by its rule."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"crc AS MATERIALIZED (SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, _: {step}) ORDER BY i) AS crc_t FROM range(256) r(i))"


def crc_sql(numbers: str) -> str:
    """CRC-32 of a list of byte values, in DuckDB, beside ``crc_t``."""
    return f"xor(list_reduce([4294967295::BIGINT] || {numbers}, lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
