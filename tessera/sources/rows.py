"""Packed rows, array files and tensor containers."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import arrays, files

TAG, VERSION, ALIGN = b"TSR1", 1, 64


def write_rows(df: DataFrame, path: str) -> None:
    """Packed rows (row_id, tokens, segs) as Parquet; the job's commit makes them visible at once."""
    df.select("row_id", "tokens", "segs").write.mode("overwrite").parquet(path)


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """S06."""
    return spark.read.parquet(path)


def write_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packed rows (tokens, segs) as array files of 16-bit numbers, in parallel; the list of the files comes last."""
    arrays.register(df.sparkSession)
    df.select("tokens", "segs").write.format("tessera_rows").mode(mode).save(path)


def read_arrays(spark: SparkSession, path: str, seq_len: int | None = None, part_bytes: int = arrays.RANGE) -> DataFrame:
    """(path, row, tokens, segs) of array files of rows, with or without segments, or flat 16-bit dumps, by byte ranges.

    Flat dumps are cut to whole rows; rows narrower than seq_len raise. In a folder that ``write_arrays`` wrote, row counts on
    over its files."""
    arrays.register(spark)
    reader = spark.read.format("tessera_rows").option("range", part_bytes)
    return (reader if seq_len is None else reader.option("length", seq_len)).load(path)


def write_tensors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tensors (name, shape, values) as aligned blobs with their directories, in parallel; the list of the parts comes last."""
    arrays.register(df.sparkSession)
    df.select("name", "shape", F.col("values").cast("array<float>").alias("values")).write.format("tessera_tensors").mode(mode).save(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, values, offset) of what ``write_tensors`` wrote, every checksum verified."""
    arrays.register(spark)
    return spark.read.format("tessera_tensors").load(path)


def container_bytes(tensors: list[tuple[str, np.ndarray]], meta: dict | None = None) -> bytes:
    """Header, JSON directory, blobs that start at multiples of 64 bytes, each with its checksum."""
    at, entries, blobs = 0, [], []
    for name, a in tensors:
        raw = np.ascontiguousarray(a).tobytes()
        entries.append({"name": name, "dtype": a.dtype.str, "shape": list(a.shape), "at": at, "size": len(raw), "crc": zlib.crc32(raw)})
        blobs.append(raw + b"\0" * (-len(raw) % ALIGN))
        at += len(blobs[-1])
    directory = json.dumps({"tensors": entries, "meta": meta or {}}).encode()
    head = struct.pack("<4sHxxQQ", TAG, VERSION, len(directory), at)
    pad = b"\0" * (-(len(head) + len(directory)) % ALIGN)
    return head + directory + pad + b"".join(blobs)


def container_tensors(data: bytes):
    """(name, array) pairs; a wrong tag, version, size, bound or checksum is refused."""
    size = struct.calcsize("<4sHxxQQ")
    if len(data) < size:
        raise ValueError("the container is cut short")
    tag, version, n, total = struct.unpack_from("<4sHxxQQ", data)
    if tag != TAG or version != VERSION:
        raise ValueError("not a container of this version")
    start = -(-(size + n) // ALIGN) * ALIGN
    if len(data) != start + total:
        raise ValueError("the container's size is wrong")
    for e in json.loads(data[size : size + n])["tensors"]:
        if e["at"] + e["size"] > total:
            raise ValueError(f"{e['name']} lies outside the container")
        raw = data[start + e["at"] : start + e["at"] + e["size"]]
        if zlib.crc32(raw) != e["crc"]:
            raise ValueError(f"{e['name']} is damaged")
        yield e["name"], np.frombuffer(raw, e["dtype"]).reshape(e["shape"])


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, values) of container files."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, a in container_tensors(content):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([list(a.shape)], pa.list_(pa.int32())), pa.array([a.ravel().astype(np.float32)], pa.list_(pa.float32()))], names=["path", "name", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, shape array<int>, values array<float>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, to hold against a list of expected ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def aligned_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, problem) for leaves (name, shape) that only one side has or whose shapes differ."""
    j = a.select("name", F.col("shape").alias("sa")).join(b.select("name", F.col("shape").alias("sb")), "name", "full_outer")
    p = F.when(F.col("sa").isNull(), "only in the second").when(F.col("sb").isNull(), "only in the first").when(F.col("sa") != F.col("sb"), "shapes differ")
    return j.select("name", p.alias("problem")).filter("problem is not null")


def save_checkpoint(leaves: DataFrame, path: str, geometry: dict, step: int = 0) -> str:
    """Leaves (name, shape, values) and one row of metadata as a new version, published when both are whole.

    Until the pointer has moved, and if anything fails before, readers get the version before. Older versions stay, for
    readers that have begun; ``files.removed`` deletes what is no longer wanted. The version's name."""
    name = f"step{step:09d}-{uuid.uuid4().hex[:8]}"
    leaves.write.parquet(f"{path}/{name}/leaves")
    meta = json.dumps({"tag": TAG.decode(), "version": VERSION, "step": step, "geometry": geometry}, sort_keys=True)
    leaves.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1).write.parquet(f"{path}/{name}/meta")
    files.publish(leaves.sparkSession, path, name)
    return name


def load_checkpoint(spark: SparkSession, path: str, geometry: dict | None = None) -> tuple[DataFrame, int]:
    """(leaves, step) of the published version; another tag or version, or a geometry that differs from the given one, is refused."""
    name = files.current(spark, path)
    if name is None:
        raise FileNotFoundError(f"no checkpoint was published at {path}")
    meta = json.loads(spark.read.parquet(f"{path}/{name}/meta").first().meta)
    if meta["tag"] != TAG.decode() or meta["version"] != VERSION:
        raise ValueError("not a checkpoint of this version")
    if geometry is not None and (off := sorted(k for k in {*geometry, *meta["geometry"]} if geometry.get(k) != meta["geometry"].get(k))):
        raise ValueError(f"the checkpoint's geometry differs in {', '.join(off)}")
    return spark.read.parquet(f"{path}/{name}/leaves"), meta["step"]


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, sha256, verdict): ``digests`` held against sidecars (path, want): ok, unchecked without one; a wrong digest fails."""
    j = files.join(expected, "path", "left")
    bad = F.raise_error(F.concat(F.lit("wrong digest: "), F.col("path")))
    return j.select("path", "sha256", F.when(F.col("want").isNull(), "unchecked").when(F.lower("want") == F.col("sha256"), "ok").otherwise(bad).alias("verdict"))
