"""Files of any store that pyarrow opens, pointers that are replaced at once, and verified copies."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT_ONCE = 1 << 20
POINTER = "_current"


def filesystem(uri: str):
    """(file system, path) of a folder or file, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else uri if not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, name: str) -> None:
    """Makes ``name`` the current version of ``folder``: a file with the name is written beside the pointer and moved over it."""
    jvm = spark.sparkContext._jvm
    at, store = _hadoop(spark, f"{folder}/{POINTER}")
    new, _ = _hadoop(spark, f"{folder}/.{POINTER}-{uuid.uuid4().hex}")
    out = store.create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, at, overwrite)


def current(spark: SparkSession, folder: str) -> str | None:
    """The name that was published last."""
    at, store = _hadoop(spark, f"{folder}/{POINTER}")
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, store = _hadoop(spark, path)
        store.delete(p, True)


COPIED = pa.schema([("path", pa.string()), ("target", pa.string()), ("sha256", pa.string()), ("verdict", pa.string())])


def _copied(to: str, force: bool):
    def digest_of(store, path):
        sha = hashlib.sha256()
        with store.open_input_stream(path) as f:
            while chunk := f.read(AT_ONCE):
                sha.update(chunk)
        return sha.hexdigest()

    def one(path: str, want: str | None):
        (source, at), name = filesystem(path), path.rsplit("/", 1)[-1]
        store, folder = filesystem(to)
        store.create_dir(folder, recursive=True)
        target, part = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}.part"
        there = store.get_file_info(target)
        if there.is_file and there.size and not force:
            return path, f"{to}/{name}", digest_of(store, target), "cached"
        sha = hashlib.sha256()
        with source.open_input_stream(at) as f, store.open_output_stream(part) as out:
            while chunk := f.read(AT_ONCE):
                sha.update(chunk)
                out.write(chunk)
        if want is not None and want.lower() != sha.hexdigest():
            store.delete_file(part)
            return path, None, sha.hexdigest(), "wrong digest"
        store.move(part, target)
        return path, f"{to}/{name}", sha.hexdigest(), "unchecked" if want is None else "ok"

    def run(batches):
        for b in batches:
            for path, want in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_pylist([dict(zip(COPIED.names, one(path, want)))], schema=COPIED)

    return run


def fetched(files: DataFrame, to: str, force: bool = False) -> DataFrame:
    """(path, target, sha256, verdict) of files (path, want) that are copied to the folder ``to``.

    Verdicts: ok; unchecked, where no digest is wanted; cached, where a file of that name is there already, which stays as it is;
    wrong digest, of which nothing is left. A task copies block by block beside the target and moves the copy over when its digest
    is right, so that a half copy is never seen and a task that is run again does no harm. Names must differ."""
    rows = files.select(F.col("path"), F.col("want").cast("string")).repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return rows.mapInArrow(_copied(to, force), "path string, target string, sha256 string, verdict string")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder; none is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
