"""Array files and tensor containers as data sources.

``tessera_rows``: packed rows (tokens, segs) in array files of 16-bit numbers, (rows, length, 2). Each task writes files of
its own, of ``FILE`` bytes at most, whose shape is known when they are written, and reports them; the commit, and nothing
before it, writes the list of the files with the number of their first row. Reading is by byte ranges: a partition takes the rows that begin
in its range, from files with a list or without one, with segments or not, or from flat dumps.

``tessera_tensors``: tensors (name, shape, values) as blobs that begin at multiples of 64 bytes. Each task writes a blob file
and a directory of it; the commit writes the list of the parts, so that no directory of all tensors passes the driver.
Reading checks every blob's checksum.

Both register with a session once: ``register(spark)``. A write that fails leaves files that no list names; ``overwrite``
replaces the list last, and so all at once.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.files import filesystem

LIST = "_parts.json"
HEADER, ALIGN = 128, 64
MAGIC = b"\x93NUMPY\x01\x00"
RANGE = 32 << 20
FILE = 64 << 20
AT_ONCE = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: (name, rows, bytes) of each, and the length of their rows."""

    files: list[tuple[str, int, int]]
    width: int = 0


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    first: int  # number of the file's first row


def _put_list(folder: str, files: list[tuple[str, int, int]], tag: str) -> None:
    """Writes the list beside its place and moves it there."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    out, first, at = [], 0, 0
    for name, rows, size in files:
        out.append({"name": name, "rows": rows, "size": size, "first": first, "at": at})
        first, at = first + rows, at + size
    new = f"{path}/.{LIST}.{uuid.uuid4().hex}"
    with store.open_output_stream(new) as f:
        f.write(json.dumps({"tag": tag, "rows": first, "size": at, "parts": out}).encode())
    store.move(new, f"{path}/{LIST}")


def _get_list(folder: str, tag: str) -> list[dict] | None:
    from pyarrow import fs

    store, path = filesystem(folder)
    if store.get_file_info(f"{path}/{LIST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{path}/{LIST}") as f:
        found = json.loads(f.read())
    if found["tag"] != tag:
        raise ValueError(f"{folder} holds {found['tag']}, not {tag}")
    return found["parts"]


class _Writer(DataSourceArrowWriter):
    tag, ends = "", ("",)

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def commit(self, messages) -> None:
        before = [] if self.overwrite else [(p["name"], p["rows"], p["size"]) for p in _get_list(self.folder, self.tag) or []]
        if len({m.width for m in messages if m is not None and m.files}) > 1:
            raise ValueError("rows of different lengths can't share a folder")
        _put_list(self.folder, before + [f for m in messages if m is not None for f in m.files], self.tag)

    def abort(self, messages) -> None:
        store, path = filesystem(self.folder)
        for m in messages:
            for name, _, _ in m.files if m is not None else []:
                for end in self.ends:
                    store.delete_file(f"{path}/{name}{end}")


# Packed rows


class RowsWriter(_Writer):
    tag = "tessera_rows"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, held, rows, width = [], [], 0, 0
        for b in iterator:
            tokens, segs = (b.column(b.schema.get_field_index(c)) for c in ("tokens", "segs"))
            if not b.num_rows:
                continue
            sizes = set(tokens.value_lengths().to_pylist()) | set(segs.value_lengths().to_pylist()) | ({width} if width else set())
            if len(sizes) != 1 or None in sizes:
                raise ValueError("packed rows must be of one length, with as many segments")
            width = sizes.pop()
            both = np.stack([np.asarray(c.flatten()).reshape(-1, width) for c in (tokens, segs)], axis=-1)
            if both.min(initial=0) < 0 or both.max(initial=0) > 0xFFFF:
                raise ValueError("a token doesn't fit in 16 bits")
            held.append(both.astype("<u2").tobytes())
            rows += b.num_rows
            if sum(map(len, held)) >= FILE:
                out.append(self._file(held, rows, width))
                held, rows = [], 0
        if rows:
            out.append(self._file(held, rows, width))
        return Written(out, width)

    def _file(self, held: list[bytes], rows: int, width: int) -> tuple[str, int, int]:
        store, folder = filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.npy"
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(header((rows, width, 2)))
            for block in held:
                f.write(block)
        return name, rows, HEADER + sum(map(len, held))


def header(shape: tuple[int, ...]) -> bytes:
    text = f"{{'descr': '<u2', 'fortran_order': False, 'shape': {shape}, }}".encode()
    return MAGIC + (HEADER - 10).to_bytes(2, "little") + text.ljust(HEADER - 11) + b"\n"


def _shape(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the data begins) of an open array file; a flat dump has one long row."""
    f.seek(0)
    if f.read(6) != MAGIC[:6]:
        return (f.size() // 2,), np.dtype("<u2"), 0
    f.seek(0)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or kind.hasobject:
        raise ValueError("only plain arrays in row order are read")
    return shape, kind, f.tell()


class RowsReader(DataSourceReader):
    def __init__(self, folder: str, length: int | None, step: int):
        self.folder, self.length, self.step = folder, length, step

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        parts = _get_list(self.folder, RowsWriter.tag)
        if parts is None:
            store, path = filesystem(self.folder)
            info = store.get_file_info(path)
            files = [info] if info.is_file else sorted((x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
            base = self.folder if info.is_file else None
            found = [(base or f"{self.folder.rstrip('/')}/{x.path.removeprefix(path).lstrip('/')}", x.size, -1) for x in files]
        else:
            found = [(f"{self.folder.rstrip('/')}/{p['name']}", p["size"], p["first"]) for p in parts]
        return [Range(name, at, min(at + self.step, size), first) for name, size, first in found for at in range(0, size, self.step)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = filesystem(partition.path)
        with store.open_input_file(path) as f:
            shape, kind, data = _shape(f)
            if len(shape) == 1:
                if not self.length:
                    raise ValueError(f"{path}: a flat dump needs the length of its rows")
                shape = (shape[0] // self.length, self.length)
            if len(shape) not in (2, 3) or self.length and shape[1] < self.length:
                raise ValueError(f"{path}: rows of shape {shape[1:]}, {self.length} asked for")
            wide, n = int(np.prod(shape[1:])) * kind.itemsize, self.length or shape[1]
            row = lambda byte: min(shape[0], max(0, -(-(byte - data) // wide)))  # noqa: E731  the first row that begins there or later
            first, last = row(partition.start), row(partition.stop)
            for at in range(first, last, max(1, AT_ONCE // wide)):
                stop = min(last, at + max(1, AT_ONCE // wide))
                f.seek(data + at * wide)
                a = np.frombuffer(f.read((stop - at) * wide), kind).reshape(stop - at, *shape[1:])[:, :n].astype(np.int32)
                tokens, segs = (a[..., 0], a[..., 1]) if a.ndim == 3 else (a, None)
                ends = pa.array(np.arange(0, (stop - at + 1) * n, n), pa.int32())
                column = lambda x: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))  # noqa: E731, B023
                numbers = np.arange(at, stop) + max(0, partition.first)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (stop - at)), pa.array(numbers), column(tokens), column(segs) if segs is not None else pa.nulls(stop - at, pa.list_(pa.int32()))], names=["path", "row", "tokens", "segs"])


class Rows(DataSource):
    """Options: ``length``, the length of the rows to read, and ``range``, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return RowsWriter.tag

    def schema(self) -> str:
        return "path string, row long, tokens array<int>, segs array<int>"

    def reader(self, schema: StructType) -> RowsReader:
        return RowsReader(self.options["path"], int(self.options["length"]) if "length" in self.options else None, int(self.options.get("range", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> RowsWriter:
        return RowsWriter(self.options["path"], overwrite)


# Tensors


class TensorsWriter(_Writer):
    tag, ends = "tessera_tensors", (".blobs", ".dir")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        name, at, n = uuid.uuid4().hex, 0, 0
        with store.open_output_stream(f"{folder}/{name}.blobs") as blobs, store.open_output_stream(f"{folder}/{name}.dir") as directory:
            for b in iterator:
                names, shapes, values = (b.column(b.schema.get_field_index(c)) for c in ("name", "shape", "values"))
                for i in range(b.num_rows):
                    raw = np.asarray(values[i].values).astype("<f4").tobytes()
                    shape = shapes[i].as_py()
                    if int(np.prod(shape, dtype=np.int64)) * 4 != len(raw):
                        raise ValueError(f"{names[i].as_py()}: {len(raw) // 4} values don't make {shape}")
                    directory.write(json.dumps({"name": names[i].as_py(), "shape": shape, "at": at, "size": len(raw), "crc": zlib.crc32(raw)}).encode() + b"\n")
                    blobs.write(raw + b"\0" * (-len(raw) % ALIGN))
                    at, n = at + len(raw) + -len(raw) % ALIGN, n + 1
        return Written([(name, n, at)])


class TensorsReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        parts = _get_list(self.folder, TensorsWriter.tag)
        if parts is None:
            raise ValueError(f"{self.folder} has no list of parts: it was never committed")
        return [Range(f"{self.folder.rstrip('/')}/{p['name']}", p["at"], p["size"], p["first"]) for p in parts] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = filesystem(partition.path)
        with store.open_input_stream(f"{path}.dir") as f:
            entries = [json.loads(x) for x in f.read().splitlines()]
        with store.open_input_file(f"{path}.blobs") as f:
            if f.size() != partition.stop:
                raise ValueError(f"{path}: {f.size()} bytes of blobs, {partition.stop} were committed")
            held, size = [], 0
            for i, e in enumerate(entries):
                f.seek(e["at"])
                raw = f.read(e["size"])
                if len(raw) != e["size"] or zlib.crc32(raw) != e["crc"]:
                    raise ValueError(f"{e['name']} is damaged")
                held.append((e["name"], e["shape"], np.frombuffer(raw, "<f4"), partition.start + e["at"]))
                size += len(raw)
                if size >= AT_ONCE or len(held) == 1024 or i == len(entries) - 1:
                    names, shapes, values, offsets = zip(*held)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(shapes, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(offsets)], names=["name", "shape", "values", "offset"])
                    held, size = [], 0


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return TensorsWriter.tag

    def schema(self) -> str:
        return "name string, shape array<int>, values array<float>, offset long"

    def reader(self, schema: StructType) -> TensorsReader:
        return TensorsReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> TensorsWriter:
        return TensorsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (Rows, Tensors):
        spark.dataSource.register(source)
