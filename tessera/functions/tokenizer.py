"""A fitted subword vocabulary over columns (T02-T04, W13). Vocabularies are given, never fitted here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.packing import BOS, EOS, PAD

_loaded: dict = {}


def processor(path: str):
    """One processor per worker and path."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def encode(df: DataFrame, key: str, text: str, path: str, isolate: bool = True, pieces: bool = False) -> DataFrame:
    """(key, ids) or (key, pieces); ``isolate`` spaces the structural characters first, exactly once.

    The file at ``path`` must be there on every executor.
    """
    kind = "array<string>" if pieces else "array<int>"

    def run(batches):
        p = processor(path)
        for b in batches:
            got = p.encode([t or "" for t in b.column(1).to_pylist()], out_type=str if pieces else int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string() if pieces else pa.int32()))], names=[key, "pieces" if pieces else "ids"])

    t = T.pre_tokenize(F.col(text)) if isolate else F.col(text)
    return df.select(key, t.alias("t")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {'pieces' if pieces else 'ids'} {kind}")


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text); the spacing rule isn't undone."""

    def run(batches):
        p = processor(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.decode(x or []) for x in b.column(1).to_pylist()])], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def framed(ids, max_len: int):
    """Start, ids, end, cut and padded to max_len."""
    cut = F.slice(F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS))), 1, max_len)
    return F.concat(cut, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size(cut)))


def pinned_length(df: DataFrame, key: str, prompt: str, path: str, window: int) -> DataFrame:
    """(key, pinned): tokens up to the end of the tools block, one slot of the window left; 0 without a block."""
    at = F.instr(prompt, T.TOOLS_END)
    head = F.when(at > 0, F.substr(F.col(prompt), F.lit(1), at + len(T.TOOLS_END) - 1)).otherwise("")
    e = encode(df.select(key, head.alias("h")), key, "h", path).join(df.select(key, (at > 0).alias("has")), key)
    return e.select(key, F.when(F.col("has"), F.least(F.size("ids") + 1, F.lit(max(0, window - 1)))).otherwise(0).alias("pinned"))
