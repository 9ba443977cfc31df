"""Operator 9: token counts by a map-side two-tier lookup.

Texts are cut into the tokenizer's own pre-tokens, whose token counts add up to the text's. The first tier is a compact
table of frequent pre-tokens and their counts, found on a bounded sample of documents and broadcast (``tier_size`` rows
at most); the second is a cache in each worker, of bounded size, which outlives its tasks, filled by encoding what the
first tier misses. No pre-token of the documents is shuffled; only the sample's are, to find the frequent ones. The tiers hold what the library itself gave, so that they change speed and nothing else.

The fast cut covers texts whose characters all lie in a range where NFC changes nothing and where lower-casing is the
same in Python and in the library; any other text is encoded by the library whole. The cut is checked against the
library on sample texts by the tests.

Defined results: a null text counts as empty, 0 bytes and 0 tokens; special strings inside texts are the tokens that
the library makes of them; repeated rows and null ids come back one by one; extra columns are ignored. Empty table: no
rows.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

LIMIT = 2048

#: The pre-token pattern of the vocabulary file, a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Anything outside these needs the library's own normaliser: Latin letters, general punctuation, the euro sign.
ODD = regex.compile(r"[^\x00-įĲ-ǃǍ-ǰǴ-ȶ‐-‧€]")
#: ASCII white space apart, these are white space to one side and not to the other.
CONTROL = regex.compile(r"[\x1c-\x1f]")


def tokenizer(path: str | None = None):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Counting:
    """Counts tokens of texts with a table of frequent pre-tokens and a bounded cache for the rest."""

    def __init__(self, tokenizer, frequent: dict[str, int] | None = None, cache_size: int = 400_000):
        self.library, self.frequent, self.cache_size = tokenizer, frequent or {}, cache_size
        self.known = dict(self.frequent)  # both tiers
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def pre_tokens(self, text: str) -> tuple[list[str], int] | None:
        """The pre-tokens of a text and its number of special tokens; None if the library has to cut it."""
        if ODD.search(text) or CONTROL.search(text):
            return None
        n, parts = 0, [text]
        if self.special and "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        found = PATTERN.findall(parts[0].lower())
        for p in parts[1:]:
            found += PATTERN.findall(p.lower())
        return found, n

    def __call__(self, texts: list[str]) -> list[int]:
        cut, missing, whole = [], set(), []
        for k, t in enumerate(texts):
            c = self.pre_tokens(t)
            cut.append(c)
            if c is None:
                whole.append(k)
            else:
                missing.update(c[0])
        missing -= self.known.keys()
        if len(self.known) + len(missing) > self.cache_size + len(self.frequent):
            self.known = dict(self.frequent)
            missing = {w for c in cut if c for w in c[0]} - self.known.keys()
        fresh = list(missing)
        for i in range(0, len(fresh), 4096):
            some = fresh[i : i + 4096]
            self.known.update(zip(some, map(len, self.library.encode_batch(some, add_special_tokens=False))))
        out, number = [0] * len(texts), self.known.__getitem__
        for k, c in enumerate(cut):
            if c is not None:
                out[k] = c[1] + sum(map(number, c[0]))
        if whole:
            for k, e in zip(whole, self.library.encode_batch([texts[k] for k in whole], add_special_tokens=False)):
                out[k] = len(e)
        return out


def frequent_table(docs: DataFrame, path: str | None, sample_docs: int, tier_size: int) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of up to ``sample_docs`` documents, those of least id hash."""

    def count(batches):
        c, own = Counter(), Counting(tokenizer(path))
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and (cut := own.pre_tokens(t)):
                    c.update(cut[0])
        some = c.most_common(tier_size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["w", "n"])

    n = docs.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, (1 << 20) * sample_docs // max(n, 1))
    sample = docs.filter(share).select("text").limit(2 * sample_docs)
    top = sample.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(tier_size)
    found = [r.w for r in top.select("w").collect()]
    return dict(zip(found, map(len, tokenizer(path).encode_batch(found, add_special_tokens=False))))


#: The worker's counter, by the name of its table: one at a time, kept from task to task.
_KEPT: dict[str, Counting] = {}


def _counting(name: str, path: str | None, shared, cache_size: int) -> Counting:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Counting(tokenizer(path), shared.value, cache_size)
    return _KEPT[name]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, sample_docs: int = 2000, tier_size: int = 50_000, cache_size: int = 400_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared, name = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, sample_docs, tier_size)), uuid.uuid4().hex

    def run(batches):
        count = _counting(name, path, shared, cache_size)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = count(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents under the 49k word vocabulary."""
    return token_counts(common.documents(spark, sf_dir))
