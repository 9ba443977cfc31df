"""Operator 12: importance resampling towards a target distribution, over hashed n-grams.

A text's features are its runs of 1 to ``n`` consecutive words, repeats included; a feature's bucket is its CRC-32 modulo
``buckets``. Each task runs a DuckDB of its own over batches of its texts: SQL cuts the words, unnests them, makes the n-grams by
windows, and counts them by text and bucket, with ``zlib.crc32`` registered as a function that sees each distinct n-gram
of a batch once. The counts are spilled to Parquet in the shared folder, where Spark commits them, so that a lost executor's
tasks are simply run again. From there on all is Spark: the counts of the source and of the target are summed by bucket,
each bucket has a gain (the logarithm of the ratio of its smoothed shares), a text's weight is the mean gain of its
features, and adding Gumbel noise from a hash of the id turns the highest scores into a weighted draw without
replacement.

Bounds: a batch holds ``AT_ONCE`` characters; a longer text goes through in parts, cut between words, and the last word
of a part goes in front of the next, so that no run is lost. Only the ``buckets`` gains come to the driver. Ranks
need no order over the whole table: a score is a whole number between -41000 and 60000 whatever the table's size, so that
the scores are counted by value, added up from the highest, and ids are put in order inside a score only.

Defined results: a null text has no words; a text without features weighs 0; the 20 words are all words of the text;
a null id is hashed as empty text and comes after the other ids of its score; rows that repeat are drawn row by row, in the
order of the written table; extra columns are ignored. Empty source: no rows. Empty target: gains from smoothing alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

BUCKETS, N, SEED = 10_000, 2, 7
AT_ONCE = 1_000_000
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc32(column):
    """zlib's CRC-32 of each string, for DuckDB."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    b = column.cast(pa.binary())
    at = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1].tolist()
    data = (b.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return pa.array([zlib.crc32(data[i:j]) for i, j in zip(at, at[1:])], pa.int64())


def database():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("SET temp_directory = ''")
    con.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def statement(n: int, buckets: int) -> str:
    """(row, bucket, n) of the table ``batch`` (row, text)."""
    runs = ["SELECT row, w AS f FROM w"]
    for m in range(2, n + 1):
        last = ", ".join(f"lead(w, {k}) OVER v AS w{k}" for k in range(1, m))
        runs.append(f"SELECT row, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, m))}) FROM (SELECT row, w, {last} FROM w WINDOW v AS (PARTITION BY row ORDER BY place)) WHERE w{m - 1} IS NOT NULL")
    return f"""WITH w AS MATERIALIZED (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM words),
  f AS MATERIALIZED ({" UNION ALL ".join(runs)}),
  b AS (SELECT f, (crc32(f) % {buckets})::INT AS bucket FROM (SELECT DISTINCT f FROM f))
  SELECT row, bucket, count(*)::INT AS n FROM f JOIN b USING (f) GROUP BY row, bucket"""


class Counter:
    """Counts of the texts of one task."""

    def __init__(self, n: int, buckets: int):
        self.con, self.n, self.buckets, self.sql = database(), n, buckets, statement(n, buckets)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and row, bucket, count, in the order of rows and buckets."""
        self.con.register("batch", pa.table({"row": pa.array(range(len(texts)), pa.int32()), "text": pa.array(texts, pa.string())}))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE words AS SELECT row, coalesce({WORDS}, []) AS words FROM batch")
        words = self.con.sql("SELECT len(words)::BIGINT AS n FROM words ORDER BY row").to_arrow_table().column(0).to_numpy()
        t = self.con.sql(self.sql).to_arrow_table()
        row, bucket, n = (t.column(k).to_numpy() for k in range(3))
        order = np.argsort(row.astype(np.int64) * self.buckets + bucket, kind="stable")
        return words, row[order], bucket[order], n[order]

    def long(self, text: str) -> tuple[int, np.ndarray]:
        """Words and counts by bucket of a text that is longer than a batch."""
        words, counts, kept, at = 0, np.zeros(self.buckets, np.int64), [], 0
        while at < len(text):
            gap = GAP.search(text, min(len(text), at + AT_ONCE))
            end = gap.start() + 1 if gap else len(text)
            n, _, bucket, count = self.batch([" ".join([*kept, text[at:end]])])
            np.add.at(counts, bucket, count)
            if kept:  # their runs were counted with the part before
                _, _, bucket, count = self.batch([" ".join(kept)])
                np.subtract.at(counts, bucket, count)
            words += int(n[0]) - len(kept)
            kept = self.tail(kept, text[at:end])
            at = end
        return words, counts

    def tail(self, kept: list[str], part: str) -> list[str]:
        """The last words of all parts so far."""
        if self.n < 2:
            return []
        return self.con.execute(f"SELECT (? || {WORDS.replace('text', 'x')})[-{self.n - 1}:] FROM (SELECT ?::VARCHAR AS x)", [kept, part]).fetchall()[0][0]


def _counted(n: int, buckets: int):
    def run(batches):
        counter = Counter(n, buckets)

        def short(ids, texts):
            words, row, bucket, count = counter.batch(texts)
            at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            total = np.add.reduceat(np.append(count.astype(np.int64), 0), at[:-1]) * (at[1:] > at[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v, pa.int32())) for v in (bucket, count)]
            return pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(total), *lists], names=FIELDS)

        def one(ids, text):
            words, counts = counter.long(text)
            bucket = np.flatnonzero(counts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(bucket)], pa.int32()), pa.array(v.astype(np.int32))) for v in (bucket, counts[bucket])]
            return pa.RecordBatch.from_arrays([ids, pa.array([words]), pa.array([int(counts.sum())]), *lists], names=FIELDS)

        try:
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                start = held = 0
                for i, text in enumerate([*texts, None]):
                    size = len(text or "")
                    if i == len(texts) or held + size > AT_ONCE:
                        if i > start:
                            yield short(ids.slice(start, i - start), texts[start:i])
                        start, held = i, 0
                        if size > AT_ONCE:
                            yield one(ids.slice(i, 1), text)
                            start = i + 1
                            continue
                    held += size
        finally:
            counter.con.close()

    return run


FIELDS = ["id", "n_words", "n_features", "bucket", "n"]


def counts(texts: DataFrame, path: str, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, bucket list, count list) of each row of ``texts`` (id, text), spilled to ``path``."""
    rows = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return common.written(rows.mapInArrow(_counted(n, buckets), "id long, n_words long, n_features long, bucket array<int>, n array<int>"), path, compression="zstd")


def merged(spilled: DataFrame) -> DataFrame:
    """(bucket, n): counts of all texts."""
    return spilled.select(F.inline(F.arrays_zip("bucket", "n"))).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: floor(1000 ln) of the ratio of its smoothed shares, target over source."""
    spark = source.sparkSession
    both = merged(source).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(merged(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).persist()
    S, T = rows.agg(F.sum("s"), F.sum("t")).first()
    gain = F.floor(1000 * F.log((F.col("t") + 1) * F.lit(S + buckets) / ((F.col("s") + 1) * F.lit(T + buckets))))
    out = [r.g for r in rows.select("bucket", gain.alias("g")).orderBy("bucket").collect()]  # buckets rows
    rows.unpersist()
    return out


def weight(gain: list[int]) -> Column:
    """The mean gain of a text's features, rounded down."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("bucket", "n", lambda b, n: F.get(table, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = total - F.pmod(total, F.greatest(F.col("n_features"), F.lit(1)))
    return F.when(F.col("n_features") > 0, (whole / F.col("n_features")).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(seed: int) -> Column:
    """floor(1000 g) for a Gumbel variate g from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """(at, rank) of the drawn rows of ``scored`` (at, id, score), which is a written table: the highest scores, then the smallest ids."""
    drawn = scored.count() * percent // 100
    by_score = scored.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    starts = by_score.select("score", F.coalesce(above, F.lit(0)).alias("above")).filter(F.col("above") < drawn)
    # rows that share score, id and part of the table are counted first, so that a row of a third of all is as many rows as parts
    part = F.shiftright("at", 33)
    rows = scored.join(starts, "score").select("at", "score", "above", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), part.alias("part"))
    own = ["score", "none", "id", "part"]
    groups = rows.groupBy(*own).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("score").orderBy("none", "id", "part").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select(*own, F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("above") + F.col("before") + F.row_number().over(Window.partitionBy(*own).orderBy("at"))
    return rows.join(groups, own).select("at", rank.alias("rank")).filter(F.col("rank") <= drawn)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row of ``docs`` (id, text); rank is null for rows not drawn."""
    spark = docs.sparkSession
    where = common.shared_dir(spark)
    source, wanted = counts(docs, f"{where}/source", n, buckets), counts(target, f"{where}/target", n, buckets)
    w = weight(gains(source, wanted, buckets))
    scored = source.select(F.monotonically_increasing_id().alias("at"), "id", "n_words", "n_features", w.alias("weight")).withColumn("score", F.col("weight") + noise(seed))
    scored = common.written(scored, f"{where}/scored")
    common.removed(spark, f"{where}/source", f"{where}/target")
    ranks = ranked(scored.filter(F.col("n_words") >= least_words).select("at", "id", "score"), percent)
    return scored.join(ranks, "at", "left").select("id", "n_words", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's distribution."""
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    out = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def oracle(percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same as DuckDB SQL, for runs of one and two words."""
    words = f"coalesce({WORDS}, [])"
    numbers = "list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)"
    h = f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT"
    return f"""WITH {common.crc_table()}, t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
  q AS (SELECT {words} AS ws FROM benchmark),
  f AS MATERIALIZED (SELECT r, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS f FROM t),
  g AS MATERIALIZED (SELECT unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS f FROM q),
  b AS MATERIALIZED (SELECT f, ({common.crc_sql(numbers)} % {buckets})::INT AS bucket FROM (SELECT f FROM f UNION SELECT f FROM g), crc),
  fb AS MATERIALIZED (SELECT r, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY r, bucket),
  s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM fb GROUP BY bucket), u AS (SELECT bucket, count(*)::DOUBLE AS t FROM g JOIN b USING (f) GROUP BY bucket),
  c AS MATERIALIZED (SELECT i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS sa, sum(coalesce(t, 0)) OVER () AS ta FROM range({buckets}) x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN u ON u.bucket = i),
  k AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1) * (sa + {buckets}) / ((s + 1) * (ta + {buckets}))))::BIGINT AS gain FROM c),
  w AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM fb JOIN k USING (bucket) GROUP BY r),
  d AS MATERIALIZED (SELECT r, doc_id, len(ws) AS words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END::BIGINT AS weight FROM t LEFT JOIN w USING (r)),
  e AS MATERIALIZED (SELECT *, weight + floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296)))::BIGINT AS score FROM d),
  x AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE words >= {least_words})
  SELECT doc_id, n_features, weight, score, rank FROM e LEFT JOIN (SELECT r, rank FROM x WHERE rank <= {percent} * n // 100) USING (r)"""
