"""Rules over leaf names and small tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import MARKERS, unused
from tessera.operators import corpus as C
from tessera.operators import packing as P


def family(name: Column) -> Column:
    """The first part of a canonical name."""
    return F.substring_index(name, ".", 1)


def in_families(name: Column, families: list[str]) -> Column:
    """whether the name's family starts with one of the prefixes."""
    f = family(name)
    out = F.lit(False)
    for x in families:
        out = out | f.startswith(x)
    return out


def is_matrix(name: Column, shape: Column, lookup_hints: list[str]) -> Column:
    """three axes or more, and no table by its name."""
    hint = F.lit(False)
    for h in lookup_hints:
        hint = hint | name.contains(h)
    return (F.size(shape) >= 3) & ~hint


def adapter_targets(leaves: DataFrame, targets: list[str], scope: str, training_only: list[str], least: float = 1e-6) -> DataFrame:
    """(name) of kernels inside ``scope`` whose module is a target and that aren't all zero, in order; none raises."""
    parts = F.split("name", r"\.")
    module = F.get(parts, F.size(parts) - 2)
    alive = F.exists("values", lambda v: F.abs(v) > least)
    found = leaves.filter((F.element_at(parts, -1) == "kernel") & F.array_contains(parts, scope) & module.isin(targets) & ~in_families(F.col("name"), training_only) & alive).select("name").orderBy("name")
    if found.isEmpty():
        raise ValueError(f"no leaf of {targets} inside {scope}")
    return found


def contains_run(parts: Column, run: Column) -> Column:
    """Whether ``run`` occurs in ``parts`` as consecutive components."""
    n = F.size(run)
    starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1)))
    return (n > 0) & (n <= F.size(parts)) & F.exists(starts, lambda i: F.slice(parts, i, n) == run)


#: The parts that the paths which hold one name are dealt to.
SALTS = 8


def match_runs(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name): each path with the longest quantised name that it contains as a run of components.

    A component holds no dot, so that a run is a name if and only if their texts are equal: the whole run is the join key, for
    runs of as many components as the longest name has. Names meet each run once, so that a name that all paths hold
    is as many rows as there are paths, which join in many tasks.
    """
    n = names.filter("name is not null").select("name").distinct().withColumn("_n", F.size(F.split("name", r"\.")))
    most = F.broadcast(n.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most")))  # one row
    p = paths.filter("path is not null").select("path").distinct().select("path", F.split("path", r"[./]").alias("_p")).crossJoin(most)
    starts = F.sequence(F.lit(1), F.size("_p"))
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.col("_most"), F.size("_p") - i + 1)), lambda m: F.array_join(F.slice("_p", i, m), "."))
    runs = p.filter("_most > 0").select("path", F.explode(F.array_distinct(F.flatten(F.transform(starts, runs)))).alias("name"))
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    dealt = n.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = runs.withColumn("_salt", salt).join(dealt, ["name", "_salt"])
    return hit.groupBy("path").agg(F.max_by("name", F.struct("_n", "name")).alias("name"))


def gather(rows: DataFrame, memory: DataFrame, key: list[str]) -> DataFrame:
    """(key..., vector): the table rows that the hashes name, (table, slot), concatenated in table order."""
    j = rows.join(memory, ["table", "slot"])
    return j.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("table", "values"))), lambda s: s["values"])).alias("vector"))


def restack(layers: DataFrame) -> DataFrame:
    """(name, values): per-layer pieces in layer order; layer -1 stays whole."""
    return layers.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("layer", "values"))), lambda s: s["values"])).alias("values"))


def constrained_fraction(tokens: DataFrame, masked: str) -> DataFrame:
    """The share of tokens that were masked."""
    return tokens.agg(F.coalesce(F.avg(F.col(masked).cast("double")), F.lit(0.0)).alias("fraction"))


def check_markers(vocabulary: DataFrame, first: int = 4) -> DataFrame:
    """The vocabulary (id, piece), which fails when a marker isn't at its id."""
    want = F.create_map(*[x for i, m in enumerate(MARKERS) for x in (F.lit(first + i), F.lit(m))])
    w = want[F.col("id")]
    ok = w.isNull() | (w == F.col("piece"))
    return vocabulary.withColumn("piece", F.when(ok, F.col("piece")).otherwise(F.raise_error(F.concat(F.lit("marker out of place at id "), F.col("id").cast("string")))))


def positional(a: DataFrame, b: DataFrame, order: str, key: str = "ix") -> DataFrame:
    """Pairs of rows by their places; frames of different lengths raise."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows: they pair by position, so there must be as many")

    def numbered(d):
        one = unused(d, "one")
        return C.running_total(d.withColumn(one, F.lit(1)), one, [order], name=key).drop(one)

    return numbered(a).join(numbered(b).drop(order), key)


def build_corpus(docs: DataFrame, shares: list[tuple[str, float]] | DataFrame, tokens: int, seq_len: int, count: Column, seed: int = 0) -> DataFrame:
    """Documents (source, doc_id, text) to packed spans of ``tokens`` // ``seq_len`` rows.

    Filter, dedup per source, draw to token shares, pack in draw order interleaved by how far each budget is spent.
    """
    if tokens // seq_len < 1:
        raise ValueError("the budget is less than one row")
    from tessera.functions import text as T

    spark = docs.sparkSession
    if not isinstance(shares, DataFrame):
        shares = spark.createDataFrame([(s, x, i) for i, (s, x) in enumerate(shares)], "source string, share double, ord int")
    budgets = C.apportion(shares, tokens)
    d = docs.select("source", "doc_id", T.clean(F.col("text")).alias("text")).filter(C.keep(F.col("text")))
    d = C.first_of(d.withColumn("key", F.sha2("text", 256)), ["source", "key"], ["doc_id"]).withColumn("n", count + 1)
    drawn = C.mix_draw(d, budgets, "source", "n", "doc_id", seed).withColumn("place", F.col("before") / F.greatest("budget", F.lit(1)))
    # the place is in [0, 1): its thousandths are even buckets of the order
    return P.spans(drawn, "n", ["place", "source", "doc_id"], seq_len, F.floor(F.col("place") * 1000)).filter(F.col("row_id") < tokens // seq_len).drop("place")


def save_report(frames: dict[str, DataFrame], path: str) -> None:
    """Small report frames as one JSON text, through Spark's writer so that any file system will do."""
    spark = next(iter(frames.values())).sparkSession
    report = {k: [r.asDict(True) for r in f.collect()] for k, f in frames.items()}
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_report(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)




def canonical_order(leaves: DataFrame, regions: list[str], name: str = "name", layer: str = "layer") -> DataFrame:
    """(place, name, layer): leaves by region, then layer (whole ones first), then natural name.

    A leaf's region is the first of ``regions`` that its name starts with; others come last.
    """
    from tessera.functions.text import natural_key

    region = F.lit(len(regions))
    for i, r in reversed(list(enumerate(regions))):
        region = F.when(F.col(name).startswith(r), i).otherwise(region)
    t = leaves.select(name, layer, region.alias("_r"), F.greatest(F.col(layer), F.lit(0)).alias("_l"), natural_key(F.col(name)).alias("_k")).withColumn("_one", F.lit(1))
    bucket = F.struct("_r", "_l")
    t = C.running_total(t, "_one", ["_r", "_l", "_k", name, layer], bucket, name="place")
    return t.select("place", name, layer)
