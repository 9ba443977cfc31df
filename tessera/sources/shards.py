"""Text shards, JSON lines, catalogues.

Shards are read by Spark's text source, so that any file system it knows will do; ``.gz`` is opened by its suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import calls as K
from tessera.operators import corpus as C
from tessera.operators.retrieval import unit


def _files(spark: SparkSession, path: str, pattern: str, whole: bool = False) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", whole).text(path)
    # rows of a block are read in order, and blocks by where they start: together the order of the file
    return df.select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_shards(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, shard, block, row, text): one document per line, JSON line or JSON list member.

    Lines of ``.jsonl`` and whole ``.json`` files must parse, or the job fails; records without a text field are dropped.
    """
    order = ["shard", "block", "row"]
    lines = _files(spark, path, "*.{jsonl,jsonl.gz}").filter(T.trim(F.col("value")) != "").withColumn("v", F.parse_json("value"))
    lines = lines.select(*order, F.when(F.col("v").isNotNull(), T.text_field(F.col("value"))).alias("text"))
    whole = _files(spark, path, "*.{json,json.gz}", True).withColumn("v", F.parse_json("value"))
    members = F.coalesce(K.items(F.col("v")), F.array("v"))
    whole = whole.select("shard", "block", F.posexplode(members).alias("row", "m")).select("shard", "block", F.col("row").cast("long").alias("row"), T.text_field(F.to_json("m")).alias("text"))
    plain = _files(spark, path, "*").filter(~F.col("shard").rlike(r"\.jsonl?(\.gz)?$") & (T.trim(F.col("value")) != "")).select(*order, F.col("value").alias("text"))
    return lines.unionByName(whole).unionByName(plain).filter(F.coalesce("text", F.lit("")) != "").select(F.lit(source).alias("source"), *order, "text")


def source_documents(spark: SparkSession, path: str, source: str, prose: bool = True, structured: bool = False) -> DataFrame:
    """Cleaned documents of a source that pass its filter, the first of equals per shard."""
    df = read_shards(spark, path, source).withColumn("text", T.clean(F.col("text"))).filter(C.keep(F.col("text"), prose, structured))
    return C.first_of(df.withColumn("_k", F.sha2("text", 256)), ["source", "shard", "_k"], ["block", "row"]).drop("_k")


def source_dirs(spark: SparkSession, root: str, names: list[str]) -> dict[str, str]:
    """The folder of each source; all missing ones are named in one error."""
    jvm = spark.sparkContext._jvm
    found, missing = {}, []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            found[n] = f"{root}/{n}"
        else:
            missing.append(n)
    if missing:
        raise FileNotFoundError(f"no folder for {', '.join(missing)} under {root}")
    return found


def read_objects(spark: SparkSession, path: str, need: str | None = None) -> DataFrame:
    """(value VARIANT) per JSON line, or per member of whole JSON files; ``need`` keeps objects with that key."""
    if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")):
        df = spark.read.text(path).filter(T.trim(F.col("value")) != "").select(F.parse_json("value").alias("value"))
    else:
        v = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
        df = v.select(F.explode(F.coalesce(K.items(F.col("v")), F.array("v"))).alias("value"))
    return df.filter(F.map_contains_key(K.fields(F.col("value")), need)) if need else df


def write_jsonl(df: DataFrame, path: str) -> int:
    """One compact JSON row per line, non-ASCII kept; the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(F.to_json(F.struct("*")).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return int(seen.get["n"])


def write_isolated(df: DataFrame, column: str, path: str) -> None:
    """Lines with structural characters spaced, for fitting a tokenizer."""
    df.select(T.pre_tokenize(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def as_stream(data):
    """Rows as an iterator, partition by partition from a DataFrame, or what is one already."""
    return data.toLocalIterator() if isinstance(data, DataFrame) else iter(data)


def ordered_map(df: DataFrame, order: list[str], run, schema: str) -> DataFrame:
    """``run`` over Arrow batches on all cores, its rows (which keep the order columns) in that order again."""
    return df.mapInArrow(run, schema).orderBy(*order)


def compact_json(*columns):
    """The columns as one compact JSON text, non-ASCII kept."""
    return F.to_json(F.struct(*columns))


def catalogue(spark: SparkSession, path: str, embeddings: DataFrame | None = None) -> DataFrame:
    """(ix, name, schema VARIANT, text) of a tool catalogue, with emb, of unit length, from ``embeddings`` (name, emb).

    ix is the place among all tools of all files, by path and line, or by path and place in a JSON list.
    """
    if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")):
        lines = _files(spark, path, "*").filter(T.trim(F.col("value")) != "").select("shard", "block", "row", F.parse_json("value").alias("schema"))
        named = lines.filter(F.map_contains_key(K.fields(F.col("schema")), "name"))
    else:
        v = _files(spark, path, "*", True).select("shard", "block", F.parse_json("value").alias("v"))
        each = v.select("shard", "block", F.posexplode(F.coalesce(K.items(F.col("v")), F.array("v"))).alias("row", "schema"))
        named = each.filter(K.field(F.col("schema"), "name").isNotNull())
    df = C.running_total(named.withColumn("one", F.lit(1)), "one", ["shard", "block", "row"], F.struct("shard", "block"), name="ix")
    keys = F.map_keys(F.coalesce(K.fields(K.field(F.col("schema"), "parameters.properties", "variant")), F.create_map().cast(K.ARGS)))
    out = df.select(F.col("ix").cast("long").alias("ix"), K.field(F.col("schema"), "name").alias("name"), "schema", F.concat_ws(" ", K.field(F.col("schema"), "description"), F.array_join(keys, " ")).alias("text"))
    return out if embeddings is None else out.join(embeddings.select("name", unit(F.col("emb")).alias("emb")), "name", "left")
