"""Session settings and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results rely on, or that let Spark re-plan at run time.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``__`` for ``.``."""
    b = SparkSession.builder.master(master).appName("tessera")
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Tables of texts, whose rows cost far more to work on than to move.
TEXTS = frozenset({"documents", "pages", "conversations"})


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the files give fewer tasks than that, as one small file does."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt to all cores by their key, however few files and row groups hold them: where each costs far more to work on than to move."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; without that setting a local master gets one of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: a folder is needed that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return remembered(f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}")


#: Folders that queries of this process have made.
_MADE: list[str] = []


def remembered(path: str) -> str:
    """Notes a folder that ``clear`` will delete."""
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate folders that queries of this process have made; call it when their results have been read."""
    jvm, n = spark.sparkContext._jvm, 0
    while _MADE:
        p = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return n


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` once, and read back from there wherever it is used."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the directory ``sf_dir``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
