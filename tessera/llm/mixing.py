"""Operator 2: mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted in cells (source, language, topic). Raking scales the cells' token weights margin by margin until
source, language and topic shares meet their targets; a weight never exceeds 1 / ``rate`` times the
cell's tokens, so that ``rate`` times the ratio of weight to tokens is a probability. A document is kept if a number that depends on its id and
the seed alone lies under its cell's probability.

The cell table has a row per combination that occurs, not per document. Up to ``one_task_cells`` rows, which are counted,
it is raked in one task that needs no shuffle per margin; a larger one is raked by grouped sums, pre-aggregated per task
and joined back. Both ways scale alike, round by round, and write the weights to the shared folder. Rounds end at
``rounds``, or before where the largest gap between a margin's share and its target, the residual, is ``enough`` or less;
it stays above zero where that bound holds weights down, and comes with the result.

Targets: a margin's shares are given as (value, share) rows, or by default are its token shares to the power of
``temper``, which raises small sources and holds down a hot one. Values without a target keep their natural share.

Defined results: null sources, languages and topics are values of their own, "(none)"; null and empty texts have no
tokens and their cell, if it has no other, keeps the ratio 1; a very long text is as many tokens as it has; a null doc_id
counts as empty text in the draw; repeated rows, and rows that tie at an id, are drawn alike. Extra columns are kept by ``sample`` and ignored by ``plan``. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
SEED = 17


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """The documents table has no topic: its stand-in is the text's form, by rows of cells and by length."""
    n = F.length(text)
    return F.when(text.contains(" | "), "table").when(n >= 8000, "long").when(n >= 1500, "article").when(n >= 300, "note").otherwise("short")


def cell_of(topic: Column | None = None) -> Column:
    """A document's source, language and topic, none of them null."""
    parts = F.col("source").cast("string"), F.col("lang").cast("string"), form_topic(F.col("text").cast("string")) if topic is None else topic
    return F.struct(*[F.coalesce(c, F.lit(NONE)).alias(m) for m, c in zip(MARGINS, parts)])


def targets_of(cells: DataFrame, margin: str, temper: float, given: DataFrame | None) -> DataFrame:
    """(value, target): shares of a margin, summing to 1."""
    natural = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    if given is None:
        wanted = natural.withColumn("s", F.when(F.col("t") > 0, F.pow("t", F.lit(temper))).otherwise(0.0))
    else:
        share = F.col("t") / F.lit(max(1.0, natural.agg(F.sum("t")).first()[0] or 0.0))
        wanted = natural.join(given.select("value", "share"), "value", "left").withColumn("s", F.coalesce("share", share))
    total = wanted.agg(F.sum("s")).first()[0] or 0.0  # one number, so that no window spans all values of a margin
    return wanted.select(F.col("value").alias(margin), (F.col("s") / F.lit(total) if total > 0 else F.lit(0.0)).alias(f"target_{margin}"))


def _scaled(w: DataFrame, margin: str, rate: float, one_task: bool) -> DataFrame:
    """The weights after one scaling to a margin's targets."""
    if one_task:
        now = F.sum("w").over(Window.partitionBy(margin).orderBy(*MARGINS).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        w = w.coalesce(1).withColumn("now", now)
    else:
        w = w.join(w.groupBy(margin).agg(F.sum("w").alias("now")), margin)
    scaled = F.when(F.col("now") > 0, F.col("w") * F.col(f"target_{margin}") * F.col("total") / F.col("now")).otherwise(F.col("w"))
    return w.withColumn("w", F.least(scaled, F.col("tokens") / F.lit(rate))).drop("now")


def residual_of(w: DataFrame) -> float:
    """The largest gap between a margin's share of the wanted total and its target."""
    gaps = [w.groupBy(m).agg(F.abs(F.try_divide(F.sum("w"), F.max("total")) - F.max(f"target_{m}")).alias("gap")).select("gap") for m in MARGINS]
    return gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max(F.coalesce("gap", F.lit(0.0)))).first()[0] or 0.0


def rake(cells: DataFrame, where: str, rounds: int = 12, rate: float = 0.5, temper: float = 0.7, targets: dict[str, DataFrame] | None = None, one_task_cells: int = 200_000, enough: float = 1e-12) -> tuple[DataFrame, float]:
    """``cells`` (source, lang, topic, tokens) with p, the probability of keeping a document of the cell, and the residual."""
    cells = common.written(cells, f"{where}/cells")
    one_task = cells.count() <= one_task_cells
    w = cells
    for m in MARGINS:
        w = w.join(targets_of(cells, m, temper, (targets or {}).get(m)), m)
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    w = common.written(w.withColumn("w", F.col("tokens").cast("double")).withColumn("total", F.lit(float(total))), f"{where}/start")
    residual, last = 0.0, f"{where}/start"
    for i in range(rounds):
        for m in MARGINS:
            w = _scaled(w, m, rate, one_task)
            if not one_task or (m == MARGINS[-1] and (i % 4 == 3 or i == rounds - 1)):
                w, before, last = common.written(w, f"{where}/round{i}-{m}"), last, f"{where}/round{i}-{m}"
                common.removed(cells.sparkSession, before)
        if i % 4 == 3 or i == rounds - 1:
            residual = residual_of(w)
            if residual <= enough:
                break
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)
    return w.select(*MARGINS, F.least(F.lit(1.0), F.lit(rate) * ratio).alias("p")), residual


def draw(seed: int = SEED) -> Column:
    """A number in [0, 1) from the seed and the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    rows = docs.select(cell_of(topic).alias("cell"), tokens_of(F.col("text").cast("string")).alias("tokens"))
    return rows.groupBy("cell.source", "cell.lang", "cell.topic").agg(F.sum("tokens").alias("tokens"))


def sample(docs: DataFrame, topic: Column | None = None, seed: int = SEED, **raking) -> DataFrame:
    """The rows of ``docs``, all columns, that the calibrated probabilities keep."""
    p, _ = rake(cells_of(docs, topic), common.shared_dir(docs.sparkSession), **raking)
    cell, share = common.fresh(docs, "cell", "share")
    marked = docs.withColumn(cell, cell_of(topic)).join(p.select(F.struct(*MARGINS).alias(cell), F.col("p").alias(share)), cell)
    return marked.filter(draw(seed) < F.col(share)).select(common.columns(docs))


def plan(docs: DataFrame, topic: Column | None = None, seed: int = SEED, **raking) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept, residual) per row of ``docs``."""
    where = common.shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), cell_of(topic).alias("cell"), tokens_of(F.col("text").cast("string")).alias("tokens")).select("doc_id", "cell.*", "tokens")
    rows = common.written(rows, f"{where}/rows")
    p, residual = rake(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), where, **raking)
    out = rows.join(p, list(MARGINS))
    return out.select("doc_id", *MARGINS, "tokens", F.round("p", 6).alias("probability"), (draw(seed) < F.col("p")).alias("kept"), F.round(F.lit(residual), 6).alias("residual"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling probabilities of all documents, and the draw."""
    return plan(common.documents(spark, sf_dir))


def oracle(rounds: int = 12, rate: float = 0.5, temper: float = 0.7, seed: int = SEED) -> str:
    """The same as DuckDB SQL, one common table per scaling."""
    topic = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN length(text) >= 8000 THEN 'long' WHEN length(text) >= 1500 THEN 'article' WHEN length(text) >= 300 THEN 'note' ELSE 'short' END"
    parts = [
        f"r AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, s / sum(s) OVER () AS target_{m} FROM (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {temper}) ELSE 0.0 END AS s FROM c GROUP BY {m}))")
    joins = " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS)
    parts.append(f"w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS w, (sum(tokens) OVER ())::DOUBLE AS total FROM c {joins})")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (least(CASE WHEN now > 0 THEN w * target_{m} * total / now ELSE w END, tokens / {rate}) AS w) FROM (SELECT * EXCLUDE (now) REPLACE (w AS w), sum(w) OVER (PARTITION BY {m}) AS now FROM (SELECT *, 0 AS now FROM w{n})))".replace("SELECT * REPLACE", "SELECT * EXCLUDE (now) REPLACE"))
            n += 1
    p = f"least(1.0, {rate} * CASE WHEN tokens > 0 THEN w / tokens ELSE 1.0 END)"
    parts.append(f"p AS (SELECT source, lang, topic, {p} AS p FROM w{n})")
    u = f"(('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT)::DOUBLE / 4294967296"
    gaps = " UNION ALL ".join(f"SELECT abs(sum(w) / max(total) - max(target_{m})) AS gap FROM w{n} GROUP BY {m}" for m in MARGINS)
    parts.append(f"e AS MATERIALIZED (SELECT round(max(coalesce(gap, 0)), 6) AS residual FROM ({gaps}))")
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, {u} < p AS kept, residual FROM r JOIN p USING (source, lang, topic), e"
