"""Scoring: headline rates, breakdowns, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the report.
THRESHOLDS, BINS = (0.30, 0.50, 0.60, 0.70, 0.80, 0.90), 10
ERRORS = ("wrong_tool_name", "wrong_argument_key", "missing_required", "value_outside_choices", "number_outside_range", "wrong_type", "malformed_json")


def share(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def counted(weight: str | None):
    """A count of the rows that meet a condition, and a sum; each row stands for as many as ``weight`` says, or for itself."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return lambda ok: F.coalesce(F.sum(F.when(ok, w)), F.lit(0).cast("long")), lambda x: F.sum(x * w)


def headline(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """A07, A08, A12 from one row per request: off_topic, n_calls, n_valid, exact, selected, hit, total.

    A row may stand for many requests that are alike: ``weight`` names the column of their number, here and below.
    """
    on, none = ~F.col("off_topic"), F.col("n_calls") == 0
    count, add = counted(weight)
    agg = rows.agg(
        count(F.lit(True)).alias("n"), count(on).alias("requests"), count(~on).alias("off"), add(F.col("n_calls")).alias("calls"), add(F.col("n_valid")).alias("valid"), count(on & F.col("exact")).alias("exact"),
        count(on & F.col("selected")).alias("selected"), count(~on & none).alias("refused"), count(on & none).alias("over"), add(F.when(on, F.col("hit"))).alias("hit"), add(F.when(on, F.col("total"))).alias("total"),
    )
    c = F.col
    return agg.select(
        "n", "requests", "calls", share(c("exact"), c("requests")).alias("exact_call"), share(c("selected"), c("requests")).alias("tool_selection"), share(c("hit"), c("total")).alias("argument_grounding"),
        share(c("refused"), c("off")).alias("refusal"), share(c("valid"), c("calls"), 1.0).alias("schema_valid"), share(c("over"), c("requests")).alias("over_refusal"),
    )


def by_family(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """A10."""
    count, _ = counted(weight)
    return rows.filter(~F.col("off_topic")).groupBy("family").agg(share(count(F.col("exact")), count(F.lit(True))).alias("exact_call"))


def by_slice(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Each request counts in two slices."""
    slices = F.array(F.when(F.col("held_out"), "held_out").otherwise("seen"), F.when(F.col("n_gold") > 1, "multi_call").otherwise("single_call"))
    count, _ = counted(weight)
    return rows.filter(~F.col("off_topic")).withColumn("slice", F.explode(slices)).groupBy("slice").agg(share(count(F.col("exact")), count(F.lit(True))).alias("exact_call"))


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """(lo, hi], the first closed at 0; null outside [0, 1]."""
    return F.when((conf >= 0) & (conf <= 1), F.greatest(F.ceil(conf * bins), F.lit(1)).cast("int"))


def reliability_bins(df: DataFrame, conf: str, correct: str, bins: int = BINS) -> DataFrame:
    """Every bin, empty ones as zeros."""
    got = df.withColumn("bin", bin_of(F.col(conf), bins)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(correct).alias("accuracy"))
    all_ = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    out = all_.join(got, "bin", "left").select("bin", ((F.col("bin") - 1) / bins).alias("lo"), (F.col("bin") / bins).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), z("confidence"), z("accuracy"))
    return out.withColumn("gap", F.col("accuracy") - F.col("confidence"))


def calibration_errors(df: DataFrame, conf: str, correct: str, bins: int = BINS) -> DataFrame:
    """(ece, mce); confidences outside [0, 1] are in no bin but count in the total."""
    per = df.withColumn("bin", bin_of(F.col(conf), bins)).groupBy("bin").agg(F.count("*").alias("n"), (F.avg(correct) - F.avg(conf)).alias("gap"))
    one = per.agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs("gap"))).alias("s"), F.sum("n").alias("n"), F.max(F.when(F.col("bin").isNotNull(), F.abs("gap"))).alias("mce"))
    return one.select(share(F.col("s"), F.col("n")).alias("ece"), F.coalesce("mce", F.lit(0.0)).alias("mce"))


def threshold_sweep(df: DataFrame, conf: str, correct: str, thresholds=THRESHOLDS) -> DataFrame:
    """A16, in one pass: a column per threshold, then a row per threshold."""
    c, ok = F.col(conf), F.col(correct)
    aggs = []
    for t in thresholds:
        h = c >= t
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), F.avg(h.cast("double")).alias("handled"), F.avg(F.when(h, ok)).alias("exact_call_handled"), F.avg(F.when(~h, ok)).alias("exact_call_escalated")))
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return rows.na.fill(0.0)


def order_statistics(df: DataFrame, value: str, ranks: list[int], at_once: int = 10_000) -> dict[int, float]:
    """The values that stand at the given places (from 0) in ascending order; nulls don't count. Exact at any size.

    Each pass sketches the values that are still in question by Spark's mergeable quantile summary, takes the sketch's bounds
    around the places, and counts what lies below and between them, so that the sketch decides how fast the range narrows
    and never the result. A range of ``at_once`` rows, or of one value, ends it; values are then counted, not listed. No task ever
    holds or sorts the table.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    out, n = {}, None
    for rank in sorted(set(ranks)):
        if n is None:
            n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
            whole = (lo, hi)
        if not 0 <= rank < n:
            raise ValueError(f"there is no place {rank} among {n} values")
        (lo, hi), below, inside = whole, 0, n
        while lo != hi and inside > at_once:
            share, slack = (rank - below) / inside, 2e-4
            got = rows.filter(F.col("v").between(lo, hi)).agg(F.percentile_approx("v", F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack))), F.lit(10_000))).first()[0]
            a, b = (min(max(x, lo), hi) for x in got)
            v = F.col("v")
            under, at_a, between, at_b, over = rows.filter(v.between(lo, hi)).agg(*[F.count_if(c) for c in (v < a, v == a, v.between(a, b), v == b, v > b)]).first()
            if rank - below < under:
                new = (lo, a, below, under + at_a)
            elif rank - below < under + between:
                new = (a, b, below + under, between)
            else:
                new = (b, hi, below + under + between - at_b, over + at_b)
            if new[:2] == (lo, hi):
                break  # few values, each of many rows
            lo, hi, below, inside = new
        if lo == hi:
            out[rank] = lo
            continue
        for v, k in rows.filter(F.col("v").between(lo, hi)).groupBy("v").count().orderBy("v").collect():
            below += k
            if rank < below:
                out[rank] = v
                break
    return out


def percentile(df: DataFrame, value: str, share: float) -> float | None:
    """The value below which a share of the rows lies, interpolated between the two places next to it; null without rows."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return None
    at = share * (n - 1)
    k = int(at)
    found = order_statistics(df, value, sorted({k, min(k + 1, n - 1)}))
    a, b = found[k], found[min(k + 1, n - 1)]
    return a + (b - a) * (at - k)


def perplexity_confidence(ppl: Column, mu: Column, k: float = 5.0) -> Column:
    """0.5 at mu, falling in log perplexity."""
    return 1 / (1 + F.exp(F.lit(k) * (F.ln(F.greatest(ppl, F.lit(1.0))) - F.ln(F.greatest(mu, F.lit(1.0 + 1e-9))))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(p / (1 - p))


def tempered(p: Column, temperature: Column) -> Column:
    """The calibrated confidence."""
    return 1 / (1 + F.exp(-logit(p) / temperature))


def temperature_grid(df: DataFrame, conf: str, correct: str, lo: float = 0.05, hi: float = 20.0, points: int = 400) -> DataFrame:
    """(i, t, nll) per grid point.

    Equal predictions are counted first; each of the rest meets every grid point in its own task, which adds them up, so that
    one row per point and task is shuffled.
    """
    import math

    g = df.select(logit(F.col(conf).cast("double")).alias("z"), F.col(correct).cast("double").alias("y")).groupBy("z", "y").agg(F.count("*").alias("n"))
    x = g.select("z", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    t = F.exp(F.lit(math.log(lo)) + F.col("i") * F.lit((math.log(hi) - math.log(lo)) / (points - 1)))
    q = F.least(F.greatest(1 / (1 + F.exp(-F.col("z") / t)), F.lit(1e-9)), F.lit(1 - 1e-9))
    nll = -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))
    return x.groupBy("i").agg((F.sum(nll * F.col("n")) / F.sum("n")).alias("nll")).select("i", t.alias("t"), "nll")


def fit_temperature(df: DataFrame, conf: str, correct: str, **k) -> DataFrame:
    """The temperature of least loss, the first of equals."""
    return temperature_grid(df, conf, correct, **k).agg(F.min_by("t", F.struct(F.round("nll", 9), "i")).alias("temperature"))


def regression_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mse, mae and Pearson's r; NaN where a side is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.agg(F.avg((x - y) * (x - y)).alias("mse"), F.avg(F.abs(x - y)).alias("mae"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return s.select("mse", "mae", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).otherwise(float("nan")).alias("pearson"))


def weighted_perplexity(df: DataFrame, ce: str, weight: str) -> DataFrame:
    """A21."""
    return df.agg(F.exp(F.sum(F.col(ce) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0))).alias("perplexity"))


def mean_of_batches(df: DataFrame, batch: str, loss: str, size: int) -> DataFrame:
    """Mean over whole batches of their mean loss."""
    b = df.groupBy(batch).agg(F.avg(loss).alias("l"), F.count("*").alias("n")).filter(F.col("n") == size)
    return b.agg(F.avg("l").alias("loss"))


def softmax_pool(df: DataFrame, group: list[str], logit_: str, value: str) -> DataFrame:
    """Softmax-weighted mean of a value per group, stable by its largest logit."""
    m = df.groupBy(*group).agg(F.max(logit_).alias("_m"))
    e = F.exp(F.col(logit_) - F.col("_m"))
    return df.join(m, group).groupBy(*group).agg((F.sum(e * F.col(value)) / F.sum(e)).alias("pooled"))


def contrastive_loss(pairs: DataFrame, row: str, col: str, score: str) -> DataFrame:
    """Symmetric cross-entropy of matching row and column over all scores."""

    def side(by):
        m = pairs.groupBy(by).agg(F.max(score).alias("_m"))
        z = pairs.join(m, by).groupBy(by).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col(score) - F.col("_m"))))).alias("_z"))
        return pairs.filter(F.col(row) == F.col(col)).join(z, by).agg(F.avg(F.col("_z") - F.col(score)).alias("l"))

    return side(row).crossJoin(side(col).withColumnRenamed("l", "l2")).select(((F.col("l") + F.col("l2")) / 2).alias("loss"))


def _is(value: str):
    return lambda x: x == value


def error_rates(rows: DataFrame, problems: str, unread: str) -> DataFrame:
    """Errors of each kind per 1000 calls, one decimal.

    ``problems`` holds a list of struct(problem, arg) per call of a turn; ``unread`` says that a turn could not be read as
    calls: it counts as malformed, and as one attempted call if it has none.
    """
    n = F.size(F.col(problems))
    bad = F.coalesce(F.col(unread), F.lit(False))
    calls = F.sum(n + F.when(bad & (n == 0), 1).otherwise(0))
    named = [F.sum(F.size(F.filter(F.transform(F.flatten(problems), lambda p: p["problem"]), _is(e)))).alias(e) for e in ERRORS if e != "malformed_json"]
    total = rows.agg(F.greatest(calls, F.lit(1)).alias("_calls"), F.count_if(bad).alias("malformed_json"), *named)
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("problem"), F.col(e).alias("n")) for e in ERRORS])).alias("x")
    return total.select("_calls", each).select("x.problem", F.round(1000.0 * F.coalesce("x.n", F.lit(0)) / F.col("_calls"), 1).alias("per_1000"))


def calibration_report(df: DataFrame, conf: str, correct: str) -> DataFrame:
    """(temperature, ece, mce, ece_tempered, mce_tempered): calibration as it is, and with the fitted temperature."""
    t = fit_temperature(df, conf, correct)
    after = df.crossJoin(F.broadcast(t)).withColumn(conf, tempered(F.col(conf), F.col("temperature")))
    cooled = calibration_errors(after, conf, correct).toDF("ece_tempered", "mce_tempered")
    return t.crossJoin(F.broadcast(calibration_errors(df, conf, correct))).crossJoin(F.broadcast(cooled))


def report_text(headline: dict, families: list[tuple[str, float]], sweep: list[dict]) -> str:
    """The rates, the families by falling rate, and the sweep, one to a line."""
    out = [f"{k.replace('_', ' '):<24}{v:>8.1%}" for k, v in headline.items()]
    out += [f"{k:<24}{v:>8.1%}" for k, v in sorted(families, key=lambda x: -x[1])]
    return "\n".join(out + [f"{r['threshold']:<24.2f}" + "".join(f"{r[k]:>8.1%}" for k in ("handled", "exact_call_handled", "exact_call_escalated")) for r in sweep])
