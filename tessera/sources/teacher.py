"""Replies of a text service, and the labelled examples made from them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import calls as K

#: Answers that are worth another try: fixed values.
RETRY = frozenset({408, 409, 425, 429, 500, 502, 503, 504})


def post(url: str, body: dict, tries: int = 5, wait: float = 1.0, timeout: float = 120.0) -> str:
    """One reply's text; transport errors, RETRY answers and unreadable replies are tried again, ever later."""
    data = json.dumps(body).encode()
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == tries - 1:
                raise
        except (OSError, ValueError, KeyError, IndexError):
            if k == tries - 1:
                raise
        time.sleep(wait * 2**k)
    raise RuntimeError("no try was made")


def ask(prompts: DataFrame, client=post, **settings) -> DataFrame:
    """(batch, reply, error) of (batch, body JSON) rows; a request that failed for good has no reply, but its cause.

    ``client`` is any function of (url, body, ...); tests and reruns pass one that replays a table.
    """

    def run(batches):
        for b in batches:
            out, errors = [], []
            for body in b.column(1).to_pylist():
                try:
                    reply, error = client(body=json.loads(body), **settings), None
                except Exception as e:  # noqa: BLE001  a failed batch is counted and its cause kept, not fatal
                    reply, error = None, f"{type(e).__name__}: {e}"
                out.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["batch", "reply", "error"])

    return prompts.select(F.col("batch").cast("long").alias("batch"), "body").mapInArrow(run, "batch long, reply string, error string")


def examples(replies: DataFrame, tools: str) -> DataFrame:
    """(batch, pos, query, answers, reason) of every parsed example; reason is "" for those that validate."""
    p = replies.filter("reply is not null").select("batch", F.col(tools).alias("tools"), F.posexplode(K.parse_examples(F.col("reply"))).alias("pos", "x"))
    e = p.select(F.concat_ws("-", "batch", "pos").alias("id"), "batch", "pos", "tools", K.field(F.col("x"), "query").alias("query"), F.to_json(K.field(F.col("x"), "answers", "variant")).alias("answers"))
    return e.join(K.validate(e, "id", "query", "answers", "tools"), "id").drop("id", "tools")


def generate(replies: DataFrame, tools: str, target: int) -> DataFrame:
    """The first ``target`` distinct valid examples in order of batch and place."""
    from tessera.operators.corpus import first_of

    ok = examples(replies, tools).filter("reason = ''").withColumn("_k", K.dedup_key(F.col("query"), F.col("answers")))
    return first_of(ok, ["_k"], ["batch", "pos"]).drop("_k").orderBy("batch", "pos").limit(target)


def generation_report(replies: DataFrame, made: DataFrame, kept: DataFrame) -> DataFrame:
    """Failed batches, produced, kept, duplicate and refusal shares."""
    a = replies.agg(F.count_if(F.col("reply").isNull()).alias("failed"))
    b = made.filter("reason = ''").agg(F.count("*").alias("produced"), F.countDistinct(K.dedup_key(F.col("query"), F.col("answers"))).alias("unique"))
    c = kept.agg(F.count("*").alias("kept"), F.count_if(F.col("answers") == "[]").alias("refusals"))
    return a.crossJoin(b).crossJoin(c).select("failed", "produced", "kept", (1 - F.col("unique") / F.greatest("produced", F.lit(1))).alias("duplicates"), (F.col("refusals") / F.greatest("kept", F.lit(1))).alias("refusal_share"))
