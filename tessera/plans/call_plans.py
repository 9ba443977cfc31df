"""Queries of call validation, scoring and calibration.

The events table stands in for tool calls: the tool is the event type, its one argument is ``k`` of the properties.
Gold and predicted calls, tool schemas, requests and confidences are built from the event id by fixed rules, so that every
branch of the operators is met; DuckDB states the same rules directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import calls as K
from tessera.operators import corpus as C
from tessera.operators import scoring as S
from tessera.session import dealt, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def calls(spark, d, deal=dealt):
    """event_id, tool, k, two, q, gold, pred, tools, off_topic, held_out, confidence."""
    i, tool, k = F.col("event_id"), F.col("tool"), F.col("k")
    every = lambda n: i % n == 0
    call = lambda name, args: F.concat(F.lit('{"name":"'), name, F.lit('","arguments":{'), args, F.lit("}}"))
    arg = lambda x: F.concat(F.lit('"k":'), x)
    second = F.when(every(7), F.concat(F.lit(","), call(tool, arg((k + 100).cast("string"))))).otherwise("")
    pk = F.when(i % 10 < 3, k + 1).otherwise(k).cast("string")
    pk = F.when(every(6), F.concat(F.lit('"'), pk, F.lit('"'))).otherwise(pk)
    pargs = F.when(every(31), "").otherwise(F.concat(arg(pk), F.when(every(29), ',"zz":1').otherwise("")))
    ptool = F.when(every(17), F.concat(tool, F.lit("_x"))).otherwise(tool)
    gold = F.concat(F.lit("["), call(tool, arg(k.cast("string"))), second, F.lit("]"))
    pred = F.concat(F.lit("["), call(ptool, pargs), F.when(every(14), second).otherwise(""), F.lit("]"))
    tools = F.concat(F.lit('[{"name":"'), tool, F.lit('","description":"log a thing","parameters":{"type":"object","properties":{"k":{"type":"integer","minimum":0,"maximum":90}},"required":["k"]}}]'))
    q = F.when(i % 8 == 1, "").when(i % 4 == 0, F.concat(F.lit("please "), tool, F.lit(" item "), k, F.lit(" now"))).otherwise("only one, thing")
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return deal(events, "event_id").select(
        "event_id", "tool", "k", q.alias("q"), F.when(every(8), "[]").otherwise(gold).alias("gold"), F.when(every(23), "[]").otherwise(pred).alias("pred"), tools.alias("tools"),
        every(8).alias("off_topic"), every(5).alias("held_out"), ((i * 37 % 1000) / F.lit(1000.0)).alias("confidence"), F.when(every(9), '{"name":"x"}').otherwise(gold).alias("answers"),
    )


#: The same in DuckDB: e(event_id, tool, k, q, off, held, conf, two, none, badname, wrong, text, missing, extra).
E = """WITH e AS (SELECT event_id, event_type AS tool, (props->>'$.k')::BIGINT AS k, event_id % 8 = 0 AS off, event_id % 5 = 0 AS held, (event_id * 37 % 1000) / 1000.0::DOUBLE AS conf,
  event_id % 7 = 0 AS two, event_id % 14 = 0 AS ptwo, event_id % 23 = 0 AS nocall, event_id % 17 = 0 AS badname, event_id % 10 < 3 AS wrong, event_id % 6 = 0 AS astext, event_id % 31 = 0 AS missing, event_id % 29 = 0 AS extra,
  CASE WHEN event_id % 8 = 1 THEN '' WHEN event_id % 4 = 0 THEN 'please ' || event_type || ' item ' || (props->>'$.k') || ' now' ELSE 'only one, thing' END AS q, event_id % 9 = 0 AS nolist FROM events),
  r AS (SELECT *, CASE WHEN nocall THEN 0 ELSE 1 + ptwo::INT END AS n_calls, CASE WHEN off THEN 0 ELSE 1 + two::INT END AS n_gold, NOT nocall AND NOT badname AND NOT wrong AND NOT missing AND NOT extra AND (NOT two OR ptwo) AS exact,
    NOT nocall AND NOT badname AND (NOT two OR ptwo) AS selected, (NOT nocall AND NOT badname AND NOT wrong AND NOT missing)::INT + (NOT nocall AND ptwo)::INT AS hit, 1 + two::INT AS total, CASE WHEN wrong THEN k + 1 ELSE k END AS pk FROM e),
  p AS (SELECT event_id, 0 AS ix, 'wrong_tool_name' AS problem FROM r WHERE NOT nocall AND badname
    UNION ALL SELECT event_id, 0, 'wrong_argument_key' FROM r WHERE NOT nocall AND NOT badname AND NOT missing AND extra
    UNION ALL SELECT event_id, 0, 'missing_required' FROM r WHERE NOT nocall AND NOT badname AND missing
    UNION ALL SELECT event_id, 0, 'wrong_type' FROM r WHERE NOT nocall AND NOT badname AND NOT missing AND astext
    UNION ALL SELECT event_id, 0, 'number_outside_range' FROM r WHERE NOT nocall AND NOT badname AND NOT missing AND NOT astext AND pk > 90
    UNION ALL SELECT event_id, 1, 'number_outside_range' FROM r WHERE NOT nocall AND ptwo AND k + 100 > 90),
  v AS (SELECT *, n_calls - (SELECT count(DISTINCT ix) FROM p WHERE p.event_id = r.event_id) AS n_valid FROM r)"""


def parsed(c: str):
    return K.call_list(F.try_parse_json(c))


def read(c):
    """Calls, gold calls and what is wrong with the calls, each parsed once."""
    c = c.withColumn("p", parsed("pred")).withColumn("g", parsed("gold")).withColumn("specs", K.specs(F.try_parse_json("tools")))
    return c.withColumn("problems", K.problems(F.col("p"), F.col("specs")))


def requests(spark, d):
    """What the report adds up, a row for all ``rows`` requests that are alike; those are counted where they lie, and then dealt."""
    alike = F.col("tool").alias("family"), "off_topic", "held_out", "pred", "gold", "tools"
    each = calls(spark, d, lambda events, key: events).groupBy(*alike).agg(F.count("*").alias("rows"))
    c = read(dealt(each, "pred", "gold"))
    c = c.withColumn("pf", K.forms(F.col("p"))).withColumn("gf", K.forms(F.col("g"))).withColumn("hits", K.compared(F.col("pf"), F.col("gf")))
    bad = F.size(F.filter("problems", lambda x: F.size(x) > 0))
    return c.select("rows", "family", "off_topic", "held_out", F.size("p").alias("n_calls"), F.size("g").alias("n_gold"), (F.col("pf") == F.col("gf")).alias("exact"), (K.names(F.col("pf")) == K.names(F.col("gf"))).alias("selected"), "hits.hit", "hits.total", (F.size("p") - bad).alias("n_valid"))


REASON = """CASE WHEN q = '' THEN 'empty query' WHEN nolist THEN 'answers is not a list'
  WHEN (NOT contains(replace(q, ',', ''), k::VARCHAR) AND NOT (k = 1 AND contains(q, 'one'))) OR (two AND NOT contains(q, (k + 100)::VARCHAR)) THEN 'values not evidenced in the query' ELSE '' END"""


@query(f"{E} SELECT event_id, {REASON} AS reason FROM e")
def validate_reason(spark, d):
    return K.validate(calls(spark, d), "event_id", "q", "answers", "tools")


@query(f"{E} SELECT event_id, sum((NOT contains(replace(q, ',', ''), x::VARCHAR) AND NOT (x = 1 AND contains(q, 'one')))::INT)::BIGINT AS ungrounded FROM (SELECT event_id, q, unnest(CASE WHEN two THEN [k, k + 100] ELSE [k] END) AS x FROM e WHERE NOT off) GROUP BY event_id")
def ungrounded_args(spark, d):
    c = K.explode_calls(calls(spark, d), parsed("gold"), ["event_id", "q"])
    bad = F.filter(F.map_entries("arguments"), lambda e: ~K.grounded(e["value"], F.array().cast("array<variant>"), F.col("q")))
    return c.groupBy("event_id").agg(F.sum(F.size(bad)).alias("ungrounded"))


@query(f"{E} SELECT event_id, ix::INT AS ix, problem FROM p")
def schema_errors(spark, d):
    return K.schema_errors(calls(spark, d), "event_id", parsed("pred"), "tools").select("event_id", "ix", "problem")


@query(f"{E}, u AS (SELECT event_id, event_id % 11 = 0 AS unread, event_id % 22 = 0 AS cut FROM e), n AS (SELECT sum(CASE WHEN cut THEN 1 ELSE n_calls + (unread AND n_calls = 0)::INT END) AS n, count(*) FILTER (unread) AS bad FROM r JOIN u USING (event_id)), k AS (SELECT p.problem FROM p JOIN u USING (event_id) WHERE NOT cut) SELECT t.problem, round(1000.0::DOUBLE * CASE WHEN t.problem = 'malformed_json' THEN bad ELSE coalesce(c, 0) END / n, 1) AS per_1000 FROM (SELECT unnest(['wrong_tool_name', 'wrong_argument_key', 'missing_required', 'value_outside_choices', 'number_outside_range', 'wrong_type', 'malformed_json']) AS problem) t LEFT JOIN (SELECT problem, count(*) AS c FROM k GROUP BY problem) USING (problem), n")
def errors_per_1000(spark, d):
    i = F.col("event_id")  # every 11th turn can't be read to its end, every second of these not at all
    c = calls(spark, d).withColumn("pred", F.when(i % 22 == 0, "[]").otherwise(F.col("pred")))
    return S.error_rates(read(c).withColumn("unread", i % 11 == 0), "problems", "unread")


@query(f"{E} SELECT event_id, tool || '_x' AS tool FROM e WHERE badname AND NOT nocall")
def undeclared_tools(spark, d):
    c = read(calls(spark, d)).select("event_id", F.explode(F.flatten("problems")).alias("x"))
    return c.filter("x.problem = 'wrong_tool_name'").select("event_id", F.col("x.arg").alias("tool"))


@query(f"{E} SELECT event_id, 'k' AS key FROM e WHERE missing AND NOT nocall AND NOT badname")
def missing_required(spark, d):
    c = read(calls(spark, d)).select("event_id", F.explode(F.flatten("problems")).alias("x"))
    return c.filter("x.problem = 'missing_required'").select("event_id", F.col("x.arg").alias("key"))


@query(f"{E} SELECT event_id, tool, 'log a thing' AS description FROM e WHERE NOT off")
def schema_lookup(spark, d):
    c = calls(spark, d).filter("not off_topic").select("event_id", F.get(parsed("gold"), F.lit(0))["name"].alias("tool"), K.declared(F.try_parse_json("tools")).alias("declared"))
    found = K.lookup(F.col("declared"), F.col("tool"))
    return c.select("event_id", "tool", found["description"].alias("description")).filter("description is not null")


@query(f"{E} SELECT event_id, exact FROM r WHERE NOT off")
def exact_call(spark, d):
    return calls(spark, d).filter("not off_topic").select("event_id", K.exact_call(parsed("pred"), parsed("gold")).alias("exact"))


@query(f"{E} SELECT sum(hit)::BIGINT AS hit, sum(total)::BIGINT AS total, round(sum(hit) / sum(total), 6) AS grounding FROM r WHERE NOT off")
def argument_grounding(spark, d):
    g = calls(spark, d).filter("not off_topic").select(K.grounding(parsed("pred"), parsed("gold")).alias("g"))
    return g.agg(F.sum("g.hit").alias("hit"), F.sum("g.total").alias("total")).withColumn("grounding", F.round(F.col("hit") / F.col("total"), 6))


RATES = ("exact_call", "tool_selection", "argument_grounding", "refusal", "schema_valid", "over_refusal")


@query(f"{E} SELECT count(*) AS n, count(*) FILTER (NOT off) AS requests, sum(n_calls)::BIGINT AS calls, round(avg(exact::INT) FILTER (NOT off), 6) AS exact_call, round(avg(selected::INT) FILTER (NOT off), 6) AS tool_selection, round(sum(hit) FILTER (NOT off) / sum(total) FILTER (NOT off), 6) AS argument_grounding, round(avg(nocall::INT) FILTER (off), 6) AS refusal, round(sum(n_valid) / sum(n_calls), 6) AS schema_valid, round(avg(nocall::INT) FILTER (NOT off), 6) AS over_refusal FROM v")
def score_headline(spark, d):
    h = S.headline(requests(spark, d), "rows")
    return h.select("n", "requests", "calls", *[F.round(r, 6).alias(r) for r in RATES])


@query(f"{E} SELECT tool AS family, round(avg(exact::INT), 6) AS exact_call FROM r WHERE NOT off GROUP BY tool")
def score_by_family(spark, d):
    return S.by_family(requests(spark, d), "rows").withColumn("exact_call", F.round("exact_call", 6))


@query(f"{E} SELECT slice, round(avg(exact::INT), 6) AS exact_call FROM (SELECT exact, unnest([CASE WHEN held THEN 'held_out' ELSE 'seen' END, CASE WHEN n_gold > 1 THEN 'multi_call' ELSE 'single_call' END]) AS slice FROM r WHERE NOT off) GROUP BY slice")
def score_by_slice(spark, d):
    return S.by_slice(requests(spark, d), "rows").withColumn("exact_call", F.round("exact_call", 6))


def confident(spark, d):
    c = calls(spark, d).filter("not off_topic")
    return c.select("event_id", "confidence", K.exact_call(parsed("pred"), parsed("gold")).cast("double").alias("correct"))


B = f"{E}, c AS (SELECT conf, exact::INT::DOUBLE AS y, greatest(ceil(conf * 10), 1)::INT AS bin FROM r WHERE NOT off), b AS (SELECT bin, count(*) AS n, avg(conf) AS cf, avg(y) AS ac FROM c GROUP BY bin)"


@query(f"{B} SELECT round(sum(n * abs(ac - cf)) / sum(n), 6) AS ece, round(max(abs(ac - cf)), 6) AS mce FROM b")
def calibration_error(spark, d):
    return S.calibration_errors(confident(spark, d), "confidence", "correct").select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query(f"{B} SELECT i::INT AS bin, round((i - 1) / 10, 6) AS lo, round(i / 10, 6) AS hi, coalesce(n, 0) AS n, round(coalesce(cf, 0), 6) AS confidence, round(coalesce(ac, 0), 6) AS accuracy, round(coalesce(ac - cf, 0), 6) AS gap FROM range(1, 11) t(i) LEFT JOIN b ON bin = i")
def reliability_bins(spark, d):
    r = S.reliability_bins(confident(spark, d), "confidence", "correct")
    return r.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "confidence", "accuracy", "gap")])


@query(f"{B} SELECT t AS threshold, round(avg((conf >= t)::INT), 6) AS handled, round(coalesce(avg(y) FILTER (conf >= t), 0), 6) AS exact_call_handled, round(coalesce(avg(y) FILTER (conf < t), 0), 6) AS exact_call_escalated FROM c, (SELECT unnest([0.3, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) GROUP BY t")
def threshold_sweep(spark, d):
    r = S.threshold_sweep(confident(spark, d), "confidence", "correct")
    return r.select("threshold", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


@query("WITH m AS (SELECT quantile_cont(value, 0.8) AS mu FROM events) SELECT event_id, round(1 / (1 + exp(5 * (ln(greatest(value, 1)) - ln(greatest(mu, 1.000000001))))), 6) AS confidence FROM events, m")
def ppl_confidence(spark, d):
    e = table(spark, d, "events")
    mu = F.lit(S.percentile(e, "value", 0.8))
    return e.select("event_id", F.round(S.perplexity_confidence(F.col("value"), mu), 6).alias("confidence"))


GRID = f"""{B}, s AS (SELECT least(greatest(conf, 1e-6), 1 - 1e-6) AS p, y FROM c), z AS (SELECT ln(p / (1 - p)) AS z, y, count(*) AS n FROM s GROUP BY ALL),
  g AS (SELECT i, exp(ln(0.05) + i * (ln(20.0) - ln(0.05)) / 399) AS t FROM range(400) r(i)), q AS (SELECT i, t, y, n, least(greatest(1 / (1 + exp(-z / t)), 1e-9), 1 - 1e-9) AS q FROM z, g),
  l AS (SELECT i, t, -sum(n * (y * ln(q) + (1 - y) * ln(1 - q))) / sum(n) AS nll FROM q GROUP BY i, t)"""


@query(f"{GRID} SELECT round(arg_min(t, (round(nll, 9), i)), 6) AS temperature FROM l")
def temperature_fit(spark, d):
    return S.fit_temperature(confident(spark, d), "confidence", "correct").select(F.round("temperature", 6).alias("temperature"))


def _errors(of: str) -> str:
    return f"SELECT round(sum(n * abs(ac - cf)) / sum(n), 5) AS ece, round(max(abs(ac - cf)), 5) AS mce FROM (SELECT greatest(ceil(p * 10), 1) AS bin, count(*) AS n, avg(p) AS cf, avg(y) AS ac FROM {of} GROUP BY bin)"


@query(f"""{GRID}, best AS (SELECT arg_min(t, (round(nll, 9), i)) AS t FROM l), raw AS (SELECT conf AS p, y FROM c), cool AS (SELECT 1 / (1 + exp(-ln(p / (1 - p)) / t)) AS p, y FROM s, best)
  SELECT round(t, 6) AS temperature, a.ece, a.mce, b.ece AS ece_tempered, b.mce AS mce_tempered FROM best, ({_errors('raw')}) a, ({_errors('cool')}) b""")
def calibration(spark, d):
    r = S.calibration_report(confident(spark, d), "confidence", "correct")
    return r.select(F.round("temperature", 6).alias("temperature"), *[F.round(c, 5).alias(c) for c in r.columns[1:]])


@query("SELECT round(avg((quality - toxic) ** 2), 6) AS mse, round(avg(abs(quality - toxic)), 6) AS mae, round(corr(quality, toxic), 6) AS pearson FROM labels")
def regression_stats(spark, d):
    return S.regression_stats(table(spark, d, "labels"), "quality", "toxic").select(*[F.round(c, 6).alias(c) for c in ("mse", "mae", "pearson")])


@query("SELECT round(exp(sum(value / 100 * (event_id % 3)) / sum(event_id % 3)), 6) AS perplexity FROM events")
def weighted_perplexity(spark, d):
    e = table(spark, d, "events").select((F.col("value") / 100).alias("ce"), (F.col("event_id") % 3).cast("double").alias("w"))
    return S.weighted_perplexity(e, "ce", "w").select(F.round("perplexity", 6).alias("perplexity"))


@query("SELECT event_type, round(sum(exp(value / 50) * user_id) / sum(exp(value / 50)), 4) AS pooled FROM events GROUP BY event_type")
def probe_pool(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") / 50).alias("l"), F.col("user_id").cast("double").alias("v"))
    return S.softmax_pool(e, ["event_type"], "l", "v").select("event_type", F.round("pooled", 4).alias("pooled"))


# Text of replies and turns


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS n FROM events")
def parse_examples(spark, d):
    q = F.concat(F.lit('{"query": "'), F.col("event_type"), F.lit('"}'))
    m = F.col("event_id") % 4
    reply = F.when(m == 0, F.concat(F.lit("Here you go:\n```json\n["), q, F.lit(", 5, "), q, F.lit(', {"other": 1}]\n```'))).when(m == 1, F.concat(F.lit("["), q, F.lit("]"))).when(m == 2, "[broken").otherwise(F.lit("{} no list"))
    return table(spark, d, "events").select("event_id", F.size(K.parse_examples(reply)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 3) THEN event_type END AS name, CASE WHEN event_id % 5 IN (0, 1, 3) THEN props->>'$.k' END AS k, CASE event_id % 5 WHEN 2 THEN 'unparsable JSON' WHEN 3 THEN 'a call had no name' WHEN 4 THEN NULL END AS error FROM events")
def parse_calls(spark, d):
    k, n = F.get_json_object("props", "$.k"), F.col("event_type")
    m = F.col("event_id") % 5
    plain = F.concat(F.lit('[{"name":"'), n, F.lit('","arguments":{"k":'), k, F.lit("}}]"))
    turn = (
        F.when(m == 0, F.concat(F.lit("<think>t</think>\n<tool_call>"), T.pre_tokenize(plain), F.lit("</tool_call><|im_end|>")))
        .when(m == 1, F.concat(F.lit('I call {"name":"'), n, F.lit('","parameters":{"k":'), k, F.lit("}} now")))
        .when(m == 2, "nothing [ to see").when(m == 3, F.concat(F.lit('<tool_call>[{"name":"'), n, F.lit('","arguments":{"k":'), k, F.lit('}},{"arguments":{}}]'))).otherwise("<tool_call></tool_call>")
    )
    e = table(spark, d, "events").select("event_id", K.parse_calls(turn).alias("p"))
    first = F.get("p.calls", F.lit(0))
    return e.select("event_id", first["name"].alias("name"), F.try_variant_get(first["arguments"]["k"], "$", "string").alias("k"), F.col("p.error").alias("error"))


@query("SELECT event_id, md5(regexp_replace(props, '([({\\[\",\\]})])', ' \\1 ', 'g')) AS spaced, props AS restored FROM (SELECT event_id, replace(props, ': ', ':') AS props FROM events)")
def pre_tokenize(spark, d):
    e = table(spark, d, "events").select("event_id", F.replace("props", F.lit(": "), F.lit(":")).alias("props"))
    return e.select("event_id", F.md5(T.pre_tokenize(F.col("props"))).alias("spaced"), T.restore_json(T.pre_tokenize(F.col("props"))).alias("restored"))


@query("SELECT conv_id, turn, trim(text, chr(10) || ' ') AS text FROM conversations")
def strip_markers(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.strip_markers(F.concat(F.lit("<|im_start|> "), F.col("text"), F.lit("</tool_result><|im_end|>\n"))).alias("text"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS words FROM documents")
def normalise_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("words"))


@query(f"{E} SELECT event_id, '<|im_start|>user' || chr(10) || '<tools>[]</tools>' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt, '<think>r</think>' || chr(10) || '<tool_call>[]</tool_call><|im_end|>' AS target FROM e")
def render_prompt(spark, d):
    return calls(spark, d).select("event_id", K.render(F.col("q"), F.lit("[]"), F.lit("[]"), F.lit("r")).alias("r")).select("event_id", "r.*")


TURN = "CASE role WHEN 'assistant' THEN rtrim(text, chr(10) || ' ') || '<|im_end|>' || chr(10) ELSE '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) END"


@query(f"""WITH o AS (SELECT conv_id, turn, role, text, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM conversations),
  h AS (SELECT *, coalesce(f, min(turn) OVER (PARTITION BY conv_id)) AS first FROM o),
  t AS (SELECT conv_id, string_agg(CASE WHEN turn = first THEN '<|im_start|>user' || chr(10) || '<tools>[]</tools>' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE {TURN} END, '' ORDER BY turn) AS x FROM h WHERE turn >= first GROUP BY conv_id)
  SELECT conv_id, md5('<|im_start|>system' || chr(10) || 'S<|im_end|>' || chr(10) || x || CASE WHEN ends_with(x, '<|im_start|>assistant' || chr(10)) THEN '' ELSE '<|im_start|>assistant' || chr(10) END) AS prompt FROM t""")
def render_conversation(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.md5(K.render_conversation(F.col("turns"), F.lit("[]"), F.lit("S"))).alias("prompt"))


@query(f"{E} SELECT tool, two, k, min(event_id) AS first, count(*) AS n FROM e GROUP BY tool, two, k")
def dedup_request_call(spark, d):
    c = calls(spark, d).select("event_id", "tool", "k", (F.col("event_id") % 7 == 0).alias("two"), K.dedup_key(F.concat(F.lit(" "), F.upper("tool")), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('[{"b":2,"k":'), F.col("k"), F.lit("}]"))).otherwise(F.concat(F.lit('[{"k":'), F.col("k"), F.lit("}]")))).alias("key"))
    n = c.groupBy("key").agg(F.count("*").alias("n"))
    return C.first_of(c, ["key"], ["event_id"]).join(n, "key").select("tool", "two", "k", F.col("event_id").alias("first"), "n")
