"""Queries of the token automaton and of streams with state, over conversations, events and documents."""

from __future__ import annotations

from typing import Annotated, Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import registry as B
from tessera.functions import validation as V
from tessera.functions.registry import Field
from tessera.operators import automaton as A
from tessera.operators.corpus import running_total
from tessera.plans.corpus_plans import CLEANED, KEEP
from tessera.session import scratch, stored, table
from tessera.streaming import state as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The token automaton. Seven sets of tools, made of the event types; a turn calls one of its set, or one of the next.

SETS = 7
PIECE = r"[a-z]{1,3}|[0-9_]|[^a-z0-9_]"


def _turns(spark, d) -> DataFrame:
    """(conv_id, turn, pieces, tools): calls made of conversations, cut into pieces."""
    types = F.array_sort(F.collect_set("event_type"))
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    set_ = F.pmod("conv_id", F.lit(SETS))
    tool = lambda t, s: F.concat(t, F.lit("_"), s)
    schema = F.lit('","parameters":{"properties":{"role":{"type":"string","enum":["user","assistant"]},"turn":{"type":"integer","minimum":0}},"required":["role"]}}')
    declared = F.concat(F.lit("["), F.array_join(F.transform("types", lambda t: F.concat(F.lit('{"name":"'), tool(t, F.col("set")), schema)), ","), F.lit("]"))
    named = tool(F.get("types", F.pmod(F.col("n"), F.size("types")).cast("int")), F.pmod(F.col("set") + F.when(F.col("turn") % 3 == 2, 1).otherwise(0), F.lit(SETS)))
    text = F.concat(F.lit('ok <tool_call>[{"name":"'), named, F.lit('","arguments":{"role":"'), F.col("role"), F.lit('","turn":'), "turn", F.lit("}}"))
    rows = c.withColumn("set", set_).join(F.broadcast(table(spark, d, "events").agg(types.alias("types"))))
    return rows.select("conv_id", "turn", declared.alias("tools"), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)).alias("texts"))


def _vocabulary(turns: DataFrame) -> DataFrame:
    """(id, piece): every piece of the turns, also with a blank in front and with a quote behind."""
    p = turns.select(F.explode("texts").alias("p")).distinct()
    p = p.select(F.explode(F.array("p", F.concat(F.lit(" "), "p"), F.concat("p", F.lit('"')))).alias("piece")).distinct()
    return running_total(p.withColumn("one", F.lit(1)), "one", ["piece"], F.substring("piece", 1, 2), [], "id").select("id", "piece")


#: Declared words by set, kind and tool, and the pieces of the vocabulary, as DuckDB tables.
WORDS = rf"""t AS (SELECT DISTINCT event_type AS t FROM events), n AS (SELECT list(t ORDER BY t) AS ts FROM t),
  c AS (SELECT conv_id, turn, role, conv_id % {SETS} AS s, ts[length(text) % len(ts) + 1] || '_' || ((conv_id % {SETS} + CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) % {SETS}) AS tool FROM conversations, n),
  words AS MATERIALIZED (SELECT s, 'name' AS kind, NULL AS tool, t || '_' || s AS word FROM t, (SELECT DISTINCT s FROM c) UNION ALL SELECT s, 'key', t || '_' || s, unnest(['role', 'turn']) FROM t, (SELECT DISTINCT s FROM c)
    UNION ALL SELECT s, 'value', t || '_' || s, unnest(['user', 'assistant']) FROM t, (SELECT DISTINCT s FROM c)),
  spans AS MATERIALIZED (SELECT conv_id, turn, s, 'name' AS kind, NULL AS tool, tool AS text FROM c UNION ALL SELECT conv_id, turn, s, 'key', tool, unnest(['role', 'turn']) FROM c UNION ALL SELECT conv_id, turn, s, 'value', tool, role FROM c)"""


@query(rf"""WITH {WORDS}, p AS (SELECT *, regexp_extract_all(text || '"', '{PIECE}') AS ps FROM spans),
  i AS (SELECT row_number() OVER () AS r, conv_id, turn, s, kind, tool, ps[k] AS piece, array_to_string(ps[:k - 1], '') AS prefix FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM p)),
  m AS (SELECT i.r, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(i.kind) AS kind, bool_or(starts_with(w.word, prefix || piece) OR (piece = '"' AND w.word = prefix)) AS fits FROM i JOIN words w ON w.s = i.s AND w.kind = i.kind AND w.tool IS NOT DISTINCT FROM i.tool AND starts_with(w.word, prefix) GROUP BY i.r)
  SELECT conv_id, turn, kind, count(*) AS masked, count(*) FILTER (fits) AS fits FROM m GROUP BY ALL""")
def turn_masks(spark, d):
    """All pieces of all turns looked up in the automaton: how many stand in a span, and how many of them it allows."""
    turns, vocabulary, words, steps = _automaton(spark, d)
    each = turns.select("conv_id", "turn", "tools", F.posexplode("texts").alias("at", "piece")).join(vocabulary, "piece")
    pieces = each.groupBy("conv_id", "turn", "tools").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", "piece"))), lambda p: F.struct(p["id"], p["piece"])).alias("pieces"))
    pieces = pieces.withColumn("key", F.struct("conv_id", "turn"))
    seen = A.positions(pieces, "key", "pieces", "tools", words, steps)
    return seen.groupBy("key", "kind").agg(F.count("*").alias("masked"), F.count_if("fits").alias("fits")).select("key.conv_id", "key.turn", "kind", "masked", "fits")


def _automaton(spark, d):
    """(turns, vocabulary, words, steps): the tables of the automaton are built once and kept."""
    where = scratch(spark)
    turns = stored(_turns(spark, d), f"{where}/turns")
    vocabulary, words = stored(_vocabulary(turns), f"{where}/vocabulary"), stored(A.constraints(turns, "tools"), f"{where}/words")
    return turns, vocabulary, words, stored(A.transitions(words, vocabulary), f"{where}/steps")


@query(rf"""WITH {WORDS}, v0 AS (SELECT DISTINCT unnest(regexp_extract_all('ok <tool_call>[{{"name":"' || tool || '","arguments":{{"role":"' || role || '","turn":' || turn || '}}}}', '{PIECE}')) AS p FROM c), v AS (SELECT DISTINCT unnest([p, ' ' || p, p || '"']) AS piece FROM v0),
  states AS (SELECT DISTINCT s, kind, tool, left(word, k::INT) AS prefix FROM (SELECT *, unnest(range(0, length(word) + 1)) AS k FROM words)),
  x AS (SELECT piece, piece AS x, false AS spaced FROM v UNION SELECT piece, ltrim(piece, ' '), true FROM v),
  ok AS (SELECT DISTINCT st.s, st.kind, st.tool, prefix, piece FROM states st JOIN words w ON w.s = st.s AND w.kind = st.kind AND w.tool IS NOT DISTINCT FROM st.tool AND starts_with(w.word, prefix)
    JOIN x ON x.x <> '' AND (starts_with(substr(w.word, length(prefix) + 1) || '"', x.x) OR starts_with(x.x, substr(w.word, length(prefix) + 1) || '"')) AND (prefix = '' OR NOT spaced OR starts_with(x.x, '"')))
  SELECT kind, tool, prefix, count(DISTINCT s) AS sets, count(*) AS allowed FROM ok GROUP BY kind, tool, prefix""")
def state_masks(spark, d):
    """The bitmap of each state: how many pieces it allows, over the sets of tools that have it."""
    masks = A.masks(_automaton(spark, d)[3])
    return masks.groupBy("kind", "tool", "prefix").agg(F.count_distinct("tools").alias("sets"), F.sum(F.bitmap_count("allowed")).cast("long").alias("allowed"))


# Schemas that act


def _book(
    user: Annotated[int, Field(minimum=5, maximum=900)],
    kind: Literal["click", "view"],
    amount: Annotated[float, Field(exclusive_minimum=0.5)] = 1.0,
    note: Annotated[str, Field(max_length=8, pattern="^[a-z]+[0-9]*$")] = "none",
    tags: list[int] | None = None,
) -> str:
    """Books an event."""
    return kind


BOOKED = """b AS (SELECT event_id, user_id, event_type, value, event_id % 7 AS m FROM events)"""


@query(f"""WITH {BOOKED} SELECT event_id, concat_ws('; ', CASE WHEN m = 0 THEN 'user: is missing' WHEN m = 1 THEN 'user: is not integer' WHEN user_id < 5 THEN 'user: minimum 5' WHEN user_id > 900 THEN 'user: maximum 900' END,
    CASE WHEN event_type NOT IN ('click', 'view') THEN 'kind: is not one of the choices' END, CASE WHEN m <> 2 AND round(value, 2) <= 0.5 THEN 'amount: exclusiveMinimum 0.5' END,
    CASE WHEN m <> 3 AND length(event_type || event_id) > 8 THEN 'note: maxLength 8' END, CASE WHEN m = 4 THEN 'note: pattern ^[a-z]+[0-9]*$' END, CASE WHEN m = 5 THEN 'tags[1]: is not integer' END, CASE WHEN m = 6 THEN 'extra: is not declared' END) AS problems FROM b""")
def checked_calls(spark, d):
    """Calls made of events, checked by predicates that a function's signature compiles to."""
    calls, schema = _booked(spark, d)
    return calls.select("event_id", F.array_join(V.violations(F.parse_json("arguments"), schema["parameters"]), "; ").alias("problems"))


@query(f"""WITH {BOOKED} SELECT event_id, CASE WHEN m IN (0, 1) THEN NULL ELSE user_id END AS user, event_type AS kind, CASE WHEN m = 2 THEN 1.0 ELSE round(value, 2) END AS amount, CASE WHEN m = 3 THEN 'none' WHEN m = 4 THEN upper(event_type) || event_id ELSE event_type || event_id END AS note, CASE WHEN m = 5 THEN 2 END AS n_tags FROM b""")
def typed_calls(spark, d):
    """The same calls cast to the struct that the schema compiles to, with its defaults."""
    calls, schema = _booked(spark, d)
    rows = calls.select("event_id", V.typed(F.parse_json("arguments"), schema["parameters"]).alias("a")).select("event_id", "a.*")
    return rows.select("event_id", "user", "kind", "amount", "note", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"))


def _booked(spark, d):
    schema, m = B.build_schema(_book), F.col("event_id") % 7
    user = F.when(m == 1, F.to_variant_object(F.array(F.col("user_id")))).when(m != 0, F.col("user_id").cast("variant"))
    note = F.when(m == 4, F.concat(F.upper("event_type"), "event_id")).when(m != 3, F.concat("event_type", "event_id"))
    tags = F.when(m == 5, F.lit('[1,"x"]'))
    parts = [("user", F.to_json(user)), ("kind", F.to_json(F.col("event_type").cast("variant"))), ("amount", F.when(m != 2, F.to_json(F.round("value", 2).cast("variant")))), ("note", F.to_json(note.cast("variant"))), ("tags", tags), ("extra", F.when(m == 6, F.lit("1")))]
    given = F.array_join(F.filter(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in parts]), lambda x: x.isNotNull()), ",")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("{"), given, F.lit("}")).alias("arguments")), schema


# Streams with state


def _streamed(df: DataFrame, made, mode: str = "update", parts: int = 4) -> str:
    """Runs ``made(stream)`` over ``df``, whose rows come in ``parts`` files dealt by a hash: half of them, then, in a new
    query on the same checkpoint, the rest. The folder of the run."""
    spark, part = df.sparkSession, "part"
    where = scratch(spark)
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    for k in range(2):
        half = dealt.filter(F.col(part) % 2 == 1 - k)
        half.repartition(parts // 2, part).drop(part).write.parquet(f"{where}/in/{k}")
        S.run(made(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts // 2).parquet(f"{where}/in/*")), where, mode)
    return where


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) % 3 AS calls, (length(text) % 97) / 97.0::DOUBLE AS sure FROM conversations),
  a AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS steps FROM t),
  r AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN '' WHEN sure < 0.1 THEN 'escalate' WHEN calls = 0 THEN 'done' WHEN steps >= 3 THEN 'max_steps' ELSE '' END AS reason FROM a)
  SELECT conv_id, coalesce(min(turn) FILTER (reason <> ''), max(turn)) + 1 AS turns, coalesce(arg_min(reason, turn) FILTER (reason <> ''), '') AS stop_reason FROM r GROUP BY conv_id""")
def stream_runs(spark, d):
    """Agent runs as their turns come in, out of order, over two queries."""
    n = F.length("text")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", (n % 3).cast("long").alias("n_calls"), ((n % 97) / F.lit(97.0)).alias("confidence"))
    return S.latest(spark, _streamed(turns, lambda s: S.agent_runs(s, 3, 0.1)), "conv_id")


@query("SELECT conv_id, turn, md5(text) AS md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE i <= 1 OR i > n - 2")
def stream_memory(spark, d):
    """The first turn and the last two, in a memory of three places, as turns come in out of order."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    held = S.latest(spark, _streamed(turns, lambda s: S.memories(s, 1, 3)), "conv_id")
    return held.select("conv_id", F.inline("held")).select("conv_id", F.col("at").alias("turn"), F.md5("payload").alias("md5"))


TOOL = '[{"name":"reply","parameters":{"properties":{"role":{"enum":["user","assistant"]},"text":{"type":"string"}},"required":["text"]}}]'


@query("""SELECT conv_id * 100 + turn AS turn_id, CASE WHEN turn % 3 = 0 THEN 'value' WHEN turn % 3 = 1 THEN 'key' ELSE 'disarmed' END AS state, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN 'te' ELSE '' END AS text, CASE WHEN turn % 3 < 2 THEN 'reply' END AS tool, turn % 3 < 2 AS forbids_close FROM conversations""")
def stream_calls(spark, d):
    """Where calls stand whose pieces, of three characters, come in out of order; nothing read is kept."""
    head = F.concat(F.lit('<think>x</think><tool_call>[{ "name" : "reply", "arguments" : {"role":"'), "role")
    text = F.when(F.col("turn") % 3 == 0, head).when(F.col("turn") % 3 == 1, F.concat(head, F.lit('", "te'))).otherwise(F.concat(head, F.lit('"}}]</tool_call>')))
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,3}"), F.lit(0))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("conv_id"), F.posexplode(pieces).alias("at", "piece"))
    rows = rows.select("conv_id", F.col("at").cast("long").alias("at"), "piece")
    return S.latest(spark, _streamed(rows, lambda s: S.call_states(s, TOOL)), "conv_id").withColumnRenamed("conv_id", "turn_id")


ONE_LINE = CLEANED.replace("FROM documents", r"FROM (SELECT doc_id, source, lang, regexp_replace(text, '[\n\r]+', ' ', 'g') AS text FROM documents)")


@query(f"SELECT DISTINCT md5(c) AS md5 FROM ({ONE_LINE}) WHERE coalesce({KEEP}, false)")
def stream_texts(spark, d):
    """Documents as lines of text files, cleaned and filtered as they come, each text once over two queries."""
    lines = table(spark, d, "documents").select(F.regexp_replace("text", r"[\n\r]+", " ").alias("value")).filter("value IS NOT NULL")
    where = scratch(spark)
    for k in range(2):
        lines.filter(F.pmod(F.xxhash64("value"), F.lit(3)) != k).write.text(f"{where}/in/{k}")  # a third comes twice
        S.run(S.first_seen(S.text_stream(spark, f"{where}/in/*", maxFilesPerTrigger="1000"), "text"), where)
    return spark.read.parquet(f"{where}/out").select(F.md5("text").alias("md5"))
