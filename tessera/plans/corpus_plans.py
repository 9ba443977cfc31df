"""Queries of corpus curation and packing, over the documents, pages and events tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus as C
from tessera.operators import packing as P
from tessera.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# DuckDB pieces. The text of a line ends in ASCII white space at most, in these tables.
CLEAN = r"regexp_replace(trim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+(\n|$)', '\1', 'g'), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')"
LINES = "list_filter(string_split(c, chr(10)), lambda x: trim(x, ' \t') <> '')"
KEEP = "length(c) >= 200 AND len(l) > 0 AND NOT (len(l) > 8 AND 1 - len(list_distinct(l)) / len(l) > 0.30) AND list_sum(list_transform(l, lambda x: length(x))) / len(l) >= 12"
CLEANED = f"SELECT *, {LINES} AS l FROM (SELECT doc_id, source, lang, text, {CLEAN} AS c FROM documents)"
TOKENS = r"len(regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+'))"


def n_tokens(c="text"):
    return F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


@query(f"""WITH k AS (SELECT source, sha256(c) AS key, coalesce({KEEP}, false) AS keep FROM ({CLEANED})),
  g AS (SELECT source, CASE WHEN keep THEN key END AS key, count(*) AS n, count(*) FILTER (keep) AS good FROM k GROUP BY ALL)
  SELECT source, sum(n)::BIGINT AS n_read, count(*) FILTER (good > 0) AS n_kept, sum(CASE WHEN good > 0 THEN good - 1 ELSE 0 END)::BIGINT AS n_duplicate FROM g GROUP BY source""")
def corpus_keep_report(spark, d):
    return C.keep_report(table(spark, d, "documents"))


@query(f"SELECT doc_id, md5(c) AS md5, length(c) AS n FROM ({CLEANED})")
def clean_text(spark, d):
    c = T.clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(c).alias("md5"), F.length(c).cast("long").alias("n"))


@query("SELECT doc_id, round((length(text) - length(replace(text, '�', ''))) / length(text), 6) AS ratio FROM documents")
def replacement_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.replacement_ratio(F.col("text")), 6).alias("ratio"))


@query(r"SELECT page_id, (len(regexp_extract_all(html, '[\pC\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]')) - len(regexp_extract_all(html, '[\n\t]')))::BIGINT AS n FROM pages")
def nonprint_count(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.round(T.nonprint_ratio(html) * F.length(html)).cast("long").alias("n"))


@query(f"SELECT doc_id, len(l) AS n_lines, round(1 - len(list_distinct(l)) / len(l), 6) AS ratio FROM ({CLEANED})")
def duplicate_line_ratio(spark, d):
    lines = T.content_lines(T.clean(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.round(T.duplicate_ratio(lines), 6).alias("ratio"))


@query(f"SELECT doc_id, round(list_sum(list_transform(l, lambda x: length(x))) / len(l), 6) AS mean_line FROM ({CLEANED})")
def mean_line_length(spark, d):
    lines = T.content_lines(T.clean(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.round(T.mean_length(lines), 6).alias("mean_line"))


BARE = r"""regexp_replace(html, '"([^"\\]|\\[\s\S])*"', '', 'g')"""
STEP = "CASE WHEN a = '!' OR (x IN ('(', '[', '{') AND length(a) >= 65) THEN '!' WHEN x IN ('(', '[', '{') THEN a || x WHEN right(a, 1) || x IN ('()', '[]', '{}') THEN left(a, -1) ELSE '!' END"


# the stack is a text that starts with a blank, so that it is never empty
@query(rf"WITH b AS (SELECT page_id, {BARE} AS t FROM pages) SELECT page_id, NOT contains(t, '\"') AND list_reduce(list_prepend(' ', regexp_extract_all(t, '[()\[\]{{}}]')), lambda a, x: {STEP}) = ' ' AS balanced FROM b".replace('\\"', '"'))
def balanced_brackets(spark, d):
    return table(spark, d, "pages").select("page_id", T.balanced(F.col("html")).alias("balanced"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'doc ' || event_id WHEN event_id % 4 = 1 THEN event_type END AS text FROM events")
def text_field_extract(spark, d):
    e = table(spark, d, "events")
    record = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"text": "", "body": "doc '), F.col("event_id"), F.lit('"}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(F.col("event_id") % 4 == 2, F.lit('{"text": 5}')).otherwise(F.lit("{broken"))
    )
    return e.select("event_id", T.text_field(record).alias("text"))


@query(f"SELECT source, min(doc_id) AS doc_id, count(*) AS copies FROM ({CLEANED}) GROUP BY source, sha256(c)")
def exact_dedup_in_source(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2(T.clean(F.col("text")), 256).alias("key"))
    return C.first_ids(docs, ["source", "key"], "doc_id").drop("key")


@query("WITH s AS (SELECT source, count(*)::DOUBLE AS share FROM documents GROUP BY source), e AS (SELECT source, 1000011 * share / sum(share) OVER () AS e FROM s), r AS (SELECT *, 1000011 - sum(floor(e)) OVER () AS short, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, source) AS n FROM e) SELECT source, (floor(e) + (n <= short)::INT)::BIGINT AS tokens FROM r")
def mix_plan(spark, d):
    """A budget of tokens dealt to the documents' sources by their numbers of rows."""
    shares = table(spark, d, "documents").groupBy("source").agg(F.count("*").cast("double").alias("share"))
    return C.apportion(shares, 1_000_011, order="source").select("source", "tokens")


BUDGETS = [("en", 60000), ("de", 9000), ("fr", 9000), ("es", 7000)]
DRAW = f"""WITH t AS (SELECT doc_id, lang, {TOKENS} AS n, md5('0:' || doc_id) AS o FROM documents),
  b(lang, budget) AS (VALUES ('en', 60000), ('de', 9000), ('fr', 9000), ('es', 7000)),
  r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)"""


def _draw(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", n_tokens().alias("n"))
    return C.mix_draw(docs, spark.createDataFrame(BUDGETS, "lang string, tokens long"), "lang", "n", "doc_id")


@query(f"{DRAW} SELECT doc_id, lang, n, before::BIGINT AS before FROM r JOIN b USING (lang) WHERE before < budget")
def mix_draw(spark, d):
    return _draw(spark, d).select("doc_id", "lang", "n", "before")


@query(f"{DRAW}, k AS (SELECT lang, count(*) FILTER (before < budget) AS kept, count(*) AS n_read, coalesce(sum(n) FILTER (before < budget), 0) AS tok FROM r JOIN b USING (lang) GROUP BY lang) SELECT lang, kept, n_read, tok::BIGINT AS tokens, round(tok / sum(tok) OVER (), 6) AS share, greatest(budget - tok, 0)::BIGINT AS shortfall FROM k JOIN b USING (lang)")
def mix_report(spark, d):
    budgets = spark.createDataFrame(BUDGETS, "lang string, tokens long")
    return C.mix_report(table(spark, d, "documents"), _draw(spark, d), budgets, "lang", "n").withColumn("share", F.round("share", 6))


@query("WITH a AS (SELECT 'docs' AS source, doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 0.5) / count(*) OVER () AS place FROM documents), b AS (SELECT 'pages' AS source, page_id AS id, (row_number() OVER (ORDER BY page_id) - 0.5) / count(*) OVER () AS place FROM pages) SELECT source, id, round(place, 9)::DOUBLE AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def interleaved_sources(spark, d):
    docs, pages = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "pages").select(F.col("page_id").alias("id"))
    return C.interleave({"docs": docs, "pages": pages}, "id").select("source", "id", F.round("place", 9).alias("place"))


CORPUS = [("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1)]


@query(f"""WITH k AS (SELECT doc_id, lang, c AS text FROM ({CLEANED}) WHERE coalesce({KEEP}, false)), u AS (SELECT *, {TOKENS} + 1 AS n, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS nth FROM k),
  o AS (SELECT lang, doc_id, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u WHERE nth = 1),
  b(lang, budget) AS (VALUES {', '.join(f"('{x}', {int(y * 200_000)})" for x, y in CORPUS)}), w AS (SELECT *, before / budget AS place FROM o JOIN b USING (lang) WHERE before < budget),
  a AS (SELECT lang, doc_id, n, coalesce(sum(n) OVER (ORDER BY place, lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM w),
  x AS (SELECT *, unnest(range(s // 512, (s + n - 1) // 512 + 1)) AS row_id FROM a), p AS (SELECT row_id, lang AS source, doc_id, greatest(0, s - row_id * 512)::BIGINT AS lo, least(512, s + n - row_id * 512)::BIGINT AS hi FROM x WHERE row_id < 200000 // 512)
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lo)::INT AS seg FROM p""")
def corpus_build(spark, d):
    """The whole build over documents: clean, filter, first of equals, draw to token shares, interleave, pack."""
    from tessera.operators.names import build_corpus

    docs = table(spark, d, "documents").select(F.col("lang").alias("source"), "doc_id", "text")
    return build_corpus(docs, CORPUS, 200_000, 512, n_tokens())


@query("SELECT 'block.' || vec_id || '.attn.' || CASE vec_id % 3 WHEN 0 THEN 'out' ELSE 'q' END || '.kernel' AS name FROM embeddings WHERE vec_id % 3 <> 2 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0")
def adapter_targets(spark, d):
    """the kernels that adapters go to: named modules inside attention, that ship and aren't all zero."""
    from tessera.operators.names import adapter_targets as targets

    i = F.col("vec_id")
    name = F.concat(F.when(i % 7 == 0, "head").otherwise("block"), F.lit("."), i, F.lit(".attn."), F.when(i % 3 == 0, "out").when(i % 3 == 1, "q").otherwise("gate"), F.lit(".kernel"))
    values = F.when(i % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return targets(table(spark, d, "embeddings").select(name.alias("name"), values.alias("values")), ["out", "q"], "attn", ["head"])


S = 512
SPANS = f"""WITH t AS (SELECT doc_id, {TOKENS} + 1 AS n FROM documents), a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM t),
  x AS (SELECT doc_id, s, s + n AS e, unnest(range(s // {S}, (s + n - 1) // {S} + 1)) AS row_id FROM a),
  sp AS (SELECT row_id, doc_id, greatest(0, s - row_id * {S})::BIGINT AS lo, least({S}, e - row_id * {S})::BIGINT AS hi FROM x),
  spans AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lo)::INT AS seg FROM sp)"""


def _spans(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (n_tokens() + 1).alias("n"))
    return P.spans(docs, "n", "doc_id", S)


@query(f"{SPANS} SELECT row_id, seg, doc_id, lo, hi FROM spans")
def pack_spans(spark, d):
    return _spans(spark, d)


@query(f"{SPANS} SELECT row_id, max(seg)::INT AS segments, sum(hi - lo)::BIGINT AS tokens, ({S} - sum(hi - lo))::BIGINT AS padding, sum(seg * (hi - lo))::BIGINT AS seg_sum FROM spans GROUP BY row_id")
def pack_segments(spark, d):
    # each document as 4s and one end, which its segments are read back from
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi", "last"))), lambda x: F.concat(F.array_repeat(F.lit(4), (x["hi"] - x["lo"] - 1).cast("int")), F.array(F.when(x["last"], P.EOS).otherwise(4)))))
    ends = _spans(spark, d).withColumn("last", F.col("row_id") == F.max("row_id").over(Window.partitionBy("doc_id")))
    seg = ends.groupBy("row_id").agg(ids.alias("ids")).select("row_id", P.segments_from_eos(F.col("ids")).alias("seg"))
    tokens = F.size("seg").cast("long")
    return seg.select("row_id", F.array_max("seg").alias("segments"), tokens.alias("tokens"), (F.lit(S) - tokens).alias("padding"), F.aggregate("seg", F.lit(0).cast("long"), lambda a, x: a + x).alias("seg_sum"))


@query(f"{SPANS} SELECT row_id, sum(hi - lo - 1)::BIGINT AS mask1, sum(greatest(hi - lo - 2, 0))::BIGINT AS mask2 FROM spans GROUP BY row_id")
def loss_mask_counts(spark, d):
    pos = _spans(spark, d).select("row_id", "seg", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("pos"))
    return P.loss_mask(pos).groupBy("row_id").agg(F.count_if("mask1").alias("mask1"), F.count_if("mask2").alias("mask2"))


@query("WITH e AS (SELECT unnest(range(2))::INT AS epoch), o AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('3:' || epoch || ':' || doc_id), doc_id) - 1 AS p, count(*) OVER (PARTITION BY epoch) AS n FROM documents, e) SELECT epoch, (p // 32)::BIGINT AS batch, doc_id FROM o WHERE (p // 32 + 1) * 32 <= n")
def row_batches(spark, d):
    return P.batches(table(spark, d, "documents"), "doc_id", 32, 3, 2)


def _fnv_sql(n, t, slots):
    acc = str((P.SEED * (t + 1)) & P.MASK) + "::HUGEINT"
    for j in range(n):
        tok = f"coalesce(lag(event_id, {j}) OVER w, 0)" if j else "event_id"
        acc = f"((xor(({acc})::BIGINT, ({tok})::BIGINT)::HUGEINT * {P.PRIME}) & {P.MASK})"
    return f"(xor(({acc})::BIGINT, ({acc})::BIGINT >> 15) % {slots})::BIGINT"


@query(f"SELECT event_id, {_fnv_sql(2, 0, 8192)} AS h2, {_fnv_sql(3, 1, 8192)} AS h3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def ngram_hash(spark, d):
    e = table(spark, d, "events")
    h = lambda n, t: P.ngram_hash("event_id", n, t, 8192, ["user_id"], "event_id")
    return e.select("event_id", h(2, 0).alias("h2"), h(3, 1).alias("h3"))


@query("SELECT event_id, coalesce(lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id), 0)::BIGINT AS two_back FROM events")
def shift_right(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", P.shift_right(e, "event_id", 2, ["user_id"], "event_id").alias("two_back"))


@query("SELECT event_id, round(0.5 * value + 0.25 * coalesce(lag(value, 3) OVER w, 0) + 0.125 * coalesce(lag(value, 6) OVER w, 0), 6) AS tapped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def dilated_taps(spark, d):
    return table(spark, d, "events").select("event_id", F.round(P.taps("value", [0.5, 0.25, 0.125], 3, ["user_id"], "event_id"), 6).alias("tapped"))


@query(f"{SPANS.replace(str(S), '32')}, p AS (SELECT row_id, seg, unnest(range(lo, hi)) AS pos FROM spans) SELECT row_id, sum(k)::BIGINT AS edges FROM (SELECT row_id, pos - min(pos) OVER (PARTITION BY row_id, seg) + 1 AS k FROM p) GROUP BY row_id")
def packing_mask_edges(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (n_tokens() + 1).alias("n"))
    return P.packing_keys(P.spans(docs, "n", "doc_id", 32)).groupBy("row_id").agg(F.sum(P.n_keys(F.col("keys"))).alias("edges"))


@query(f"""{SPANS.replace(str(S), '64')}, p AS (SELECT row_id, lo, unnest(range(lo, hi)) AS q FROM spans), k AS (SELECT row_id, q, unnest(range(lo, q + 1)) AS k FROM p)
  SELECT row_id, count(*) AS edges, count(*) FILTER (k = 30) AS on_sink FROM k WHERE q - k < 8 OR k IN (0, 1, 30) GROUP BY row_id""")
def window_in_segments(spark, d):
    """The window mask with pinned keys within each place's segment, as intervals."""
    docs = table(spark, d, "documents").select("doc_id", (n_tokens() + 1).alias("n"))
    keys = P.packing_keys(P.spans(docs, "n", "doc_id", 64))
    keys = keys.select("row_id", P.both_keys(F.col("keys"), P.window_keys(F.col("query"), 8, [0, 1, 30])).alias("keys"))
    return keys.groupBy("row_id").agg(F.sum(P.n_keys(F.col("keys"))).alias("edges"), F.count_if(P.holds(F.col("keys"), F.lit(30))).alias("on_sink"))


@query("SELECT event_id, CASE WHEN event_id < 16 THEN event_id ELSE 16 + (event_id - 16) % 48 END AS slot FROM events")
def ring_slots(spark, d):
    return table(spark, d, "events").select("event_id", P.ring_slot(F.col("event_id"), 16, 64).alias("slot"))


@query(f"SELECT lang, least(4096, greatest(128, pow(2, ceil(log2(max({TOKENS}) + 2)))::INT))::INT AS max_len FROM documents GROUP BY lang")
def seq_bucket(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(P.bucket_length(F.max(n_tokens()) + 2, 4096).alias("max_len"))


@query("SELECT user_id, 400::INT AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def pad_rows(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    ids = P.pad_to(F.col("l"), 400, 0)
    return g.select("user_id", F.size(ids).alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("WITH p AS (SELECT user_id, event_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM events) SELECT user_id, count(*) AS n FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) WHERE before < 0.5 GROUP BY user_id")
def topp_cut(spark, d):
    e = table(spark, d, "events")
    e = e.withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy("user_id")))
    return P.nucleus(e, ["user_id"], "p", "event_id", 0.5).groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)::INT) AS a FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, a[1:greatest(len(a) - 8, 0)] AS p, a[greatest(len(a) - 7, 1):] AS t FROM w) SELECT doc_id, len(list_filter(p[len(p) - least(len(p), 54) + 1:] || t, lambda x: x <> 0))::INT + 2 AS used, (2 + coalesce(list_sum(p[len(p) - least(len(p), 54) + 1:]), 0) + list_sum(t) + 1)::BIGINT AS total, (len(t) + 1)::DOUBLE AS weight FROM s")
def sft_encode(spark, d):
    a = F.transform(F.split("text", " "), lambda x: F.length(x))
    s = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", a.alias("a"))
    n = F.greatest(F.size("a") - 8, F.lit(0))
    x = P.encode_example(F.slice("a", F.lit(1), n), F.slice("a", n + 1, F.lit(8)), 64)
    s = s.select("doc_id", x.alias("x"))
    add = lambda c, zero: F.aggregate(c, zero, lambda a, v: a + v)
    used = F.size(F.filter("x.ids", lambda v: v != P.PAD))
    return s.select("doc_id", used.alias("used"), add(F.col("x.ids"), F.lit(0).cast("long")).alias("total"), add(F.col("x.weights"), F.lit(0.0)).alias("weight"))
