"""The token automaton of constrained calls (G02-G06, G08): what declared tools allow, as tables that turns are looked up in.

``constraints`` turns declared tools into words: the names, the argument keys of each tool, the members of enums. Their
prefixes are states, and ``transitions`` is the product of states and vocabulary, (state, piece) -> next state, built by
equality joins of substrings with pieces. ``masks`` folds it into a bitmap of allowed ids per state.

A turn isn't walked piece by piece: ``reading`` folds its JSON tokens in the JVM and says where names, keys and values
stand, so that the state before every piece is the text of its span so far, and ``positions`` joins all pieces of all
turns with the table at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CALL_END, CALL_START, let
from tessera.operators.calls import declared, field, is_object, items, kind, lookup

BLANK = r"[ \t\n\x0B\f\r]"
#: A string, closed or up to the end of the text; a sign; blanks; anything else up to one of these.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}\[\],:]|[ \t\n\x0B\f\r]+|[^{}\[\],:" \t\n\x0B\f\r]+'
CLOSED = r'(?s)\A"[^"\\]*+(?:\\.[^"\\]*+)*+"\z'
#: What may follow a value without quotes.
VALUE_ENDS = ",}]"
SPANS = "array<struct<start:int,stop:int,kind:string,tool:string,key:string>>"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def _rule(tools: Column, tool: Column, key: Column) -> Column:
    """The schema of an argument if it restricts values, as a variant; null otherwise."""
    spec = F.try_element_at(lookup(tools, tool)["properties"], F.coalesce(key, F.lit("")))
    held = lambda s: field(s, "enum", "variant").isNotNull() | field(s, "minimum", "variant").isNotNull() | field(s, "maximum", "variant").isNotNull()
    return let(spec, lambda s: F.when(is_object(s) & held(s), s))


def _allowed(rule: Column, quoted: Column, token: Column) -> Column:
    """Whether a value that has ended keeps a rule."""
    member = lambda e: (quoted == (kind(e) == "STRING")) & F.when(kind(e) == "STRING", F.try_variant_get(e, "$", "string") == token).otherwise(F.to_json(e) == token)
    x = token.try_cast("double")
    number = x.isNotNull() & ~F.isnan(x) & (F.coalesce(field(rule, "minimum", "double"), x) <= x) & (x <= F.coalesce(field(rule, "maximum", "double"), x))
    enum = items(field(rule, "enum", "variant"))
    return F.coalesce(F.when(enum.isNotNull(), F.exists(enum, member)).otherwise(quoted | number), F.lit(False))


STATE = ("pos", "stack", "tool", "key", "args", "keys", "broken", "state", "span", "spans")


def _step(tools: Column, spans: bool):
    """One JSON token. The stack has a letter per open bracket: k and v for an object before and after a key's end, or [.

    Each kind of token has a branch of its own, so that a token pays for what it changes; ``spans`` lists where they stand."""

    def new(s, t, **changed):
        changed["pos"] = s["pos"] + F.length(t["text"])
        return F.struct(*[changed.get(n, s[n]).alias(n) for n in STATE])

    def step(s, t):
        return let(F.substring(t["text"], 1, 1), lambda c: F.when(c.isin(*" \t\n\x0b\f\r"), new(s, t)).when(c.isin(*"{}[],:"), sign(s, t, c)).otherwise(spelled(s, t, c)))

    def head(s):
        return F.left(s["stack"], F.greatest(F.length(s["stack"]) - 1, F.lit(0)))

    def in_args(s):
        return (s["args"] > 0) & (F.length(s["stack"]) == s["args"])

    def sign(s, t, c):
        free = {"state": F.lit("free"), "span": F.lit("")}
        ruled = F.when(in_args(s), _rule(tools, s["tool"], s["key"]).isNotNull()).otherwise(False)
        begins = (c == "{") & s["key"].eqNullSafe(F.lit("arguments")) & (s["args"] == 0)
        opened = {"key": F.lit(None).cast("string"), "args": F.when(begins, F.length(s["stack"]) + 1).otherwise(s["args"]), "keys": F.when(begins, F.array().cast("array<string>")).otherwise(s["keys"])}
        return (
            F.when(c == ":", new(s, t, **free | {"state": F.when(ruled, "await").otherwise("free")}))
            .when(c == ",", new(s, t, stack=F.when(s["stack"].endswith("v"), F.concat(head(s), F.lit("k"))).otherwise(s["stack"]), **free))
            .when(c.isin("{", "["), new(s, t, stack=F.concat(s["stack"], F.when(c == "{", "k").otherwise(c)), **opened, **free))
            .otherwise(new(s, t, stack=head(s), args=F.when(in_args(s), 0).otherwise(s["args"]), **free))
        )

    def spelled(s, t, c):
        quoted = c == '"'
        closed = ~t["last"] | F.when(quoted, t["text"].rlike(CLOSED)).otherwise(False)  # what has no end is the last token
        inner = lambda closed: F.when(quoted, F.substr(t["text"], F.lit(2), F.length(t["text"]) - F.when(closed, 2).otherwise(1))).otherwise(t["text"])
        known = lambda closed: F.struct(closed.alias("closed"), inner(closed).alias("inner"), in_args(s).alias("in_args"))
        is_key, is_name = quoted & s["stack"].endswith("k"), quoted & s["key"].eqNullSafe(F.lit("name")) & (s["args"] == 0)
        return let(let(closed, known), lambda b: F.when(is_key, key(s, t, b)).when(is_name, name(s, t, b)).otherwise(value(s, t, b, quoted)))

    def shown(b):
        return F.btrim(b["inner"], F.lit(" \t\n\x0b\f\r"))

    def at(s, t, b, held, quoted=None):
        """The spans with that of the token."""
        if not spans:
            return s["spans"]
        quote = lambda x: F.when(x, 1).otherwise(0)
        start, stop = (F.lit(1), quote(b["closed"])) if quoted is None else (quote(quoted), quote(quoted & b["closed"]))
        none = F.lit(None).cast("string")
        spot = F.struct((s["pos"] + start).alias("start"), (s["pos"] + F.length(t["text"]) - stop).alias("stop"), held.alias("kind"), F.when(held != "name", s["tool"]).otherwise(none).alias("tool"), F.when(held.isin("value", "bare"), s["key"]).otherwise(none).alias("key"))
        return F.concat(s["spans"], F.array(spot))

    def key(s, t, b):
        places = F.when(b["in_args"], at(s, t, b, F.lit("key"))).otherwise(s["spans"])

        def ended(word):
            props = F.coalesce(lookup(tools, s["tool"])["properties"], F.create_map().cast("map<string, variant>"))
            ruled = F.when(b["in_args"], _rule(tools, s["tool"], word).isNotNull()).otherwise(False)
            return new(s, t, stack=F.concat(head(s), F.lit("v")), key=word, keys=F.when(b["in_args"], F.array_append(s["keys"], word)).otherwise(s["keys"]), broken=s["broken"] | (b["in_args"] & ~F.map_contains_key(props, word)), state=F.when(ruled, "await").otherwise("free"), span=F.lit(""), spans=places)

        word = F.when(b["in_args"], _bare(b["inner"])).otherwise(shown(b))
        return F.when(b["closed"], let(word, ended)).otherwise(new(s, t, state=F.when(b["in_args"], "key").otherwise("free"), span=_bare(b["inner"]), spans=places))

    def name(s, t, b):
        places = at(s, t, b, F.lit("name"))
        ended = lambda word: new(s, t, tool=word, broken=s["broken"] | lookup(tools, word).isNull(), state=F.lit("free"), span=F.lit(""), spans=places)
        return let(_bare(b["inner"]), lambda word: F.when(b["closed"], ended(word)).otherwise(new(s, t, state=F.lit("name"), span=word, spans=places)))

    def value(s, t, b, quoted):
        places = at(s, t, b, F.when(quoted, "value").otherwise("bare"), quoted)

        def by(rule):
            ended = new(s, t, broken=s["broken"] | ~_allowed(rule, quoted, shown(b)), state=F.lit("free"), span=F.lit(""), spans=places)
            going = new(s, t, state=F.lit("value"), span=_bare(b["inner"]), spans=places)
            return F.when(rule.isNull(), new(s, t, state=F.lit("free"), span=F.lit(""))).when(b["closed"], ended).otherwise(going)

        return let(F.when(b["in_args"], _rule(tools, s["tool"], s["key"])), by)

    return step


START = "struct<pos:int,stack:string,tool:string,key:string,args:int,keys:array<string>,broken:boolean,state:string,span:string,spans:" + SPANS + ">"


def body(text: Column) -> Column:
    """What stands behind the last call marker if no end marker follows it; null otherwise."""
    rest = F.substring_index(text, CALL_START, -1)
    return F.when(text.contains(CALL_START) & ~rest.contains(CALL_END), rest)


def reading(body: Column, tools: Column, spans: bool = True) -> Column:
    """The fold of a call list's JSON tokens over ``declared`` tools: where it stops, and, with ``spans``, where its spans stand."""
    cut = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    mark = lambda all_: F.transform(all_, lambda t, i: F.struct(t.alias("text"), (i == F.size(all_) - 1).alias("last")))
    marked = let(cut, mark)  # a text is cut once, not once per token
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("stack"), none.alias("tool"), none.alias("key"), F.lit(0).alias("args"), F.array().cast("array<string>").alias("keys"), F.lit(False).alias("broken"), F.lit("free").alias("state"), F.lit("").alias("span"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(marked, start.cast(START), _step(tools, spans))


def call_state(df: DataFrame, key: str, text: str, tools: str) -> DataFrame:
    """The state in which each unfinished turn stops, what is pending, and whether a rule was broken."""
    rows = df.select(F.col(key).alias("id"), body(F.coalesce(F.col(text), F.lit(""))).alias("body"), declared(F.try_parse_json(F.coalesce(tools, F.lit("[]")))).alias("tools"))
    none = F.array().cast("array<string>")

    def result(r):
        on, args = r.isNotNull(), F.coalesce(r["args"], F.lit(0)) > 0
        required = F.coalesce(lookup(F.col("tools"), r["tool"])["required"], none)
        pending = F.when(args, F.array_sort(F.array_distinct(F.array_except(required, r["keys"])))).otherwise(none)
        return F.struct(
            F.when(on, r["state"]).otherwise("disarmed").alias("state"), F.when(on, r["span"]).otherwise("").alias("text"), r["tool"].alias("tool"), F.coalesce(r["keys"], none).alias("keys"),
            pending.alias("pending"), F.coalesce(r["broken"], F.lit(False)).alias("broken"), F.coalesce((F.size(pending) > 0) & (F.length(r["stack"]) == r["args"]), F.lit(False)).alias("forbids_close"),
        )

    read = F.when(F.col("body").isNotNull(), reading(F.col("body"), F.col("tools"), spans=False))
    return rows.select(F.col("id").alias(key), let(read, result).alias("r")).select(key, "r.*")


# The tables


SPAN = ["tools", "kind", "tool", "key"]


def constraints(tools: DataFrame, column: str) -> DataFrame:
    """(tools, kind, tool, key, word): the words that declared tools (JSON text) allow, once per distinct text.

    Kinds: ``name``, ``key`` of a tool, ``value`` and ``bare`` for the members of an enum, in quotes or not."""
    each = tools.select(F.col(column).alias("text")).distinct().select(F.xxhash64("text").alias("tools"), F.explode(declared(F.try_parse_json("text"))).alias("t"))
    none = F.lit(None).cast("string")
    names = each.filter("t.tool <> ''").select("tools", F.lit("name").alias("kind"), none.alias("tool"), none.alias("key"), F.col("t.tool").alias("word"))
    args = each.select("tools", F.col("t.tool").alias("tool"), F.explode("t.properties").alias("key", "spec"))
    keys = args.select("tools", F.lit("key").alias("kind"), "tool", none.alias("key"), F.col("key").alias("word"))
    members = args.select("tools", "tool", "key", F.explode(items(field(F.col("spec"), "enum", "variant"))).alias("e"))
    text = F.when(kind(F.col("e")) == "STRING", F.try_variant_get("e", "$", "string")).otherwise(F.to_json("e"))
    values = members.select("tools", F.when(kind(F.col("e")) == "STRING", "value").otherwise("bare").alias("kind"), "tool", "key", text.alias("word"))
    return names.unionByName(keys).unionByName(values).distinct()


def transitions(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tools, kind, tool, key, prefix, id, next): pieces that can follow each prefix; ``next`` is null where the span ends.

    Blanks in front of a piece count for nothing at the start of a span and before what ends it."""
    v = vocabulary.filter(F.coalesce("piece", F.lit("")) != "").select("id", "piece", F.regexp_replace("piece", f"^{BLANK}+", "").alias("shown"))
    w = words.select(*SPAN, "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("n"))
    w = w.select(*SPAN, F.substring(F.col("word"), F.lit(1), F.col("n")).alias("prefix"), F.substr("word", F.col("n") + 1).alias("rest"))
    # a piece that goes on inside the word is one of the rest's own heads; what is longer than any piece is not looked for
    longest = v.agg(F.coalesce(F.max(F.length("piece")), F.lit(0)).alias("longest"))
    heads = w.filter("rest <> ''").distinct().join(F.broadcast(longest)).select("*", F.explode(F.sequence(F.lit(1), F.least(F.length("rest"), F.greatest("longest", F.lit(1))))).alias("m"))
    heads = heads.select(*SPAN, "prefix", F.substring(F.col("rest"), F.lit(1), F.col("m")).alias("head")).distinct()
    inner = v.select("id", F.explode(F.array(F.struct(F.col("piece").alias("head"), F.lit(False).alias("spaced")), F.struct(F.col("shown").alias("head"), F.lit(True).alias("spaced")))).alias("p")).select("id", "p.*").filter("head <> ''")
    going = heads.join(inner, "head").filter((F.col("prefix") == "") | ~F.col("spaced")).select(*SPAN, "prefix", "id", F.concat("prefix", "head").alias("next")).distinct()
    # a piece that ends the span has the rest in front of its end: a quote, or what may follow a value
    quoted = v.filter(F.col("piece").contains('"')).select("id", F.lit(True).alias("quoted"), F.substring_index("piece", '"', 1).alias("rest"), F.substring_index("shown", '"', 1).alias("shown"))
    ends = rf"[{VALUE_ENDS.replace(']', '')}\] \t\n\x0B\f\r]"
    open_ = v.select("id", F.lit(False).alias("quoted"), F.regexp_extract("piece", rf"(?s)^(.*?){ends}", 1).alias("rest"), F.regexp_extract("shown", rf"(?s)^(.*?){ends}", 1).alias("shown"), F.col("piece").rlike(ends).alias("ends"), F.col("shown").rlike(ends).alias("shown_ends"))
    last = quoted.select("id", "quoted", "rest", F.lit(False).alias("spaced")).unionByName(quoted.select("id", "quoted", F.col("shown").alias("rest"), F.lit(True).alias("spaced")))
    last = last.unionByName(open_.filter("ends").select("id", "quoted", "rest", F.lit(False).alias("spaced"))).unionByName(open_.filter("shown_ends").select("id", "quoted", F.col("shown").alias("rest"), F.lit(True).alias("spaced"))).distinct()
    done = w.withColumn("quoted", F.col("kind") != "bare").distinct().join(last, ["quoted", "rest"])
    done = done.filter((F.col("prefix") == "") | ~F.col("spaced") | ((F.col("rest") == "") & F.col("quoted"))).filter((F.col("kind") != "bare") | (F.col("prefix") != "") | (F.col("rest") != ""))
    return going.unionByName(done.select(*SPAN, "prefix", "id", F.lit(None).cast("string").alias("next")).distinct())


PAGE = 1 << 15


def masks(table: DataFrame) -> DataFrame:
    """(tools, kind, tool, key, prefix, page, allowed): bitmaps of 32768 ids each, by Spark's own bitmap aggregate.

    A state without rows allows nothing, which by the rule means that everything stays."""
    return table.select(*SPAN, "prefix", "id").distinct().groupBy(*SPAN, "prefix", F.floor(F.col("id") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.pmod("id", F.lit(PAGE))).alias("allowed"))


def allows(mask: Column, id_: Column) -> Column:
    """Whether a bitmap of ``masks`` has an id's bit."""
    at = F.pmod(id_, F.lit(PAGE)).cast("int")
    byte = F.conv(F.hex(F.substring(mask, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


def positions(turns: DataFrame, key: str, pieces: str, tools: str, words: DataFrame, table: DataFrame) -> DataFrame:
    """(key, at, id, kind, prefix, fits): every piece of every turn that stands in a span whose text so far is a state.

    ``pieces`` is a list of (id, piece) whose texts make up the turn. ``fits`` says whether the table has the step."""
    text = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    rows = turns.select(F.col(key).alias("turn"), F.col(pieces).alias("pieces"), text.alias("text"), F.xxhash64(tools).alias("tools"), declared(F.try_parse_json(tools)).alias("declared"))
    rows = rows.withColumn("body", body(F.col("text"))).filter("body IS NOT NULL")
    rows = rows.select("turn", "tools", "body", "pieces", (F.length("text") - F.length("body")).alias("before"), reading(F.col("body"), F.col("declared"))["spans"].alias("spans"))
    add = lambda a, p: F.struct((a["to"] + F.length(p["piece"])).alias("to"), F.array_append(a["out"], a["to"]).alias("out"))
    starts = F.aggregate("pieces", F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("out")), add)["out"]
    each = rows.select("turn", "tools", "body", "before", "spans", F.posexplode(F.arrays_zip("pieces", starts.alias("start"))).alias("at", "p"))
    each = each.select("turn", "tools", "body", "spans", "at", F.col("p.pieces.id").alias("id"), (F.col("p.start") - F.col("before")).alias("start"))
    span = F.get(F.filter("spans", lambda s: (s["start"] <= F.col("start")) & (F.col("start") <= s["stop"]) & ((s["kind"] != "bare") | (s["start"] < F.col("start")))), F.lit(0))
    each = each.withColumn("s", span).filter("s IS NOT NULL")
    each = each.select("turn", "at", "id", "tools", "s.kind", "s.tool", "s.key", _bare(F.substring("body", F.col("s.start") + 1, F.col("start") - F.col("s.start"))).alias("prefix"))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    states = words.select(*SPAN, F.explode(F.sequence(F.lit(0), F.length("word"))).alias("n"), "word").select(*SPAN, F.substring(F.col("word"), F.lit(1), F.col("n")).alias("prefix")).distinct()
    known = each.join(states, same(each, states, [*SPAN, "prefix"]), "left_semi")
    steps = table.select(*SPAN, "prefix", "id", F.lit(True).alias("fits")).distinct()
    out = known.join(steps, same(known, steps, [*SPAN, "prefix", "id"]), "left")
    return out.select(known["turn"].alias(key), known["at"], known["id"], known["kind"], known["prefix"], F.coalesce("fits", F.lit(False)).alias("fits"))
