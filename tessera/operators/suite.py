"""Benchmark generation.

The catalogue is data: tools (name, family, held_out, keys, phrasings) and slot values (name, key, value). Draws follow the
seeded md5 order, so that counts and invariants are those of the suite and any engine can replay it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.text import unused
from tessera.operators.corpus import DIGITS, apportion, running_total, seeded

#: Fixed values of the suite: families and sizes, off-topic and held-out counts, share of two-call rows, twins' targets.
FAMILIES = [("phone", 420), ("wearable", 240), ("smart home", 330), ("robot", 210)]
OFF_TOPIC, HELD_OUT, MULTI_SHARE, TOOLS_PER_TURN, NEAR, TWIN_OVERLAPS = 180, 241, 0.10, 5, 2, (0.60, 0.75, 0.90)


def family_plan(spark, families=FAMILIES, held_out: int = HELD_OUT, multi_share: float = MULTI_SHARE) -> DataFrame:
    """(family, total, held, multi, single): how many rows of each kind a family gets.

    ``families`` lists (family, total) in order, or is a table (family, total, ord)."""
    f = families if isinstance(families, DataFrame) else spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(families)], "family string, total int, ord int")
    held = apportion(f, held_out, "family", "total").withColumnRenamed("tokens", "held")
    multi = F.bround(F.col("total") * multi_share).cast("long")
    return held.select("family", F.col("total").cast("long").alias("total"), "held", multi.alias("multi"), (F.col("total") - F.col("held") - multi).alias("single"))


def even(total: Column, buckets: Column, place: Column) -> Column:
    """The share of bucket ``place`` (from 0) of an even split, the remainder to the first."""
    return F.floor(total / buckets) + F.when(place < total % buckets, 1).otherwise(0)


def fill(template: Column, values: Column) -> Column:
    """A phrasing with {key} replaced by the values of a map."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


#: Combinations of slot values that are made within one row.
COMBINATIONS = 1 << 14


def combinations(tools: DataFrame, values: DataFrame, at_once: int = COMBINATIONS) -> tuple[DataFrame, DataFrame]:
    """(name, phrasing, combos): every phrasing with all combinations of slot values, ``at_once`` to a row at most; and (name, n):
    how many each tool has.

    Slots are cut into parts by a hash, parts are combined slot by slot in joins, and the rows are dealt out before the
    combinations of their parts are made, so that no row or task grows with the product.
    """
    per = values.groupBy("name", "key").agg(F.min("slot").alias("_slot"), F.count("*").alias("_n"))
    per = per.withColumn("_at", F.row_number().over(Window.partitionBy("name").orderBy("_slot", "key")) - 1).withColumn("_of", F.count("*").over(Window.partitionBy("name")))
    part = F.pmod(F.xxhash64("ord", "value"), F.ceil(F.col("_n") / F.floor(F.pow(F.lit(float(at_once)), 1 / F.col("_of")))))
    parts = values.join(per, ["name", "key"]).groupBy("name", "_at", "key", part.alias("_part")).agg(F.collect_list(F.struct("ord", "value")).alias("v"))
    t = tools.join(per.select("name").distinct(), "name", "left_semi").select("name", F.explode("phrasings").alias("phrasing"), F.array().cast("array<struct<key:string,v:array<struct<ord:bigint,value:string>>>>").alias("slots"))
    for i in range(per.agg(F.max("_of")).first()[0] or 0):
        t = t.join(parts.filter(F.col("_at") == i).select("name", "key", "v"), "name", "left")
        t = t.select("name", "phrasing", F.when(F.col("key").isNull(), F.col("slots")).otherwise(F.array_append("slots", F.struct("key", F.transform("v", lambda x: F.struct(x["ord"].cast("bigint").alias("ord"), x["value"].alias("value"))).alias("v")))).alias("slots"))
    empty = F.array(F.create_map().cast("map<string,string>"))

    def grow(combos, slot):
        return F.flatten(F.transform(combos, lambda m: F.transform(slot["v"], lambda v: F.map_concat(m, F.create_map(slot["key"], v["value"])))))

    session = tools.sparkSession
    dealt = t.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    n = tools.join(per.groupBy("name").agg(F.product("_n").alias("_n")), "name").select("name", (F.size("phrasings") * F.col("_n")).alias("n"))
    return dealt.select("name", "phrasing", F.aggregate("slots", empty, grow).alias("combos")), n


def assignments(tools: DataFrame, values: DataFrame, seed: int = 0) -> DataFrame:
    """(name, phrasing, values, query, place): every phrasing with every combination of slot values, in seeded order."""
    t = combinations(tools, values)[0]
    t = t.select("name", "phrasing", F.explode("combos").alias("values")).withColumn("query", fill(F.col("phrasing"), F.col("values")))
    t = t.withColumn("_o", seeded(seed, F.col("name"), F.col("query"))).withColumn("_one", F.lit(1))
    return running_total(t, "_one", ["_o", "query"], F.substring("_o", 1, DIGITS), ["name"], "place").drop("_o", "_one")


def first_assignments(combos: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The rows of ``assignments`` whose place is below ``most``: each row of combinations keeps its first ones, which are then ranked."""
    said = lambda m, i: T.let(fill(F.col("phrasing"), m), lambda q: F.struct(seeded(seed, F.col("name"), q).alias("o"), q.alias("query"), i.alias("i")))
    first = T.let(F.col("combos"), lambda c: F.transform(F.slice(F.sort_array(F.transform(c, said)), 1, max(1, most)), lambda x: F.struct(F.get(c, x["i"]).alias("values"), x["query"].alias("query"), x["o"].alias("_o"))))
    t = combos.select("name", "phrasing", F.inline(first))
    place = F.row_number().over(Window.partitionBy("name").orderBy("_o", "query")) - 1
    return t.withColumn("place", place).filter(F.col("place") < most).drop("_o")


def reasoning(values: Column) -> Column:
    """C11: 'value' -> key; ... in key order of the map."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(F.lit("'"), e["value"], F.lit("' -> "), e["key"])), "; ")


def alike(phrasings: DataFrame, values: DataFrame) -> DataFrame:
    """Of slot values (name, key, slot, ord, value) those that a twin can need: the first two of each class of alike ones.

    A word that no other value or phrasing of its tool holds is shared with no request but the value's own. So all values of
    a slot with as many such words, and the same other ones, overlap with a request alike, and the first of them wins; the
    second stands in where the request holds the first. Where a value's words could run into others, it is a class of its own.
    """
    said = phrasings.select("name", "phrasing").distinct()
    v = values.groupBy("name", "key", "value").agg(F.min(F.struct("slot", "ord")).alias("_at"))  # of equal texts the first wins
    v = v.withColumn("_w", F.array_distinct(T.words(F.col("value"))))
    words = v.select("name", F.explode("_w").alias("_x")).unionByName(said.select("name", F.explode(F.array_distinct(T.words(F.col("phrasing")))).alias("_x")))
    often = words.groupBy("name", "_x").agg(F.count("*").alias("_c"))
    spelled = v.select("name", "key", "value", "_at", F.explode_outer("_w").alias("_x")).join(often, ["name", "_x"], "left")
    kinds = spelled.groupBy("name", "key", "value", "_at").agg(F.count_if(F.col("_c") == 1).alias("_own"), F.sort_array(F.collect_list(F.when(F.col("_c") > 1, F.col("_x")))).alias("_shared"))
    # words run into others at a placeholder within a word, or by a value that is filled itself
    joined = said.filter(F.lower("phrasing").rlike(r"[a-z0-9}]\{|\}[a-z0-9]")).select("name").unionByName(v.filter(F.col("value").rlike(r"[{}]")).select("name"))
    joined = joined.distinct().withColumn("_joined", F.lit(True))
    kinds = kinds.join(joined, "name", "left").withColumn("_alone", F.when(F.col("_joined"), F.col("value")))
    first = Window.partitionBy("name", "key", "_at.slot", "_own", "_shared", "_alone").orderBy("_at")
    two = kinds.withColumn("_nth", F.row_number().over(first)).filter("_nth <= 2")
    return two.select("name", "key", "_at.slot", "_at.ord", "value")


def twins(rows: DataFrame, values: DataFrame, key: list[str], phrasings: DataFrame | None = None) -> DataFrame:
    """Per row (key..., name, phrasing, values, query, target) the one-slot change whose overlap is nearest the target.

    ``phrasings`` has (name, phrasing) of all rows, which is less to read than the rows."""
    values = alike(rows if phrasings is None else phrasings, values)
    v = values.select("name", F.col("key").alias("slot_key"), F.col("value").alias("new"), "slot", "ord")
    asked = rows.withColumn("_x", F.array_distinct(T.words(F.col("query"))))  # once per request
    c = asked.join(v, "name").filter(F.col("values")[F.col("slot_key")] != F.col("new"))
    changed = F.transform_values("values", lambda k, x: F.when(k == F.col("slot_key"), F.col("new")).otherwise(x))
    c = c.withColumn("_tv", changed).withColumn("_tq", fill(F.col("phrasing"), F.col("_tv")))
    c = c.withColumn("_ov", T.jaccard(F.col("_x"), F.array_distinct(T.words(F.col("_tq"))), 1.0))
    best = F.min_by(F.struct(F.col("_tq").alias("query"), F.col("_tv").alias("values"), F.col("slot_key").alias("differs"), F.round("_ov", 4).alias("overlap")), F.struct(F.round(F.abs(F.col("_ov") - F.col("target")), 9), "slot", "ord"))
    return c.groupBy(*key).agg(best.alias("twin"))


def off_topic(templates: DataFrame, subjects: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(query, place): templates with every subject, ``count`` of them in seeded order."""
    s = subjects.agg(F.collect_list("subject").alias("subjects"))  # a catalogue's pool, a few dozen words
    q = templates.crossJoin(F.broadcast(s)).select(F.explode(F.transform("subjects", lambda x: F.replace(F.col("template"), F.lit("{topic}"), x))).alias("query"))
    q = q.withColumn("_o", seeded(seed, F.col("query"))).withColumn("_one", F.lit(1))
    return running_total(q, "_one", ["_o", "query"], F.substring("_o", 1, DIGITS), [], "place").filter(F.col("place") < count).select("query", "place")


def bind(first: Column, second: Column, binding: dict[str, str]) -> Column:
    """The second call's arguments, the bound ones taken from the first's."""
    return F.map_concat(F.map_filter(second, lambda k, v: ~k.isin(list(binding))), F.create_map(*[x for k, s in binding.items() for x in (F.lit(k), first[s])]))


def split_holdout(df: DataFrame, key: str, share: float, seed: int = 0, whole: bool = True) -> DataFrame:
    """``df`` with held_out: the first int(n * share) rows of the seeded order.

    Without ``whole``, every row that starts before the share's end: a part of a row counts as one."""
    n = df.count()
    end = int(n * share) if whole else float(n * Decimal(str(share)))
    o, one, place = unused(df, "o", "one", "place")
    d = df.withColumn(o, seeded(seed, F.col(key))).withColumn(one, F.lit(1))
    d = running_total(d, one, [o, key], F.substring(o, 1, DIGITS), [], place)
    return d.withColumn("held_out", F.col(place) < end).drop(o, one, place)


def sample_per_group(df: DataFrame, group: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """K rows per group without replacement, in seeded order."""
    w = Window.partitionBy(*group).orderBy(seeded(seed, *[F.col(g) for g in group], F.col(key)), key)
    n = unused(df, "n")
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) <= k).drop(n)


def build_suite(tools: DataFrame, values: DataFrame, seed: int = 0, families=FAMILIES, held_out: int = HELD_OUT) -> DataFrame:
    """One-call requests per the family plan: (id, family, name, query, values, held_out, reasoning, twin).

    A tool's share is an even part of its family's; a catalogue too small for its share raises.
    """
    spark = tools.sparkSession
    plan = family_plan(spark, families, held_out)
    w = Window.partitionBy("family", "held_out")
    t = tools.withColumn("_i", F.row_number().over(w.orderBy("name")) - 1).withColumn("_n", F.count("*").over(w)).join(F.broadcast(plan), "family")
    t = t.withColumn("want", even(F.when(F.col("held_out"), F.col("held")).otherwise(F.col("single")), F.col("_n"), F.col("_i")))
    combos, room = combinations(t.select("name", "phrasings"), values)
    short = room.join(t.select("name", "want"), "name").filter("n < want").limit(1).collect()
    if short:
        raise ValueError(f"tool {short[0].name!r} can produce {short[0].n:.0f} distinct requests, {short[0].want} asked for")
    most = t.agg(F.max("want")).first()[0] or 0
    a = first_assignments(combos, int(most), seed).join(t.select("name", "family", "held_out", "want"), "name").filter(F.col("place") < F.col("want"))
    order = Window.partitionBy("family").orderBy(seeded(seed, F.lit("row"), F.col("query")), "query")
    a = a.withColumn("_r", F.row_number().over(order)).withColumn("id", F.concat(F.replace("family", F.lit(" "), F.lit("-")), F.lit("-"), F.lpad(F.col("_r").cast("string"), 4, "0")))
    a = a.withColumn("target", F.get(F.array(*map(F.lit, TWIN_OVERLAPS)), (F.col("_r") - 1) % len(TWIN_OVERLAPS)))
    twin = twins(a.select("id", "name", "phrasing", "values", "query", "target"), values, ["id"], tools.select("name", F.explode("phrasings").alias("phrasing")))
    return a.join(twin, "id", "left").select("id", "family", "name", "query", "values", "held_out", reasoning(F.col("values")).alias("reasoning"), "twin")


def declare(requests: DataFrame, neighbours: DataFrame, near: int = NEAR, per_turn: int = TOOLS_PER_TURN, seed: int = 0) -> DataFrame:
    """(id, names, overlap): the target, its ``near`` nearest tools and a seeded draw of those that share nothing.

    ``neighbours`` has (name, other, overlap, place); the names of a turn are in seeded order.
    """
    c = requests.select("id", "name").join(neighbours, "name")
    c = c.withColumn("_near", F.col("place") <= near).filter(F.col("_near") | (F.col("overlap") == 0))
    w = Window.partitionBy("id").orderBy(F.desc("_near"), seeded(seed, F.col("id"), F.col("other")))
    c = c.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_turn - 1)
    g = c.groupBy("id", "name").agg(F.collect_list("other").alias("o"), F.max("overlap").alias("overlap"))
    names = F.concat(F.array("name"), "o")
    order = F.array_sort(F.transform(names, lambda x: F.struct(seeded(seed, F.lit("turn"), F.col("id"), x).alias("k"), x.alias("n"))))
    return g.select("id", F.transform(order, lambda s: s["n"]).alias("names"), F.round("overlap", 4).alias("overlap"))


def two_call_requests(tools: DataFrame, values: DataFrame, pair: tuple[str, str], phrasings: list[str], binding: dict[str, str], count: int, seed: int = 0) -> DataFrame:
    """(query, first, second, place): one sentence for two calls; slots of the second that are bound, or that
    the first has too, take the first's values. A catalogue too small for ``count`` raises."""
    spark = tools.sparkSession
    own = values.filter(F.col("name") == pair[0])
    had = own.select("key").distinct()
    more = values.filter((F.col("name") == pair[1]) & ~F.col("key").isin(list(binding) or [""])).join(had, "key", "left_anti")
    both = own.select(F.lit("pair").alias("name"), "key", "slot", "ord", "value").unionByName(more.select(F.lit("pair").alias("name"), "key", (F.col("slot") + 100).alias("slot"), "ord", "value"))
    a = assignments(spark.createDataFrame([("pair", phrasings)], "name string, phrasings array<string>"), both, seed)
    if a.count() < count:
        raise ValueError(f"pair {pair[0]}+{pair[1]} can't produce {count} distinct requests")
    keys = {r.name: r["keys"] for r in values.filter(F.col("name").isin(*pair)).groupBy("name").agg(F.collect_set("key").alias("keys")).collect()}  # two tools' slots
    first = F.map_filter("values", lambda k, v: k.isin(keys[pair[0]]))
    second = F.map_concat(F.map_filter("values", lambda k, v: k.isin([k_ for k_ in keys[pair[1]] if k_ not in binding] or [""])), *([F.create_map(*[x for k_, s in binding.items() for x in (F.lit(k_), F.col("values")[s])])] if binding else []))
    return a.filter(F.col("place") < count).select("query", first.alias("first"), second.alias("second"), "place")


def copy_rows(spark, rows: int | DataFrame, seed: int = 0, lo: int = 4, hi: int = 24, vocab: int = 512) -> DataFrame:
    """(row, prompt, target): seeded copy-task rows, as many as asked for or one per ``id``: a random run of tokens, to be repeated."""
    ids = rows if isinstance(rows, DataFrame) else spark.range(rows)
    n = F.lit(lo) + F.floor(F.conv(F.substring(seeded(seed, F.col("id")), 1, 8), 16, 10).cast("double") / 4294967296 * (hi - lo + 1)).cast("int")
    token = lambda i: F.lit(14) + (F.conv(F.substring(seeded(seed, F.col("row"), i), 1, 8), 16, 10).cast("long") % (vocab - 14)).cast("int")
    return ids.select(F.col("id").alias("row"), n.alias("n")).select("row", F.transform(F.sequence(F.lit(1), F.col("n")), token).alias("prompt")).withColumn("target", F.col("prompt"))


def twin_requests(suite: DataFrame) -> DataFrame:
    """The twins as requests of their own."""
    t = suite.filter("twin is not null")
    return t.select(F.concat("id", F.lit("-twin")).alias("id"), "family", "name", F.col("twin.query").alias("query"), F.col("twin.values").alias("values"), "held_out", reasoning(F.col("twin.values")).alias("reasoning"), F.col("id").alias("twin_of"))


def summary(suite: DataFrame) -> DataFrame:
    """Counts, held-out share, mean overlap of twins."""
    return suite.agg(F.count("*").alias("requests"), F.count_if("held_out").alias("held_out"), F.count("twin").alias("twins"), F.avg("twin.overlap").alias("mean_overlap"))


def with_twins(suite: DataFrame) -> DataFrame:
    """The suite and its twins as one relation; twin_of is null for a request of the suite itself."""
    return suite.drop("twin").unionByName(twin_requests(suite), allowMissingColumns=True)


def save_suite(suite: DataFrame, path: str) -> None:
    """One JSON request per line."""
    suite.write.mode("overwrite").json(path)


def load_suite(spark, path: str, schema) -> DataFrame:
    """The requests that ``save_suite`` wrote."""
    return spark.read.schema(schema).json(path)


def tool_schemas(tools: DataFrame, slots: DataFrame) -> DataFrame:
    """(name, schema, combinations): each tool's JSON schema from its slots (name, key, slot, value, type, minimum, maximum,
    enum, optional), and how many requests its phrasings and values make.

    A slot's type, bounds and flags are those of its first value's row.
    """
    per = slots.groupBy("name", "key").agg(F.min("slot").alias("slot"), F.count("*").alias("n"), *[F.min_by(c, "ord").alias(c) for c in ("type", "minimum", "maximum", "enum", "optional")], F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("pool"))
    choices = F.when(F.col("enum"), F.transform("pool", lambda p: p["value"]))
    prop = F.struct(F.col("type"), F.col("minimum"), F.col("maximum"), choices.alias("enum"))
    per = per.select("name", "key", "slot", "n", F.coalesce("optional", F.lit(False)).alias("optional"), prop.alias("property"))
    g = per.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("slot", "key", "property", "optional", "n"))).alias("s"))
    t = tools.join(g, "name", "left").withColumn("s", F.coalesce("s", F.array().cast(g.schema["s"].dataType)))
    props = F.map_from_entries(F.transform("s", lambda x: F.struct(x["key"], x["property"])))
    required = F.transform(F.filter("s", lambda x: ~x["optional"]), lambda x: x["key"])
    schema = F.to_json(F.struct("name", "description", F.struct(F.lit("object").alias("type"), props.alias("properties"), required.alias("required")).alias("parameters")))
    return t.select("name", schema.alias("schema"), F.aggregate("s", F.size("phrasings").cast("long"), lambda a, x: a * x["n"]).alias("combinations"))


def catalogue_problems(tools: DataFrame, slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, problem) for every way in which a catalogue's own gold answers would be invalid.

    Phrasings must mention every slot, numbers lie within their slot's bounds, choices be texts, and the tools of a pair
    (first, second, bound) share no argument but bound ones.
    """
    keys = slots.select("name", "key").distinct()
    silent = tools.select("name", F.explode("phrasings").alias("p")).join(keys, "name").filter(~F.col("p").contains(F.concat(F.lit("{"), F.col("key"), F.lit("}"))))
    number = F.col("value").try_cast("double")
    outside = slots.filter((F.col("type") != "string") & ((number < F.col("minimum")) | (number > F.col("maximum"))))
    untyped = slots.filter(F.col("enum") & (F.col("type") != "string"))
    a, b = keys.select(F.col("name").alias("first"), "key"), keys.select(F.col("name").alias("second"), "key")
    shared = pairs.join(a, "first").join(b, ["second", "key"]).filter(~F.array_contains("bound", F.col("key")))
    say = lambda df, name, *text: df.select(F.col(name).alias("name"), F.concat(*text).alias("problem"))
    return (
        say(silent, "name", F.lit("a phrasing never mentions "), F.col("key"))
        .unionByName(say(outside, "name", F.col("key"), F.lit(" has a value outside its bounds: "), F.col("value")))
        .unionByName(say(untyped, "name", F.col("key"), F.lit(" has choices that aren't texts")))
        .unionByName(say(shared, "first", F.lit("shares "), F.col("key"), F.lit(" with "), F.col("second"), F.lit(", unbound")))
        .distinct()
    )


def checked_catalogue(tools: DataFrame, slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """the tools; a problem of the catalogue raises."""
    bad = catalogue_problems(tools, slots, pairs).orderBy("name", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.name}: {r.problem}" for r in bad))
    return tools


def full_suite(tools: DataFrame, values: DataFrame, pairs: list[tuple], templates: DataFrame, subjects: DataFrame, seed: int = 0, families=FAMILIES, held_out: int = HELD_OUT, off_topic_rows: int = OFF_TOPIC, near: int = NEAR, per_turn: int = TOOLS_PER_TURN) -> DataFrame:
    """One-call, two-call and off-topic requests with their declared tools: (id, family, query, calls, held_out, reasoning, tools).

    ``calls`` lists (name, arguments) in order, none for off-topic rows. ``pairs`` has (family, first, second, phrasings,
    binding) per family; its two-call rows are as many as the family's plan says. ``tools`` are names in seeded order.
    """
    from tessera.operators.retrieval import tool_neighbours

    spark = tools.sparkSession
    call = lambda name, args: F.struct(name.alias("name"), args.alias("arguments"))
    rows = build_suite(tools, values, seed, families, held_out).select("id", "family", "name", "query", F.array(call(F.col("name"), F.col("values"))).alias("calls"), "held_out", "reasoning")
    wanted = {r.family: r.multi for r in family_plan(spark, families, held_out).collect()}
    for family, first, second, phrasings, binding in pairs:
        two = two_call_requests(tools, values, (first, second), phrasings, binding, wanted[family], seed)
        n = F.lpad((F.col("place") + 1).cast("string"), 4, "0")
        said = F.concat(reasoning(F.col("first")), F.lit("; "), reasoning(F.col("second")))
        two = two.select(F.concat(F.lit(family.replace(" ", "-") + "-two-"), n).alias("id"), F.lit(family).alias("family"), F.lit(first).alias("name"), "query", F.array(call(F.lit(first), F.col("first")), call(F.lit(second), F.col("second"))).alias("calls"), F.lit(False).alias("held_out"), said.alias("reasoning"))
        rows = rows.unionByName(two)
    off = off_topic(templates, subjects, off_topic_rows, seed)
    target = tools.select("name").withColumn("_t", F.row_number().over(Window.orderBy(seeded(seed, F.col("name")))) - 1)  # a catalogue of tools
    off = off.crossJoin(F.broadcast(tools.agg(F.count("*").alias("_n")))).withColumn("_t", (F.col("place") % F.col("_n")).cast("int")).join(target, "_t")
    none = rows.schema["calls"].dataType
    off = off.select(F.concat(F.lit("off-topic-"), F.lpad((F.col("place") + 1).cast("string"), 4, "0")).alias("id"), F.lit("off topic").alias("family"), "name", "query", F.array().cast(none).alias("calls"), F.lit(False).alias("held_out"), F.lit("no tool fits").alias("reasoning"))
    rows = rows.unionByName(off)
    turn = declare(rows.select("id", "name"), tool_neighbours(tools), near, per_turn, seed).select("id", "names")
    also = F.filter(F.transform("calls", lambda c: c["name"]), lambda n: ~F.array_contains("names", n))
    return rows.join(turn, "id").select("id", "family", "query", "calls", "held_out", "reasoning", F.concat("names", also).alias("tools"))
