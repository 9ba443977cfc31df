"""Tool calls: replies, validation, groundedness, equality.

A call list is JSON text, [{"name": ..., "arguments": {...}}]; values stay VARIANT until they are compared. Tools are
rows: one per (example, tool, property), or JSON lists of schemas in the example itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

ARGS = "map<string, variant>"
#: What is read of a call, and of a declared tool when calls are checked: in one step, since steps by field cost more than the checks.
CALL = f"struct<name: string, arguments: {ARGS}>"
CALLS = f"array<{CALL}>"
SPECS = "array<struct<name: string, parameters: struct<properties: map<string, struct<type: string, enum: array<variant>, minimum: double, maximum: double>>, required: array<string>>>>"
#: Code fences around a reply: a fixed value.
FENCE = r"(?m)^\s*```(?:json)?\s*|\s*```\s*$"
#: Numbers that a request can spell out: fixed values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "a": 1, "an": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}


def kind(v: Column) -> Column:
    """The outer JSON type of a variant: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, OBJECT or ARRAY."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def items(v: Column) -> Column:
    """A variant list as an array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column) -> Column:
    """A variant object as a map, null for anything else."""
    return F.try_variant_get(v, "$", ARGS)


def is_object(v: Column) -> Column:
    """Whether a variant is an object; ``kind`` would write out the types of all that it holds."""
    return F.coalesce(fields(v).isNotNull(), F.lit(False))


def field(v: Column, path: str, type_: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", type_)


def call_list(v: Column) -> Column:
    """calls of a prediction: null, a response with function_calls, one call, or a list; others are dropped."""
    none = F.array().cast(CALLS)
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$", CALLS), F.try_variant_get(v, "$.function_calls", CALLS), F.when(field(v, "name").isNotNull(), F.array(F.try_variant_get(v, "$", CALL))), none)
    return F.transform(F.filter(T.let(v, inner), lambda c: c.isNotNull()), lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["arguments"], F.create_map().cast(ARGS)).alias("arguments")))


def explode_calls(df: DataFrame, calls: Column, keep: list[str]) -> DataFrame:
    """(keep..., ix, name, arguments) per call."""
    return df.select(*keep, F.posexplode(calls).alias("ix", "call")).select(*keep, "ix", F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))


def parse_examples(reply: Column) -> Column:
    """the objects with a query in the widest [...] of a reply; an empty list if it can't be read."""
    body = T.trim(F.regexp_replace(reply, FENCE, ""))
    got = items(F.try_parse_json(F.regexp_extract(body, r"(?s)\[.*\]", 0)))
    return F.coalesce(F.filter(got, lambda r: is_object(r) & F.map_contains_key(fields(r), "query")), F.array().cast("array<variant>"))


def parse_calls(text: Column) -> Column:
    """struct(calls, error) of an emitted turn; never raises. Each step is worked out once per turn."""
    empty = F.array().cast(f"array<struct<name: string, arguments: {ARGS}>>")

    def arguments(c):
        given = F.coalesce(field(c, "arguments", "variant"), field(c, "parameters", "variant"))
        nested = T.let(given, lambda a: F.when(kind(a) == "STRING", F.try_parse_json(a.cast("string"))).otherwise(a))
        return F.coalesce(fields(nested), F.create_map().cast(ARGS))

    def found(body, v, list_):
        named = F.transform(list_, lambda c: F.coalesce(is_object(c) & (kind(field(c, "name", "variant")) == "STRING"), F.lit(False)))
        return T.let(F.array_position(named, False), lambda bad: of_good(body, v, list_, bad))

    def of_good(body, v, list_, bad):
        good = F.when(bad > 0, F.slice(list_, F.lit(1), F.greatest(bad.cast("int") - 1, F.lit(0)))).otherwise(list_)
        calls = F.transform(good, lambda c: F.struct(field(c, "name").alias("name"), arguments(c).alias("arguments")))
        error = F.when(body == "", None).when(v.isNull(), "unparsable JSON").when(list_.isNull(), "expected a list of calls").when(bad > 0, "a call had no name")
        return F.struct(F.when(body == "", empty).otherwise(F.coalesce(calls, empty)).alias("calls"), error.alias("error"))

    def of_body(body):
        v = F.coalesce(F.try_parse_json(body), F.try_parse_json(T.outermost(body)))
        return T.let(v, lambda v: T.let(F.when(is_object(v), F.array(v)).otherwise(items(v)), lambda list_: found(body, v, list_)))

    behind = F.when(F.instr(text, T.CALL_START) > 0, F.substr(text, F.instr(text, T.CALL_START) + len(T.CALL_START))).otherwise(text)
    return T.let(T.trim(T.restore_json(T.strip_markers(F.substring_index(behind, T.CALL_END, 1)))), of_body)


def number_in(value: Column, query: Column) -> Column:
    """a number is evidenced by its digits, commas aside, or by a word for it."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    spelled = F.exists(T.words(query), lambda w: F.coalesce(words[w].cast("double") == value, F.lit(False)))
    return F.replace(query, F.lit(","), F.lit("")).contains(T.number_text(value)) | spelled


def in_enum(value: Column, enum: Column) -> Column:
    """Whether a value is a member: equal type class and equal text, as JSON."""
    return F.coalesce(F.exists(enum, lambda e: F.to_json(e) == F.to_json(value)), F.lit(False))


def grounded(value: Column, enum: Column, query: Column) -> Column:
    """enum members, flags and nulls need no evidence; numbers and strings do; nested values have none."""

    def by(k):
        return (
            F.when(value.isNull() | k.isin("VOID", "BOOLEAN") | in_enum(value, enum), True)
            .when(k.isin("BIGINT", "DECIMAL", "DOUBLE"), number_in(F.try_variant_get(value, "$", "double"), query))
            .when(k == "STRING", T.normalise(query).contains(T.normalise(F.try_variant_get(value, "$", "string"))))
            .otherwise(False)
        )

    return T.let(kind(value), by)


def declared(tools: Column) -> Column:
    """The tools of a variant list as structs (tool, properties, required, description)."""
    return F.transform(
        F.coalesce(items(tools), F.array().cast("array<variant>")),
        lambda t: F.struct(
            F.coalesce(field(t, "name"), F.lit("")).alias("tool"),
            F.coalesce(fields(field(t, "parameters.properties", "variant")), F.create_map().cast(ARGS)).alias("properties"),
            F.coalesce(F.try_variant_get(t, "$.parameters.required", "array<string>"), F.array().cast("array<string>")).alias("required"),
            field(t, "description").alias("description"),
        ),
    )


def specs(tools: Column) -> Column:
    """The tools of a variant list as structs (tool, properties, required), each property as struct(type, enum, minimum, maximum)."""

    def of(t):
        given = t["parameters"]
        return F.struct(
            F.coalesce(t["name"], F.lit("")).alias("tool"),
            F.coalesce(given["properties"], F.create_map().cast("map<string, struct<type: string, enum: array<variant>, minimum: double, maximum: double>>")).alias("properties"),
            F.coalesce(given["required"], F.array().cast("array<string>")).alias("required"),
        )

    return F.transform(F.coalesce(F.try_variant_get(tools, "$", SPECS), F.array().cast(SPECS)), of)


def lookup(tools: Column, name: Column) -> Column:
    """Of ``declared`` tools or ``specs`` the one of a name, the last if there are several; null if there is none."""
    return F.try_element_at(F.filter(tools, lambda t: t["tool"] == name), F.lit(-1))


def validate(df: DataFrame, key: str, query: str, answers: str, tools: str) -> DataFrame:
    """(key, reason) per example: the first rule that fails, "" if none.

    ``answers`` and ``tools`` are JSON text. Calls and schemas share the row, so that nothing is shuffled.
    """
    df = df.select(F.col(key), F.col(query).alias("_q"), F.try_parse_json(answers).alias("_a"), specs(F.try_parse_json(tools)).alias("_t"))

    def judged(c):
        return T.let(F.struct(lookup(F.col("_t"), F.coalesce(field(c, "name"), F.lit(""))).alias("spec"), fields(field(c, "arguments", "variant")).alias("args")), lambda x: of_known(x["spec"], x["args"], c))

    def of_known(spec, args, c):
        reason = (
            F.when(~is_object(c), "a call is not an object")
            .when(spec.isNull(), "undeclared tool")
            .when(args.isNull(), "no arguments object")
            .when(F.size(F.array_except(F.map_keys(args), F.map_keys(spec["properties"]))) > 0, "undeclared arguments")
            .when(F.size(F.array_except(spec["required"], F.map_keys(args))) > 0, "missing required")
        )
        evidence = lambda e: grounded(e["value"], spec["properties"][e["key"]]["enum"], F.col("_q"))
        return T.let(reason, lambda r: F.struct(r.alias("reason"), F.when(r.isNull(), ~F.forall(F.map_entries(args), evidence)).otherwise(False).alias("ungrounded")))

    df = df.withColumn("_list", items(F.col("_a"))).withColumn("_r", F.transform("_list", judged))
    worst = F.get(F.filter("_r", lambda r: r["reason"].isNotNull()), F.lit(0))["reason"]
    final = (
        F.when(F.coalesce(T.trim(F.col("_q")), F.lit("")) == "", "empty query")
        .when(F.col("_list").isNull(), "answers is not a list")
        .when(worst.isNotNull(), worst)
        .when(F.exists("_r", lambda r: F.coalesce(r["ungrounded"], F.lit(False))), "values not evidenced in the query")
        .otherwise("")
    )
    return df.select(key, final.alias("reason"))


#: JSON types and the variant types that pass for them; a flag passes for a number, as in the scorer that this follows.
JSON_TYPES = {"string": ["STRING"], "integer": ["BIGINT", "BOOLEAN"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


PROBLEMS = "array<struct<problem: string, arg: string>>"


def problems(calls: Column, tools: Column) -> Column:
    """for each call a list of struct(problem, arg): why it can't be executed as written by the tools, which are ``specs``."""
    said = lambda p, arg: F.struct(F.lit(p).alias("problem"), arg.alias("arg"))
    fits = [f"{t} {k}" for t, kinds in JSON_TYPES.items() for k in kinds]

    def of_call(c):
        return T.let(lookup(tools, c["name"]), lambda spec: of_known(spec, c))

    def of_known(spec, c):
        args = c["arguments"]
        unknown = F.transform(F.array_except(F.map_keys(args), F.map_keys(spec["properties"])), lambda k: said("wrong_argument_key", k))
        missing = F.transform(F.array_except(spec["required"], F.map_keys(args)), lambda k: said("missing_required", k))

        def of_value(e):
            v = e["value"]

            def of_wants(x):
                wants, k = x["wants"], x["kind"]
                n = F.when(k.isin("BIGINT", "DECIMAL", "DOUBLE") & (wants["minimum"].isNotNull() | wants["maximum"].isNotNull()), F.try_variant_get(v, "$", "double"))
                outside = T.let(n, lambda n: (n < wants["minimum"]) | (n > wants["maximum"]))
                tests = [("wrong_type", wants["type"].isin(*JSON_TYPES) & ~F.concat_ws(" ", wants["type"], k).isin(fits)), ("value_outside_choices", wants["enum"].isNotNull() & ~in_enum(v, wants["enum"])), ("number_outside_range", outside)]
                return F.array_compact(F.array(*[F.when(t, said(p, e["key"])) for p, t in tests]))

            return T.let(F.struct(spec["properties"][e["key"]].alias("wants"), kind(v).alias("kind")), of_wants)

        values = F.flatten(F.transform(F.map_entries(args), of_value))  # of what is not declared nothing is wanted
        return F.when(spec.isNull(), F.array(said("wrong_tool_name", c["name"]))).otherwise(F.flatten(F.array(unknown, missing, F.coalesce(values, F.array().cast(PROBLEMS)))))

    return F.transform(calls, of_call)


def schema_errors(df: DataFrame, key: str, calls: Column, tools: str) -> DataFrame:
    """(key, ix, problem, arg) for every reason why a predicted call can't be executed as written."""
    df = df.select(key, calls.alias("_c"), specs(F.try_parse_json(tools)).alias("_t"))
    found = df.select(key, F.posexplode(problems(F.col("_c"), F.col("_t"))).alias("ix", "p"))
    return found.select(key, "ix", F.explode("p").alias("p")).select(key, "ix", "p.problem", "p.arg")


def comparable(v: Column) -> Column:
    """F16: a value in the form in which two answers are compared: case and space folded, digits in quotes a number."""
    number = lambda x, other: T.let(x, lambda x: F.when(F.abs(x) < float("inf"), F.concat(F.lit("n:"), x.cast("string"))).otherwise(other))
    plain = F.concat(F.lit("j:"), F.coalesce(F.to_json(v), F.lit("null")))

    def of_text(t):
        read = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), t.try_cast("double"))
        return number(read, F.concat(F.lit("s:"), t))

    def by(k):
        text = F.lower(T.trim(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)[\s\x1c-\x1f]+", " ")))
        return F.when(k == "STRING", T.let(text, of_text)).when(k.isin("BIGINT", "DECIMAL", "DOUBLE"), number(F.try_variant_get(v, "$", "double"), plain)).otherwise(plain)

    return T.let(kind(v), by)


def comparable_args(args: Column) -> Column:
    """A call's arguments as a sorted array of (key, comparable value)."""
    return F.sort_array(F.transform(F.map_entries(args), lambda e: F.struct(e["key"].alias("key"), comparable(e["value"]).alias("value"))))


def names(calls: Column) -> Column:
    """the tool names in order."""
    return F.transform(calls, lambda c: c["name"])


def forms(calls: Column) -> Column:
    """The form in which two call lists are compared: an array of (name, args), args as by ``comparable_args``."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), comparable_args(c["arguments"]).alias("args")))


def exact_call(predicted: Column, gold: Column) -> Column:
    """equal names and equal comparable arguments, call by call."""
    return forms(predicted) == forms(gold)


def grounding(predicted: Column, gold: Column) -> Column:
    """struct(hit, total) over the gold arguments; a call of another name at its place hits none."""
    return compared(forms(predicted), forms(gold))


def compared(predicted: Column, gold: Column) -> Column:
    """``grounding`` of two lists that are ``forms`` already; each pair of places is looked at once."""
    hit = lambda p, g: F.when(p["name"] == g["name"], F.size(F.array_intersect(g["args"], p["args"]))).otherwise(0)
    both = lambda x: F.struct(
        F.aggregate(F.zip_with(x["p"], x["g"], hit), F.lit(0), lambda a, n: a + n).alias("hit"),
        F.aggregate(x["g"], F.lit(0), lambda a, g: a + F.size(g["args"])).alias("total"),
    )
    return T.let(F.struct(predicted.alias("p"), gold.alias("g")), both)


def render(query: Column, tools: Column, answers: Column, reasoning: Column) -> Column:
    """struct(prompt, target); tools and answers are compact JSON text."""
    prompt = F.concat(F.lit(f"{T.IM_START}user\n{T.TOOLS_START}"), tools, F.lit(f"{T.TOOLS_END}\n"), query, F.lit(f"{T.IM_END}\n{T.IM_START}assistant\n"))
    target = F.concat(F.lit(T.THINK_START), reasoning, F.lit(f"{T.THINK_END}\n{T.CALL_START}"), answers, F.lit(f"{T.CALL_END}{T.IM_END}"))
    return F.struct(prompt.alias("prompt"), target.alias("target"))


def render_conversation(turns: Column, tools: Column, system: Column) -> Column:
    """One text of ordered turns (role, text): the first user turn with the tools, later ones by role."""
    opener = f"{T.IM_START}assistant\n"
    first = F.greatest(F.array_position(F.transform(turns, lambda t: t["role"]), "user").cast("int"), F.lit(1))
    head = render(F.get(turns, first - 1)["text"], tools, F.lit(""), F.lit(""))["prompt"]

    def later(t):
        body = F.regexp_replace(t["text"], r"(?U)[\s\x1c-\x1f]+\z", "")
        body = F.when(body.endswith(T.IM_END), F.regexp_replace(F.substr(body, F.lit(1), F.length(body) - len(T.IM_END)), r"(?U)[\s\x1c-\x1f]+\z", "")).otherwise(body)
        result = F.concat(F.lit(f"{T.IM_START}user\n{T.RESULT_START}"), F.to_json(F.struct(t["text"].alias("t"))), F.lit(f"{T.RESULT_END}{T.IM_END}\n{opener}"))
        return F.when(t["role"] == "assistant", F.concat(body, F.lit(f"{T.IM_END}\n"))).when(t["role"] == "tool", result).otherwise(F.concat(F.lit(f"{T.IM_START}user\n"), t["text"], F.lit(f"{T.IM_END}\n{opener}")))

    rest = F.array_join(F.transform(F.slice(turns, first + 1, F.size(turns)), later), "")
    lead = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit(f"{T.IM_START}system\n"), system, F.lit(f"{T.IM_END}\n"))).otherwise("")
    prompt = F.concat(lead, head, rest)
    return F.when(prompt.endswith(opener), prompt).otherwise(F.concat(prompt, F.lit(opener)))


def dedup_key(query: Column, answers: Column) -> Column:
    """C17: request and call together: trimmed lower-case query, answers with sorted keys."""
    return F.struct(F.lower(T.trim(query)).alias("query"), F.to_json(F.try_parse_json(answers)).alias("answers"))
