"""Text expressions: cleaning, markers, words, names. All are Columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the wire format.
MARKERS = ["<|im_start|>", "<|im_end|>", "<think>", "</think>", "<tools>", "</tools>", "<tool_call>", "</tool_call>", "<tool_result>", "</tool_result>"]
IM_START, IM_END, THINK_START, THINK_END, TOOLS_START, TOOLS_END, CALL_START, CALL_END, RESULT_START, RESULT_END = MARKERS
#: The characters that carry JSON structure.
ISOLATED = r'[({\[",\]})]'
#: White space at line ends as Python strips it; Java's own class lacks the last four.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Fields of a JSON record that can hold the document, in order of preference.
TEXT_FIELDS = ("text", "content", "code", "body", "document")


def let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often it is used.

    A sum over no rows: an array of one would be made and copied, and its item's type be found anew for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, of)


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """The names, with as many underscores in front as keep them apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


def clean(text: Column) -> Column:
    """line ends to LF, lines right-stripped, outer newlines cut, at most one blank line in a row."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\A\n+|\n+\z", "")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def replacement_ratio(text: Column) -> Column:
    """share of U+FFFD."""
    return F.try_divide(F.regexp_count(text, F.lit("�")), F.length(text))


def nonprint_ratio(text: Column) -> Column:
    """share of characters that don't print, newline and tab aside."""
    return F.try_divide(F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\t]]")), F.length(text))


def content_lines(text: Column) -> Column:
    """the lines that hold something."""
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")


def duplicate_ratio(lines: Column) -> Column:
    """1 - distinct / all."""
    return 1 - F.try_divide(F.size(F.array_distinct(lines)), F.size(lines))


def mean_length(lines: Column) -> Column:
    """mean characters of a line."""
    return F.try_divide(F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.size(lines))


def balanced(text: Column, max_depth: int = 64) -> Column:
    """whether brackets match outside double-quoted strings, no deeper than ``max_depth``.

    Strings without brackets' meaning are cut first, then the rest is one fold over the brackets left.
    """
    bare = F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*+"', "")  # whole strings
    open_string = bare.contains('"')
    left = F.regexp_replace(bare, r"[^()\[\]{}]", "")
    closes = lambda top, c: ((top == "(") & (c == ")")) | ((top == "[") & (c == "]")) | ((top == "{") & (c == "}"))
    start = F.struct(F.lit("").alias("stack"), F.lit(True).alias("ok"))

    def step(a, c):
        opens = c.isin("(", "[", "{")
        stack = a["stack"]
        top = F.right(stack, F.lit(1))
        pushed = F.concat(stack, c)
        popped = F.substr(stack, F.lit(1), F.greatest(F.length(stack) - 1, F.lit(0)))
        fine = F.when(opens, F.length(pushed) <= max_depth).otherwise(closes(top, c))
        return F.when(~a["ok"], a).otherwise(F.struct(F.when(opens, pushed).otherwise(popped).alias("stack"), F.coalesce(fine, F.lit(False)).alias("ok")))

    chars = F.filter(F.split(left, ""), lambda c: c != "")
    return ~open_string & F.aggregate(chars, start, step, lambda a: a["ok"] & (a["stack"] == ""))


def pre_tokenize(text: Column) -> Column:
    """A space on both sides of each structural character; not idempotent."""
    return F.regexp_replace(text, f"({ISOLATED})", " $1 ")


def restore_json(text: Column) -> Column:
    """Takes one space off each side of a structural character."""
    return F.regexp_replace(text, f" ?({ISOLATED}) ?", "$1")


def strip_markers(text: Column) -> Column:
    """Without the ten markers, outer white space cut."""
    return trim(F.regexp_replace(text, "|".join(m.replace("|", r"\|") for m in MARKERS), ""))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def between(text: Column, start: str, end: str) -> Column:
    """After the first start, up to the next end or the text's end; "" without a start."""
    at = F.instr(text, start)
    tail = F.substr(text, at + len(start))
    return F.when(at == 0, "").otherwise(trim(F.substring_index(tail, end, 1)))


def outermost(text: Column) -> Column:
    """The widest [...], else the widest {...}, else null."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return F.coalesce(found(r"(?s)\[.*\]"), found(r"(?s)\{.*\}"))


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def normalise(text: Column) -> Column:
    """The words, joined by spaces."""
    return F.array_join(words(text), " ")


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Overlap of two word lists as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lexical_score(query: Column, name: Column, text: Column) -> Column:
    """Shared words over the root of the tool's number of words, plus 1 if the request spells its name out."""
    tool, asked = F.array_distinct(words(text)), F.array_distinct(words(query))
    spelled = F.regexp_replace(F.lower(name), "_", " ")
    shared = F.size(F.array_intersect(asked, tool)) / F.sqrt(F.size(tool))
    bonus = F.when((spelled != "") & normalise(query).contains(spelled), 1.0).otherwise(0.0)
    return F.when(F.size(tool) == 0, 0.0).otherwise(shared + bonus)


def number_text(x: Column, digits: int = 6) -> Column:
    """C11: a number with six significant digits, as %g prints it, or with as many as asked for, 15 at most."""
    if not 1 <= digits <= 15:
        raise ValueError("1 to 15 digits")
    d = x.cast("double")
    e = F.when(d == 0, 0).otherwise(F.floor(F.log10(F.abs(d)))).cast("int")
    cut = lambda x, n: F.regexp_replace(F.regexp_replace(F.bround(x, n).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def printed(e):
        exact = d.cast("decimal(38,16)")
        fixed = cut(exact, digits + 4)
        for n in range(0, min(digits + 4, 17)):
            fixed = F.when(F.lit(digits - 1) - e == n, cut(exact, n)).otherwise(fixed)
        mantissa = cut((d / F.pow(F.lit(10.0), e)).cast("decimal(20,15)"), digits - 1)
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.when((e >= digits) | (e < -4), F.concat(mantissa, F.lit("e"), power)).otherwise(F.when(d == 0, "0").otherwise(fixed))

    # a mantissa that rounds up to ten has the next exponent
    up = lambda e: F.when(F.abs(d) >= F.pow(F.lit(10.0), e + 1) - F.pow(F.lit(10.0), e - digits + 1) / 2, e + 1).otherwise(e)
    whole = (d == F.floor(d)) & (F.abs(d) < float(f"1e{digits}"))  # most numbers, and none of the work
    return F.when(whole, d.cast("long").cast("string")).otherwise(let(let(e, up), printed))


def natural_key(text: Column, width: int = 12) -> Column:
    """A text that sorts digit runs as numbers."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def canonical_name(name: Column, dropped: list[str], aliases: dict[str, str], prefixes: list[str]) -> Column:
    """One name for a leaf of a parameter tree, by the tables of a naming scheme.

    Parts stand between dots or slashes, in lower case; a prefix like ``head_`` is a part of its own. A part is replaced by its
    alias, left out if it is one of ``dropped``, and said once where it comes twice in a row. A name of nothing but
    dropped parts keeps its last one.
    """
    split_off = F.lit("|".join(p.rstrip("_") for p in prefixes))
    lower = F.lower(trim(F.translate(name, "/", ".")))
    parts = F.split(F.regexp_replace(lower, F.concat(F.lit("("), split_off, F.lit(")_")), F.lit("$1.")) if prefixes else lower, "[.]")
    called = F.map_from_arrays(F.lit(list(aliases)), F.lit(list(aliases.values()))) if aliases else F.create_map().cast("map<string,string>")
    said = F.filter(F.transform(parts, lambda p: F.coalesce(F.try_element_at(called, p), p)), lambda p: ~p.isin("", *dropped))
    once = F.filter(F.arrays_zip(said.alias("p"), F.concat(F.array(F.lit("")), said).alias("before")), lambda x: x["p"] != x["before"])
    return F.when(F.size(said) == 0, F.element_at(parts, -1)).otherwise(F.array_join(F.transform(once, lambda x: x["p"]), "."))


def snake(name: Column) -> Column:
    """C14: a name's parts in lower case: an acronym, a capitalised word or a run without capitals is one."""
    word = F.lit("([A-Z]+(?=[A-Z][a-z])|[A-Z]*[^A-Z]+|[A-Z]+)")
    return F.lower(F.array_join(F.transform(F.split(name, "_"), lambda w: F.array_join(F.regexp_extract_all(w, word, F.lit(1)), "_")), "_"))


def digit_allowed(prefix: Column, digit: Column, lo: Column, hi: Column) -> Column:
    """Whether a number that starts with prefix and digit lies in [lo, hi]; null bounds are open.

    With k more digits, the numbers that start with v are those from v * 10^k to v * 10^k + 10^k - 1. Numbers of more digits
    than the bound that they grow towards are past it.
    """
    text = F.concat(prefix, digit)
    minus = text.startswith("-")
    digits = F.regexp_replace(text, "^-", "")
    v = digits.try_cast("double")
    # of magnitudes: a negative number's lie between those of the two bounds, the other way round
    least = F.greatest(F.when(minus, -hi).otherwise(lo), F.lit(0.0))
    most = F.when(minus, -lo).otherwise(hi)
    room = F.length(F.abs(most.cast("decimal(38,0)")).cast("string")) - F.length(digits)

    def reached(k):
        scale = F.pow(F.lit(10.0), k)
        return (v * scale <= most) & (v * scale + scale - 1 >= F.coalesce(least, F.lit(0.0)))

    meets = F.exists(F.sequence(F.lit(0), F.least(F.greatest(room, F.lit(0)), F.lit(40))), reached)
    return F.when(~digits.rlike("^[0-9]+$"), False).when(most.isNull(), True).otherwise(F.coalesce(meets, F.lit(False)))


def digit_follows(prefix: Column, digit: Column, lo: Column, hi: Column) -> Column:
    """C19 as the walk asks it: JSON has no leading zeros, so that no digit follows a lone one."""
    return ~F.regexp_replace(prefix, "^-", "").startswith("0") & digit_allowed(prefix, digit, lo, hi)


def number_complete(text: Column, lo: Column, hi: Column) -> Column:
    """C20: whether a finished whole number lies in its range."""
    far = F.lit(float("inf"))
    whole = F.when(text.rlike("^-?[0-9]+$"), text.cast("double"))
    return F.coalesce(whole.between(F.coalesce(lo, -far), F.coalesce(hi, far)), F.lit(False))


def text_field(line: Column) -> Column:
    """The document of a JSON line: a bare string, or the first non-empty string of the known fields."""
    v = F.try_parse_json(line)
    is_text = lambda x: F.schema_of_variant(x) == "STRING"

    def field(name):
        got = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(is_text(got), F.nullif(got.cast("string"), F.lit("")))

    return F.when(is_text(v), v.cast("string")).otherwise(F.coalesce(*[field(n) for n in TEXT_FIELDS]))
