import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus as C


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def cleaned(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = "\n".join(x.rstrip() for x in t.split("\n")).strip("\n")
    return re.sub("\n{3,}", "\n\n", t)


def test_clean_on_random_line_ends(spark):
    r = random.Random(0)
    texts = ["".join(r.choice(["a", "b c", " ", "\t", "\n", "\r", "\r\n", "\x1c", "\x1f", " ", " ", "\x0b"]) for _ in range(r.randrange(0, 25))) for _ in range(600)] + ["", "\n\n", " \n"]
    assert [v[0] for v in values(spark, texts, T.clean(F.col("t")))] == [cleaned(t) for t in texts]


def brackets(t, depth=64):
    stack, quoted, skip = [], False, False
    for c in t:
        if quoted:
            quoted, skip = (quoted if skip or c != '"' else False), (c == "\\" and not skip)
        elif c == '"':
            quoted = True
        elif c in "([{":
            stack.append(c)
            if len(stack) > depth:
                return False
        elif c in ")]}" and (not stack or "([{".index(stack.pop()) != ")]}".index(c)):
            return False
    return not stack and not quoted


def test_balanced(spark):
    r = random.Random(1)
    texts = ["".join(r.choice('()[]{}"\\ax') for _ in range(r.randrange(0, 12))) for _ in range(1500)] + ["(" * 64 + ")" * 64, "(" * 65 + ")" * 65, '"open', "", '{"a": "}"}']
    assert [v[0] for v in values(spark, texts, T.balanced(F.col("t")))] == [brackets(t) for t in texts]


def test_filter_branches(spark):
    line = "a line of some words that go on for long enough"
    good = "\n".join(f"{line} {i}" for i in range(10))
    cases = [
        (good, True), (None, False), ("", False), ("short", False), ("x" * 199, False), ("x" * 200, True), ("�" + "x" * 400, False), ("�" + "x" * 600, True), ("\x01" * 3 + "x" * 250, False), ("\x01" * 2 + "x" * 250, True),
        ("\n".join([line] * 8), True), ("\n".join([line] * 9), False), ("\n".join(["ab cd"] * 3 + [f"k{i} v" for i in range(60)]), False), ("( " + "x" * 300, True),
    ]
    got = [v[0] for v in values(spark, [c[0] for c in cases], C.keep(T.clean(F.col("t"))))]
    assert got == [c[1] for c in cases]
    assert values(spark, ["( " + "x" * 300], C.keep(F.col("t"), structured=True)) == [(False,)]


def test_markers_and_spans(spark):
    t = ["<|im_start|> a <tools>b</tools>\n", "no marks", "x [1, [2]] y {z}", "{a} b", "none"]
    got = values(spark, t, T.strip_markers(F.col("t")), T.between(F.col("t"), "<tools>", "</tools>"), T.outermost(F.col("t")))
    assert got[0][:2] == ("a b", "b") and got[1][:2] == ("no marks", "")
    assert [g[2] for g in got[2:]] == ["[1, [2]]", "{a}", None]
    spaced = values(spark, ['{"room":"kitchen"}'], T.pre_tokenize(F.col("t")), T.restore_json(T.pre_tokenize(F.col("t"))))
    assert spaced == [(' {  " room " : " kitchen "  } ', '{"room":"kitchen"}')]


def test_numbers_print_as_g(spark):
    r = random.Random(2)
    x = [0.0, 1.0, -2.5, 100000.0, 999999.0, 999999.5, 1e6, 1234567.0, 0.0001, 0.00001234, 1e-10, 21.0, 3.14159265, 1e20, -0.5] + [round(r.uniform(-1e7, 1e7), r.randrange(0, 6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    assert [v.t for v in df.select("i", T.number_text(F.col("x")).alias("t")).orderBy("i").collect()] == [f"{v:g}" for v in x]


def test_digit_walker(spark):
    def brute(prefix, digit, lo, hi):
        """Whether some number of so many digits as the bound has starts so and lies in the range."""
        c = prefix + digit
        n = len(str(abs(int(lo if c.startswith("-") else hi)))) - len(c.lstrip("-"))
        return any(lo <= int(c + (str(x).zfill(k) if k else "")) <= hi for k in range(max(n, 0) + 1) for x in range(10**k))

    rows = [(p, g, lo, hi) for p in ("", "-", "1", "-1", "12", "-4") for g in "0159" for lo, hi in ((50.0, 100.0), (0.0, 9.0), (-20.0, 30.0), (-150.0, -120.0))]
    df = spark.createDataFrame(rows, "p string, g string, lo double, hi double")
    got = {tuple(r)[:4]: r.ok for r in df.select("*", T.digit_allowed(F.col("p"), F.col("g"), F.col("lo"), F.col("hi")).alias("ok")).collect()}
    assert got == {r: brute(*r) for r in rows}
    v = values(spark, ["5", "-", "", "07", "101"], T.number_complete(F.col("t"), F.lit(1.0), F.lit(100.0)))
    assert [x[0] for x in v] == [True, False, False, True, False]


def test_names(spark):
    v = values(spark, ["params/Layers/self_attn/attn/out_proj/kernel", "layer10.w", "layer2.w", "head_a/b", "kernel"], T.canonical_name(F.col("t"), ["params", "layers", "kernel"], {"self_attn": "attn"}, ["head_"]), T.natural_key(F.col("t")), T.snake(F.lit("HTTPServerName")))
    assert [x[0] for x in v] == ["attn.out_proj", "layer10.w", "layer2.w", "head.a.b", "kernel"]
    assert v[2][1] < v[1][1] and v[0][2] == "http_server_name"


def test_no_digit_follows_a_lone_zero(spark):
    df = spark.createDataFrame([("0", "3"), ("-0", "3"), ("", "0"), ("1", "0"), ("-", "3")], "p string, g string")
    got = {(r.p, r.g): r.ok for r in df.select("*", T.digit_follows(F.col("p"), F.col("g"), F.lit(-50.0), F.lit(50.0)).alias("ok")).collect()}
    assert got == {("0", "3"): False, ("-0", "3"): False, ("", "0"): True, ("1", "0"): True, ("-", "3"): True}


def test_numbers_print_with_more_digits(spark):
    r = random.Random(3)
    x = [0.0, 10000.25, 1500000.75, 6e6, 999999999999999.0, 1e15, 0.1, 1 / 3, -2.5e-7, 99999.9999999] + [r.randrange(10**8) / 4 for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double").select("i", T.number_text(F.col("x"), 15).alias("a"), T.number_text(F.col("x"), 9).alias("b"))
    assert [(v.a, v.b) for v in df.orderBy("i").collect()] == [(f"{v:.15g}", f"{v:.9g}") for v in x]
