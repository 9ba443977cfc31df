import random

from pyspark.sql import functions as F

from tessera.llm import token_counts as t

TEXTS = [
    "", "Hello  wOrld's it'll DON'T 12.5%", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <|end", "ÀÉÎ ß Ÿ ſ ŉ ǰ İ", "Σίσυφος ΟΔΥΣΣΕΥΣ", "á é", "日本語テキスト です", "“quoted” — dash… €5",
    "tab\tnew\nline\x0bvt\x0cff\x1cfs\x1fus\x85nel nbsp em", "ǅ Ǆ ǆ Dž", "½ ² ³ ¼ ª º ٣", "emoji 😀👍🏽", "''''s 's'S 'LL", "a" * 5000, "İstanbul Iğdır", "Å Ω", "ȺȾ ɐ ʼn",
]


def test_counts_are_the_librarys():
    lib = t.tokenizer()
    r = random.Random(4)
    chars = "aAbB'sSlL 1½éÉßÿŸŁł.,-_<|>\n\t ’…€ıİŉſ"
    texts = TEXTS + ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(1500)] + [chr(i) + "a" + chr(i).upper() for i in range(0x250)]
    want = [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert t.Counting(lib)(texts) == want
    assert t.Counting(lib, {"hello": 1, "a": 1}, cache_size=5)(texts) == want


def test_rows_nulls_and_empty(spark):
    rows = [(1, "a b"), (None, None), (2, ""), (2, ""), (3, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, t.token_counts(docs).collect()), key=str)
    assert got == sorted([(1, 3, 2, False), (None, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 15000, 3000, True)], key=str)
    assert t.token_counts(docs.limit(0)).count() == 0
