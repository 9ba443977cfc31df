"""The registered opN_ queries on the smallest tables, column by column, against brute force or their DuckDB twins."""

import hashlib
import math
import os
import zlib

import duckdb
import pytest
import xxhash

from tessera.llm import registry
from tests.llm.test_katz import Brute, same
from tests.llm.test_pii import bootstrap, brute

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def rows(spark, name):
    return registry.QUERIES[name](spark, D).collect()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twins(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_op1(spark, docs):
    import re

    prints = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op1_simhash")}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op3(spark, con):
    x = dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    got = {}
    for r in rows(spark, "op3_neighbours"):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    cos = lambda a, b: dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b))
    hits = 0
    for q in (i for i in x if i % 50 == 0):
        best = sorted((-cos(x[q], x[i]), i) for i in x if i != q)[:5]
        g = sorted(got[q])
        assert [k for k, _, _ in g] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos(x[q], x[i]), rel=1e-12) for _, i, s in g)
        hits += len({i for _, i in best} & {i for _, i, _ in g})
    assert hits >= 0.95 * 5 * len(got)


def test_op4(spark, docs):
    name = ("email", "ip", "card", "phone", "secret")
    added = bootstrap([t or "" for _, t in docs])
    said = lambda spans: ",".join(f"{name[k]}:{a}:{b}" for a, k, b in sorted(spans))
    want = {}
    for (i, t), more in zip(docs, added):
        base = brute(t or "")
        want[i] = (*[sum(k == kind for _, k, _ in base) for kind in range(4)], hashlib.sha256(said(base).encode()).hexdigest(), said(base + [x for x in more if x[1] < 4]), said([x for x in more if x[1] == 4]))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.secrets) for r in rows(spark, "op4_pii")}
    assert got == want


def test_op5(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    import re

    b = Brute.__new__(Brute)
    import tests.llm.test_katz as k

    before = k.tokens
    k.tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    try:
        b.__init__([t for i, t in docs if not held(i)], 2)
        same([tuple(r) for r in rows(spark, "op5_katz")], [b.row(i, held(i), t) for i, t in docs])
    finally:
        k.tokens = before


def test_op7(spark, con, docs):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = rows(spark, "op7_language_id")
    assert sorted(r.doc_id for r in got) == [i for i, _ in docs]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op8(spark, docs):
    size = {i: len((t or "").encode()) + 8 for i, t in docs}
    got = rows(spark, "op8_shards")
    assert {r.doc_id: r["size"] for r in got} == size and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert {r.doc_id: r.text_crc32 for r in got} == {i: zlib.crc32((t or "").encode()) for i, t in docs}
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(i)
    place = {r.doc_id: r.shard for r in got}
    assert all(len({place[i] for i in g}) == 1 for g in groups.values())
    # the loads are those of the one-by-one schedule
    loads = [0] * 24
    for n in sorted((sum(size[i] for i in g) for g in groups.values()), reverse=True):
        k = loads.index(min(loads))
        loads[k] += n
    assert sorted(sum(r["size"] for r in got if r.shard == k) for k in range(24)) == sorted(loads)
    for k in range(24):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_op9(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    n = {i: len(lib.encode(t or "", add_special_tokens=False)) for i, t in docs}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op9_token_counts")}
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 2048) for i, t in docs}
