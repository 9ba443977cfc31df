"""Operator 4: personal data, by fixed patterns and bootstrapped contextual extraction.

Base spans of four kinds come from fixed patterns. They seed the extraction, and so do strings of 32 to 64 hexadecimal
digits that are assigned in quotes, as seeds of a fifth kind, secret, which has no base spans. The tokens around an entity
(words and punctuation marks) make its lexical patterns: the two and the three before it, and the one before with the one
after; a pattern of punctuation alone says nothing and isn't kept. Candidates are identifier-like tokens and groups of
digits that no base span covers.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence for a kind is the summed score of its
known instances of the kind over the number of all its instances plus one; it counts from half of ``threshold`` on, if it
is met with ``min_seeds`` known ones. A candidate's score is the noisy-or over its patterns; with ``threshold`` or more, and a shape that
fits the kind, it is known from the next round on, so that what was found induces patterns as the seeds do. Rounds end
when nothing changes, or after ``rounds``. The occurrences of found instances in counting patterns are added as spans,
and so are those of seeds of secrets. Base spans stay as they are.

A candidate is a token of 5 to 128 characters between white space, stripped of punctuation, with a digit or an @, or a
run of 7 to 19 digits in groups joined by single blanks, dots, hyphens or brackets.

Defined results: a null text counts as empty: no spans. Offsets are code points, end exclusive. Repeated rows and null
ids come back one by one; extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Kinds in their fixed order; the last has no base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match starts inside a run of digits but after an earlier one, which takes the whole run.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SIGN = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\w+|[^\w\s]")
ASSIGNED = re.compile(r"[=:]\s?[\"']([0-9A-Fa-f]{32,64})[\"']")
GROUPS = re.compile(r"(?<![0-9])[+(]?[0-9]+(?:(?:[ .-]|\) ?| ?\()[0-9]+)+")
#: The longest candidate.
LONGEST = 128
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str):
    """Leftmost matches, found from each @: what stands before it in the class of local parts starts the match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _luhn(digits: str) -> bool:
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(DOUBLED[x] for x in d[-2::-2])) % 10 == 0


def _cards(text: str):
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m.group())
        if 14 <= len(d) <= 19 and _luhn(d):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if SIGN.search(text):
        out += [(a, 1, b) for a, b in _ips(text)]
        out += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in _phones(text)]
    return sorted(out)


def _fits(kind, token):
    """Whether a candidate's shape allows the kind."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    secret = (F.length(token) >= 16) & (digits > 0) & ~token.contains(" ") & ~token.contains("@")
    return F.when(kind == 0, token.contains("@")).when(kind == 1, (dots >= 3) & (digits >= 4)).when(kind == 2, digits.between(12, 19)).when(kind == SECRET, secret).otherwise(digits.between(7, 15))


def _named(token: str) -> str:
    """A token in lower case, a very long one by its digest."""
    token = token.lower()
    return token if len(token) <= 64 else hashlib.sha1(token.encode("utf-8", "surrogatepass")).hexdigest()


def _before(text: str, end: int, n: int) -> list[str]:
    """The last ``n`` tokens before ``end``, whole ones."""
    size = 48
    while True:
        start = max(0, end - size)
        found = TOKEN.findall(text, start, end)
        if len(found) > n or not start:  # the first one may be cut
            return [_named(t) for t in found[-n:]]
        size *= 4


def _patterns(text: str, start: int, end: int) -> list[str]:
    before = _before(text, start, 3)
    after = TOKEN.search(text, end)
    out = [("L", before[-n:]) for n in (2, 3) if len(before) >= n]
    if before and after:
        out.append(("B", [before[-1], "_", _named(after.group())]))
    return [f"{kind} {' '.join(p)}" for kind, p in out if any(t != "_" and t[0].isalnum() for t in p)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of identifier-like tokens and groups of digits outside the base spans."""
    runs = [m.span() for m in GROUPS.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 19]
    found, last = [(a, b) for a, b in runs if any(c.isspace() for c in text[a:b])], 0
    for m in SIGN.finditer(text):
        i = m.start()
        if i < last:
            continue
        a = b = i
        while a > 0 and i - a <= LONGEST and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - i <= LONGEST and not text[b].isspace():
            b += 1
        last = b
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while a < b and not text[b - 1].isalnum() and text[b - 1] != ")":
            b -= 1
        if 5 <= b - a <= LONGEST:
            found.append((a, b))
    # base spans first, then the longer candidates; nothing overlaps what is taken already
    out, taken = [], sorted((a, e) for a, _, e in base)
    for a, b in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        k = bisect.bisect_left(taken, (b,))
        if all(e <= a for _, e in taken[max(0, k - len(KINDS)) : k]):
            bisect.insort(taken, (a, b))
            out.append((a, b))
    return sorted(out)


def _row(text: str):
    base = base_spans(text)
    seen = [(p, text[a:b].lower(), a, b, kind) for a, kind, b in base for p in _patterns(text, a, b)]
    if SIGN.search(text):
        secrets = {m.span(1) for m in ASSIGNED.finditer(text)}
        seen += [(p, text[a:b].lower(), a, b, SECRET if (a, b) in secrets else -1) for a, b in candidates(text, base) for p in _patterns(text, a, b)]
    return base, seen


SPAN = "struct<start: int, kind: int, end: int>"
SEEN = "struct<pattern: string, instance: string, start: int, end: int, kind: int>"


def _scan(docs: DataFrame) -> DataFrame:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [_row(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([[dict(zip(("start", "kind", "end"), s)) for s in base] for base, _ in rows], pa.list_(span)),
                        pa.array([hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in base).encode()).hexdigest() for base, _ in rows]),
                        pa.array([[dict(zip(("pattern", "instance", "start", "end", "kind"), s)) for s in found] for _, found in rows], pa.list_(seen)),
                    ],
                    names=["doc_id", "base", "base_sha256", "seen"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, base array<{SPAN}>, base_sha256 string, seen array<{SEEN}>")


def _noisy_or(confidence):
    return 1 - F.exp(F.sum(F.log(1 - F.least(confidence, F.lit(0.999999)))))


def discover(seen: DataFrame, where: str, rounds: int = 6, min_seeds: int = 5, threshold: float = 0.9) -> DataFrame:
    """(pattern, instance, kind): the found instances, and seeds of secrets, with the counting patterns that they stand in.

    ``seen`` has pattern, instance and kind (-1: not known) per occurrence.
    """
    edges = common.written(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), f"{where}/edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("kind >= 0").select("instance", F.col("kind").alias("of"), F.lit(1.0).alias("score")).distinct()
    known, before = seeds, None
    for i in range(rounds):
        support = edges.join(known, "instance").groupBy("pattern", "of").agg(F.sum("score").alias("score"), F.count("*").alias("known"))
        good = support.filter(F.col("known") >= min_seeds).join(size, "pattern").select("pattern", "of", (F.col("score") / (F.col("n") + 1)).alias("conf"))
        good = common.written(good.filter(F.col("conf") >= threshold / 2), f"{where}/good{i}")
        votes = edges.filter("kind < 0").join(good, "pattern").filter(_fits(F.col("of"), F.col("instance")))
        new = votes.groupBy("instance", "of").agg(_noisy_or(F.col("conf")).alias("score")).filter(F.col("score") >= threshold)
        new = common.written(new, f"{where}/new{i}")
        known = seeds.unionByName(new)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("instance", "of").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.filter("kind < 0").join(new.select("instance", "of"), "instance").unionByName(edges.filter(F.col("kind") == SECRET).withColumn("of", F.col("kind")))
    return found.join(good, ["pattern", "of"]).select("pattern", "instance", F.col("of").alias("kind"))


def find(docs: DataFrame, **k) -> DataFrame:
    """(doc_id, base, base_sha256, added, n_discovered) per row of ``docs``; base and added are arrays of (start, kind, end).

    ``added`` has the spans of discovered instances, and those of seeds of secrets; ``n_discovered`` counts the former alone."""
    where = common.shared_dir(docs.sparkSession)
    rows = common.written(_scan(docs).withColumn("row", F.monotonically_increasing_id()), f"{where}/rows")
    seen = rows.filter(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    found = common.written(discover(seen, f"{where}/graph", **k), f"{where}/found")
    common.removed(docs.sparkSession, f"{where}/graph")
    new = seen.filter(f"kind < 0 or kind = {SECRET}").withColumnRenamed("kind", "own").join(found, ["pattern", "instance"])
    # one kind per token: the first in order
    added = new.groupBy("row", "start", "end").agg(F.min("kind").alias("kind"), F.max(F.col("own") < 0).alias("discovered"))
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"), F.count_if("discovered").alias("n_discovered"))
    out = rows.join(added, "row", "left")
    return out.select("doc_id", "base", "base_sha256", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"), F.coalesce("n_discovered", F.lit(0)).alias("n_discovered"))


def joined(spans):
    """kind:start:end by start, then kind, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(k: int):
    return lambda x: x == k  # a second parameter would be taken for the element's place


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents; secrets, which aren't of the four kinds, in a column of their own."""
    n = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _equals(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:SECRET])]
    secret = F.filter("added", lambda s: s["kind"] == SECRET)
    every = F.concat("base", F.filter("added", lambda s: s["kind"] < SECRET))
    return find(common.documents(spark, sf_dir)).select("doc_id", *n, "base_sha256", joined(every).alias("spans"), F.col("n_discovered").cast("long").alias("n_discovered"), joined(secret).alias("secrets"), F.size(every).cast("long").alias("n_spans"))
