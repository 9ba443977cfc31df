"""Constrained text: prefixes, candidates, and pieces that fit (C19, C20, G01, G02, G06, G07, J17, C33); automaton.py has the calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import digit_allowed, number_complete
from tessera.operators.automaton import call_state  # noqa: F401


def trie(words: DataFrame, group: list[str], word: str) -> DataFrame:
    """A prefix tree as rows: (group..., prefix, next, terminal); next is null at a leaf."""
    w = words.select(*group, word).distinct()
    p = w.select(*group, word, F.explode(F.sequence(F.lit(0), F.length(word))).alias("n"))
    p = p.select(*group, F.substring(F.col(word), F.lit(1), F.col("n")).alias("prefix"), F.nullif(F.substring(F.col(word), F.col("n") + 1, F.lit(1)), F.lit("")).alias("next"))
    return p.groupBy(*group, "prefix").agg(F.sort_array(F.collect_set("next")).alias("next"), F.max(F.col("next").isNull()).alias("terminal"))


def candidates(vocabulary: DataFrame, words: DataFrame, prefix: str) -> DataFrame:
    """(id, piece) that can follow ``prefix`` within some word, or end it with a quote.

    Pieces meet the words left on the first character; if none fits, all pieces stay.
    """
    rest = words.filter(F.col("word").startswith(prefix)).select(F.substr("word", F.lit(len(prefix) + 1)).alias("rest")).distinct()
    goal = rest.select(F.concat("rest", F.lit('"')).alias("goal"))
    v = vocabulary.filter(F.col("piece") != "").withColumn("first", F.substring("piece", 1, 1))
    fit = v.join(goal.withColumn("first", F.substring("goal", 1, 1)), "first")
    # a piece may run past the closing quote: what follows the quote is free
    fits = fit.filter(F.col("goal").startswith(F.col("piece")) | F.col("piece").startswith(F.col("goal"))).select("id", "piece").distinct()
    any_ = fits.agg((F.count("*") > 0).alias("any"))
    return vocabulary.crossJoin(any_).join(fits.select("id").withColumn("ok", F.lit(True)), "id", "left").filter(F.col("ok") | ~F.col("any")).select("id", "piece")


def token_text(piece, is_control, is_byte):
    """What a vocabulary piece adds to the text."""
    code = F.conv(F.substring(piece, 4, 2), 16, 10).cast("int")
    return F.when(is_control, "").when(is_byte, F.char(code)).otherwise(F.replace(piece, F.lit("▁"), F.lit(" ")))


#: What may follow a value.
VALUE_ENDS = ",}] \t\r\n"


def number_fits(piece: Column, prefix: Column, lo: Column, hi: Column, most: int = 24) -> Column:
    """Whether a piece can go on a number begun as ``prefix`` that must lie in [lo, hi], null bounds being open.

    A piece is digits, each of which must leave the range reachable, and then nothing or an end, where the number is complete.
    No digit follows a lone zero, and only a range below zero takes a minus.
    """
    head = F.regexp_extract(piece, r"^-?[0-9]*", 0)
    tail = F.substr(piece, F.length(head) + 1)
    whole = F.concat(prefix, head)
    ok = (piece != "") & F.when(head.startswith("-"), (prefix == "") & (lo.isNull() | (lo < 0))).otherwise(True) & ~whole.rlike("^-?0[0-9]")
    steps = F.sequence(F.lit(1), F.least(F.length(head), F.lit(most)))
    digit = lambda i: (F.substr(head, i, F.lit(1)) == "-") | digit_allowed(F.concat(prefix, F.substr(head, F.lit(1), i - 1)), F.substr(head, i, F.lit(1)), lo, hi)
    walked = (F.length(head) == 0) | F.forall(steps, digit)
    ended = F.when(tail == "", True).otherwise(F.lit(VALUE_ENDS).contains(F.substr(tail, F.lit(1), F.lit(1))) & number_complete(whole, lo, hi))
    return ok & walked & ended


def bare_fits(piece: Column, rest: Column) -> Column:
    """Whether a piece can go on an unquoted choice of which ``rest`` is left: a part of it, or all and then an end."""
    past = F.substr(piece, F.length(rest) + 1)
    return (piece != "") & (rest.startswith(piece) | (piece.startswith(rest) & F.lit(VALUE_ENDS).contains(F.substr(past, F.lit(1), F.lit(1)))))


def await_fits(piece: Column, seen_colon: Column, value_fits) -> Column:
    """Whether a piece can stand between a key and its value: blanks, the colon unless seen, then a value that ``value_fits``."""
    trimmed = F.regexp_replace(piece, r"^\s+", "")
    colon = trimmed.startswith(":")
    value = F.when(seen_colon, trimmed).otherwise(F.regexp_replace(F.substr(trimmed, F.lit(2)), r"^\s+", ""))
    return F.when(~seen_colon & ~colon, False).otherwise((value == "") | value_fits(value))
