"""Texts against a table of patterns of any size: an inverted index instead of one expression.

Every pattern that can't match without some literal (``dialect.needed``) is filed under one
three-character gram of each of its literals, the one that the fewest texts hold. Texts are
filed under those of their grams that the index has. Text and pattern meet where a gram
joins them, and only such candidates are tried. The catalogue is never collected; patterns
that need no literal are few by nature, and are compiled into the texts' own pass (more than
BARE of them are refused).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrella.functions.dialect import java, needed
from sentrella.functions.plan import fence, written
from sentrella.operators.detect import low

GRAM, BARE = 3, 500


def grams(text: Column) -> Column:
    """The distinct grams of a text, by its characters (a position of a string isn't found at
    once). The characters are bound by an array of one element: a lambda would split the text
    anew for each place."""

    def of(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - GRAM)
        found = F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)])))
        return F.when(F.size(chars) >= GRAM, found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(F.split(text, "")), of))


def read(entries: DataFrame) -> DataFrame:
    """signature_id, the pattern in the JVM's dialect, and its needed literals (null: none)."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"signature_id": pdf["signature_id"], "pattern": [java(p) for p in pdf["pattern"]], "words": [needed(p) for p in pdf["pattern"]]})

    return entries.select("signature_id", "pattern").mapInPandas(each, "signature_id string, pattern string, words array<string>")


def hits(texts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts (tid, text, copies), and (tid, copies, signature_id) of every one and
    every pattern that it matches. A text moves twice, to meet its copies and its candidates;
    what is found moves by the text's number."""
    own = written(texts.select("text").where("text is not null").groupBy("text").agg(F.count("*").alias("copies")).withColumn("tid", F.monotonically_increasing_id()), "pattern-texts")
    table = written(read(entries), "pattern-entries")
    words = table.where("words is not null").select("signature_id", "pattern", F.explode("words").alias("word")).distinct()
    filed = words.withColumn("gram", F.explode(grams(F.col("word"))))
    # How many texts hold each gram that the index could use: summed in the map tasks.
    held = own.select("tid", F.explode(grams(low(F.col("text")))).alias("gram")).join(filed.select("gram").distinct(), "gram")
    held = written(held, "pattern-grams")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("signature_id", "pattern", "word").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    index = filed.join(often, "gram", "left").withColumn("r", rarest).where("r = 1").select("gram", "signature_id", "pattern", "word")
    candidates = held.join(index, "gram").groupBy("tid").agg(F.collect_set(F.struct("signature_id", "pattern", "word")).alias("found"))
    # A text travels once, with its candidates; the literal is sought before the pattern is tried.
    tried = fence(own.join(candidates, "tid").withColumn("low", low(F.col("text"))), "tid", "copies", "text", "found")
    matched = F.filter("found", lambda x: F.contains(F.col("low"), x["word"]) & F.regexp_like(F.col("text"), x["pattern"]))
    sought = tried.select("tid", "copies", F.array_distinct(F.transform(matched, lambda x: x["signature_id"])).alias("ids"))
    out = fence(sought, "tid", "copies").select("tid", "copies", F.explode("ids").alias("signature_id"))
    bare = table.where("words is null").select("signature_id", "pattern").limit(BARE + 1).collect()
    if len(bare) > BARE:
        raise ValueError(f"more than {BARE} patterns that need no literal")
    if bare:
        some = F.filter(F.array(*[F.when(F.col("text").rlike(r.pattern), F.lit(r.signature_id)) for r in bare]), lambda x: x.isNotNull())
        # An id may belong to patterns of both kinds.
        out = out.unionByName(own.select("tid", "copies", F.explode(some).alias("signature_id"))).distinct()
    return own, out


def matches(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(text, signature_id) of every text, counted once however often it occurs, and every pattern
    that it matches. ``texts`` has text, ``entries`` signature_id and pattern; null texts match
    nothing, equal ids of different patterns count as one signature."""
    own, found = hits(texts, entries)
    return found.join(own.select("tid", "text"), "tid").select("text", "signature_id")


def counts(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(signature_id, n): how many texts, copies included, each pattern occurs in."""
    return hits(texts, entries)[1].groupBy("signature_id").agg(F.sum("copies").alias("n"))
