"""A model of any kind over texts, and the delivery of messages to something that may fail.

A model is a function that loads a scorer; the scorer takes a list of texts and gives a reply
for each, as an endpoint would: JSON of candidates with label and score. It is loaded once in a
Python worker, gets batches, and has a time limit. A batch that fails is tried row by row, so
one bad text fails alone; its error is a column, not an exception. Replies of an unknown shape
count as SAFE with confidence 0 and are marked degraded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrella.functions.plan import written

Scorer = Callable[[list[str]], list[str]]
BATCH, SECONDS, ERROR_CHARS, RECEIVES = 64, 30.0, 500, 5
CANDIDATE = "struct<label:string,score:double>"

_loaded: dict[Callable, Scorer] = {}


def called(scorer: Scorer, texts: list[str], seconds: float) -> list[str]:
    """The replies to a batch, or an error after ``seconds``. A call that hangs keeps its thread."""
    pool = ThreadPoolExecutor(1)
    try:
        replies = pool.submit(scorer, texts).result(timeout=seconds)
    except TooLate:
        raise TimeoutError(f"no reply in {seconds:g} s") from None
    finally:
        pool.shutdown(wait=False)
    if len(replies) != len(texts):
        raise ValueError(f"{len(replies)} replies to {len(texts)} texts")
    return replies


def replies(text: Column, load: Callable[[], Scorer], batch: int = BATCH, seconds: float = SECONDS) -> Column:
    """struct<reply, error> of each text. ``load`` is a function of a module, so that a worker
    knows it again."""

    @F.pandas_udf("struct<reply:string,error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if load not in _loaded:
            _loaded[load] = load()
        scorer = _loaded[load]

        def tried(texts: list[str]) -> list[tuple]:
            try:
                return [(r, None) for r in called(scorer, texts, seconds)]
            except Exception as e:  # noqa: BLE001 (whatever a model raises is the row's error)
                if len(texts) > 1:
                    return [x for t in texts for x in tried([t])]
                return [(None, f"{type(e).__name__}: {e}"[:ERROR_CHARS])]

        for part in parts:
            texts = [t or "" for t in part]
            yield pd.DataFrame([x for at in range(0, len(texts), batch) for x in tried(texts[at : at + batch])], columns=["reply", "error"])

    return run(text)


def verdict(reply: Column) -> Column:
    """struct<label, confidence, degraded> of a reply: the candidate of the largest score, of a
    list or of the first list in a list."""
    flat, nested = F.from_json(reply, f"array<{CANDIDATE}>"), F.from_json(reply, f"array<array<{CANDIDATE}>>")
    first = lambda c: F.filter(c, lambda x: x["label"].isNotNull() | x["score"].isNotNull())
    candidates = F.when(F.size(first(F.get(nested, F.lit(0)))) > 0, first(F.get(nested, F.lit(0)))).otherwise(first(flat))
    best = F.array_max(F.transform(candidates, lambda x, i: F.struct(F.coalesce(x["score"], F.lit(0.0)).alias("by"), (-i).alias("i"), x.alias("x"))))["x"]
    known = best["label"].isNotNull() & best["score"].isNotNull()
    return F.struct(F.when(known, best["label"]).otherwise("SAFE").alias("label"), F.when(known, best["score"]).otherwise(0.0).alias("confidence"), (~F.coalesce(known, F.lit(False))).alias("degraded"))


def scored(rows: DataFrame, text: str, load: Callable[[], Scorer], batch: int = BATCH, seconds: float = SECONDS) -> DataFrame:
    """``rows`` with label, confidence, degraded and error; each different text is scored once."""
    texts = rows.select(text).distinct().withColumn("r", replies(F.col(text), load, batch, seconds))
    read = texts.select(F.col(text).alias("_text"), F.col("r.error").alias("error"), F.when(F.col("r.error").isNull(), verdict(F.col("r.reply"))).alias("v"))
    both = rows.join(read, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")
    return both.select(*rows.columns, "v.label", "v.confidence", "v.degraded", "error")


def tally(rows: DataFrame, blocked: Column, skipped: Column) -> DataFrame:
    """Counts of one run: rows that can't be read are skipped, failed ones errors, all others
    processed, and of those the blocked."""
    fine = ~skipped & F.col("error").isNull()
    return rows.agg(F.count_if(fine).alias("processed"), F.count_if(fine & blocked).alias("blocked"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & F.col("error").isNotNull()).alias("errors"), F.count_if(F.coalesce("degraded", F.lit(False))).alias("degraded"))


def delivered(messages: DataFrame, handle: Callable[[DataFrame, int], DataFrame], receives: int = RECEIVES) -> DataFrame:
    """At-least-once delivery: ``handle(messages, attempt)`` adds an error (null: done) and any
    results. The failed part of a round is queued again, and what has failed ``receives`` times
    goes to the dead letters. Adds attempts and outcome (delivered, dead_letter).

    Each round is written to the shared folder, so attempt counts and results outlive executors
    and a round's successes aren't handled again by the next."""
    waiting, out = messages, None
    for attempt in range(1, receives + 1):
        tried = written(handle(waiting, attempt).withColumn("attempts", F.lit(attempt)), "delivery")
        last = attempt == receives
        here = tried if last else tried.where("error IS NULL")
        here = here.withColumn("outcome", F.when(F.col("error").isNull(), "delivered").otherwise("dead_letter"))
        out = here if out is None else out.unionByName(here)
        if last or not tried.where("error IS NOT NULL").limit(1).count():
            break
        waiting = tried.where("error IS NOT NULL").select(*messages.columns)
    return out
