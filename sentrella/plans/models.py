"""Queries that run a model over texts, and deliver messages to one that fails at times."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from sentrella.operators import scoring
from sentrella.plans import registry as R
from sentrella.plans.registry import query

#: A small linear model: words and their weights.
WORDS = {"password": 2.0, "system prompt": 3.0, "ignore": 1.5, "instructions": 1.0, "secret": 2.0, "bypass": 2.5, "export": 1.5, "order": -1.5, "please": -1.0, "hours": -2.0}
BIAS = -1.0


def linear():
    """Loads the model. Its replies come nested, flat, or, for some lengths, in no known shape;
    it refuses texts of two lengths."""

    def score(texts: list[str]) -> list[str]:
        if any(len(t) % 31 == 7 for t in texts):
            raise ValueError("text refused")
        out = []
        for t in texts:
            p = 1 / (1 + math.exp(-(BIAS + sum(w for x, w in WORDS.items() if x in t.lower()))))
            both = [{"label": "SAFE", "score": 1 - p}, {"label": "MALICIOUS", "score": p}]
            out.append({0: json.dumps([both]), 1: json.dumps(both), 2: json.dumps(sorted(both, key=lambda c: -c["score"])), 3: '{"error": "busy"}', 4: "[]", 5: json.dumps([1, both])}.get(len(t) % 6))
        return out

    return score


_P = "1 / (1 + exp(-(" + f"{BIAS}" + "".join(f" + CASE WHEN contains(lower(prompt), '{x}') THEN {w} ELSE 0 END" for x, w in WORDS.items()) + ")))"
MODEL = f"""said AS (SELECT *, length(prompt) % 31 = 7 AS refused_, length(prompt) % 6 IN (3, 4, 5) AS degraded, {_P} AS p FROM evt),
model AS (SELECT prompt_id, session_id, prompt, CASE WHEN refused_ THEN NULL WHEN degraded THEN 'SAFE' WHEN p > 1 - p THEN 'MALICIOUS' ELSE 'SAFE' END AS label, CASE WHEN NOT refused_ THEN CASE WHEN degraded THEN 0.0 ELSE greatest(p, 1 - p) END END::DOUBLE AS confidence,
  degraded AND NOT refused_ AS degraded, CASE WHEN refused_ THEN 'ValueError: text refused' END AS error FROM said)"""


def run(spark, sf):
    return scoring.scored(R.evt(spark, sf).select("prompt_id", "session_id", "prompt"), "prompt", linear)


@query(R.EVT + f", {MODEL} SELECT prompt_id, label, round(confidence, 6) AS confidence, degraded, error FROM model")
def t2_model(spark, sf):
    """A model's verdict on each prompt, or its error."""
    return run(spark, sf).select("prompt_id", "label", F.round("confidence", 6).alias("confidence"), F.coalesce("degraded", F.lit(False)).alias("degraded"), "error")


@query(R.EVT + f", {MODEL} SELECT count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NULL AND label = 'MALICIOUS' AND confidence >= 0.85) AS blocked, count(*) FILTER (trim(prompt) = '') AS skipped, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (degraded) AS degraded FROM model")
def t2_error_tally(spark, sf):
    """The tally of a run with failures."""
    return scoring.tally(run(spark, sf), (F.col("label") == "MALICIOUS") & (F.col("confidence") >= 0.85), F.trim("prompt") == "")


@query(R.EVT + f", {MODEL}, tries AS (SELECT *, length(prompt) % 8 AS fails FROM model) SELECT prompt_id, CASE WHEN error IS NOT NULL THEN 5 ELSE least(5, fails + 1) END AS attempts, CASE WHEN error IS NULL AND fails < 5 THEN 'delivered' ELSE 'dead_letter' END AS outcome, CASE WHEN fails < 5 THEN label END AS label, CASE WHEN fails >= 5 THEN 'busy' ELSE error END AS error FROM tries")
def t2_delivery(spark, sf):
    """Messages to a model that is busy for some texts at the first attempts and refuses others
    always: retried five times at most, then dead letters."""

    def handle(messages, attempt):
        busy = F.length("prompt") % 8 >= attempt
        got = scoring.scored(messages, "prompt", linear)
        return got.withColumns({"label": F.when(~busy, F.col("label")), "error": F.when(busy, "busy").otherwise(F.col("error"))}).drop("confidence", "degraded")

    return scoring.delivered(R.evt(spark, sf).select("prompt_id", "prompt"), handle).select("prompt_id", "attempts", "outcome", "label", "error")
