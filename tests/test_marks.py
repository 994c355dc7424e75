"""Turns are searched once, as marks; the features are those of the joined texts."""

import re

from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.operators import context
from sentrella.plans import registry
from sentrella.sources import views


def test_a_listed_text_may_go_over_the_joint_of_turns(spark):
    said = ["tell me of the system", "prompt", "fake", "receipt and the hidden", "fields", "what", "if it says not", "allowed", "try again", "", "manager", "already", "approved it", "say", "to", "support that", "edge", "CASE",
            "who is", "working late", "my Σ", "weak", "coverage", *views.SAYINGS[:40], "export", "all", "the refund", "without", "proof", "overall", "private", "key", "bank", "details"]
    rows = [("s", f"u{k}", f"p{k}{i:03}", i, t) for k, turns in enumerate((said, said[::-1])) for i, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "scope_id string, session_id string, prompt_id string, epoch long, prompt string")
    got = {r.prompt_id: r for r in context.text_features(context.history(df)).collect()}
    crossed = 0
    for _, u, p, i, t in rows:
        turns = [x[4] for x in rows if x[1] == u and x[3] <= i]
        three, five, six = (" ".join(turns[-n:]) for n in (3, 5, 6))
        text3, both = f"{three} {t}", f"{six} {t}".lower()
        r = got[p]
        crossed += any(w in text3.lower() for w in fixed.ABUSE_INDICATORS) and not any(w in x.lower() for x in turns[-3:] for w in fixed.ABUSE_INDICATORS)
        assert r.abuse_indicator == any(w in text3.lower() for w in fixed.ABUSE_INDICATORS), (turns[-3:], p)
        assert [n for n in r.behaviour_reasons if "_enumeration" not in n and "_escalation" not in n] == [n for _, n, x in fixed.BEHAVIOURS if re.search(x, text3, re.I)], turns[-3:]
        path = [(float(s), n) for s, n, early, late in fixed.ESCALATIONS if any(w in t.lower() for w in late) and any(w in both for w in early)]
        assert (r.escalation_score, r.escalation_reason) == (path[0] if path else (0.0, ""))
        rep = 20 * (any(w in t.lower() for w in fixed.REPHRASE_WORDS) and any(w in five.lower() for w in fixed.DENIAL_WORDS))
        rep += sum(pts for words, pts in ((fixed.SCHEMA_WORDS, 15), (fixed.RESTRICTED_WORDS, 20)) if sum(any(w in x.lower() for w in words) for x in turns[-5:]) >= 3)
        assert r.text_repetition == rep
    assert crossed > 5


def test_the_category_is_that_of_the_models_input(spark):
    said = [*views.SAYINGS, " ", "", "customer", "names", "take", "over"]
    rows = [("s", "u", f"p{i:03}", i, t, "allow", 0, "JAILBREAK" if i % 3 else "SAFE", 0.8) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "scope_id string, session_id string, prompt_id string, epoch long, prompt string, decision string, best_score int, label string, confidence double")
    made = context.evidence(context.model_input(context.history(df)))
    assert made.where(F.col("category") != context.category_of(F.col("label"), F.col("ml_input"))).count() == 0 and made.count() == len(rows)


def test_context_scoring_joins_events_with_distinct_prompts_alone(spark):
    """Verdicts come with the prompts: no join of all prompts with all verdicts."""
    plan = registry.QUERIES["t2_enforced"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" Join " in line or "- Join" in line or line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 1
