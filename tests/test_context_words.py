"""Patterns of the context stage are tried only where the words that they need occur."""

from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.functions.dialect import java, needed_all
from sentrella.operators import context, detect, sessions
from sentrella.sources import views

PATTERNS = [p for _, _, p in fixed.BEHAVIOURS] + [p for _, p in fixed.SAFE_INTENTS] + list(fixed.CAPABILITY_PATTERNS)


def test_every_set_of_needed_words_is_found():
    assert needed_all(r"\b(reset|verify)\b.{0,80}\b(Bypass|skip)s?\b") == [["reset", "verify"], ["bypass", "skip"]]
    assert needed_all(r"\d+|abc") == [] and needed_all("(") == []
    assert all(needed_all(p) for p in PATTERNS)


def test_words_lose_no_match(spark):
    said = [*views.SAYINGS, *[s for _, _, s, _, _ in views.TEMPLATES], "BYPA\u017f\u017f the \u017fecurity", "what can this bot do", "\u0130mmediately", "reset without proof, a refund that the manager approved", ""]
    df = spark.createDataFrame([(a + " " + b,) for a, b in zip(said, said[7:] + said[:7])], "t string")
    t = F.col("t")
    both = df.select(F.array(*[t.rlike(java(p, True)) for p in PATTERNS]).alias("plain"), F.array(*[context.occurs(t, detect.low(t), p) for p in PATTERNS]).alias("words")).collect()
    assert all(r.plain == r.words for r in both) and sum(map(sum, (r.plain for r in both))) > 50


def test_without_a_model_no_text_is_looked_at_and_the_step_says_the_same(spark):
    rows = [("local", f"s{i % 3}", "a/b", f"p{i:02d}", 1000 * i, views.SAYINGS[i], [0, 9, 13][i % 3], [], "unknown", ["allow", "block", "allow", "allow"][i % 4]) for i in range(40)]
    judged = spark.createDataFrame(rows, "scope_id string, session_id string, source string, prompt_id string, epoch long, prompt string, best_score int, matched_signatures array<string>, expected_label string, decision string").withColumn("refused", F.lit(False))
    verdicts = judged.select("prompt_id", F.lit("JAILBREAK").alias("label"), F.lit(0.97).alias("confidence"))
    got = context.score_context(judged, verdicts, reviewed=False)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString() and "gate_category" not in got.columns
    base = context.context_step(context.Policy(), False)
    read = context.evidence(context.history(judged.join(verdicts, "prompt_id"))).drop("hist")
    whole = sessions.fold(read, lambda state, row: (lambda x: (x[0], {**x[1], "t2_category": x[1]["category"]}))(base(state, row)), context.STEP_IN, context.STEP_OUT)
    names = ["prompt_id", *[x.strip().split(" ")[0] for x in context.STEP_OUT.split(",")]]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))
    assert {r.path for r in got.select("path").collect()} == {"layer1_blocked", "no_endpoint"}
