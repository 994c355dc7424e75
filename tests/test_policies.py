"""The policy in force, by brute force over odd logs, and what the stages do with it."""

import random

import pytest
from pyspark.sql import functions as F

from sentrella.operators import context, correlate, policies

LOG = "scope_id string, updated_at long, policy_version string, tier2_mode string, tier2_default_kill_threshold string"


@pytest.mark.parametrize("bin_seconds", [7, 100, 10_000])
def test_as_of_equals_brute_force(spark, bin_seconds):
    rng = random.Random(bin_seconds)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    rows = [(i, key(), rng.choice([None, *range(-50, 400)]) if i % 20 == 0 else rng.randrange(-50, 400)) for i in range(800)]
    marks = [(key(), rng.choice([t := rng.randrange(0, 300), t // 10 * 10, None if rng.random() < 0.1 else t]), f"{v:03d}") for v in range(60)]
    got = policies.as_of(spark.createDataFrame(rows, "id long, k string, t long").repartition(3), spark.createDataFrame(marks, "k string, at long, v string"), ["k"], "t", "at", ["v"], bin_seconds)
    assert got.columns == ["id", "k", "t", "v"]
    found = {r.id: r.v for r in got.collect()}
    assert len(found) == got.count() == len(rows)
    for i, k, t in rows:
        held = [(at, v) for mk, at, v in marks if k is not None and mk == k and at is not None and t is not None and at <= t]
        assert found[i] == (max(held)[1] if held else None), (i, k, t)


def test_rows_and_marks_of_one_time_are_merged_not_paired(spark):
    rows = spark.range(2000).selectExpr("id", "'a' AS k", "id % 50 AS t")
    marks = spark.range(2000).selectExpr("'a' AS k", "id % 50 AS at", "format_string('%05d', id) AS v")
    got = policies.as_of(rows, marks, ["k"], "t", "at", ["v"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert all(int(r.v) == 1950 + r.t for r in got.collect()) and got.count() == 2000


def test_defaults_never_enforce(spark):
    rows = spark.createDataFrame([("s", 10), ("s", 5), ("t", 10), (None, 10)], "scope_id string, epoch long")
    log = spark.createDataFrame([("s", 7, "4", "enforce", "2"), ("s", 8, "5", " ENFORCE", "bad"), ("s", 11, "6", "off", None)], LOG)
    switches = spark.createDataFrame([(9, True, True, True, True)], "updated_at long, global_kill boolean, tier2_kill boolean, tier3_kill boolean, enforcement boolean")
    got = {(r.scope_id, r.epoch): r for r in policies.in_force(rows, log, switches).collect()}
    first, later = got["s", 5], got["s", 10]
    assert (later.tier2_mode, later.policy_version, later.tier2_default_kill_threshold, later.global_kill) == ("enforce", 5, 0.97, True)
    for r in (first, got["t", 10], got[None, 10]):
        assert r.tier2_mode == r.tier3_mode == "shadow" and r.policy_version == 1
    assert not first.global_kill and got["t", 10].global_kill
    empty = policies.in_force(rows, log.limit(0), switches.limit(0)).collect()
    assert len(empty) == 4 and not any(r.global_kill or r.enforcement for r in empty)


ROW = {"epoch": 1, "decision": "allow", "regex_score": 80.0, "category": "credential_theft", "text_repetition": 0.0, "behaviour_score": 60.0, "escalation_score": 0.0, "model_score": 90.0, "category_score": 50.0, "discount": 0.0, "abuse_indicator": True, "safe": False, "label": "JAILBREAK", "confidence": 0.98}
ON = {"tier2_mode": "enforce", "kill_threshold": 0.9, "min_malicious": 2, "single_threshold": 0.99, "session_kill_score": 120.0, "global_kill": True, "tier2_kill": True, "enforcement": True}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"global_kill": False}, "global_kill_disabled"), ({"tier2_kill": False}, "tier2_kill_disabled"), ({"enforcement": False}, "enforcement_not_configured"), ({"tier2_mode": "shadow"}, "tenant_mode_not_enforce"), ({"label": "SAFE"}, "model_label_not_malicious"),
        ({"kill_threshold": 0.985}, "confidence_below_threshold"), ({"safe": True}, "safe_intent_gate_blocked"), ({"model_score": 0.0, "regex_score": 0.0, "category_score": 0.0}, "prompt_score_below_kill_threshold"), ({"category": "generic_malicious"}, "generic_malicious_not_enough"),
        ({"category": "reconnaissance"}, "repeated_evidence_required"), ({"category": "reconnaissance", "min_malicious": 1}, "kill_eligible_repeated_or_session_score"), ({"category": "reconnaissance", "session_kill_score": 40.0}, "kill_eligible_repeated_or_session_score"),
        ({"category": "prompt_injection"}, "session_score_below_threshold"), ({"category": "prompt_injection", "single_threshold": 0.95}, "kill_eligible_obvious_extreme_confidence"), ({"tier2_mode": "off"}, "off"),
    ],
)
def test_every_reason_of_the_policy_that_a_row_carries(change, reason):
    _, out = context.context_step(None)(None, ROW | ON | change)
    assert out["reason"] == reason and out["kill"] == reason.startswith("kill_eligible")


def test_findings_under_their_own_policies(spark):
    base = {"method": "exact_hash", "group_category": "credential_theft", "would_have_killed": True, "group_score": 95.0, "sessions": 5, "confidence": 0.95, "threshold_used": "x", "decision": "grouped_malicious", "tier3_mode": "enforce", "tier3_min_sessions_for_kill": 3, "tier3_similarity_threshold": 0.9, "tier3_kill_threshold": 0.95, "global_kill": True, "tier3_kill": True, "enforcement": True}
    cases = [({}, ""), ({"tier3_mode": "shadow"}, "tenant_mode_not_enforce"), ({"global_kill": False}, "global_kill_disabled"), ({"tier3_kill": False}, "tier3_kill_disabled"), ({"enforcement": False}, "enforcement_not_configured"), ({"group_score": 89.9}, "group_score_below_threshold"), ({"tier3_min_sessions_for_kill": 6}, "affected_sessions_below_threshold"), ({"tier3_kill_threshold": 0.96}, "confidence_below_threshold"), ({"tier3_similarity_threshold": 0.96}, "similarity_below_threshold"), ({"method": "session_risk_burst", "group_category": "unknown"}, "generic_pattern_alert_only"), ({"method": "session_risk_burst"}, "method_not_enforcement_eligible"), ({"would_have_killed": False}, "x")]
    rows = spark.createDataFrame([{**base, **c, "id": i} for i, (c, _) in enumerate(cases)])
    got = {r.id: r for r in correlate.guarded(rows, None).collect()}
    for i, (_, reason) in enumerate(cases):
        assert got[i].kill_denied_reason == reason and got[i].kill_triggered == (reason == "") and got[i].action == ("kill" if reason == "" else "grouped_alert_only")


def test_scope_of_many_rows_keeps_its_versions(spark):
    """A third of all rows in one scope, thousands of versions: rows meet those of their bin only."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 100).cast("string"))).alias("k"), (F.col("id") * 7 % 100_000).alias("t"))
    marks = spark.range(2_000).select(F.lit("hot").alias("k"), (F.col("id") * 50).alias("at"), F.col("id").alias("v"))
    got = policies.as_of(rows, marks, ["k"], "t", "at", ["v"], 500)
    wrong = got.where(F.when(F.col("k") == "hot", ~F.col("v").eqNullSafe(F.floor(F.col("t") / 50))).otherwise(F.col("v").isNotNull()))
    assert wrong.count() == 0 and got.count() == 30_000
