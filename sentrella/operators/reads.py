"""Read side: dashboards, search, evaluation, policy and sinks.

``as_of`` (epoch seconds) stands for the clock, so that every query is repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrella.functions import scalars as S
from sentrella.functions.text import title

INTERVALS = {"5m": 300, "15m": 900, "1h": 3600, "6h": 21600}
NONE = "array<string>"


def scoped(df: DataFrame, scope: str = "local", source: str = "") -> DataFrame:
    out = df.where(F.col("scope_id") == scope)
    return out.where(F.col("source") == source) if source else out


def events_of(judged: DataFrame) -> DataFrame:
    """The audit event of every evaluated prompt."""
    return judged.where(~F.coalesce("refused", F.lit(False))).select(
        F.concat(F.lit("tier1#"), "prompt_id").alias("event_id"), F.col("epoch").alias("event_ts"), "session_id", "scope_id", "source", "decision", "matched_signatures",
        F.col("best_score").alias("risk_score"), F.col("risk_intents").alias("attack_intents"), F.col("policy_rules").alias("matched_policy_rules"), F.lit(None).cast("string").alias("provenance"),
    )


def recent_events(events: DataFrame, as_of: Column | int, hours: int, scope: str = "local", source: str = "") -> DataFrame:
    return scoped(events, scope, source).where(F.col("event_ts") >= (F.lit(as_of) if isinstance(as_of, int) else as_of) - hours * 3600)


def sessions(registry: DataFrame, as_of: Column) -> DataFrame:
    """Unexpired sessions by status, latest first inside each (a range sort over all tasks)."""
    order = F.coalesce(F.nullif("last_evaluated_at", F.lit(0)), "created_at")
    found = registry.where(F.col("ttl") >= as_of).orderBy("status", F.desc(order), "session_id")
    return found.select("session_id", "source", "status", "last_decision", "last_risk_score", "last_evaluated_at")


def timeline(events: DataFrame, interval: str = "1h") -> DataFrame:
    """Counts by bucket; whatever isn't a block counts as allowed; empty buckets don't appear."""
    n = INTERVALS.get(interval, 3600)
    bucket = F.col("event_ts") - F.pmod("event_ts", F.lit(n))
    return events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("detections"), F.count_if(F.col("decision") == "block").alias("blocks"), F.count_if(~F.col("decision").eqNullSafe("block")).alias("allows"))


def _signals(otherwise: Column) -> Column:
    return F.when(F.size("matched_signatures") > 0, F.col("matched_signatures")).otherwise(otherwise)


def by_category(events: DataFrame) -> DataFrame:
    """Blocked events by signature, else by rule, else 'policy', with their percentage."""
    policy = F.array(F.lit("policy"))
    s = _signals(F.when(F.size("matched_policy_rules") > 0, F.col("matched_policy_rules")).otherwise(policy))
    counts = events.where("decision = 'block'").select(F.explode(s).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("percentage"))  # one row on the right


def by_signature(events: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent signatures of blocked events (a top-k report)."""
    rows = events.where("decision = 'block'").select(F.explode(_signals(F.array(F.lit("policy")))).alias("signature_id"), "event_ts")
    return rows.groupBy("signature_id").agg(F.count("*").alias("hits"), F.max("event_ts").alias("last_seen")).orderBy(F.desc("hits"), "signature_id").limit(top)


def kpis(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col("decision") == "block").alias("blocked"), F.floor(100 * F.count_if(F.col("decision") == "block") / F.nullif(F.count("*"), F.lit(0)) + 0.5).cast("bigint").alias("block_rate"), F.coalesce(F.max("risk_score"), F.lit(0)).alias("max_risk"),
    )


def context_kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("kill").alias("kills"), F.count_if(F.col("verdict").isin("watch", "suspicious", "high_risk")).alias("raised"), F.count("*").alias("reviewed"))


def distinct_sources(*tables: DataFrame) -> DataFrame:
    parts = [t.select(F.trim("source").alias("source")).distinct() for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("source <> ''").distinct()


def search(history: DataFrame, as_of: Column, scope: str = "local", source: str = "", session: str = "", decision: str = "", keyword: str = "", min_risk: int = 0, hours: int = 24, limit: int = 100) -> DataFrame:
    """Newest matching prompts. The limit (1 to 500) is the search's own; hours go to 2,160."""
    df = scoped(history, scope, source).where(F.col("epoch") >= as_of - max(1, min(hours, 2160)) * 3600)
    if session:
        df = df.where(F.contains(F.lower("session_id"), F.lit(session.lower())))
    if decision:
        df = df.where(F.lower("decision") == decision.lower())
    if keyword:
        df = df.where(F.contains(F.lower("prompt"), F.lit(keyword.lower())))
    if min_risk:
        df = df.where(F.col("best_score") >= min_risk)
    return df.orderBy(F.desc("epoch"), F.desc("prompt_id")).limit(max(1, min(limit, 500)))


def history_kpis(history: DataFrame) -> DataFrame:
    return history.agg(F.count_if(F.col("decision") == "block").alias("blocked"), F.max("best_score").alias("max_risk"), F.count_distinct(F.nullif("session_id", F.lit(""))).alias("sessions"), F.count("*").alias("records"))


def evidence(scored: DataFrame, top: int = 10) -> DataFrame:
    """Latest prompts that were blocked or that the context stage found suspicious (a top-k report)."""
    bad = (F.col("decision") == "block") | (F.col("action") == "kill") | F.col("verdict").isin("watch", "suspicious", "high_risk", "malicious")
    return scored.where(bad).orderBy(F.desc("epoch"), F.desc("prompt_id")).limit(top)


def latest_reviewed(scored: DataFrame, top: int = 12) -> DataFrame:
    return scored.where("path = 'scored'").orderBy(F.desc("epoch"), F.desc("prompt_id")).limit(top)


def ledger(judged: DataFrame, would: Column | None = None) -> DataFrame:
    """One evaluation row for each prompt: what was expected, done and predicted. ``would``
    tells where a shadow policy would have ended the session."""
    block = F.col("decision") == "block"
    rows = judged.where(~F.coalesce("refused", F.lit(False))).select(
        "scope_id", "source", "session_id", "prompt_id", F.lit("tier1").alias("tier"), F.col("epoch").alias("event_ts"), F.lit("production").alias("run_id"), F.coalesce("expected_label", F.lit("unknown")).alias("expected_label"),
        F.when(block, "blocked").otherwise("allowed").alias("actual_action"), F.when(block, "block").otherwise("pass").alias("predicted_outcome"), F.coalesce(F.lit(False) if would is None else would, F.lit(False)).alias("would_have_killed"),
    )
    return rows.withColumns({
        "result_actual": S.outcome(F.col("expected_label"), F.col("actual_action"), F.col("predicted_outcome")),
        "result_would_have": S.outcome(F.col("expected_label"), F.when(F.col("would_have_killed"), "killed").otherwise("allowed"), F.col("predicted_outcome")),
        "sort_key": F.concat_ws("#", F.col("event_ts").cast("string"), "session_id", "prompt_id", "tier"),
    })


def evaluation(rows: DataFrame) -> DataFrame:
    """Confusion counts with precision and recall in whole percent."""
    n = {k: F.count_if(F.col("result_actual") == k).alias(k) for k in ("true_positive", "true_negative", "false_positive", "false_negative", "unknown")}
    out = rows.agg(*n.values(), F.count("*").alias("total"))
    ratio = lambda a, b: F.floor(100 * F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)) + 0.5).cast("bigint")
    return out.withColumns({"precision_pct": ratio("true_positive", "false_positive"), "recall_pct": ratio("true_positive", "false_negative")})


def by_source(events: DataFrame) -> DataFrame:
    """Counts by scope and source with their rollups."""
    return events.rollup("scope_id", "source").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "block").alias("blocked"), F.grouping_id().alias("level"))


FAMILIES = (("sig-r-atlas-", "Prompt injection"), ("sig-r-se-", "Social engineering"), ("sig-r-ci-", "Community intelligence"), ("sig-r-zd-", "Emerging attack"), ("sig-h-", "Known bad prompt"))


def family(category: Column) -> Column:
    """The display family of a signature or rule id."""
    low = F.lower(category)
    out = F.when(category == "", "Policy rule").when(low.startswith("ml:") | low.startswith("ml-tier2-") | low.isin("malicious", "label_1", "attack"), "Tier 2 ML")
    for prefix, name in FAMILIES:
        out = out.when(category.startswith(prefix), name)
    return out.otherwise(title(category))


def regrouped(categories: DataFrame) -> DataFrame:
    """Category counts by family, with the percentage computed anew."""
    g = categories.groupBy(family(F.col("category")).alias("family")).agg(F.sum("n").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("family", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("percentage"))  # one row on the right


def labels(events: DataFrame) -> DataFrame:
    """Severity, source label, primary signal and rule reference of each event."""
    sig, rule = F.get("matched_signatures", F.lit(0)), F.get("matched_policy_rules", F.lit(0))
    starts = lambda p: F.exists("matched_signatures", lambda s: s.startswith(p))
    block = F.col("decision") == "block"
    return events.withColumns({
        "ui_severity": S.ui_severity(F.col("risk_score")), "alert_severity": S.alert_severity(F.col("risk_score")),
        "detection_source": F.when(F.size("matched_policy_rules") > 0, "Scope policy").when(starts("sig-r-atlas-"), "MITRE ATLAS pattern").when(starts("sig-r-se-"), "Social engineering pattern").when(starts("sig-r-ci-"), "Community intelligence").when(starts("sig-h-"), "Known prompt hash").when(F.size("matched_signatures") > 0, "Custom signature").when(block, "Policy engine").otherwise("No match"),
        "rule_reference": F.coalesce(rule, sig, F.when(block, "policy").otherwise("-")),
        "primary_signal": F.coalesce(sig, rule, F.when(block, "Policy rule").otherwise("No trigger")),
    })


def feed(events: DataFrame, scored: DataFrame, found: DataFrame) -> DataFrame:
    """One list of detections of all layers."""
    e = events.select(F.lit("Detection Event").alias("layer"), F.col("event_id").alias("id"), F.col("session_id").alias("session"), F.coalesce(F.get("attack_intents", F.lit(0)), F.lit("uncategorized")).alias("category"), F.col("event_ts").alias("at"))
    one = events.where((F.col("decision") == "block") | (F.size("matched_signatures") > 0)).select(F.lit("Layer 1").alias("layer"), F.col("event_id").alias("id"), F.col("session_id").alias("session"), F.coalesce(F.get("attack_intents", F.lit(0)), F.lit("uncategorized")).alias("category"), F.col("event_ts").alias("at"))
    two = scored.select(F.lit("Tier 2").alias("layer"), F.concat("prompt_id", F.lit("-tier2")).alias("id"), F.col("session_id").alias("session"), F.col("t2_category").alias("category"), F.col("epoch").alias("at"))
    three = found.select(F.lit("Tier 3").alias("layer"), F.col("burst_id").alias("id"), F.col("least_session").alias("session"), F.col("group_category").alias("category"), F.col("window_start").alias("at"))
    return e.unionByName(one).unionByName(two).unionByName(three)


def findings_as_events(found: DataFrame) -> DataFrame:
    """Cross-session findings in the shape of audit events."""
    return found.select(
        F.concat_ws("#", F.lit("tier3"), "method", F.col("window_start").cast("string"), "group_key").alias("event_id"), F.col("window_start").alias("event_ts"), F.lit(None).cast("string").alias("session_id"), "scope_id", F.lit("").alias("source"),
        F.lit("grouped").alias("decision"), F.array("group_category").alias("matched_signatures"), F.col("group_score").cast("int").alias("risk_score"), F.array().cast(NONE).alias("attack_intents"), F.array().cast(NONE).alias("matched_policy_rules"), F.lit("tier3").alias("provenance"),
    )


def by_provenance(events: DataFrame, provenance: str) -> DataFrame:
    """Events of one origin, latest first."""
    return events.where(F.col("provenance") == provenance).orderBy(F.desc("event_ts"), "event_id")


def summary(events: DataFrame) -> DataFrame:
    """Six views of the events in one table (view, name, n): totals, decisions, sources,
    severities, rules and hours."""
    one = lambda view, name: events.groupBy(F.lit(view).alias("view"), name.alias("name")).agg(F.count("*").alias("n"))
    rules = events.select(F.explode("matched_policy_rules").alias("r")).groupBy(F.lit("rule").alias("view"), F.col("r").alias("name")).agg(F.count("*").alias("n"))
    hour = (F.col("event_ts") - F.col("event_ts") % 3600).cast("string")
    parts = [one("total", F.lit("all")), one("decision", F.col("decision")), one("source", F.col("source")), one("severity", S.ui_severity(F.col("risk_score"))), one("hour", hour)]
    for p in parts:
        rules = rules.unionByName(p)
    return rules


# --- messages and alerts -----------------------------------------------------------

MESSAGE = "struct<prompt:string,session_id:string,scope_id:string,source:string,decision:string,timestamp:bigint,prompt_id:string>"


def messages(judged: DataFrame) -> DataFrame:
    """The queue message of each prompt, and whether it can be published: one without a prompt
    or a session isn't."""
    body = F.to_json(F.struct("prompt", "session_id", "scope_id", "source", "decision", F.col("epoch").alias("timestamp"), "prompt_id"))
    return judged.select("prompt_id", body.alias("message"), (F.coalesce(F.trim("prompt"), F.lit("")) != "").__and__(F.coalesce("session_id", F.lit("")) != "").alias("published"))


CHANNELS = ("notification", "finding")


def alerts(blocked: DataFrame, kill_outcome: Column) -> DataFrame:
    """Each blocked prompt once for each channel, with its severity and subject. A row without a
    session can't be delivered: it is marked failed, and the rest of the batch goes on."""
    return blocked.select(
        "prompt_id", "session_id", F.explode(F.array(*[F.lit(c) for c in CHANNELS])).alias("channel"), S.alert_severity(F.col("best_score")).alias("severity"),
        S.alert_subject(kill_outcome, F.coalesce("session_id", F.lit(""))).alias("subject"), (F.coalesce("session_id", F.lit("")) == "").alias("failed"),
    )


def health(rows: DataFrame, component: Column, reason: Column) -> DataFrame:
    """Degraded-service counts by component and reason; rows without a reason are sound."""
    return rows.select(component.alias("component"), reason.alias("reason")).where("reason is not null").groupBy("component", "reason").agg(F.count("*").alias("degraded"))


# --- policies --------------------------------------------------------------------

#: Stored fields, their kinds and defaults.
POLICY_FIELDS = (
    ("tier2_default_kill_threshold", "float", 0.97), ("tier2_high_risk_threshold", "float", 0.85), ("tier2_require_repeated_malicious", "bool", True), ("tier2_min_malicious_verdicts_for_kill", "count", 2),
    ("tier2_allow_single_verdict_kill_threshold", "float", 0.99), ("tier3_min_sessions_for_kill", "count", 3), ("tier3_similarity_threshold", "float", 0.90), ("tier3_kill_threshold", "float", 0.95), ("policy_version", "count", 1),
)


#: All names under which a policy's fields are stored.
POLICY_NAMES = [f for f, _, _ in POLICY_FIELDS] + ["tier2_mode", "tier3_mode", "tier2_enabled", "tier3_enabled"]


def policy_fields(stored: DataFrame, default_mode: str = "shadow") -> dict[str, Column]:
    """The fields of a policy, read from the columns that ``stored`` has: clamped, else
    defaults. Old on/off flags give the mode where none is stored. Stored columns are strings;
    a stored zero counts."""
    have = {c: F.col(c).cast("string") if c in stored.columns else F.lit(None).cast("string") for c in POLICY_NAMES}
    read = {"float": S.to_float, "bool": S.to_bool, "count": S.count_of}
    out = {f: read[k](have[f], d) for f, k, d in POLICY_FIELDS}
    for t in ("tier2", "tier3"):
        out[f"{t}_mode"] = S.mode_of(have[f"{t}_mode"], F.when(S.to_bool(have[f"{t}_enabled"], True), default_mode).otherwise("off"))
    return out


def policies(scopes: DataFrame, stored: DataFrame, default_mode: str = "shadow") -> DataFrame:
    """The policy of each scope (see ``policy_fields``)."""
    df = scopes.select("scope_id").join(stored, "scope_id", "left")
    return df.select("scope_id", *[v.alias(k) for k, v in policy_fields(stored, default_mode).items()])


def policy_write(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New policies as versions that follow the stored ones of their scope (append-only)."""
    last = stored.groupBy("scope_id").agg(F.max(S.to_int(F.col("policy_version"))).alias("last"))
    return new.drop("policy_version").join(last, "scope_id", "left").withColumn("policy_version", F.coalesce("last", F.lit(0)) + 1).drop("last")


def policy_valid(policy: DataFrame) -> DataFrame:
    """Policies inside their bounds: thresholds from 0 to 1, counts from 1, known modes."""
    ok = F.lit(True)
    for f, kind, _ in POLICY_FIELDS:
        if kind == "float":
            ok = ok & F.col(f).between(0.0, 1.0)
        elif kind == "count":
            ok = ok & (F.col(f) >= 1)
    return policy.where(ok & F.col("tier2_mode").isin("off", "shadow", "enforce") & F.col("tier3_mode").isin("off", "shadow", "enforce"))


# --- sinks -----------------------------------------------------------------------


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: one for each key that isn't stored yet."""
    return rows.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """Merged table: ``keep`` columns hold their stored value where there is one, ``replace``
    columns take the new one."""
    a, b = stored.select(key, *keep, *replace), rows.select(key, *[F.col(c).alias(f"new_{c}") for c in keep + replace])
    both = a.join(b, key, "full_outer")
    return both.select(key, *[F.coalesce(c, f"new_{c}").alias(c) for c in keep], *[F.coalesce(f"new_{c}", c).alias(c) for c in replace])


def encrypted(evidence_rows: DataFrame, key: Column) -> DataFrame:
    """Evidence as AES-256-GCM ciphertext, bound to its session as associated data."""
    body = F.to_json(F.struct("prompt", "session_id", "decision", "best_score"))
    return evidence_rows.select(
        "session_id", F.concat(F.lit("sessions/"), "session_id", F.lit("/"), F.col("epoch").cast("string"), F.lit("-"), "decision", F.lit(".enc.json")).alias("object_key"),
        F.base64(F.aes_encrypt(body.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("session_id").cast("binary"))).alias("ciphertext"),
    )


def write_events(events: DataFrame, path: str) -> None:
    """Append to the audit table, partitioned by scope."""
    events.write.mode("append").partitionBy("scope_id").parquet(path)


def tally(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("path") == "scored").alias("processed"), F.count_if("kill").alias("blocked"), F.count_if(F.col("path") != "scored").alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("errors") if "error" in scored.columns else F.lit(0).cast("bigint").alias("errors"))
