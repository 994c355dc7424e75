"""DuckDB SQL of the same results, built from the same fixed values.

It holds for ASCII prompts, where the pattern dialects agree; the derived prompts are ASCII.
"""

from __future__ import annotations

from sentrella.functions import fixed
from sentrella.functions.dialect import literal
from sentrella.sources.views import prompts_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def hits(named: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in named)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def ladder(value: str, steps, otherwise) -> str:
    lit = lambda x: q(x) if isinstance(x, str) else str(x)
    return "CASE " + " ".join(f"WHEN {value} >= {b} THEN {lit(x)}" for b, x in steps) + f" ELSE {lit(otherwise)} END"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'), ' ')"
LEET = "translate(lower(prompt), '" + fixed.LEET_FROM + "', '" + fixed.LEET_TO + "')"


def structure(prompt: str = "prompt") -> str:
    """Links, addresses, ids, digests, quotations and numbers by their kind."""
    t = f"trim(regexp_replace(lower({prompt}), '\\s+', ' ', 'g'), ' ')"
    steps = ((r"https?://\S+|www\.\S+", "<url>"), (r"\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b", "<email>"), (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"), (r"\b[0-9a-f]{16,}\b", "<hash>"), (r"\x27(?:\\.|[^\\])*?\x27|\x22(?:\\.|[^\\])*?\x22", "<quote>"), (r"\b\d+(?:\.\d+)?\b", "<num>"))
    for pattern, name in steps:
        t = f"regexp_replace({t}, '{pattern}', '{name}', 'g')"
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[a-z0-9_<>'']+'), lambda x: CASE WHEN length(x) >= 24 AND regexp_matches(x, '[0-9]') THEN '<id>' ELSE x END), ' ')"


def chain(col: str, pairs) -> str:
    for a, b in pairs:
        col = f"regexp_replace({col}, {q(chr(92) + 'b' + literal(a) + chr(92) + 'b')}, {q(b)}, 'g')"
    return col


def term_hits(name: str) -> str:
    out = []
    for t in fixed.TERMS[name]:
        c = f"contains(policy_text, {q(t)})" if name == "multilingual" else rx("policy_text", rf"\b{literal(t)}\b")
        if " " in t and name != "multilingual":
            c = f"({c} OR contains(policy_compact, {q(t.replace(' ', ''))}))"
        out.append((t, c))
    return hits(out)


def policy_rules() -> list[tuple[str, str, bool, int, str]]:
    h = lambda n: f"len(hit_{n}) > 0"
    p = lambda n: rx("policy_text", fixed.RULE_PATTERNS[n])
    ok = "NOT safe_intent"
    hostile = f"({h('hostile')} AND ({h('workplace')} OR {h('system')}))"
    both = lambda *c: " AND ".join(c)
    out = [
        ("critical_prompt_extraction", "system_prompt_extraction", True, 12, both(h("extraction"), h("prompt"))),
        ("critical_company_secret_extraction", "secret_extraction", True, 12, both(h("extraction"), h("secret"), h("system"), ok)),
        ("critical_system_company_secrets", "secret_extraction", True, 11, both(h("secret"), h("system"), p("question"), ok)),
        ("credential_request_no_target", "credential_theft", False, 8, both(h("extraction"), h("secret"), f"NOT {h('system')}", ok)),
        ("critical_security_bypass", "security_bypass", True, 10, both(h("bypass"), h("security"), ok)),
        ("unauthorized_access_attempt", "security_bypass", False, 8, both(p("unauthorized"), ok)),
        ("indirect_access_probing", "reconnaissance", False, 8, both(p("indirect"), ok)),
        ("social_engineering_authority_impersonation", "social_engineering", True, 10, both(h("authority"), f"({h('secret')} OR {h('extraction')})", ok)),
        ("social_engineering_authority_access", "social_engineering", False, 8, both(h("authority"), p("elevated"), ok)),
        ("insider_threat_hostile_intent", "insider_threat", True, 10, hostile),
        ("critical_insider_retaliation_credentials", "insider_retaliation_credential_abuse", True, 12, both(hostile, h("secret"))),
        ("workplace_credential_extraction", "credential_theft", True, 10, both(h("workplace"), h("secret"), h("extraction"), ok)),
        ("workplace_credential_request", "credential_theft", False, 8, both(h("workplace"), h("secret"), ok)),
        ("covert_access_attempt", "insider_threat", False, 8, both(p("covert"), ok)),
        ("multilingual_sensitive_abuse", "multilingual_abuse", False, 6, h("multilingual")),
        ("employee_safety_schedule_exposure", "employee_safety", False, 6, both(h("employee"), ok)),
        ("cross_family_employee_shipping_intelligence", "employee_safety_shipping_abuse", True, 12, both(h("employee"), h("shipping"))),
        ("shipping_customer_data_abuse", "abusing_shipping_information", False, 8, both(h("shipping"), h("extraction"), ok)),
        ("inventory_internal_data_exfiltration", "inventory_exfiltration", False, 8, both(h("inventory"), ok)),
        ("refund_fraud_workflow_abuse", "fraudulent_returns_refunds", False, 8, both(h("refund"), ok)),
        ("account_takeover_recovery_abuse", "account_takeover", False, 8, both(h("takeover"), ok)),
        ("internal_kb_exfiltration", "internal_knowledge_base_exfiltration", False, 8, both(h("knowledge"), ok)),
        ("medical_chemical_information_abuse", "medical_chemical_abuse", False, 8, both(h("chemical"), ok)),
        ("frontend_or_cart_control_bypass", "frontend_cart_bypass", False, 8, both(h("frontend"), ok)),
    ]
    return out


def tier1(terminate: bool = True) -> str:
    """CTEs evt, texts, scanned, ruled, judged (stateless) and folded (with session state)."""
    sig = hits([(i, rx("T", p)) for i, _, _, p in fixed.SIGNATURES])
    scan = lambda col: sig.replace("regexp_matches(T,", f"regexp_matches({col},")
    weights = {i: fixed.SEVERITY_WEIGHTS[s] for i, s, _, _ in fixed.SIGNATURES}
    by_weight: dict[int, list[str]] = {}
    for i, w in weights.items():
        by_weight.setdefault(w, []).append(q(i))
    weight = "greatest(0, " + ", ".join(f"CASE WHEN list_has_any(sigs, [{', '.join(v)}]) THEN {k} ELSE 0 END" for k, v in by_weight.items()) + ")"
    safe = " OR ".join([any_of("policy_text", fixed.SAFE_PHRASES), *[rx("policy_text", p) for p in fixed.SAFE_PATTERNS], "(len(hit_safe) > 0 AND len(hit_extraction) = 0)"])
    rules = policy_rules()
    score = " + ".join(f"CASE WHEN list_contains(rules, {q(r)}) THEN {s} ELSE 0 END" for r, _, _, s, _ in rules)
    critical = "list_has_any(rules, [" + ", ".join(q(r) for r, _, c, _, _ in rules if c) + "])"
    groups = hits([(g, "(" + " OR ".join(rx("lower(corrected)", p) for p in ps) + ")") for g, (_, ps) in fixed.RISK_GROUPS.items()])
    combos = hits([(s, f"list_has_all(words, [{', '.join(q(w) for w in ws.split())}])") for ws, _, s in fixed.RISK_COMBOS])
    base = " + ".join([f"CASE WHEN list_contains(intents, {q(g)}) THEN {w} ELSE 0 END" for g, (w, _) in fixed.RISK_GROUPS.items()] + [f"CASE WHEN list_contains(combos, {q(s)}) THEN {p} ELSE 0 END" for _, p, s in fixed.RISK_COMBOS])
    expanded = "plain_text"
    for a, b in fixed.POLICY_TYPOS:
        expanded = f"replace({expanded}, {q(a)}, {q(b)})"
    basic = SQUEEZE.format(r"regexp_replace(regexp_replace(" + LEET + r", '[_/\\]+', ' ', 'g'), '[^\p{L}\p{N}_\s''\x22-]', ' ', 'g')")
    plain = SQUEEZE.format(r"regexp_replace(regexp_replace(" + LEET + r", '[_\-/\\]+', ' ', 'g'), '[^\p{L}\p{N}_\s''-]', ' ', 'g')")
    corrected = SQUEEZE.format(chain("normalized", fixed.TYPOS + fixed.PHRASES + fixed.GRAMMAR))
    block = "(policy_critical OR policy_score >= 8)"
    decayed = "f.score * CASE WHEN s.epoch - f.epoch <= 0 THEN 1 ELSE greatest(0.25, least(1.0, pow(0.5, (s.epoch - f.epoch) / 900.0))) END"
    raw = f"least(20.0, {decayed} + s.session_input + least(3, len(list_intersect(s.intents, f.seen_intents))) + CASE WHEN f.seen >= 2 AND s.session_input >= 4 THEN 1 ELSE 0 END)"
    cols = "session_id, rn, prompt_id, epoch"
    stop = "f.terminated"
    term = "TRUE" if terminate else "FALSE"
    return f"""
WITH RECURSIVE evt AS MATERIALIZED ({prompts_sql()}),
texts AS MATERIALIZED (SELECT prompt, normalized, {corrected} AS corrected, plain_text, {expanded} AS policy_text
  FROM (SELECT prompt, {basic} AS normalized, {plain} AS plain_text FROM (SELECT DISTINCT prompt FROM evt))),
scanned AS MATERIALIZED (SELECT *, {weight} AS signature_score FROM (
  SELECT *, list_distinct_ordered(list_concat(list_concat({scan('corrected')}, {scan('normalized')}), {scan('prompt')})) AS sigs FROM texts)),
termed AS MATERIALIZED (SELECT *, {', '.join(f'{term_hits(n)} AS hit_{n}' for n in fixed.TERMS)} FROM (SELECT *, regexp_replace(policy_text, '\\s+', '', 'g') AS policy_compact, string_split_regex(trim(lower(corrected), ' '), '\\s+') AS words FROM scanned)),
ruled AS MATERIALIZED (SELECT *, {hits([(r, c) for r, _, _, _, c in rules])} AS rules FROM (SELECT *, ({safe}) AS safe_intent, {groups} AS intents, {combos} AS combos FROM termed)),
texted AS MATERIALIZED (SELECT *, {score} AS policy_score, {critical} AS policy_critical, {base} AS risk_base FROM ruled),
judged AS MATERIALIZED (SELECT *, greatest(risk_score, policy_score) AS session_input, greatest(policy_score, risk_score, signature_score) AS best_score,
    (len(sigs) > 0 OR policy_decision = 'block' OR risk_base >= 8) AS stateless_block
  FROM (SELECT evt.*, t.* EXCLUDE (prompt), risk_base + CASE WHEN NOT session_authentic AND risk_base > 0 THEN 1 ELSE 0 END AS risk_score,
    CASE WHEN {block} OR (policy_score >= 4 AND NOT safe_intent) THEN 'block' ELSE 'allow' END AS policy_decision,
    CASE WHEN {block} THEN 'block' WHEN policy_score >= 4 AND NOT safe_intent THEN 'escalate' ELSE 'allow' END AS policy_recommendation
  FROM evt JOIN texted t USING (prompt))),
seqd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY epoch, prompt_id) AS rn FROM judged),
stated AS (
  SELECT {cols}, FALSE AS refused, least(20.0, session_input::DOUBLE) AS raw, round_even(least(20.0, session_input::DOUBLE), 0)::INT AS score, 1 AS seen, intents AS seen_intents,
    (stateless_block OR session_input >= 12) AS blocked, {term} AND (stateless_block OR session_input >= 12) AS terminated FROM seqd WHERE rn = 1
  UNION ALL
  SELECT s.session_id, s.rn, s.prompt_id, CASE WHEN {stop} THEN f.epoch ELSE s.epoch END, {stop}, CASE WHEN {stop} THEN NULL ELSE {raw} END,
    CASE WHEN {stop} THEN f.score ELSE round_even({raw}, 0)::INT END, CASE WHEN {stop} THEN f.seen ELSE f.seen + 1 END,
    CASE WHEN {stop} THEN f.seen_intents ELSE list_distinct(list_concat(f.seen_intents, s.intents)) END,
    NOT {stop} AND (s.stateless_block OR {raw} >= 12), {stop} OR ({term} AND (s.stateless_block OR {raw} >= 12))
  FROM stated f JOIN seqd s ON s.session_id = f.session_id AND s.rn = f.rn + 1),
folded AS MATERIALIZED (SELECT j.* EXCLUDE (rn), st.refused, st.raw AS session_raw, st.score AS session_score, st.seen AS prompts_seen,
    CASE WHEN st.refused THEN 'refused' WHEN st.blocked THEN 'block' ELSE 'allow' END AS decision,
    CASE WHEN st.refused THEN NULL WHEN st.raw >= 12 THEN 'block' WHEN st.raw >= 6 THEN 'escalate' ELSE 'allow' END AS session_recommendation
  FROM seqd j JOIN stated st USING (session_id, rn)),
events_ AS MATERIALIZED (SELECT 'tier1#' || prompt_id AS event_id, epoch AS event_ts, session_id, scope_id, source, decision, sigs, best_score AS risk_score, intents, rules FROM folded WHERE NOT refused)
""".replace("list_distinct_ordered(", "ordered_distinct(")


MACRO = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def ordered_distinct(sql: str) -> str:
    """DuckDB's list_distinct gives no order: keep each value's first place instead."""
    at = sql.index("ordered_distinct(")
    depth, i = 0, at + len("ordered_distinct")
    while True:
        depth += (sql[i] == "(") - (sql[i] == ")")
        i += 1
        if not depth:
            break
    inner = sql[at + len("ordered_distinct(") : i - 1]
    sub = f"(SELECT list_filter(l, lambda x, n: list_position(l, x) = n) FROM (SELECT {inner} AS l))"
    return sql[:at] + sub + sql[i:]


def tier1_sql(final: str, terminate: bool = True) -> str:
    return ordered_distinct(tier1(terminate)) + final
