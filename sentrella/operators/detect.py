"""Stateless detection of one prompt: signatures, hashes, policy rules, risk groups.

Everything but the Unicode composition is a Catalyst expression. ``distinct_texts`` lets a
caller evaluate each distinct prompt once and join the result back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.functions import text as T
from sentrella.functions.dialect import FOLDED, any_of, foreign, java, literal, needed_all
from sentrella.functions.plan import fence
from sentrella.functions.scalars import ladder


#: (id, severity, category, pattern) of each signature; a catalogue is configuration, of hundreds at most.
Catalogue = tuple[tuple[str, str, str, str], ...]


#: The working texts of a prompt, which ``normalised`` adds.
TEXTS = ["raw_text", "composed", "normalized", "typo_free", "phrased", "corrected", "compact", "policy_text", "policy_compact", "lowered"]


def normalised(df: DataFrame, prompt: str = "prompt", long: bool = False) -> DataFrame:
    """Adds raw_text, normalized, corrected, compact, policy_text and policy_compact.

    ASCII texts, which Unicode composition leaves alone, aren't sent to Python for it. For ``long``
    texts Python also tells which wrong forms may occur (see ``text.seen``)."""
    own = df.columns
    df = df.withColumn("raw_text", F.coalesce(prompt, F.lit("")))
    df = df.withColumn("composed", T.nfkc(F.col("raw_text")))
    df = df.withColumns({"normalized": T.basic(F.col("composed")), "policy_plain": T.policy_text(F.col("composed"))})
    typos, phrases, grammar, expanded = None, None, None, None
    if long:
        forms = [[a for a, _ in pairs] for pairs in (fixed.TYPOS, fixed.PHRASES, fixed.GRAMMAR)]
        df = df.withColumn("wrong", T.seen([(F.col("normalized"), forms), (F.col("policy_plain"), [[a for a, _ in fixed.POLICY_TYPOS]])]))
        # A text that was changed may hold forms that it didn't.
        typos, expanded = T.bit(F.col("wrong"), 0), T.bit(F.col("wrong"), 3)
        phrases = typos | T.bit(F.col("wrong"), 1)
        grammar = phrases | T.bit(F.col("wrong"), 2)
    df = df.withColumn("typo_free", T.typos(F.col("normalized"), typos))
    df = df.withColumn("phrased", T.phrases(F.col("typo_free"), phrases))
    df = df.withColumns({"corrected": T.squeeze(T.grammar(F.col("phrased"), grammar)), "policy_text": T.policy_expanded(F.col("policy_plain"), expanded)})
    df = df.withColumns({"compact": T.compact(F.col("corrected")), "policy_compact": T.compact(F.col("policy_text")), "lowered": low(F.col("corrected"))}).drop("policy_plain", "wrong")
    return fence(df, *own)


# --- signatures ------------------------------------------------------------------


def low(text: Column) -> Column:
    """The form of a text in which the words that a pattern needs are looked for."""
    return F.lower(F.translate(text, *FOLDED))


def scan(text: Column, lowered: Column, catalogue: Catalogue | None = None, plain: bool = True, may: Callable[[str], Column] | None = None) -> Column:
    """Ids whose pattern occurs, in catalogue order. A pattern is tried only where the words that
    every match of it holds occur (``plain``), and where it ``may``."""
    tried = lambda p: T.where_needed(text, lowered, p) if plain else text.rlike(java(p))
    return T.hits([(sid, may(pattern) & tried(pattern) if may else tried(pattern)) for sid, _, _, pattern in catalogue or fixed.SIGNATURES])


#: Words of fewer letters are too common in prose to tell where a pattern may occur.
TELLING, AT_ONCE = 5, 16


def told(patterns: list[str]) -> tuple[list[list[str]], dict[str, int]]:
    """Lists of words, each for some patterns, and the list of each pattern that has one: it
    occurs only where a word of its list does."""
    first = {p: needed_all(p)[0] for p in patterns if needed_all(p)}
    some = sorted((p for p, words in first.items() if min(map(len, words)) >= TELLING), key=lambda p: first[p])
    at_once = max(AT_ONCE, -(-len(some) // 12))
    parts = [some[i : i + at_once] for i in range(0, len(some), at_once)]
    abroad = {p: words for p in patterns if p not in first and (words := foreign(p))}
    if abroad:
        parts, first = [*parts, sorted(abroad)], first | abroad
    return [sorted({w for p in part for w in first[p]}) for part in parts], {p: i for i, part in enumerate(parts) for p in part}


def signature_weight(ids: Column, hash_ids: Column, catalogue: Catalogue | None = None) -> Column:
    """The greatest weight among the matches."""
    weight = {s: fixed.SEVERITY_WEIGHTS.get(severity, 0) for s, severity, _, _ in catalogue or fixed.SIGNATURES}
    weight |= {s: fixed.SEVERITY_WEIGHTS.get(severity, fixed.UNKNOWN_HASH_WEIGHT) for s, severity, _, _ in fixed.HASHES}
    by = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])
    of = F.transform(F.concat(ids, hash_ids), lambda x: F.coalesce(F.try_element_at(by, x), F.lit(fixed.UNKNOWN_HASH_WEIGHT)))
    return F.coalesce(F.array_max(of), F.lit(0))


def hash_ids(raw: Column) -> Column:
    """The id of the raw text's digest, or else of the trimmed lower-cased text's: at most one."""
    known = F.create_map(*[F.lit(x) for i, _, _, d in fixed.HASHES for x in (d, i)])
    found = F.coalesce(F.try_element_at(known, F.sha2(raw, 256)), F.try_element_at(known, F.sha2(F.lower(F.trim(raw)), 256)))
    return F.filter(F.array(found), lambda x: x.isNotNull())


# --- policy rules ------------------------------------------------------------------


def term_hits(name: str, text: Column, compact: Column) -> Column:
    """Listed terms found as whole words or, for terms of several words, without their spaces."""
    found = []
    for t in fixed.TERMS[name]:
        # The plain search is cheap and settles nearly every text.
        c = F.contains(text, F.lit(t)) & text.rlike(java(rf"\b{literal(t)}\b"))
        if " " in t:
            c = c | F.contains(compact, F.lit(t.replace(" ", "")))
        found.append((t, c))
    return T.hits(found)


def some_term(text: Column, compact: Column) -> Column:
    """Whether any listed term may be found: one search for all of them, which settles most texts."""
    terms = sorted({t for ts in fixed.TERMS.values() for t in ts})
    return text.rlike(any_of(terms)) | compact.rlike(any_of([t.replace(" ", "") for t in terms if " " in t]))


def rules() -> list[tuple]:
    """(rule, category, severity, score, condition, terms) over the hit columns."""
    has = lambda n: F.size(f"hit_{n}") > 0
    rx = lambda n: T.where_needed(F.col("policy_text"), F.col("policy_text"), fixed.RULE_PATTERNS[n])
    h = lambda *ns: F.concat(*[F.col(f"hit_{n}") for n in ns])
    either = lambda a, b: F.when(has(a), F.col(f"hit_{a}")).otherwise(F.col(f"hit_{b}"))
    unsafe = ~F.col("safe_intent")
    text_terms = F.regexp_extract_all("policy_text", F.lit(java(fixed.UNAUTHORIZED_TERM)), F.lit(0))
    hostile = has("hostile") & (has("workplace") | has("system"))
    out = [
        ("critical_prompt_extraction", "system_prompt_extraction", "critical", 12, has("extraction") & has("prompt"), h("extraction", "prompt")),
        ("critical_company_secret_extraction", "secret_extraction", "critical", 12, has("extraction") & has("secret") & has("system") & unsafe, h("extraction", "secret", "system")),
        ("critical_system_company_secrets", "secret_extraction", "critical", 11, has("secret") & has("system") & rx("question") & unsafe, h("secret", "system")),
        ("credential_request_no_target", "credential_theft", "high", 8, has("extraction") & has("secret") & ~has("system") & unsafe, h("extraction", "secret")),
        ("critical_security_bypass", "security_bypass", "critical", 10, has("bypass") & has("security") & unsafe, h("bypass", "security")),
        ("unauthorized_access_attempt", "security_bypass", "high", 8, rx("unauthorized") & unsafe, text_terms),
        ("indirect_access_probing", "reconnaissance", "high", 8, rx("indirect") & unsafe, F.array(F.lit("indirect access probing"))),
        ("social_engineering_authority_impersonation", "social_engineering", "critical", 10, has("authority") & (has("secret") | has("extraction")) & unsafe, F.concat("hit_authority", either("secret", "extraction"))),
        ("social_engineering_authority_access", "social_engineering", "high", 8, has("authority") & rx("elevated") & unsafe, h("authority")),
        ("insider_threat_hostile_intent", "insider_threat", "critical", 10, hostile, F.concat("hit_hostile", either("workplace", "system"))),
        ("critical_insider_retaliation_credentials", "insider_retaliation_credential_abuse", "critical", 12, hostile & has("secret"), h("hostile", "workplace", "secret")),
        ("workplace_credential_extraction", "credential_theft", "critical", 10, has("workplace") & has("secret") & has("extraction") & unsafe, h("workplace", "secret", "extraction")),
        ("workplace_credential_request", "credential_theft", "high", 8, has("workplace") & has("secret") & unsafe, h("workplace", "secret")),
        ("covert_access_attempt", "insider_threat", "high", 8, rx("covert") & unsafe, F.array(F.lit("covert access"))),
        ("multilingual_sensitive_abuse", "multilingual_abuse", "high", 6, has("multilingual"), h("multilingual")),
        ("employee_safety_schedule_exposure", "employee_safety", "high", 6, has("employee") & unsafe, h("employee")),
        ("cross_family_employee_shipping_intelligence", "employee_safety_shipping_abuse", "critical", 12, has("employee") & has("shipping"), h("employee", "shipping")),
        ("shipping_customer_data_abuse", "abusing_shipping_information", "high", 8, has("shipping") & has("extraction") & unsafe, h("shipping", "extraction")),
    ]
    lists = (
        ("inventory", "inventory_internal_data_exfiltration", "inventory_exfiltration"),
        ("refund", "refund_fraud_workflow_abuse", "fraudulent_returns_refunds"),
        ("takeover", "account_takeover_recovery_abuse", "account_takeover"),
        ("knowledge", "internal_kb_exfiltration", "internal_knowledge_base_exfiltration"),
        ("chemical", "medical_chemical_information_abuse", "medical_chemical_abuse"),
        ("frontend", "frontend_or_cart_control_bypass", "frontend_cart_bypass"),
    )
    return out + [(r, c, "high", 8, has(n) & unsafe, h(n)) for n, r, c in lists]


def policy(df: DataFrame) -> DataFrame:
    """Adds policy_rules, policy_terms, policy_signals, policy_score, policy_critical,
    safe_intent, policy_decision, policy_recommendation, policy_state and policy_bucket."""
    text, compact = F.col("policy_text"), F.col("policy_compact")
    if "some_term" not in df.columns:
        df = df.withColumn("some_term", some_term(text, compact))
    df = fence(df, *[c for c in df.columns if c != "some_term"])
    found = {n: T.hits([(t, F.contains(text, F.lit(t))) for t in fixed.TERMS[n]]) if n == "multilingual" else term_hits(n, text, compact) for n in fixed.TERMS}
    df = df.withColumns({f"hit_{n}": F.when(F.col("some_term"), h).otherwise(F.array().cast("array<string>")) for n, h in found.items()}).drop("some_term")
    df = fence(df, *[c for c in df.columns if not c.startswith("hit_")])
    safe = T.contains_any(text, fixed.SAFE_PHRASES) | reduce(lambda a, b: a | b, [T.where_needed(text, text, p) for p in fixed.SAFE_PATTERNS])
    df = df.withColumn("safe_intent", safe | ((F.size("hit_safe") > 0) & (F.size("hit_extraction") == 0)))
    df = fence(df, *[c for c in df.columns if c != "safe_intent"])
    row = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("category"), F.lit(r[2] == "critical").alias("critical"), F.lit(r[3]).alias("score"), r[5].alias("terms"))
    df = df.withColumn("matched", F.filter(F.array(*[F.when(r[4], row(r)) for r in rules()]), lambda x: x.isNotNull()))
    df = fence(df, *[c for c in df.columns if c != "matched"])
    df = df.withColumns({
        "policy_rules": F.transform("matched", lambda m: m["rule"]),
        "policy_terms": F.array_sort(F.array_distinct(F.flatten(F.transform("matched", lambda m: m["terms"])))),
        "policy_signals": F.array_sort(F.array_distinct(F.transform("matched", lambda m: F.concat(m["category"], F.lit(":"), m["rule"])))),
        "policy_score": F.aggregate("matched", F.lit(0), lambda a, m: a + m["score"]),
        "policy_critical": F.exists("matched", lambda m: m["critical"]),
    })
    block = F.col("policy_critical") | (F.col("policy_score") >= 8)
    review = ~block & (F.col("policy_score") >= 4) & ~F.col("safe_intent")
    three = lambda a, b, c: F.when(block, a).when(review, b).otherwise(c)
    return df.withColumns({
        "policy_decision": three("block", "block", "allow"),
        "policy_recommendation": three("block", "escalate", "allow"),
        "policy_state": three("blocked", "awaiting_review", "allow"),
        "policy_bucket": ladder(F.col("policy_score"), [(8, "high"), (4, "medium")], "low"),
    }).drop("matched", *[f"hit_{n}" for n in fixed.TERMS])


# --- prompt risk -------------------------------------------------------------------


def _risk_patterns() -> list[str]:
    return [p for _, ps in fixed.RISK_GROUPS.values() for p in ps]


def risk(df: DataFrame, authentic: Column | None = None) -> DataFrame:
    """Adds risk_score, risk_signals, risk_intents, risk_bucket, risk_recommendation.

    An unauthentic session adds one point to a positive score and a signal, after the
    recommendation was made."""
    text = F.lower("corrected")

    lists, of = told(_risk_patterns()) if "risky_words" in df.columns else ([], {})
    tried = lambda p: T.bit(F.col("risky_words"), of[p]) & T.where_needed(text, F.col("lowered"), p) if p in of else T.where_needed(text, F.col("lowered"), p)
    groups = [(g, reduce(lambda a, b: a | b, [tried(p) for p in ps])) for g, (_, ps) in fixed.RISK_GROUPS.items()]
    words = F.split(F.trim(text), java(r"\s+"))
    # A text is cut into words only where it holds all of a combination's.
    every = lambda ws: reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in ws])
    combos = [(s, every(ws.split()) & (F.size(F.array_except(F.array(*[F.lit(w) for w in ws.split()]), words)) == 0)) for ws, _, s in fixed.RISK_COMBOS]
    df = df.withColumns({"risk_intents": T.hits(groups), "combo_hits": T.hits(combos)})
    df = fence(df, *[c for c in df.columns if c not in ("risk_intents", "combo_hits")])
    points = F.create_map(*[F.lit(x) for g, (w, _) in fixed.RISK_GROUPS.items() for x in (g, w)], *[F.lit(x) for _, p, s in fixed.RISK_COMBOS for x in (s, p)])
    base = F.aggregate(F.transform(F.concat("risk_intents", "combo_hits"), lambda x: F.element_at(points, x)), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("risk_base", base)
    more = F.lit(False) if authentic is None else ~authentic & (F.col("risk_base") > 0)
    signals = F.concat(F.transform("risk_intents", lambda g: F.concat(F.lit("risk_group:"), g)), F.col("combo_hits"))
    return df.withColumns({
        "risk_score": F.col("risk_base") + more.cast("int"),
        "risk_signals": F.when(more, F.concat(signals, F.array(F.lit("session:unverified_identity")))).otherwise(signals),
        "risk_bucket": ladder(F.col("risk_base"), [(8, "high"), (4, "medium")], "low"),
        "risk_recommendation": ladder(F.col("risk_base"), [(8, "block"), (4, "escalate")], "allow"),
    }).drop("combo_hits", "risk_base")


def detailed(ids: Column, catalogue: Catalogue | None = None) -> Column:
    """The matches as (id, severity, category), in their order."""
    of = {s: (severity, category) for s, severity, category, _ in (*(catalogue or fixed.SIGNATURES), *fixed.HASHES)}
    severity, category = (F.create_map(*[F.lit(x) for s, v in of.items() for x in (s, v[i])]) for i in (0, 1))
    return F.transform(ids, lambda x: F.struct(x.alias("id"), F.try_element_at(severity, x).alias("severity"), F.try_element_at(category, x).alias("category")))


def sighted(df: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """Adds what ``text.seen`` tells of long texts: the words that signatures need in each of the
    three forms (words_*), those of risk patterns (risky_words), and whether any listed term occurs."""
    lists, _ = told([p for _, _, _, p in catalogue or fixed.SIGNATURES])
    risky, _ = told(_risk_patterns())
    terms = sorted({t for ts in fixed.TERMS.values() for t in ts})
    joint = [t.replace(" ", "") for t in terms if " " in t]
    n, r = len(lists), len(risky)
    own = df.columns
    df = df.withColumns({"low_normalized": low(F.col("normalized")), "low_raw": low(F.col("raw_text"))})
    asked = [(F.col("lowered"), [*lists, *risky]), (F.col("low_normalized"), lists), (F.col("low_raw"), lists), (F.col("policy_text"), [terms]), (F.col("policy_compact"), [joint])]
    df = fence(df.withColumn("seen", T.seen(asked)), *own)
    part = lambda a, k: F.shiftrightunsigned("seen", a).bitwiseAND(F.lit((1 << k) - 1).cast("long"))
    made = {"words_corrected": part(0, n), "risky_words": part(n, r), "words_normalized": part(n + r, n), "words_raw_text": part(2 * n + r, n), "some_term": part(3 * n + r, 2) != 0}
    return df.withColumns(made).drop("seen", "low_normalized", "low_raw")


def detect(prompts: DataFrame, prompt: str = "prompt", catalogue: Catalogue | None = None, long: bool = False) -> DataFrame:
    """All stateless results for each prompt, with its own columns kept. ``catalogue`` replaces
    the built-in signatures (see ``catalogue.in_use``). ``long`` texts are first searched for all words
    that patterns need at once, which is worth its cost for documents."""
    df = normalised(prompts, prompt, long)
    of = None
    if long:
        df, (_, of) = sighted(df, catalogue), told([p for _, _, _, p in catalogue or fixed.SIGNATURES])
    # Three forms of the text, in this order; equal ones are scanned once.
    forms = [F.struct(F.col(c).alias("text"), low(F.col(c)).alias("low"), *([F.col(f"words_{c}").alias("words")] if long else [])) for c in ("corrected", "normalized", "raw_text")]
    variants = F.array_distinct(F.array(*forms))
    may = lambda t: (lambda p: T.bit(t["words"], of[p]) if p in of else F.lit(True)) if long else None
    found = F.array_distinct(F.flatten(F.transform(variants, lambda t: scan(t["text"], t["low"], catalogue, may=may(t)))))
    df = df.withColumns({"signature_matches": found, "hash_matches": hash_ids(F.col("raw_text"))})
    df = fence(df, *[c for c in df.columns if c not in ("signature_matches", "hash_matches")])
    df = risk(policy(df), F.col("session_authentic") if "session_authentic" in prompts.columns else None)
    df = df.withColumns({
        "matched_signatures": F.array_distinct(F.concat("signature_matches", "hash_matches")),
        "signature_score": signature_weight(F.col("signature_matches"), F.col("hash_matches"), catalogue),
    })
    best = F.greatest("policy_score", "risk_score", "signature_score")
    return df.withColumns({
        "stateless_block": (F.size("matched_signatures") > 0) | (F.col("policy_decision") == "block") | (F.col("risk_recommendation") == "block"),
        "best_score": best, "best_bucket": ladder(best, [(8, "high"), (4, "medium")], "low"),
        "signals": F.array_sort(F.array_distinct(F.concat("policy_signals", "risk_signals"))),
        "session_input": F.greatest("risk_score", "policy_score"),
    }).drop("lowered", "risky_words", *[f"words_{c}" for c in ("corrected", "normalized", "raw_text")])


def detect_distinct(prompts: DataFrame, prompt: str = "prompt", also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As ``detect``, with every distinct (text, authenticity) evaluated once: repeated prompts,
    which attacks are made of, then cost a join instead of a hundred patterns. Distinct pairs
    are formed in the map tasks first, and Spark splits skewed join partitions. The normalised
    texts (TEXTS), which are longer than all results, aren't kept. ``also`` adds further columns
    that depend on the prompt alone."""
    keys = [prompt, *(["session_authentic"] if "session_authentic" in prompts.columns else [])]
    # Short texts fill few partitions, but matching them costs far more than dealing them out.
    dealt = prompts.select(*keys).distinct().repartition(3 * prompts.sparkSession.sparkContext.defaultParallelism, *keys)
    judged = detect(also(dealt) if also else dealt, prompt)
    new = [c for c in judged.columns if c not in prompts.columns and c not in TEXTS]
    other = judged.select(*[F.col(k).alias(f"_{k}") for k in keys], *new)
    on = reduce(lambda a, b: a & b, [prompts[k].eqNullSafe(other[f"_{k}"]) for k in keys])
    return prompts.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def known_digests(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the severity of their digest in a table of known ones (null: unknown). Copies
    of a digest count once; Spark broadcasts a small feed and splits hot digests of a large one."""
    feed = known.groupBy("digest").agg(F.min("severity").alias("severity"))
    return rows.join(feed, "digest", "left")
