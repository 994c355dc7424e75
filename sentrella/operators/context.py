"""Scoring of one prompt in the context of its session.

Features that depend on texts alone are window expressions over the last ten turns (the
current one included), so they run inside Spark. Features that depend on earlier verdicts,
and the session's own score, go through one pure step (see ``sessions.fold``); its state is
ten short rows and three numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.functions.dialect import java, needed_all
from sentrella.functions.plan import fence
from sentrella.functions.scalars import ladder
from sentrella.functions.text import contains_any, numbers, skeleton
from sentrella.operators.detect import low
from sentrella.operators.sessions import KEYS, fold

HISTORY, MODEL_TURNS = 10, 5
PROGRESSION_TURNS, LEAST_TURNS, STEP, GROWTH = 6, 3, 10, 4.0


@dataclass(frozen=True)
class Policy:
    """Thresholds of one scope, with their defaults."""

    tier2_mode: str = "shadow"
    kill_threshold: float = 0.97
    min_malicious: int = 2
    single_threshold: float = 0.99
    session_kill_score: float = 120.0
    global_kill: bool = False
    tier2_kill: bool = False
    enforcement: bool = False


#: The lists that the features look for in the last turns, as ``lower`` has them. They, the words that
#: behaviours need, as ``low`` has them, and the behaviours of a turn alone are bits of its mark.
LISTS = {
    "denial": fixed.DENIAL_WORDS, "schema": fixed.SCHEMA_WORDS, "restricted": fixed.RESTRICTED_WORDS, "risky": fixed.RISKY_CONTEXT, "abuse": fixed.ABUSE_INDICATORS,
    **{f"early:{n}": early for _, n, early, _ in fixed.ESCALATIONS}, **{f"category:{c}": words for c, words in fixed.CATEGORY_KEYWORDS},
}
NEEDED = sorted({tuple(words) for _, _, p in fixed.BEHAVIOURS for words in needed_all(p)})
BIT = {k: 1 << i for i, k in enumerate([*LISTS, *NEEDED, *[f"behaviour:{n}" for _, n, _ in fixed.BEHAVIOURS]])}
#: Turns with a digit, without a word, and those whose end or beginning may be part of a listed text
#: of several words that goes over the joint of two turns.
DIGIT, BLANK, TAIL, HEAD = (1 << i for i in range(58, 62))
assert len(BIT) <= 58
#: What one prompt alone tells, as bits of its traits.
INTENTS = [f"intent:{i}" for i in range(len(fixed.SAFE_INTENTS))]
TRAIT = {k: 1 << i for i, k in enumerate(["rephrase", "risky", "able", *[f"late:{n}" for _, n, _, _ in fixed.ESCALATIONS], *INTENTS])}
MARKS = ["mark", "traits"]
_SPACED = sorted({w for words in [*LISTS.values(), *NEEDED] for w in words if " " in w})
_CUTS = [(w, i) for w in _SPACED for i, c in enumerate(w) if c == " "]
TAILS, HEADS = sorted({w[:i] for w, i in _CUTS}), sorted({w[i + 1 :] for w, i in _CUTS})
#: Whole turns that stand inside such a text.
INNER = sorted({w[i + 1 : j] for w, i in _CUTS for v, j in _CUTS if v == w and j > i})
# A joint is one space, and the model's input has a marker there that no listed text holds.
assert all(w.strip() == w and w for words in [*LISTS.values(), *NEEDED] for w in words)
assert not any("[" in w or "]" in w or w in "[user]" for _, words in fixed.CATEGORY_KEYWORDS for w in words)


def mark_of(text: Column, lower: Column, folded: Column) -> Column:
    """What of LISTS, NEEDED and BEHAVIOURS a turn holds, with its DIGIT, BLANK, TAIL and HEAD, as bits of a long."""
    either = lambda f: reduce(lambda a, b: a | b, [f(lower), f(folded)])
    one_of = lambda cs: reduce(lambda a, b: a | b, cs)
    bits = [(contains_any(lower, words), BIT[n]) for n, words in LISTS.items()] + [(contains_any(folded, words), BIT[words]) for words in NEEDED]
    bits += [(occurs(text, folded, p), BIT[f"behaviour:{n}"]) for _, n, p in fixed.BEHAVIOURS]
    bits += [(text.rlike(java(r"\d")), DIGIT), (F.trim(text) == "", BLANK)]
    bits += [(either(lambda t: one_of([t.endswith(x) for x in TAILS])), TAIL), (either(lambda t: one_of([t.startswith(x) for x in HEADS]) | t.isin(*INNER)), HEAD)]
    return _bits(bits)


def traits_of(text: Column, lower: Column, folded: Column) -> Column:
    """What the features ask of a prompt alone (see TRAIT)."""
    squeezed = F.trim(F.regexp_replace(lower, java(r"\s+"), " "))
    able = reduce(lambda a, b: a | b, [occurs(text, folded, p) for p in fixed.CAPABILITY_PATTERNS])
    bits = [(contains_any(lower, fixed.REPHRASE_WORDS), TRAIT["rephrase"]), (contains_any(squeezed, fixed.RISKY_CONTEXT), TRAIT["risky"]), (able, TRAIT["able"])]
    bits += [(contains_any(lower, late), TRAIT[f"late:{n}"]) for _, n, _, late in fixed.ESCALATIONS]
    return _bits(bits + [(occurs(text, folded, p), TRAIT[k]) for k, (_, p) in zip(INTENTS, fixed.SAFE_INTENTS)])


def _bits(named: list[tuple[Column, int]]) -> Column:
    long = lambda n: F.lit(n).cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, long(b)).otherwise(long(0)) for c, b in named])


def has(mark: Column, bits: int) -> Column:
    return mark.bitwiseAND(F.lit(bits).cast("long")) == bits


def marked(prompts: DataFrame) -> DataFrame:
    """Adds mark (see ``mark_of``) and traits: a turn is searched once, not in each window that it is
    in. Over distinct prompts (see ``detect_distinct``) it is searched once for all its copies."""
    own, text = prompts.columns, F.coalesce("prompt", F.lit(""))
    df = fence(prompts.withColumns({"said": text, "said_lower": F.lower(text), "said_low": low(text)}), *own)
    said = [F.col(c) for c in ("said", "said_lower", "said_low")]
    return fence(df.withColumns({"mark": mark_of(*said), "traits": traits_of(*said)}).drop("said", "said_lower", "said_low"), *own)


def history(prompts: DataFrame, marks: bool = True) -> DataFrame:
    """Adds hist: the last ten prompts of the session, oldest first, and their ``marks``."""
    w = Window.partitionBy(*KEYS).orderBy("epoch", "prompt_id").rowsBetween(-(HISTORY - 1), 0)
    of = lambda c: F.collect_list(c).over(w)
    hist = of(F.coalesce("prompt", F.lit("")))
    if not marks:
        return prompts.withColumn("hist", hist)
    df = prompts if "mark" in prompts.columns else marked(prompts)
    return df.withColumns({"hist": hist, "marks": of("mark")}).drop("mark")


def last(n: int, column: str = "hist") -> Column:
    return F.slice(column, F.greatest(F.size(column) - (n - 1), F.lit(1)), F.lit(n))


def model_input(df: DataFrame) -> DataFrame:
    """Adds ml_input, the last five non-empty turns, each behind its marker, and their number."""
    trimmed = F.filter(F.transform("hist", lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumn("turns", trimmed)
    five = last(MODEL_TURNS, "turns")
    return df.withColumns({"ml_input": F.array_join(F.transform(five, lambda x: F.concat(F.lit("[USER] "), x)), " "), "context_prompts": F.size(five)}).drop("turns")


def is_attack(label: Column) -> Column:
    return F.upper(label).isin(*fixed.ATTACK_LABELS)


def model_score(label: Column, confidence: Column) -> Column:
    steps = [(0.99, 90.0), (0.97, 80.0), (0.95, 65.0), (0.85, 50.0), (0.75, 35.0), (0.55, 20.0)]
    return F.when(is_attack(label), ladder(confidence, steps, 0.0)).otherwise(0.0)


def category_of(label: Column, text: Column) -> Column:
    lowered = F.lower(text)
    return category_by(label, [contains_any(lowered, words) for _, words in fixed.CATEGORY_KEYWORDS])


def category_by(label: Column, found: list[Column]) -> Column:
    """The category of a label, by which lists of keywords (in their order) were found."""
    named = [(f, c) for f, (c, _) in zip(found, fixed.CATEGORY_KEYWORDS)]
    by_word = reduce(lambda c, x: c.when(*x), named[1:], F.when(*named[0]))
    by_label = F.create_map(*[F.lit(x) for kv in fixed.LABEL_CATEGORIES.items() for x in kv])
    return F.when(~is_attack(label), "safe").otherwise(by_word.otherwise(F.coalesce(F.try_element_at(by_label, F.upper(label)), F.lit("safe"))))


def category_score(category: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in fixed.CATEGORY_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(by, category), F.lit(0)).cast("double")


def regex_component(decision: Column, risk_score: Column, severity: Column) -> Column:
    by = {"none": 0, "low": 10, "medium": 35, "high": 80, "critical": 95}
    table = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])
    blocked = F.when(risk_score >= 12, 95).when(risk_score >= 8, 80).otherwise(95)
    return F.when(decision == "block", blocked).otherwise(F.coalesce(F.try_element_at(table, F.lower(F.coalesce(severity, F.lit("none")))), F.lit(0))).cast("double")


def progression(turns: Column) -> Column:
    """Names of numeric progressions through turns of one sentence shape.

    Turns are grouped by shape (at least two words, three turns), and the numbers in each place of
    a shape form a series. A series that only rises is an enumeration where no step exceeds STEP,
    and an escalation where the last number is GROWTH times a positive first one."""
    none = F.array().cast("array<string>")
    # Few turns hold numbers; only those get a shape, and only where there are enough of them.
    counted = F.filter(turns, lambda t: t.rlike(java(r"\d")))

    def rising(series: Column) -> Column:
        steps = F.zip_with(F.slice(series, F.lit(2), F.size(series)), F.slice(series, F.lit(1), F.size(series) - 1), lambda later, earlier: later - earlier)
        low, high = F.get(series, F.lit(0)), F.element_at(series, -1)
        close = F.when(F.array_max(steps) <= STEP, F.array(F.lit("identifier_enumeration"))).otherwise(none)
        grown = F.when((low > 0) & (high / low >= GROWTH), F.array(F.lit("quantity_escalation"))).otherwise(none)
        return F.when(F.array_min(steps) > 0, F.concat(close, grown)).otherwise(none)

    def of_turns(said: Column) -> Column:
        def of_shape(shape: Column) -> Column:
            rows = F.transform(F.filter(said, lambda r: r["shape"] == shape), lambda r: r["found"])
            places = F.sequence(F.lit(0), F.array_min(F.transform(rows, lambda found: F.size(found))) - 1)
            return F.when(F.size(rows) >= LEAST_TURNS, F.flatten(F.transform(places, lambda i: rising(F.transform(rows, lambda found: F.get(found, i)))))).otherwise(none)

        shapes = F.array_distinct(F.transform(said, lambda r: r["shape"]))
        return F.array_distinct(F.flatten(F.transform(shapes, of_shape)))

    def of_counted(some: Column) -> Column:
        said = F.filter(F.transform(some, lambda t: F.struct(skeleton(t).alias("shape"), numbers(t).alias("found"))), lambda r: F.contains(r["shape"], F.lit(" ")))
        # An array of one element binds what is used several times.
        return F.when(F.size(some) >= LEAST_TURNS, F.flatten(F.transform(F.array(said), of_turns))).otherwise(none)

    return F.flatten(F.transform(F.array(counted), of_counted))


def occurs(text: Column, lowered: Column, pattern: str) -> Column:
    """Whether a pattern occurs, its case aside. It is tried only where the words that every
    match of it holds occur."""
    return reduce(lambda a, b: a & b, [contains_any(lowered, words) for words in needed_all(pattern)] + [text.rlike(java(pattern, True))])


def text_features(df: DataFrame) -> DataFrame:
    """Adds the scores that depend on the session's texts (needs prompt and what ``history`` adds).

    What turns hold is read from their marks. Joined texts are made only where a pattern is to be
    tried, or where a listed text may go over the joint of two turns (crosses)."""
    prompt = F.coalesce("prompt", F.lit(""))
    join = lambda n: F.array_join(last(n), " ")
    own = df.columns
    held = lambda n: F.aggregate(last(n, "marks"), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))
    trait = lambda name: has(F.col("traits"), TRAIT[name])
    # The prompt follows its own turns once more in the texts that are searched.
    after = F.concat(F.slice("marks", F.lit(2), F.size("marks")), F.array(F.element_at("marks", -1)))
    crosses = F.exists(F.zip_with("marks", after, lambda a, b: has(a, TAIL) & has(b, HEAD)), lambda x: x)
    counted = F.size(F.filter(last(PROGRESSION_TURNS, "marks"), lambda m: has(m, DIGIT))) >= LEAST_TURNS
    progress = F.when(counted, progression(last(PROGRESSION_TURNS))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"held3": held(3), "held5": held(5), "held6": held(6), "crosses": crosses, "progress": progress})
    df = fence(df, *own)
    crosses = F.col("crosses")
    needs = {n: reduce(lambda a, b: a | b, [BIT[tuple(words)] for words in needed_all(p)], 0) for _, n, p in fixed.BEHAVIOURS}
    # What a turn matches alone its joined text matches, since a joint is a word's end as a text's end is.
    alone = {n: has(F.col("held3"), BIT[f"behaviour:{n}"]) for n in needs}
    tried = {n: ~alone[n] & (crosses | has(F.col("held3"), bits)) for n, bits in needs.items()}
    only = lambda text: F.when(crosses, text)
    df = df.withColumns({
        "text3": F.when(reduce(lambda a, b: a | b, tried.values(), crosses), F.concat_ws(" ", join(3), prompt)), "three": only(F.lower(join(3))), "five": only(F.lower(join(5))), "both": only(F.concat_ws(" ", F.lower(join(6)), F.lower(prompt))),
    })
    df = fence(df.withColumn("lower3", only(F.lower("text3"))), *own)
    made = [c for c in df.columns if c not in own]
    found = lambda m, name, text: has(F.col(m), BIT[name]) | F.when(crosses, contains_any(F.col(text), LISTS[name])).otherwise(False)
    # As ``hits``, but compiled, which a filter by a lambda isn't.
    reasons = F.array_except(F.array(*[F.when(alone[n], F.lit(n)).when(tried[n] & F.col("text3").rlike(java(p, True)), F.lit(n)) for _, n, p in fixed.BEHAVIOURS]), F.array(F.lit(None).cast("string")))
    df = df.withColumn("behaviour_reasons", F.concat(reasons, "progress"))
    df = fence(df, *[c for c in df.columns if c != "behaviour_reasons"])
    points = F.create_map(*[F.lit(x) for p, n, _ in fixed.BEHAVIOURS for x in (n, float(p))], F.lit("identifier_enumeration"), F.lit(25.0), F.lit("quantity_escalation"), F.lit(20.0))
    df = df.withColumn("behaviour_score", F.least(F.lit(100.0), F.aggregate(F.transform("behaviour_reasons", lambda n: F.element_at(points, n)), F.lit(0.0), lambda a, x: a + x)))
    many = lambda name: F.size(F.filter(last(5, "marks"), lambda m: has(m, BIT[name]))) >= 3
    parts = {"rephrased": (trait("rephrase") & found("held5", "denial", "five"), 20), "schema": (many("schema"), 15), "restricted": (many("restricted"), 20)}
    df = df.withColumn("text_repetition", reduce(lambda a, b: a + b, [F.when(c, F.lit(float(p))).otherwise(0.0) for c, p in parts.values()]))
    paths = [(trait(f"late:{n}") & found("held6", f"early:{n}", "both"), float(p), n) for p, n, _, _ in fixed.ESCALATIONS]
    first = lambda k: reduce(lambda c, x: c.when(x[0], F.lit(x[k])), paths[1:], F.when(paths[0][0], F.lit(paths[0][k])))
    df = df.withColumns({"escalation_score": first(1).otherwise(0.0), "escalation_reason": first(2).otherwise("")})
    df = fence(df.withColumn("risky", trait("risky") | found("held3", "risky", "three")), *df.columns)
    intents = [(trait(k), n) for k, (n, _) in zip(INTENTS, fixed.SAFE_INTENTS)] + [(trait("able"), "product_question")]
    intent = reduce(lambda c, x: c.when(x[0], x[1]), intents[1:], F.when(*intents[0])).otherwise("")
    blank = F.trim(prompt) == ""
    df = df.withColumns({"capability": trait("able") & ~F.col("risky") & ~blank, "gate_category": F.when(F.col("risky") | blank, "").otherwise(intent)})
    abuse = found("held3", "abuse", "lower3")
    by = F.create_map(*[F.lit(x) for k, v in fixed.SAFE_DISCOUNTS.items() for x in (k, float(v))])
    df = df.withColumns({"abuse_indicator": abuse, "safe": (F.col("gate_category") != "") & ~abuse})
    return df.withColumn("discount", F.when(F.col("safe"), F.coalesce(F.try_element_at(by, F.col("gate_category")), F.lit(15.0))).otherwise(0.0)).drop(*made, "risky")


def overridden(df: DataFrame) -> DataFrame:
    """A capability question that the model calls an attack counts as safe, its confidence turned round."""
    wrong = is_attack(F.col("label")) & (F.col("confidence") >= 0.85) & F.col("capability")
    return df.withColumns({"confidence": F.when(wrong, F.lit(1.0) - F.col("confidence")).otherwise(F.col("confidence")), "label": F.when(wrong, "SAFE_CAPABILITY_QUESTION").otherwise(F.col("label"))})


def band(score: float) -> tuple[str, str]:
    for bound, verdict, action in ((85, "malicious", "kill"), (65, "high_risk", "raise_session_risk"), (40, "suspicious", "raise_session_risk"), (20, "watch", "log_only")):
        if score >= bound:
            return verdict, action
    return "safe", "allow"


INCREMENT = {"safe": 0.0, "watch": 5.0, "suspicious": 15.0, "high_risk": 30.0, "malicious": 50.0}
RISKY = ("suspicious", "high_risk", "malicious")


def status_of(score: float) -> str:
    return "kill_candidate" if score >= 120 else "high_risk" if score >= 80 else "watch" if score >= 40 else "active"


def eligibility(policy: Policy, forced: bool, row: dict, category: str, prompt_score: float, session_score: float, malicious_seen: int, current_malicious: bool) -> str:
    """Reason code; a kill is eligible where it begins with 'kill_eligible'."""
    confidence = float(row["confidence"])
    final, total = (prompt_score if prompt_score > 0 else session_score), session_score
    single = confidence >= policy.single_threshold
    gate = bool(row["safe"]) and not (confidence >= 0.99 and category in ("prompt_injection", "jailbreak"))
    denials = (
        (not (forced or policy.global_kill), "global_kill_disabled"),
        (not (forced or policy.tier2_kill), "tier2_kill_disabled"),
        (not (forced or policy.enforcement), "enforcement_not_configured"),
        (not (forced or policy.tier2_mode == "enforce"), "tenant_mode_not_enforce"),
        (not current_malicious, "model_label_not_malicious"),
        (confidence < policy.kill_threshold, "confidence_below_threshold"),
        (gate, "safe_intent_gate_blocked"),
        (final < 90, "prompt_score_below_kill_threshold"),
        (category == "generic_malicious", "generic_malicious_not_enough"),
    )
    for denied, reason in denials:
        if denied:
            return reason
    obvious = category in fixed.OBVIOUS_CATEGORIES
    if obvious:
        return "kill_eligible_obvious_extreme_confidence" if single else "session_score_below_threshold"
    enough = malicious_seen >= policy.min_malicious or single or total >= policy.session_kill_score
    return "kill_eligible_repeated_or_session_score" if enough else "repeated_evidence_required"


def context_step(given: Policy | None, reviewed: bool = True):
    """The step of one scope policy, or of the policy that each row carries (None). The state
    keeps the last nine verdicts before the prompt.

    With ``reviewed`` false no model is configured, and prompts take the skip path."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        policy = given or Policy(**{f: row[f] for f in POLICY_IN})
        s = state or {"score": 0.0, "epoch": 0, "terminated": False, "past": []}
        past, epoch = s["past"], int(row["epoch"])
        blocked = row["decision"] == "block"
        if not blocked and (policy.tier2_mode == "off" or not reviewed):
            path, verdict = ("off", "tier2_disabled") if policy.tier2_mode == "off" else ("no_endpoint", "not_reviewed")
            out = dict(path=path, verdict=verdict, action="log_only", category=verdict, prompt_score=0.0, session_before=0.0, session_after=0.0, session_status=status_of(s["score"]), repetition_score=0.0, repeated_suspicious=0, malicious_seen=0, reason=path, would_reason=path, event_type="", kill=False, would_kill=False)
            return {**s, "past": [*past, (verdict, verdict, "log_only")][-HISTORY + 1 :]}, out
        if blocked:
            category, repetition, score = "layer1_block", 0.0, float(row["regex_score"])
            verdict, action = "malicious", "raise_session_risk"
        else:
            category, score = row["category"], 0.0
            seen = sum(c == category for c, v, _ in past if v in ("watch", *RISKY) and c not in ("", "safe", "unknown", "tier2_disabled"))
            repetition = float(row["text_repetition"])
            if category not in ("safe", "unknown", "generic_malicious"):
                repetition += 20 if seen >= 2 else 10 if seen == 1 else 0
            repetition += 20 if sum(v == "high_risk" for _, v, _ in past[-4:]) >= 2 else 0
            repetition = min(100.0, repetition)
            evidence = (float(row["regex_score"]), float(row["behaviour_score"]), repetition, float(row["escalation_score"]))
            score = min(100.0, max(0.0, sum(evidence) + float(row["model_score"]) + float(row["category_score"]) - float(row["discount"])))
            if not any(evidence) and not row["abuse_indicator"]:
                score = min(score, 39.0)
            if row["safe"]:
                score = min(score, 19.0)
            score = round(score, 2)
            verdict, action = band(score)
        before = s["score"]
        if not s["terminated"] and float(row["regex_score"]) < 95 and verdict not in RISKY and s["epoch"]:
            age = epoch - s["epoch"]
            before *= 0.5 if age > 1800 else 0.75 if age > 900 else 1.0
        after = round(min(200.0, before + INCREMENT[verdict]), 2)
        before = round(before, 2)
        current = not blocked and row["label"].upper() in fixed.ATTACK_LABELS and float(row["confidence"]) >= 0.85
        malicious = sum(v == "malicious" or a == "kill" for _, v, a in past) + current
        if blocked:
            reason = would = "layer1_already_blocked"
        else:
            reason, would = (eligibility(policy, f, row, category, score, after, malicious, current) for f in (False, True))
        eligible, hypothetical = reason.startswith("kill_eligible"), would.startswith("kill_eligible")
        kill = action == "kill" and eligible
        if action == "kill" and not eligible:
            action = "raise_session_risk"
        risky = verdict in RISKY
        repeated = 1 if blocked else sum(v in RISKY for _, v, _ in past) + risky
        if blocked:
            event = "layer1_block"
        elif kill:
            event = "tier2_kill_allowed"
        elif policy.tier2_mode == "shadow" and hypothetical:
            event = "tier2_shadow_verdict"
        elif row["safe"] and hypothetical:
            event = "enforcement_skipped_safe_intent"
        elif verdict == "malicious":
            event = "tier2_kill_denied"
        else:
            event = f"tier2_{verdict}" if verdict != "safe" else "tier2_detection"
        if verdict == "safe" and not (kill or hypothetical or eligible):
            event = ""  # not written
        out = dict(path="layer1_blocked" if blocked else "scored", verdict=verdict, action=action, category=category, prompt_score=score, session_before=before, session_after=after, session_status="terminated" if kill else status_of(after), repetition_score=repetition, repeated_suspicious=int(repeated), malicious_seen=int(malicious), reason=reason, would_reason=would, event_type=event, kill=kill, would_kill=hypothetical)
        return {"score": after, "epoch": epoch, "terminated": s["terminated"] or kill, "past": [*past, (category, verdict, action)][-HISTORY + 1 :]}, out

    return step


#: What the stage reads of a prompt before the session fold, and of its scope's policy.
PROMPT_IN = ["scope_id", "session_id", "source", "prompt_id", "epoch", "prompt", "best_score", "matched_signatures", "expected_label"]
VERDICT = ["label", "confidence"]
POLICY_IN = [f.name for f in fields(Policy)]
STEP_IN = ["epoch", "decision", "regex_score", "category", "text_repetition", "behaviour_score", "escalation_score", "model_score", "category_score", "discount", "abuse_indicator", "safe", "label", "confidence"]
STEP_OUT = "path string, verdict string, action string, t2_category string, prompt_score double, session_before double, session_after double, session_status string, repetition_score double, repeated_suspicious int, malicious_seen int, reason string, would_reason string, event_type string, kill boolean, would_kill boolean"


def evidence(df: DataFrame) -> DataFrame:
    """Adds what the step reads, from hist, prompt, decision, best_score, label and confidence. The
    category is that of the model's input (see ``model_input``), by the marks of its turns."""
    df = overridden(text_features(df))
    said = F.filter("marks", lambda m: m.bitwiseAND(F.lit(BLANK).cast("long")) == 0)
    five = F.aggregate(last(MODEL_TURNS, "said"), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))
    df = fence(df.withColumn("said", said).withColumn("five", five).drop("said"), *df.columns)
    found = [F.col("five").bitwiseAND(F.lit(BIT[f"category:{c}"]).cast("long")) != 0 for c, _ in fixed.CATEGORY_KEYWORDS]
    df = df.withColumns({"category": category_by(F.col("label"), found), "regex_score": regex_component(F.col("decision"), F.col("best_score"), F.lit("none"))}).drop("five")
    return df.withColumns({"model_score": model_score(F.col("label"), F.col("confidence")), "category_score": category_score(F.col("category"))})


def unreviewed(df: DataFrame) -> DataFrame:
    """What the step reads where no model is configured: a blocked prompt counts by its first
    layer alone and every other one is skipped, so no text is looked at."""
    nothing = {"category": F.lit("unknown"), "abuse_indicator": F.lit(False), "safe": F.lit(False)}
    nothing |= {c: F.lit(0.0) for c in ("text_repetition", "behaviour_score", "escalation_score", "model_score", "category_score", "discount")}
    return df.withColumns(nothing | {"regex_score": regex_component(F.col("decision"), F.col("best_score"), F.lit("none"))})


def score_context(judged: DataFrame, verdicts: DataFrame | None, policy: Policy | None = Policy(), reviewed: bool = True) -> DataFrame:
    """Context scores of judged prompts (refused ones don't arrive); ``verdicts`` holds the
    model's (prompt_id, label, confidence), absent ones count as SAFE with confidence 0; with None
    the rows carry label and confidence themselves, which saves a join of all prompts. With
    ``reviewed`` false there is no model, and the columns of texts and evidence are left out. With
    ``policy`` None the rows carry their policy in the columns POLICY_IN."""
    carried = [] if policy else POLICY_IN
    known = MARKS if reviewed and set(MARKS) <= set(judged.columns) else []
    df = judged.where(~F.coalesce("refused", F.lit(False))).select(*PROMPT_IN, "decision", *known, *(VERDICT if verdicts is None else []), *carried)
    df = (df.join(verdicts, "prompt_id", "left") if verdicts is not None else df).withColumns({"label": F.coalesce("label", F.lit("SAFE")), "confidence": F.coalesce("confidence", F.lit(0.0))})
    df = evidence(history(df)).drop("hist", "marks", "traits", "behaviour_reasons") if reviewed else unreviewed(df)
    base = context_step(policy, reviewed)

    def step(state, row):
        state, out = base(state, row)
        return state, {**out, "t2_category": out["category"]}

    return fold(df, step, STEP_IN + carried, STEP_OUT)


def enforcement_risk(confidence: Column, session: Column) -> Column:
    return F.least(F.lit(12), F.bround(F.greatest(confidence * 100, session) / 100 * 12).cast("int"))
