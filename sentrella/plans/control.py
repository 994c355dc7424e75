"""Queries of the catalogue in use, event gates, messages, alerts and run control."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.functions import scalars as S
from sentrella.functions.plan import shared_folder, written
from sentrella.operators import catalogue, correlate, detect, patterns, reads, sessions
from sentrella.plans import registry as R
from sentrella.plans import sql as Q
from sentrella.plans.registry import EVT, J, evt, judged, query
from sentrella.sources import records, views

# --- the catalogue in use ------------------------------------------------------------

WORD = "[a-z]{4,}"


def feed(spark, sf):
    """A feed with one pattern for each benchmark text, its first longer word; every tenth entry
    claims a built-in id."""
    b = views.table(spark, sf, "benchmark").withColumn("pattern", F.regexp_extract(F.lower("text"), WORD, 0)).where("pattern <> ''")
    severity = F.get(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), (F.col("item_id") % 4).cast("int"))
    name = F.when(F.col("item_id") % 10 == 0, "sig-r-atlas-001").otherwise(F.concat(F.lit("feed-"), F.col("item_id").cast("string")))
    return b.select(name.alias("signature_id"), severity.alias("severity"), F.lit("feed").alias("category"), F.concat(F.lit("(?i)"), "pattern").alias("pattern"), F.col("item_id").cast("int").alias("ord"))


def own(spark, sf):
    """One configuration row with the operators' own signatures; every seventh is no pattern."""
    b = views.table(spark, sf, "benchmark").withColumn("w", F.regexp_extract(F.lower("text"), WORD + " " + WORD, 0)).where("w <> ''")
    entry = F.struct(
        "item_id", F.concat(F.lit("own-"), F.col("item_id").cast("string")).alias("signature_id"), F.when(F.col("item_id") % 3 == 0, "high").alias("severity"), F.lit(None).cast("string").alias("category"),
        F.concat(F.when(F.col("item_id") % 7 == 0, "(").otherwise("(?i)"), "w").alias("pattern"),
    )
    return catalogue.custom(b.agg(F.array_sort(F.collect_list(entry)).alias("custom_signatures")).withColumn("scope_id", F.lit("local"))).drop("scope_id")


def in_use(spark, sf):
    return catalogue.in_use(spark, catalogue.package(feed(spark, sf)), own(spark, sf))


_BUILTIN = ", ".join(f"({Q.q(i)}, {Q.q(s)}, {Q.q(c)}, {Q.q(p)}, {n}, 0)" for n, (i, s, c, p) in enumerate(fixed.SIGNATURES))
CATALOGUE = f"""builtin(signature_id, severity, category, pattern, ord, rank) AS (VALUES {_BUILTIN}),
feed AS (SELECT CASE WHEN item_id % 10 = 0 THEN 'sig-r-atlas-001' ELSE 'feed-' || item_id::VARCHAR END AS signature_id, ['critical', 'high', 'medium', 'low'][item_id % 4 + 1] AS severity, 'feed' AS category, '(?i)' || w AS pattern, item_id::INT AS ord, 1 AS rank
  FROM (SELECT item_id, regexp_extract(lower(text), '{WORD}') AS w FROM benchmark) WHERE w <> ''),
own AS (SELECT 'own-' || item_id::VARCHAR, CASE WHEN item_id % 3 = 0 THEN 'high' ELSE 'medium' END, 'custom', '(?i)' || w, n, 2 FROM (SELECT item_id, w, (row_number() OVER (ORDER BY item_id) - 1)::INT AS n FROM (SELECT item_id, regexp_extract(lower(text), '{WORD} {WORD}') AS w FROM benchmark) WHERE w <> '') WHERE n < 200 AND item_id % 7 <> 0),
parts AS (SELECT * FROM builtin UNION ALL SELECT * FROM feed WHERE (SELECT count(*) FROM feed) >= {catalogue.MIN_PACKAGE} UNION ALL SELECT * FROM own),
in_use AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY rank, ord) = 1)"""


@query(f"WITH {CATALOGUE} SELECT signature_id, severity, category, pattern, rank FROM in_use")
def sig_catalogue(spark, sf):
    """The catalogue in use: built-in, then a checked feed, then own signatures, append-only."""
    return in_use(spark, sf).select("signature_id", "severity", "category", "pattern", "rank")


@query(f"WITH {CATALOGUE} SELECT count(*) AS signatures, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM in_use")
def sig_metadata(spark, sf):
    return catalogue.metadata(in_use(spark, sf))


@query(f"WITH {CATALOGUE} SELECT signature_id, severity, category, count(*) AS documents FROM documents JOIN in_use ON rank > 0 AND regexp_matches(text, pattern) GROUP BY ALL")
def sig_added_hits(spark, sf):
    """Documents in which the added signatures occur, with severity and category."""
    used = catalogue.compiled(in_use(spark, sf).where("rank > 0"))
    if not used:
        return spark.createDataFrame([], "signature_id string, severity string, category string, documents long")
    docs = views.table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("v", F.array(F.struct("text", detect.low(F.col("text")).alias("low"))))
    found = docs.select(F.explode(F.flatten(F.transform("v", lambda t: detect.scan(t["text"], t["low"], used)))).alias("id"))
    return found.groupBy("id").agg(F.count("*").alias("documents")).withColumn("m", F.get(detect.detailed(F.array("id"), used), F.lit(0))).select(F.col("id").alias("signature_id"), "m.severity", "m.category", "documents")


@query(R.SQL["sig_added_hits"])
def sig_pattern_join(spark, sf):
    """The same by an inverted index of the patterns' literals: the catalogue stays a table."""
    entries = in_use(spark, sf).where("rank > 0")
    counted = patterns.counts(views.table(spark, sf, "documents").select("text"), entries).withColumnRenamed("n", "documents")
    return counted.join(entries.select("signature_id", "severity", "category"), "signature_id").select("signature_id", "severity", "category", "documents")


@query("WITH f AS (SELECT item_id % 3 AS g, count(*) AS n, count(*) FILTER (item_id % 3 = 1 AND item_id % 5 = 1) AS bad FROM benchmark GROUP BY 1) SELECT g AS feed, CASE WHEN bad = 0 AND n >= 10 THEN n ELSE 0 END AS accepted FROM f")
def sig_packages(spark, sf):
    """Feeds are taken whole or not at all: the second holds entries without a pattern."""
    b = views.table(spark, sf, "benchmark")
    pattern = F.when((F.col("item_id") % 3 == 1) & (F.col("item_id") % 5 == 1), "").otherwise("word")
    entries = b.select(F.concat(F.lit("feed-"), F.col("item_id").cast("string")).alias("signature_id"), pattern.alias("pattern"), (F.col("item_id") % 3).alias("feed"))
    taken = [catalogue.package(entries.where(F.col("feed") == g), minimum=10) for g in range(3)]
    both = taken[0].unionByName(taken[1]).unionByName(taken[2]).groupBy("feed").agg(F.count("*").alias("n"))
    return entries.select("feed").distinct().join(both, "feed", "left").select("feed", F.coalesce("n", F.lit(0)).alias("accepted"))


# --- event gates ------------------------------------------------------------------------

_METHODS = (*fixed.CONTROL_METHODS, "tools/call", "notifications/cancelled", "prompts/get", " ping ")


@query(f"SELECT conv_id, turn, trim(m) IN ({', '.join(map(Q.q, fixed.CONTROL_METHODS))}) OR starts_with(trim(m), 'notifications/') AS control FROM (SELECT conv_id, turn, [{', '.join(map(Q.q, _METHODS))}][(conv_id + turn) % {len(_METHODS)} + 1] AS m FROM conversations)")
def evt_control(spark, sf):
    """Protocol frames that carry no caller text."""
    m = F.get(F.array(*[F.lit(x) for x in _METHODS]), ((F.col("conv_id") + F.col("turn")) % len(_METHODS)).cast("int"))
    return views.table(spark, sf, "conversations").select("conv_id", "turn", S.is_control(m).alias("control"))


@query(f"SELECT conv_id, turn, CASE WHEN d <= {S.MAX_DEPTH} THEN 'deep text' ELSE '' END AS inspectable, d > {S.MAX_DEPTH} AS truncated FROM (SELECT conv_id, turn, conv_id % 16 AS d FROM conversations)")
def evt_nesting(spark, sf):
    """Bodies nested up to 15 deep: text below the limit is left out and reported."""
    d = (F.col("conv_id") % 16).cast("int")
    body = F.concat(F.expr("repeat('[', cast(conv_id % 16 as int))"), F.lit('"deep text"'), F.expr("repeat(']', cast(conv_id % 16 as int))"))
    return views.table(spark, sf, "conversations").where(d.isNotNull()).withColumn("h", S.harvest_text(body)).select("conv_id", "turn", F.col("h.text").alias("inspectable"), F.col("h.truncated").alias("truncated"))


@query("""SELECT conv_id, turn, role FROM conversations""")
def evt_stream_bodies(spark, sf):
    """Replies that come as plain JSON or as the data line of an event stream."""
    c = views.table(spark, sf, "conversations")
    plain = F.to_json(F.struct("role"))
    body = F.when(F.col("turn") % 2 == 0, plain).otherwise(F.concat(F.lit("event: message\ndata: "), plain, F.lit("\n\n")))
    return c.select("conv_id", "turn", F.get_json_object(records.mcp_body(body), "$.role").alias("role"))


@query(EVT + """SELECT prompt_id, 'derived-' || substr(sha256('{"account": "' || split_part(source, '/', 1) || '", "body": "' || event_id::VARCHAR || '", "request_id": "' || session_id || '"}'), 1, 32) AS session FROM evt""")
def evt_derived_session(spark, sf):
    """Stable ids of requests without a session."""
    return evt(spark, sf).select("prompt_id", S.derived_session(S.split_source(F.col("source"))["account"], F.col("session_id"), F.col("event_id").cast("string")).alias("session"))


@query("""SELECT conv_id, turn, CASE k WHEN 1 THEN 'unreadable record' WHEN 2 THEN 'no prompt' WHEN 3 THEN 'no session' END AS error, CASE WHEN k BETWEEN 1 AND 3 THEN 'safe' END AS verdict FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 IN (1, 3) THEN (conv_id + turn) % 7 WHEN (conv_id + turn) % 7 = 2 OR trim(text) = '' THEN 2 ELSE 0 END AS k FROM conversations WHERE text IS NOT NULL)""")
def evt_isolated(spark, sf):
    """Records that can't be read stay rows of their own, with a safe verdict."""
    c, k = views.table(spark, sf, "conversations").where("text is not null"), (F.col("conv_id") + F.col("turn")) % 7
    message = F.struct(F.when(k == 2, " ").otherwise(F.col("text")).alias("prompt"), F.when(k != 3, F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))).alias("session_id"))
    raw = c.select("conv_id", "turn", F.when(k == 1, "{broken").otherwise(F.to_json(message)).alias("record"))
    return records.checked(raw, "record", ["conv_id", "turn"]).select("conv_id", "turn", "error", "verdict")


# --- messages, alerts, audit ----------------------------------------------------------------


@query(J("SELECT prompt_id, prompt, session_id, scope_id, source, decision, epoch AS timestamp, TRUE AS published FROM folded"))
def snk_messages(spark, sf):
    """Queue messages, read back from their JSON."""
    m = reads.messages(judged(spark, sf))
    return m.select(F.from_json("message", reads.MESSAGE).alias("m"), "published").select("m.*", "published")


_OUTCOMES = ("not_configured", "failed", "unsupported", "unverified", "terminated")
_SUBJECT = "'Security alert: session ' || substr(session_id, 1, 8) || [' flagged (NOT terminated)', ' flagged, termination failed', ' flagged, termination unsupported', ' termination unverified', ' terminated'][event_id % 5 + 1]"


@query(J(f"SELECT prompt_id, session_id, channel, {Q.ladder('best_score', [(10, 'CRITICAL'), (7, 'HIGH'), (4, 'MEDIUM'), (1, 'LOW')], 'INFORMATIONAL')} AS severity, {_SUBJECT} AS subject, FALSE AS failed FROM folded, (VALUES ('notification'), ('finding')) c(channel) WHERE decision = 'block'"))
def snk_alerts(spark, sf):
    """Blocked prompts on both channels, with the subject that the outcome asks for."""
    outcome = F.get(F.array(*[F.lit(x) for x in _OUTCOMES]), (F.col("event_id") % 5).cast("int"))
    return reads.alerts(judged(spark, sf).where("decision = 'block'"), outcome)


@query(J("SELECT CASE WHEN event_id % 2 = 0 THEN 'queue' ELSE 'store' END AS component, CASE WHEN decision = 'refused' THEN 'session ended' ELSE 'timeout' END AS reason, count(*) AS degraded FROM folded WHERE decision = 'refused' OR event_id % 10 = 0 GROUP BY ALL"))
def snk_health(spark, sf):
    """Degraded-service counts by component and reason."""
    reason = F.when(F.col("decision") == "refused", "session ended").when(F.col("event_id") % 10 == 0, "timeout")
    return reads.health(judged(spark, sf), F.when(F.col("event_id") % 2 == 0, "queue").otherwise("store"), reason)


@query(J("SELECT scope_id, count(*) AS events, count(DISTINCT event_id) AS ids FROM events_ GROUP BY 1"))
def snk_append(spark, sf):
    """The audit table after two appends, even events first."""
    import uuid

    path = f"{shared_folder(spark)}/sentrella-audit-{uuid.uuid4().hex}"
    e = written(R.events(spark, sf), "events")  # both appends read it
    even = F.xxhash64("event_id") % 2 == 0
    reads.write_events(e.where(even), path)
    reads.write_events(e.where(~even), path)
    return spark.read.schema(e.schema).parquet(path).groupBy("scope_id").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


@query(J("""SELECT view, name, n FROM (SELECT 'total' AS view, 'all' AS name, count(*) AS n FROM events_ HAVING count(*) > 0 UNION ALL SELECT 'decision', decision, count(*) FROM events_ GROUP BY decision UNION ALL SELECT 'source', source, count(*) FROM events_ GROUP BY source
  UNION ALL SELECT 'severity', """ + Q.ladder("risk_score", [(20, "critical"), (10, "high"), (5, "medium")], "low") + """, count(*) FROM events_ GROUP BY 2 UNION ALL SELECT 'hour', (event_ts - event_ts % 3600)::VARCHAR, count(*) FROM events_ GROUP BY 2 UNION ALL SELECT 'rule', r, count(*) FROM (SELECT unnest(rules) AS r FROM events_) GROUP BY r)"""))
def qry_summary(spark, sf):
    """Six views of the events, read once."""
    from sentrella.functions.plan import written

    return reads.summary(written(R.events(spark, sf), "events"))


@query(R.T3 + f", {R.FOUND} SELECT 'tier3#' || method || '#' || window_start::VARCHAR || '#' || group_key AS event_id, window_start AS event_ts, cat AS category, trunc(group_score)::INT AS risk_score, 'tier3' AS provenance FROM found")
def qry_findings(spark, sf):
    """The findings among all events, latest first."""
    found = correlate.all_findings(R.t3_records(spark, sf), views.session_risks(evt(spark, sf)), near=False)
    both = R.events(spark, sf).unionByName(reads.findings_as_events(found))
    return reads.by_provenance(both, "tier3").select("event_id", "event_ts", F.get("matched_signatures", F.lit(0)).alias("category"), "risk_score", "provenance")


@query(J("SELECT prompt_id, best_score >= 8 AS would_have_killed, CASE WHEN expected_label = 'benign' THEN CASE WHEN best_score >= 8 OR decision = 'block' THEN 'false_positive' ELSE 'true_negative' END WHEN expected_label = 'attack' THEN CASE WHEN best_score >= 8 OR decision = 'block' THEN 'true_positive' ELSE 'false_negative' END ELSE 'unknown' END AS result_would_have FROM folded WHERE NOT refused"))
def qry_would_have(spark, sf):
    """The ledger's other outcome: what a policy that ends sessions from a score of 8 would have done."""
    return reads.ledger(judged(spark, sf), F.col("best_score") >= 8).select("prompt_id", "would_have_killed", "result_would_have")


_TITLE = "array_to_string(list_transform(string_split(lower(regexp_replace(category, '[_-]+', ' ', 'g')), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
_FAMILY = "CASE WHEN category = '' THEN 'Policy rule' WHEN starts_with(lower(category), 'ml:') OR starts_with(lower(category), 'ml-tier2-') OR lower(category) IN ('malicious', 'label_1', 'attack') THEN 'Tier 2 ML' " + " ".join(f"WHEN starts_with(category, {Q.q(p)}) THEN {Q.q(n)}" for p, n in reads.FAMILIES) + f" ELSE {_TITLE} END"
R.SQL["qry_families"] = J(f", {R.CAT}, fam AS (SELECT {_FAMILY} AS family, sum(n)::BIGINT AS n FROM cat GROUP BY 1) SELECT family, n, round(n / sum(n) OVER () * 100, 1) AS percentage FROM fam")


# --- policies and runs ------------------------------------------------------------------------


@query("""SELECT scope_id FROM (SELECT DISTINCT 'user-' || user_id::VARCHAR AS scope_id, user_id FROM events) WHERE user_id % 4 IN (1, 3) AND user_id % 7 <> 0 OR user_id % 7 = 0""")
def poly_bounds(spark, sf):
    """Scopes whose stored thresholds are inside their bounds."""
    s = views.table(spark, sf, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("scope_id"), "user_id").distinct()
    u = F.col("user_id")
    stored = s.where(u % 7 != 0).select("scope_id", F.when(u % 4 == 0, "1.5").when(u % 4 == 1, "0.3").when(u % 4 == 2, "-1").otherwise("0.9").alias("tier2_default_kill_threshold"))
    return reads.policy_valid(reads.policies(s, stored)).select("scope_id")


@query(EVT + "SELECT source AS scope_id, count(DISTINCT session_id) AS sessions FROM evt WHERE NOT ends_with(source, '-1') GROUP BY 1 HAVING count(DISTINCT session_id) >= 3")
def t3_eligible(spark, sf):
    """Scopes (here: sources) of a run: those that aren't off and have three sessions."""
    rows = R.t3_records(spark, sf).select(F.col("source").alias("scope_id"), "session_id")
    modes = rows.select("scope_id").distinct().withColumn("tier3_mode", F.when(F.col("scope_id").endswith("-1"), "off").when(F.col("scope_id").endswith("-2"), "enforce"))
    return correlate.eligible_scopes(rows, modes)


@query(R.T3 + f", {R.FOUND}, dd AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY window_start, cluster_key ORDER BY {R._RANK}, group_score DESC) = 1) SELECT count(*) AS findings, max(group_score) AS max_score, 1::BIGINT AS scopes FROM dd")
def t3_run_summary(spark, sf):
    """Counters of a run."""
    f = correlate.analyse(R.t3_records(spark, sf), views.session_risks(evt(spark, sf)), near=False)
    return correlate.run_summary(f).select("findings", "max_score", "scopes")


# --- what is recorded of corrections --------------------------------------------------------


def _pairs(name, pairs):
    rows = ", ".join(f"({i}, {Q.q(a)}, {Q.q(b)}, {Q.q(chr(92) + 'b' + Q.literal(a) + chr(92) + 'b')})" for i, (a, b) in enumerate(pairs))
    return f"{name}(i, a, b, p) AS (VALUES {rows})"


def _log(name, pairs, start):
    return f"""{name} AS (SELECT prompt, 0 AS i, {start} AS t, '' AS log FROM texts UNION ALL
  SELECT prompt, l.i + 1, regexp_replace(t, p, b, 'g'), CASE WHEN regexp_matches(t, p) THEN log || CASE WHEN log = '' THEN '' ELSE ',' END || a || '>' || b ELSE log END FROM {name} l JOIN {pairs} s ON s.i = l.i)"""


_BOTH = "SELECT prompt FROM evt UNION SELECT coalesce(text, '') FROM conversations WHERE role = 'user'"
_HINTS = "array_to_string(list_sort(" + Q.hits([(lang, Q.any_of("both_text", words)) for lang, words in fixed.LANGUAGE_TERMS.items()]) + "), ',')"
R.SQL["nrm_change_log"] = (
    Q.tier1().split("scanned AS MATERIALIZED")[0].replace("SELECT DISTINCT prompt FROM evt", _BOTH).rstrip().rstrip(",")
    + f", {_pairs('typo', fixed.TYPOS)}, {_pairs('phrase', fixed.PHRASES)}, {_log('typo_log', 'typo', 'normalized')}, "
    + _log("phrase_log", "phrase", "(SELECT t FROM typo_log x WHERE x.prompt = texts.prompt AND x.i = " + str(len(fixed.TYPOS)) + ")")
    + f" SELECT t.prompt, a.log AS typos, b.log AS phrases, {_HINTS} AS languages FROM (SELECT *, lower(prompt) || ' ' || corrected AS both_text FROM texts) t JOIN typo_log a ON a.prompt = t.prompt AND a.i = {len(fixed.TYPOS)} JOIN phrase_log b ON b.prompt = t.prompt AND b.i = {len(fixed.PHRASES)}"
)


# --- near-duplicate prompts in SQL --------------------------------------------------------------

_PLAIN = r"trim(regexp_replace(lower(prompt), '\s+', ' ', 'g'), ' ')"
R.SQL["t3_simhash"] = R.T3 + f""", tokens AS (SELECT prompt, unnest(list_concat(regexp_extract_all(pl, '[a-z0-9_'']+'), list_transform(range(1, greatest(1, length(pl) - 3)::BIGINT + 1), lambda i: substr(replace(pl, ' ', '_'), i, 4)))) AS tok FROM (SELECT DISTINCT prompt, {_PLAIN} AS pl FROM records)),
hashed AS (SELECT prompt, ('0x' || right(sha256(tok), 16))::UBIGINT AS h FROM tokens),
votes AS (SELECT prompt, b, sum(CASE WHEN (h >> b::UBIGINT) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS v FROM hashed, range(0, 64) bits(b) GROUP BY ALL),
prints AS (SELECT prompt, sum(CASE WHEN v >= 0 THEN pow(2::HUGEINT, b)::HUGEINT ELSE 0::HUGEINT END)::UBIGINT AS fp FROM votes GROUP BY prompt),
rows_ AS (SELECT window_start, session_id, prompt_id, fp FROM records JOIN prints USING (prompt)),
near AS (SELECT a.window_start, a.fp AS base, b.fp AS other FROM (SELECT DISTINCT window_start, fp FROM rows_) a JOIN (SELECT DISTINCT window_start, fp FROM rows_) b ON a.window_start = b.window_start AND bit_count(xor(a.fp, b.fp)::BIT) <= {correlate.DISTANCE}),
star AS (SELECT n.window_start, base, r.session_id, r.prompt_id FROM near n JOIN rows_ r ON r.window_start = n.window_start AND r.fp = n.other),
sets AS (SELECT window_start, (CASE WHEN base >= 9223372036854775808::UBIGINT THEN base::HUGEINT - 18446744073709551616::HUGEINT ELSE base::HUGEINT END)::VARCHAR AS group_key, count(*) AS prompts, count(DISTINCT session_id) AS sessions, list(prompt_id ORDER BY prompt_id) AS ids FROM star GROUP BY ALL HAVING count(DISTINCT session_id) >= {correlate.MIN_SESSIONS})
SELECT window_start, min(group_key) AS group_key, prompts, sessions FROM sets GROUP BY window_start, ids, prompts, sessions"""


# --- the context stage in SQL ---------------------------------------------------------------------

_RISKY = "('suspicious', 'high_risk', 'malicious')"
_CENTS = "format('{{:.2f}}', {})::DOUBLE"


def _progress_sql() -> str:
    """Progressions through the last six turns: series of the numbers of turns of one shape."""
    shape = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\d+', ' # ', 'g'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
    return f"""turned AS (SELECT prompt_id, unnest(h[-6:]) AS t, unnest(range(1, len(h[-6:]) + 1)) AS pos FROM hist),
shaped AS (SELECT prompt_id, pos, {shape} AS shape, list_transform(regexp_extract_all(t, '\\d+'), lambda x: x::DOUBLE) AS nums FROM turned WHERE regexp_matches(t, '\\d')),
series AS (SELECT prompt_id, min(pos) OVER (PARTITION BY prompt_id, shape) AS first_pos, shape, pos, count(*) OVER (PARTITION BY prompt_id, shape) AS n, min(len(nums)) OVER (PARTITION BY prompt_id, shape) AS wide, nums FROM shaped WHERE contains(shape, ' ')),
points AS (SELECT prompt_id, first_pos, shape, pos, c, nums[c] AS v FROM series, range(1, 60) k(c) WHERE n >= 3 AND c <= wide),
rises AS (SELECT *, v - lag(v) OVER w AS rise, first_value(v) OVER w AS v0 FROM points WINDOW w AS (PARTITION BY prompt_id, shape, c ORDER BY pos)),
judged_series AS (SELECT prompt_id, first_pos, c, min(rise) > 0 AND max(rise) <= 10 AS enumerated, min(rise) > 0 AND any_value(v0) > 0 AND max(v) / any_value(v0) >= 4 AS escalated FROM rises GROUP BY prompt_id, shape, first_pos, c),
progress AS (SELECT prompt_id, list(name ORDER BY place) AS names FROM (SELECT prompt_id, name, min(place) AS place FROM (
  SELECT prompt_id, 'identifier_enumeration' AS name, first_pos * 1000 + c * 2 AS place FROM judged_series WHERE enumerated UNION ALL SELECT prompt_id, 'quantity_escalation', first_pos * 1000 + c * 2 + 1 FROM judged_series WHERE escalated) GROUP BY ALL) GROUP BY prompt_id)"""


def _features_sql() -> str:
    ctes = R._text_features_sql().split(f", {R.HIST}, ", 1)[1]
    body, final = ctes.rsplit("\nSELECT prompt_id, pattern_behaviour", 1)
    behaviours = Q.hits([(n, f"regexp_matches(text3, {Q.q('(?i)' + p)})") for _, n, p in fixed.BEHAVIOURS])
    points = " + ".join(f"CASE WHEN list_contains(reasons, {Q.q(n)}) THEN {p} ELSE 0 END" for p, n in [*((p, n) for p, n, _ in fixed.BEHAVIOURS), (25, "identifier_enumeration"), (20, "quantity_escalation")])
    risky = f"({Q.any_of('lower(prompt)', fixed.RISKY_CONTEXT)} OR " + Q.any_of("lower(array_to_string(h[-3:], ' '))", fixed.RISKY_CONTEXT) + ")"
    capability = "(" + " OR ".join(f"regexp_matches(prompt, {Q.q('(?i)' + p)})" for p in fixed.CAPABILITY_PATTERNS) + ")"
    return f"""{R.HIST}, {_progress_sql()}, {body}, tf AS (SELECT prompt_id, pattern_behaviour{final}),
beh AS (SELECT prompt_id, reasons, least(100, {points})::DOUBLE AS behaviour_score, capability FROM (SELECT a.prompt_id, list_concat({behaviours}, coalesce(names, [])) AS reasons, {capability} AND NOT {risky} AND trim(prompt) <> '' AS capability FROM a LEFT JOIN progress USING (prompt_id)))"""


R.SQL["t2_progressions"] = EVT.rstrip() + f", {_features_sql()} SELECT prompt_id, coalesce(array_to_string(reasons, ','), '') AS reasons, behaviour_score FROM beh"


def context_sql(policy: str) -> str:
    """The fold of the context stage as a recursion over the prompts of a session, under the
    default policy, an enforcing one with every switch on, or the columns of a CTE ``held``."""
    own = policy == "policy"
    threshold, least, single = ("tier2_default_kill_threshold", "tier2_min_malicious_verdicts_for_kill", "tier2_allow_single_verdict_kill_threshold") if own else (0.97, 2, 0.99)
    attack = "upper(label) IN (" + ", ".join(map(Q.q, fixed.ATTACK_LABELS)) + ")"
    cat = " ".join(f"WHEN {Q.q(k)} THEN {v}" for k, v in fixed.CATEGORY_SCORES.items())
    obvious = ", ".join(map(Q.q, fixed.OBVIOUS_CATEGORIES))
    chain = f"""CASE WHEN NOT current_ THEN 'model_label_not_malicious' WHEN confidence < {threshold} THEN 'confidence_below_threshold' WHEN safe AND NOT (confidence >= 0.99 AND category IN ('prompt_injection', 'jailbreak')) THEN 'safe_intent_gate_blocked'
      WHEN (CASE WHEN score > 0 THEN score ELSE after_ END) < 90 THEN 'prompt_score_below_kill_threshold' WHEN category = 'generic_malicious' THEN 'generic_malicious_not_enough'
      WHEN category IN ({obvious}) THEN CASE WHEN confidence >= {single} THEN 'kill_eligible_obvious_extreme_confidence' ELSE 'session_score_below_threshold' END
      WHEN bad >= {least} OR confidence >= {single} OR after_ >= 120 THEN 'kill_eligible_repeated_or_session_score' ELSE 'repeated_evidence_required' END"""
    shadow = "tier2_mode = 'shadow'" if own else "FALSE" if policy == "enforce" else "TRUE"
    reason = chain if policy == "enforce" else "'global_kill_disabled'"
    if own:
        reason = "CASE WHEN NOT global_kill THEN 'global_kill_disabled' WHEN NOT tier2_kill THEN 'tier2_kill_disabled' WHEN NOT enforcement THEN 'enforcement_not_configured' WHEN tier2_mode <> 'enforce' THEN 'tenant_mode_not_enforce' ELSE " + chain + " END"
    off = "NOT blocked AND tier2_mode = 'off'" if own else "FALSE"
    held, held_join = (", p.*", " JOIN (SELECT * EXCLUDE (prompt_id), prompt_id AS held_id FROM held) p ON p.held_id = f.prompt_id") if own else ("", "")
    status = Q.ladder("after_", [(120, "kill_candidate"), (80, "high_risk"), (40, "watch")], "active")
    return f""", {R.VERDICTS}, {_features_sql()},
mi AS (SELECT prompt_id, array_to_string(list_transform(list_filter(list_transform(h, lambda x: trim(x)), lambda x: x <> '')[-5:], lambda x: '[USER] ' || x), ' ') AS ml_input FROM hist),
said AS (SELECT prompt_id, CASE WHEN wrong THEN 'SAFE_CAPABILITY_QUESTION' ELSE label END AS label, CASE WHEN wrong THEN 1.0 - confidence ELSE confidence END::DOUBLE AS confidence FROM (SELECT v.*, {attack} AND confidence >= 0.85 AND capability AS wrong FROM verdicts v JOIN beh USING (prompt_id))),
catd AS (SELECT prompt_id, label, confidence, {R._category_sql('ml_input')} AS category, ({R._MODEL})::DOUBLE AS model_score FROM said JOIN mi USING (prompt_id)),
feat AS MATERIALIZED (SELECT f.session_id, f.prompt_id, f.epoch, f.prompt, f.decision = 'block' AS blocked, f.best_score, (CASE WHEN f.decision = 'block' THEN CASE WHEN f.best_score >= 12 THEN 95 WHEN f.best_score >= 8 THEN 80 ELSE 95 END ELSE 0 END)::DOUBLE AS regex_score,
    c.label, c.confidence, c.category, c.model_score, (CASE c.category {cat} ELSE 0 END)::DOUBLE AS category_score, t.text_repetition, b.behaviour_score, t.escalation_score, t.discount, t.abuse_indicator, t.gate_category <> '' AND NOT t.abuse_indicator AS safe{held},
    row_number() OVER (PARTITION BY f.session_id ORDER BY f.epoch, f.prompt_id) AS rn FROM folded f JOIN catd c USING (prompt_id) JOIN tf t USING (prompt_id) JOIN beh b USING (prompt_id){held_join}),
ctx AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, '' AS prompt_id, 0.0::DOUBLE AS state, 0::BIGINT AS since, FALSE AS ended, []::STRUCT(c VARCHAR, v VARCHAR, a VARCHAR)[] AS past, '' AS verdict, '' AS action, '' AS category, 0.0::DOUBLE AS score, 0.0::DOUBLE AS before_, 0 AS repeated, '' AS reason, '' AS would, '' AS event_type, FALSE AS kill, FALSE AS would_kill, FALSE AS was_blocked, FALSE AS skipped FROM feat
  UNION ALL
  SELECT session_id, rn, prompt_id, CASE WHEN off THEN state ELSE after_ END, CASE WHEN off THEN since ELSE epoch END, ended OR (kill AND NOT off), list_append(past, CASE WHEN off THEN {{'c': 'tier2_disabled', 'v': 'tier2_disabled', 'a': 'log_only'}} ELSE {{'c': category, 'v': verdict, 'a': act}} END)[-9:],
    CASE WHEN off THEN 'tier2_disabled' ELSE verdict END, CASE WHEN off THEN 'log_only' ELSE act END, CASE WHEN off THEN 'tier2_disabled' ELSE category END, CASE WHEN off THEN 0.0 ELSE score END, CASE WHEN off THEN 0.0 ELSE before_r END, CASE WHEN off THEN 0 ELSE repeated END,
    CASE WHEN off THEN 'off' ELSE reason END, CASE WHEN off THEN 'off' ELSE would END, CASE WHEN off THEN '' WHEN verdict = 'safe' AND NOT (kill OR hypo OR eligible) THEN '' WHEN blocked THEN 'layer1_block' WHEN kill THEN 'tier2_kill_allowed' WHEN {shadow} AND hypo THEN 'tier2_shadow_verdict' WHEN safe AND hypo THEN 'enforcement_skipped_safe_intent'
      WHEN verdict = 'malicious' THEN 'tier2_kill_denied' WHEN verdict <> 'safe' THEN 'tier2_' || verdict ELSE 'tier2_detection' END, kill AND NOT off, hypo AND act0 = 'kill', blocked, off
  FROM (SELECT *, {off} AS off, act0 = 'kill' AND eligible AS kill, CASE WHEN act0 = 'kill' AND NOT eligible THEN 'raise_session_risk' ELSE act0 END AS act, CASE WHEN blocked THEN 1 ELSE len(list_filter(past, lambda x: x.v IN {_RISKY})) + (verdict IN {_RISKY})::INT END::INT AS repeated
  FROM (SELECT *, starts_with(reason, 'kill_eligible') AS eligible, starts_with(would, 'kill_eligible') AS hypo
  FROM (SELECT *, CASE WHEN blocked THEN 'layer1_already_blocked' ELSE {reason} END AS reason, CASE WHEN blocked THEN 'layer1_already_blocked' ELSE {chain} END AS would
  FROM (SELECT *, {_CENTS.format("least(200.0, before0 + CASE verdict WHEN 'watch' THEN 5 WHEN 'suspicious' THEN 15 WHEN 'high_risk' THEN 30 WHEN 'malicious' THEN 50 ELSE 0 END)")} AS after_, {_CENTS.format('before0')} AS before_r,
    NOT blocked AND {attack} AND confidence >= 0.85 AS current_, len(list_filter(past, lambda x: x.v = 'malicious' OR x.a = 'kill')) + (NOT blocked AND {attack} AND confidence >= 0.85)::INT AS bad
  FROM (SELECT *, state * CASE WHEN NOT ended AND regex_score < 95 AND verdict NOT IN {_RISKY} AND since <> 0 THEN CASE WHEN epoch - since > 1800 THEN 0.5 WHEN epoch - since > 900 THEN 0.75 ELSE 1.0 END ELSE 1.0 END AS before0
  FROM (SELECT *, CASE WHEN blocked THEN 'malicious' ELSE {Q.ladder('score', [(85, 'malicious'), (65, 'high_risk'), (40, 'suspicious'), (20, 'watch')], 'safe')} END AS verdict,
    CASE WHEN blocked THEN 'raise_session_risk' ELSE {Q.ladder('score', [(85, 'kill'), (40, 'raise_session_risk'), (20, 'log_only')], 'allow')} END AS act0
  FROM (SELECT * EXCLUDE (category), CASE WHEN blocked THEN 'layer1_block' ELSE category END AS category, CASE WHEN blocked THEN regex_score ELSE {_CENTS.format('CASE WHEN safe THEN least(19.0, s1) ELSE s1 END')} END AS score
  FROM (SELECT *, CASE WHEN regex_score = 0 AND behaviour_score = 0 AND rep = 0 AND escalation_score = 0 AND NOT abuse_indicator THEN least(39.0, s0) ELSE s0 END AS s1
  FROM (SELECT *, least(100.0, greatest(0.0, regex_score + behaviour_score + rep + escalation_score + model_score + category_score - discount)) AS s0
  FROM (SELECT *, least(100.0, text_repetition + CASE WHEN category NOT IN ('safe', 'unknown', 'generic_malicious') THEN CASE WHEN seen >= 2 THEN 20 WHEN seen = 1 THEN 10 ELSE 0 END ELSE 0 END + CASE WHEN len(list_filter(past[-4:], lambda x: x.v = 'high_risk')) >= 2 THEN 20 ELSE 0 END) AS rep
  FROM (SELECT c.past, c.state, c.since, c.ended, f.*, len(list_filter(c.past, lambda x: x.c = f.category AND x.v IN ('watch', 'suspicious', 'high_risk', 'malicious') AND x.c NOT IN ('', 'safe', 'unknown', 'tier2_disabled'))) AS seen
    FROM ctx c JOIN feat f ON f.session_id = c.session_id AND f.rn = c.rn + 1)))))))))))),
scored AS MATERIALIZED (SELECT x.prompt_id, x.session_id, CASE WHEN was_blocked THEN 'layer1_blocked' WHEN skipped THEN 'off' ELSE 'scored' END AS path, verdict, action, x.category, score AS prompt_score, before_ AS session_before, CASE WHEN skipped THEN 0.0 ELSE state END AS session_after, CASE WHEN kill THEN 'terminated' ELSE {status.replace('after_', 'state')} END AS session_status,
  repeated AS repeated_suspicious, reason, would AS would_reason, event_type, kill, would_kill, least(12, round_even(greatest(f.confidence * 100, state) / 100 * 12, 0))::INT AS enforcement_risk, f.epoch, f.prompt, CASE WHEN was_blocked THEN 'block' ELSE 'allow' END AS decision FROM ctx x JOIN feat f ON f.prompt_id = x.prompt_id)"""


R.SQL["t2_scored"] = J(context_sql('default') + " SELECT prompt_id, path, verdict, action, category, prompt_score, session_before, session_after, session_status, repeated_suspicious, reason, would_reason, event_type, enforcement_risk FROM scored", False)
R.SQL["t2_enforced"] = J(context_sql('enforce') + " SELECT prompt_id, verdict, action, kill, reason, session_status, event_type FROM scored", False)
R.SQL["qry_evidence_top10"] = J(context_sql('default') + " SELECT prompt_id, session_id, prompt, decision, verdict, epoch FROM scored WHERE decision = 'block' OR action = 'kill' OR verdict IN ('watch', 'suspicious', 'high_risk', 'malicious') ORDER BY epoch DESC, prompt_id DESC LIMIT 10", False)
R.SQL["qry_reviewed_top12"] = J(context_sql('default') + " SELECT prompt_id, session_id, verdict, prompt_score, epoch FROM scored WHERE path = 'scored' ORDER BY epoch DESC, prompt_id DESC LIMIT 12", False)
R.SQL["t2_tally"] = J(context_sql('default') + " SELECT count(*) FILTER (path = 'scored') AS processed, count(*) FILTER (kill) AS blocked, count(*) FILTER (path <> 'scored') AS skipped, 0::BIGINT AS errors, count(*) FILTER (kill) AS kills, count(*) FILTER (verdict IN ('watch', 'suspicious', 'high_risk')) AS raised, count(*) AS reviewed FROM scored", False)
_T3_TAIL = R.T3[len(EVT.rstrip()) + len(f", {R.VERDICTS}") :]
R.SQL["qry_feed"] = J(
    context_sql('default') + f"{_T3_TAIL}, {R.FOUND}, dd AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY window_start, cluster_key ORDER BY {R._RANK}, group_score DESC) = 1)"
    " SELECT layer, category, count(*) AS n FROM (SELECT 'Detection Event' AS layer, coalesce(intents[1], 'uncategorized') AS category FROM events_ UNION ALL SELECT 'Layer 1', coalesce(intents[1], 'uncategorized') FROM events_ WHERE decision = 'block' OR len(sigs) > 0"
    " UNION ALL SELECT 'Tier 2', category FROM scored UNION ALL SELECT 'Tier 3', cat FROM dd) GROUP BY ALL", False)


# --- records that carry the first stage's findings; clusters of vectors ----------------------------

_HAS = lambda *ws: "len(list_filter(sigs, lambda s: " + " OR ".join(f"contains(s, {Q.q(w)})" for w in ws) + ")) > 0"
_HINTED = "len(list_filter(sigs, lambda s: " + Q.any_of("lower(s)", fixed.CRITICAL_HINTS) + ")) > 0"


@query(J(f"SELECT prompt_id, CASE WHEN {_HAS('credential', 'secret')} THEN 'credential_theft' WHEN {_HAS('exfil')} THEN 'customer_data_exfiltration' WHEN {_HAS('jailbreak', 'prompt')} THEN 'system_prompt_extraction' ELSE 'unknown' END AS category, {_HINTED} AS critical_signature, best_score::DOUBLE AS record_risk FROM folded WHERE NOT refused"))
def t3_carried(spark, sf):
    """Records of the cross-session stage with the signatures and risk of the first: the category
    comes from the signature ids where none is stored."""
    j = judged(spark, sf).where("not refused").withColumns({"category": F.lit(""), "risk": F.col("best_score").cast("double"), "repeated": F.lit(0)})
    return correlate.records(j, R.MINUTES).select("prompt_id", "category", "critical_signature", "record_risk")


@query("""WITH v AS (SELECT vec_id, label, (embedding::DOUBLE[])[1:8] AS e FROM embeddings), near AS (SELECT a.label, a.vec_id AS base, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND (a.vec_id = b.vec_id OR list_cosine_similarity(a.e, b.e) >= 0.82)),
sets AS (SELECT label, list(other ORDER BY other) AS ids, count(*) AS prompts, count(DISTINCT other % 50) AS sessions FROM near GROUP BY label, base HAVING count(DISTINCT other % 50) >= 3)
SELECT 'label-' || label::VARCHAR AS category, prompts, sessions, count(*) AS groups FROM (SELECT DISTINCT label, ids, prompts, sessions FROM sets) GROUP BY ALL""")
def t3_embedding(spark, sf):
    """Star clusters of vectors of one category."""
    return correlate.stars(R.t3_embedded(spark, sf)).groupBy(F.col("group_category").alias("category"), "prompts", "sessions").agg(F.count("*").alias("groups"))


# --- the gate, feeds as files, known prompts, examples ------------------------------------------------


@query(J("SELECT prompt_id, CASE WHEN refused OR decision = 'block' THEN 'refuse' ELSE 'pass' END AS action, CASE WHEN decision = 'block' THEN 'stopped' END AS kill_outcome FROM folded"))
def eng_gate(spark, sf):
    """What a gate does with each prompt: it refuses the blocked one and stops the session at once."""
    return sessions.actions(judged(spark, sf), "gate").select("prompt_id", "action", "kill_outcome")


@query("""SELECT CASE WHEN item_id % 10 = 0 THEN 'sig-r-atlas-001' ELSE 'feed-' || item_id::VARCHAR END AS signature_id, ['critical', 'high', 'medium', 'low'][item_id % 4 + 1] AS severity, 'feed' AS category, '(?i)' || w AS pattern
FROM (SELECT item_id, regexp_extract(lower(text), '[a-z]{4,}') AS w FROM benchmark) WHERE w <> ''""")
def src_signature_feed(spark, sf):
    """A feed written as one JSON file, and read back as a whole."""
    folder = f"{shared_folder(spark)}/sentrella-feed-{uuid.uuid4().hex}"
    entry = F.to_json(F.struct(F.struct("ord", F.col("signature_id").alias("id"), "pattern", "severity", "category").alias("e"))).alias("e")
    entries = feed(spark, sf).select("ord", entry).agg(F.array_sort(F.collect_list(F.struct("ord", "e"))).alias("all"))  # one file by nature; a feed has MAX_ENTRIES at most
    body = F.concat(F.lit('{"signatures": ['), F.array_join(F.transform("all", lambda x: F.get_json_object(x["e"], "$.e")), ", "), F.lit("]}"))
    entries.select(body.alias("value")).coalesce(1).write.text(folder)
    return records.signature_feed(spark, folder).select("signature_id", "severity", "category", "pattern")


@query("""WITH known AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL)
SELECT 'doc-' || doc_id::VARCHAR AS prompt_id, sha256(coalesce(text, '')) AS digest, sha256(coalesce(text, '')) IN (SELECT digest FROM known) AS known FROM documents""")
def sig_known_prompts(spark, sf):
    """Whole documents against a feed of known digests, those of every fiftieth document: it
    finds them and their exact copies. A join, so the feed may be of any size."""
    d = views.table(spark, sf, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    known = d.where("doc_id % 50 = 0 and text is not null").select(digest.alias("digest"), F.lit("critical").alias("severity"))
    rows = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("prompt_id"), digest.alias("digest"))
    return detect.known_digests(rows, known).select("prompt_id", "digest", F.col("severity").isNotNull().alias("known"))


@query(R.T3 + f""", nth AS (SELECT method, window_start, group_key, prompt_id, row_number() OVER (PARTITION BY method, window_start, group_key ORDER BY epoch, prompt_id) AS n FROM members)
SELECT method, window_start, group_key, string_agg(prompt_id, ',' ORDER BY n) AS examples FROM nth WHERE n <= 10 GROUP BY ALL""")
def t3_examples(spark, sf):
    """The first ten prompts of each group."""
    rows, risks = written(R.t3_records(spark, sf), "t3-records"), views.session_risks(evt(spark, sf))
    m = correlate.exact_hash(rows).unionByName(correlate.pattern(rows)).unionByName(correlate.category(rows)).unionByName(correlate.session_risk(rows, risks))
    return correlate.examples(m).select("method", "window_start", "group_key", F.array_join("examples", ",").alias("examples"))


@query("""WITH own AS (SELECT 'own-' || item_id::VARCHAR AS signature_id, '(?i)' || w AS pattern FROM (SELECT item_id, regexp_extract(lower(text), '[a-z]{4,} [a-z]{4,}') AS w FROM benchmark) WHERE w <> ''), old AS (SELECT * FROM own WHERE right(signature_id, 1) IN ('0', '1', '2', '3'))
SELECT signature_id, min(pattern) AS pattern, CASE WHEN signature_id IN (SELECT signature_id FROM old) THEN 'stored' ELSE 'added' END AS state FROM own GROUP BY signature_id""")
def sig_authored(spark, sf):
    """Signatures appended as authors write them: a known id is kept, a new one is added."""
    b = views.table(spark, sf, "benchmark").select(F.concat(F.lit("own-"), F.col("item_id").cast("string")).alias("signature_id"), F.regexp_extract(F.lower("text"), WORD + " " + WORD, 0).alias("w")).where("w <> ''").select("signature_id", F.concat(F.lit("(?i)"), "w").alias("pattern"))
    stored = b.where(F.substring("signature_id", -1, 1).isin("0", "1", "2", "3"))
    return catalogue.authored(stored, b).select("signature_id", "pattern", "state")


# --- all six detectors in SQL ---------------------------------------------------------------------------

_SIM = R.SQL["t3_simhash"][len(R.T3) : R.SQL["t3_simhash"].index("\nSELECT window_start, min(group_key)")]
_BASE_KEY = "(CASE WHEN n.base >= 9223372036854775808::UBIGINT THEN n.base::HUGEINT - 18446744073709551616::HUGEINT ELSE n.base::HUGEINT END)::VARCHAR"
_ALL_MEMBERS = f"""{R.T3.replace("members AS MATERIALIZED (", "members4 AS MATERIALIZED (", 1)}{_SIM},
pick AS (SELECT window_start, min(group_key) AS group_key FROM sets GROUP BY window_start, ids),
sim AS (SELECT 'simhash' AS method, p.group_key, r.* FROM pick p JOIN near n ON n.window_start = p.window_start AND {_BASE_KEY} = p.group_key JOIN rows_ x ON x.window_start = n.window_start AND x.fp = n.other JOIN records r ON r.prompt_id = x.prompt_id),
vecs AS (SELECT vec_id, label, (embedding::DOUBLE[])[1:{views.VECTOR}] AS e, 'vec-' || lpad(vec_id::VARCHAR, 12, '0') AS prompt_id, 'user-' || (vec_id % 50)::VARCHAR AS session_id FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
vnear AS (SELECT a.label, a.vec_id AS base, b.vec_id AS other, b.prompt_id, b.session_id FROM vecs a JOIN vecs b ON a.label = b.label AND (a.vec_id = b.vec_id OR list_cosine_similarity(a.e, b.e) >= {correlate.COSINE})),
vsets AS (SELECT label, base, list(other ORDER BY other) AS ids FROM vnear GROUP BY label, base HAVING count(DISTINCT session_id) >= {correlate.MIN_SESSIONS}),
vpick AS (SELECT label, min(base) AS base FROM vsets GROUP BY label, ids),
emb AS (SELECT 'embedding' AS method, base::VARCHAR AS group_key, session_id, prompt_id, 'label-' || label::VARCHAR AS category, 0.0::DOUBLE AS record_risk, now AS epoch, now - now % {R.MINUTES * 60} AS window_start FROM vpick JOIN vnear USING (label, base), (SELECT max(epoch) AS now FROM evt)),
members AS MATERIALIZED (SELECT * FROM members4 UNION ALL BY NAME SELECT * FROM sim UNION ALL BY NAME SELECT * FROM emb)"""
_ALL_FOUND = R.FOUND.replace("(CASE method WHEN 'exact_hash'", "(CASE method WHEN 'simhash' THEN CASE WHEN has_category THEN 0.90 WHEN has_risk THEN 0.86 ELSE 0.78 END WHEN 'embedding' THEN CASE WHEN has_category AND has_risk THEN 0.93 ELSE 0.91 END WHEN 'exact_hash'", 1)
_CRITICAL = ", ".join(map(Q.q, fixed.CRITICAL_CATEGORIES))
R.SQL["t3_full_analysis"] = f"""{_ALL_MEMBERS}, {_ALL_FOUND},
burst AS (SELECT *, sha256('local|' || window_start::VARCHAR || '|' || method || '|' || cat || '|' || CASE method WHEN 'exact_hash' THEN group_key WHEN 'category_burst' THEN cat ELSE cluster_key END) AS burst_id FROM found),
dd AS (SELECT * FROM burst QUALIFY row_number() OVER (PARTITION BY window_start, cluster_key ORDER BY {R._RANK}, group_score DESC, burst_id) = 1),
sure AS (SELECT *, confidence >= 0.9 AND sessions >= 3 AND CASE method WHEN 'exact_hash' THEN critical WHEN 'simhash' THEN critical AND (average_risk >= 80 OR max_risk >= 90) WHEN 'embedding' THEN critical AND average_risk >= 80 AND repeated >= 2 WHEN 'normalized_pattern_burst' THEN critical OR max_risk >= 90 ELSE FALSE END AS would FROM dd),
named AS (SELECT *, CASE method WHEN 'exact_hash' THEN CASE WHEN would THEN 'tier3_exact_critical_repeat' ELSE 'tier3_exact_grouped_alert' END WHEN 'simhash' THEN CASE WHEN would THEN 'tier3_simhash_critical_burst' ELSE 'tier3_simhash_grouped_alert' END
    WHEN 'embedding' THEN CASE WHEN would THEN 'tier3_embedding_critical_cluster' ELSE 'tier3_embedding_grouped_alert' END WHEN 'normalized_pattern_burst' THEN CASE WHEN would THEN 'tier3_pattern_supported_critical_burst' ELSE 'tier3_pattern_grouped_alert' END
    WHEN 'session_risk_burst' THEN 'tier3_session_risk_grouped_alert' ELSE 'tier3_category_grouped_alert' END AS threshold_used,
  CASE WHEN group_score < 90 THEN 'group_score_below_threshold' WHEN sessions < 3 THEN 'affected_sessions_below_threshold' WHEN confidence < 0.95 THEN 'confidence_below_threshold' WHEN confidence < 0.9 THEN 'similarity_below_threshold'
    WHEN method IN ('normalized_pattern_burst', 'session_risk_burst') AND cat IN ('unknown', 'safe', 'allow', 'session_risk') THEN 'generic_pattern_alert_only' WHEN NOT (method IN ('exact_hash', 'simhash', 'category_burst', 'embedding') OR method = 'normalized_pattern_burst' AND cat IN ({_CRITICAL})) THEN 'method_not_enforcement_eligible' ELSE '' END AS why FROM sure)
SELECT method, window_start, cat AS category, sessions, confidence, group_score, CASE WHEN would AND why = '' THEN 'grouped_kill_triggered' ELSE {Q.ladder('group_score', [(85, 'grouped_malicious'), (65, 'grouped_high_risk')], 'grouped_watch')} END AS decision,
  CASE WHEN would AND why = '' THEN 'kill' ELSE 'grouped_alert_only' END AS action, CASE WHEN would THEN why ELSE threshold_used END AS kill_denied_reason, burst_id FROM named"""
