"""Searches that settle most documents before patterns and lists are tried."""

import re
import unicodedata

from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.functions import text as T
from sentrella.functions.dialect import any_of, java, literal
from sentrella.operators import detect
from sentrella.sources import views


def test_any_of_finds_what_the_texts_do():
    for texts in (["a", "ab", "abc", "b.c", "-x"], [t for ts in fixed.TERMS.values() for t in ts], [a for a, _ in fixed.TYPOS]):
        one, plain = re.compile(any_of(texts)), re.compile("|".join(map(literal, texts)))
        said = [*texts, *[t[:-1] for t in texts], *[t[1:] for t in texts], *[f"x{t}y" for t in texts], "", "b"]
        assert [bool(one.search(s)) for s in said] == [bool(plain.search(s)) for s in said]


def test_composition_is_skipped_only_where_it_changes_nothing(spark):
    said = ["plain", "d\u00e9j\u00e0 vu", "\u5ffd\u7565", "\u0434\u0430", "e\u0301", "\uff21\uff22", "\u304b\u3099", "\u00b2", "\ufb01", "\u1112\u1161\u11ab", "\u0627\u0653", "x" * 50_000 + "\u00e9" * 50_000, *views.SAYINGS]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", T.nfkc(F.col("s")).alias("c"), F.col("s").rlike(T.UNCHANGED).alias("skipped")).collect()
    assert all(r.c == unicodedata.normalize("NFKC", r.s) for r in rows)
    assert [r.skipped for r in rows[:11]] == [True] * 4 + [False] * 7 and rows[11].skipped


def test_lists_rules_and_combinations_equal_their_plain_form(spark):
    said = [*views.SAYINGS, *[s for _, _, s, _, _ in views.TEMPLATES], *[ws for ws, _, _ in fixed.RISK_COMBOS], *[t for ts in fixed.TERMS.values() for t in ts], "apikeys and api", "keyapi"]
    df = detect.normalised(spark.createDataFrame([(a + " " + b,) for a, b in zip(said, said[11:] + said[:11])], "prompt string"))
    text, compact = F.col("policy_text"), F.col("policy_compact")
    listed = F.array(*[F.size(T.hits([(t, F.contains(text, F.lit(t))) for t in ts]) if n == "multilingual" else detect.term_hits(n, text, compact)) > 0 for n, ts in fixed.TERMS.items()])
    patterns = [*fixed.SAFE_PATTERNS, *fixed.RULE_PATTERNS.values()]
    words = F.split(F.trim(F.lower("corrected")), java(r"\s+"))
    combos = F.array(*[F.size(F.array_except(F.array(*[F.lit(w) for w in ws.split()]), words)) == 0 for ws, _, _ in fixed.RISK_COMBOS])
    rows = detect.risk(df.withColumns({"listed": F.exists(listed, lambda x: x), "some": detect.some_term(text, compact), "plain": F.array(*[text.rlike(java(p)) for p in patterns]), "words": F.array(*[T.where_needed(text, text, p) for p in patterns]), "combos": combos})).collect()
    assert all(r.some or not r.listed for r in rows) and any(r.listed for r in rows)
    assert all(r.plain == r.words for r in rows) and any(any(r.plain) for r in rows)
    names = [n for _, _, n in fixed.RISK_COMBOS]
    assert all([n in r.risk_signals for n in names] == r.combos for r in rows) and any(any(r.combos) for r in rows)
