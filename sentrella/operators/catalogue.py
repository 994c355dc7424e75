"""Signature catalogues: the built-in one, feeds, validation and append-only union."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sentrella.functions import fixed

COLUMNS = "signature_id string, severity string, category string, pattern string, ord int"
MIN_PACKAGE, MAX_CUSTOM, MAX_ENTRIES = 20, 200, 5000


def builtin(spark: SparkSession) -> DataFrame:
    """The 92 built-in patterns; a catalogue is a small dimension by nature."""
    return spark.createDataFrame([(*s, i) for i, s in enumerate(fixed.SIGNATURES)], COLUMNS)


def hash_catalogue(spark: SparkSession) -> DataFrame:
    weight = fixed.SEVERITY_WEIGHTS
    return spark.createDataFrame([(i, s, c, d, weight.get(s, fixed.UNKNOWN_HASH_WEIGHT)) for i, s, c, d in fixed.HASHES], "signature_id string, severity string, category string, digest string, weight int")


def redos_risk(pattern: str) -> bool:
    """An unbounded quantifier over a group that itself holds an unbounded quantifier or a
    top-level alternation, which lets a backtracking matcher take exponential time."""
    stack: list[bool] = []  # for each open group: does it hold a repeat or an alternation?
    i, n = 0, len(pattern)
    closed: bool | None = None
    while i < n:
        c = pattern[i]
        if c == "\\":
            closed = None
            i += 2
            continue
        if c == "[":
            i += 1
            if pattern[i : i + 1] == "^":
                i += 1
            if pattern[i : i + 1] == "]":
                i += 1
            while i < n and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            closed = None
        elif c == "(":
            stack.append(False)
            closed = None
        elif c == ")":
            closed = stack.pop() if stack else False
            if closed and stack:
                stack[-1] = stack[-1] or pattern[i + 1 : i + 2] in ("*", "+")
        elif c in "*+" or re.match(r"\{\d*,\}", pattern[i:]):
            if closed:
                return True
            if stack:
                stack[-1] = True
            closed = None
        elif c == "|":
            if stack:
                stack[-1] = True
            closed = None
        else:
            closed = None
        i += 1
    return False


def valid_pattern(pattern: str | None) -> bool:
    if not pattern or not pattern.strip() or redos_risk(pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


@F.udf(BooleanType())
def is_valid(signature_id, pattern):
    """Row by row: feeds hold hundreds of rows, and compiling is not an expression."""
    return bool(signature_id) and valid_pattern(pattern)


def package(entries: DataFrame, content_digest: str | None = None, expected_digest: str | None = None, minimum: int = MIN_PACKAGE) -> DataFrame:
    """All entries of a feed, or none: a wrong digest, too few entries or one bad entry rejects it."""
    if expected_digest is not None and content_digest != expected_digest:
        return entries.limit(0)
    judged = entries.withColumn("ok", is_valid("signature_id", "pattern"))
    verdict = judged.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("all_ok"), F.count("*").alias("n"))
    return judged.crossJoin(F.broadcast(verdict)).where(F.col("all_ok") & (F.col("n") >= minimum)).select(*entries.columns)  # one row on the right


def custom(config: DataFrame) -> DataFrame:
    """Operator-written signatures of a configuration row: the first 200, bad ones skipped."""
    rows = config.select("scope_id", F.posexplode(F.slice("custom_signatures", 1, MAX_CUSTOM)).alias("ord", "s")).select(
        "scope_id", "s.signature_id", F.coalesce("s.severity", F.lit("medium")).alias("severity"), F.coalesce("s.category", F.lit("custom")).alias("category"), "s.pattern", "ord"
    )
    return rows.where(is_valid("signature_id", "pattern"))


def append_only(*parts: DataFrame) -> DataFrame:
    """Union in order of trust: an id belongs to its first catalogue and its first entry there."""
    ranked = [p.select("signature_id", "severity", "category", "pattern", "ord", F.lit(i).alias("rank")) for i, p in enumerate(parts)]
    both = ranked[0]
    for p in ranked[1:]:
        both = both.unionByName(p)
    first = F.row_number().over(Window.partitionBy("signature_id").orderBy("rank", "ord"))
    return both.withColumn("n", first).where("n = 1").drop("n")


def refreshed(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """The candidate, unless it holds fewer entries than the catalogue in use."""
    return candidate if candidate.count() >= current.count() else current


def in_use(spark: SparkSession, feed: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """The built-in signatures, then a checked feed's, then the operators' own; none is ever
    replaced, and the result is never smaller than the built-in catalogue."""
    base = builtin(spark)
    return refreshed(base, append_only(base, *[p for p in (feed, own) if p is not None]))


def compiled(entries: DataFrame) -> tuple[tuple[str, str, str, str], ...]:
    """The entries for ``detect.scan``, in order. A catalogue is configuration: more than
    MAX_ENTRIES is refused rather than cut."""
    rows = entries.orderBy("rank", "ord").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a catalogue of more than {MAX_ENTRIES} entries")
    return tuple((r.signature_id, r.severity, r.category, r.pattern) for r in rows)


def metadata(entries: DataFrame) -> DataFrame:
    """Number of entries of a catalogue and its distinct categories."""
    return entries.agg(F.count("*").alias("signatures"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def authored(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue of a scope after an author's additions: a stored id keeps its pattern, of a
    new one repeated in the addition the least pattern is added. Adds state, stored or added."""
    fresh = new.groupBy("signature_id").agg(F.min("pattern").alias("pattern")).join(stored.select("signature_id").distinct(), "signature_id", "left_anti")
    return stored.select("signature_id", "pattern", F.lit("stored").alias("state")).unionByName(fresh.select("signature_id", "pattern", F.lit("added").alias("state")))
