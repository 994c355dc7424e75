"""Identity, coercion, event and similarity scalars."""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from sentrella.functions import fixed
from sentrella.functions.text import plain

MAX_DEPTH, MAX_CHARS = 12, 256_000
HARVEST = StructType([StructField("text", StringType()), StructField("truncated", BooleanType())])

# --- coercions that never fail -------------------------------------------------


def to_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("double").cast("bigint"), F.lit(default).cast("bigint"))


def to_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def to_bool(value: Column, default: bool = True) -> Column:
    """A string is true where it equals 'true', whatever its case; absent values take the default."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(default))


def to_strings(value: Column) -> Column:
    return F.coalesce(F.transform(value, lambda x: x.cast("string")), F.array().cast("array<string>"))


def count_of(value: Column, default: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), to_int(value, default))


def mode_of(value: Column, default: Column | str = "shadow") -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("off", "shadow", "enforce"), v).otherwise(F.lit(default) if isinstance(default, str) else default)


# --- identity --------------------------------------------------------------------


def account_of(arn: Column) -> Column:
    parts = F.split(F.coalesce(arn, F.lit("")), ":")
    account = F.trim(F.get(parts, F.lit(4)))
    return F.when((F.size(parts) > 5) & account.rlike("^[0-9]+$"), account).otherwise("")


def agent_of(arn: Column) -> Column:
    return F.element_at(F.split(F.coalesce(arn, F.lit("")), "/"), -1)


def source_of(account: Column, agent: Column) -> Column:
    return F.concat_ws("/", account, agent)


def split_source(source: Column) -> Column:
    """account and agent, cut at the first slash."""
    at = F.instr(source, "/")
    return F.struct(
        F.when(at > 0, F.substring(source, F.lit(1), at - 1)).otherwise(source).alias("account"),
        F.when(at > 0, F.substring(source, at + 1, F.length(source))).otherwise("").alias("agent"),
    )


def runtime_id(session: Column, prefix: str = "session-") -> Column:
    """Ids of 33 characters or more stay; shorter ones are padded out by their digest."""
    return F.when(F.length(session) >= 33, session).otherwise(F.concat(F.lit(prefix), F.sha2(session, 256)))


# --- gateway events ----------------------------------------------------------------


def session_from_baggage(baggage: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(baggage, F.lit("")), r"(?:^|,)\s*session\.id=([^,\s]+)", 1))


def baggage_keys(baggage: Column) -> Column:
    names = F.transform(F.split(F.coalesce(baggage, F.lit("")), ","), lambda x: F.trim(F.get(F.split(x, "="), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def is_control(method: Column) -> Column:
    m = F.trim(F.coalesce(method, F.lit("")))
    return m.isin(*fixed.CONTROL_METHODS) | m.startswith("notifications/")


def decode_body(body: Column) -> Column:
    """base64 of UTF-8 text, or the body as it came."""
    strict = body.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(body) > 0)
    raw = F.when(strict, F.try_to_binary(body, F.lit("base64")))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.coalesce(text, body)


def _strings(node, depth: int, out: list[str]) -> bool:
    """Collects text in order; true where the structure is too deep."""
    if depth > MAX_DEPTH:
        return True
    deep = False
    if isinstance(node, str):
        out.append(node)
    elif isinstance(node, dict):
        for k, v in node.items():
            if isinstance(v, str) and k.lower() in fixed.STRUCTURAL_KEYS:
                deep |= depth + 1 > MAX_DEPTH
                continue
            deep |= _strings(v, depth + 1, out)
    elif isinstance(node, list):
        for v in node:
            deep |= _strings(v, depth + 1, out)
    return deep


def harvest(body: str | None) -> tuple[str, bool]:
    """All caller-supplied text of a JSON body (or of a plain one), and whether a limit was met."""
    try:
        node = json.loads(body) if body else None
    except ValueError:
        node = body
    except RecursionError:
        return "", True
    found: list[str] = []
    cut = _strings(node, 0, found)
    kept, room = [], MAX_CHARS
    for text in filter(None, map(str.strip, found)):
        if room <= 0 or len(text) > room:
            cut = True
            if room > 0:
                kept.append(text[:room])
            break
        kept.append(text)
        room -= len(text)
    return "\n".join(kept), cut


@F.pandas_udf(HARVEST)
def harvest_text(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([harvest(b) for b in bodies], columns=["text", "truncated"])


def derived_session(account: Column, request: Column, body: Column) -> Column:
    """A stable id of a request without one: a digest of its parts as JSON with sorted keys and a
    space after each separator. The body's text counts as it came."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), "(?s)^.{5}(.*).$", 1)
    seed = F.concat(F.lit('{"account": '), quoted(account), F.lit(', "body": '), quoted(body), F.lit(', "request_id": '), quoted(request), F.lit("}"))
    return F.concat(F.lit("derived-"), F.substring(F.sha2(seed, 256), 1, 32))


# --- similarity -----------------------------------------------------------------------


def prompt_hash(text: Column) -> Column:
    return F.sha2(plain(text), 256)


def stable_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Zero for unequal lengths or zero norms."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y)
    as_double = lambda v: F.transform(v, lambda x: x.cast("double"))
    x, y = as_double(a), as_double(b)
    norm = F.sqrt(add(F.transform(x, lambda v: v * v))) * F.sqrt(add(F.transform(y, lambda v: v * v)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), add(F.zip_with(x, y, lambda u, v: u * v)) / norm).otherwise(0.0)


def simhash_of(text: str) -> int:
    """Signed 64-bit SimHash over tokens and character 4-grams of normalised text."""
    import re

    import numpy as np

    t = " ".join((text or "").lower().split())
    joined = t.replace(" ", "_")
    grams = [joined[i : i + 4] for i in range(max(1, len(joined) - 3))] if joined else []
    counts = Counter(re.findall(r"[a-z0-9_']+", t) + grams)
    if not counts:
        return -1
    low = np.array([int.from_bytes(sha256(x.encode("utf-8", "surrogatepass")).digest()[-8:], "big") for x in counts], dtype="<u8")
    bits = np.unpackbits(low.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    votes = (2 * bits - 1).T @ np.fromiter(counts.values(), dtype=np.int64)
    return int(np.packbits(votes >= 0, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return texts.map(simhash_of)


# --- ladders ------------------------------------------------------------------------------


def ladder(value: Column, steps: list[tuple[float, object]], otherwise) -> Column:
    """The first label whose bound the value reaches."""
    (bound, label), *rest = steps
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return reduce(lambda c, s: c.when(value >= s[0], lit(s[1])), rest, F.when(value >= bound, lit(label))).otherwise(lit(otherwise))


def alert_severity(score: Column) -> Column:
    return ladder(score, [(10, "CRITICAL"), (7, "HIGH"), (4, "MEDIUM"), (1, "LOW")], "INFORMATIONAL")


def alert_subject(kill_outcome: Column, session: Column) -> Column:
    short = F.concat(F.lit("Security alert: session "), F.substring(session, 1, 8))
    end = (
        F.when(kill_outcome == "not_configured", " flagged (NOT terminated)")
        .when(kill_outcome.isin("failed", "unsupported"), F.concat(F.lit(" flagged, termination "), kill_outcome))
        .when(kill_outcome == "unverified", " termination unverified")
        .otherwise(" terminated")
    )
    return F.concat(short, end)


def ui_severity(score: Column) -> Column:
    return ladder(score, [(20, "critical"), (10, "high"), (5, "medium")], "low")


def outcome(expected: Column, actual: Column, predicted: Column) -> Column:
    blocked = F.lower(F.coalesce(actual, F.lit(""))).isin("blocked", "killed") | F.lower(F.coalesce(predicted, F.lit(""))).isin("block", "kill")
    label = F.lower(F.coalesce(expected, F.lit("unknown")))
    return (
        F.when(label == "benign", F.when(blocked, "false_positive").otherwise("true_negative"))
        .when(label == "attack", F.when(blocked, "true_positive").otherwise("false_negative"))
        .otherwise("unknown")
    )
