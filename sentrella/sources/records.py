"""Decoding of queue and stream records and of signature feeds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrella.functions import scalars as S

PROMPT = T.StructType([T.StructField(n, t) for n, t in (
    ("prompt", T.StringType()), ("session_id", T.StringType()), ("scope_id", T.StringType()), ("source", T.StringType()), ("decision", T.StringType()),
    ("timestamp", T.LongType()), ("prompt_id", T.StringType()), ("agent_runtime_arn", T.StringType()), ("runtime_session_id", T.StringType()),
)])
IDENTITY = "struct<awsPrincipalArn:string>"
GATEWAY = f"struct<gatewayRequest:struct<path:string,httpMethod:string,headers:map<string,string>,body:string,context:struct<identity:{IDENTITY}>>>"
EVENT = f"struct<mcp:{GATEWAY},http:{GATEWAY},requestContext:struct<accountId:string,requestId:string>>"
BODY = "struct<jsonrpc:string,method:string,inputText:string,params:struct<name:string,arguments:map<string,string>,_meta:struct<baggage:string>>,messages:array<struct<role:string,content:string>>>"


def typed_value(attr):
    """A typed attribute ({'S': ...}, {'N': ...}, nested L and M) as a plain value."""
    if not isinstance(attr, dict) or len(attr) != 1:
        return None
    (kind, v), = attr.items()
    if kind == "N":
        return float(v) if any(c in v for c in ".eE") else int(v)
    if kind == "L":
        return [typed_value(x) for x in v]
    if kind == "M":
        return {k: typed_value(x) for k, x in v.items()}
    return None if kind == "NULL" else v


@F.pandas_udf(T.StringType())
def untyped(images: pd.Series) -> pd.Series:
    """JSON of typed attributes as plain JSON; the nesting has no fixed depth, so no expression fits."""
    return images.map(lambda t: None if t is None else json.dumps({k: typed_value(v) for k, v in json.loads(t).items()}, ensure_ascii=False))


def queue_records(raw: DataFrame, column: str = "record") -> DataFrame:
    """Prompt messages from queue bodies (JSON text or object) and from inserts of a change stream."""
    r = raw.select(F.get_json_object(column, "$.eventName").alias("event"), F.get_json_object(column, "$.body").alias("body"), F.get_json_object(column, "$.dynamodb.NewImage").alias("image"))
    r = r.where(F.col("event").isNull() | (F.col("event") == "INSERT"))
    text = F.when(F.col("image").isNotNull(), untyped("image")).otherwise(F.col("body"))
    return r.select(F.from_json(text, PROMPT).alias("p")).where("p is not null").select("p.*")


def gateway_events(raw: DataFrame, column: str = "event", agent: str = "agent", scope: str = "local", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw gateway events (JSON text) as parsed events: envelope, identity, all inspectable text;
    with the columns ``keep`` of the raw rows. Works on streams too."""
    e = raw.select(*keep, F.from_json(column, EVENT).alias("e"))
    which = F.when(F.col("e.mcp").isNotNull(), "mcp").when(F.col("e.http").isNotNull(), "http").otherwise("")
    request = F.coalesce(F.col("e.mcp.gatewayRequest"), F.col("e.http.gatewayRequest"))
    e = e.select(*keep, which.alias("envelope"), request.alias("r"), "e.requestContext.accountId", "e.requestContext.requestId")
    body = F.when(F.col("envelope") == "http", S.decode_body(F.col("r.body"))).otherwise(F.col("r.body"))
    e = e.withColumn("body_text", body).withColumn("b", F.from_json("body_text", BODY))
    e = e.withColumn("headers", F.map_from_entries(F.transform(F.map_entries(F.coalesce("r.headers", F.create_map().cast("map<string,string>"))), lambda x: F.struct(F.lower(x["key"]), x["value"]))))
    header = lambda n: F.nullif(F.trim(F.try_element_at("headers", F.lit(n))), F.lit(""))
    asserted = F.coalesce(header("mcp-session-id"), header("x-amzn-bedrock-agentcore-runtime-session-id"))
    baggage = F.nullif(S.session_from_baggage(F.col("b.params._meta.baggage")), F.lit(""))
    account = F.coalesce(F.nullif(S.account_of(F.col("r.context.identity.awsPrincipalArn")), F.lit("")), F.col("accountId"), F.lit(""))
    arg = lambda n: F.nullif(F.trim(F.try_element_at("b.params.arguments", F.lit(n))), F.lit(""))
    said = F.array_join(F.filter(F.transform("b.messages", lambda m: m["content"]), lambda c: F.trim(c) != ""), "\n")
    e = e.withColumn("h", S.harvest_text("body_text"))
    return e.select(
        *keep, F.lit(scope).alias("scope_id"), "envelope", S.source_of(account, F.lit(agent)).alias("source"), account.alias("account_id"),
        F.coalesce(asserted, baggage, S.derived_session(F.col("accountId"), F.col("requestId"), F.col("body_text"))).alias("session_id"), asserted.isNotNull().alias("session_authentic"),
        F.coalesce(F.nullif(F.trim("b.inputText"), F.lit("")), arg("prompt"), arg("message"), said, F.lit("")).alias("prompt"),
        F.when(S.is_control(F.col("b.method")), "").otherwise(F.col("h.text")).alias("inspectable_text"), F.col("h.truncated").alias("truncated"),
        S.is_control(F.col("b.method")).alias("control_frame"), F.array_join(S.baggage_keys(F.col("b.params._meta.baggage")), ",").alias("baggage_keys"),
    ).withColumn("gate", F.when(F.trim("inspectable_text") == "", "pass").when(F.col("truncated"), "refuse_truncated").when(F.col("account_id") == "", "refuse_no_source").otherwise("evaluate"))


def signature_feed(spark: SparkSession, path: str, expected_digest: str | None = None) -> DataFrame:
    """A feed file, a bare list or an object with a list of signatures, checked as a whole."""
    from sentrella.operators.catalogue import package

    whole = spark.read.text(path, wholetext=True)
    kind = "array<struct<id:string,pattern:string,severity:string,category:string>>"
    entries = whole.select(F.coalesce(F.from_json(F.get_json_object("value", "$.signatures"), kind), F.from_json("value", kind)).alias("s")).select(F.posexplode("s").alias("ord", "s")).select(F.col("s.id").alias("signature_id"), "s.severity", "s.category", "s.pattern", "ord")
    digest = whole.select(F.sha2("value", 256).alias("d")).first()
    return package(entries, digest.d if digest else None, expected_digest)


def mcp_body(body):
    """The JSON of a reply that comes plain or as the data line of an event stream."""
    data = F.regexp_extract(body, r"(?m)^data:\s*(.+)$", 1)
    return F.when(data != "", data).otherwise(body)


def checked(raw: DataFrame, column: str = "record", keep: list[str] | None = None) -> DataFrame:
    """Every record as a prompt message or, where it can't be read, as a row of its own with the
    reason and a safe verdict: one bad record doesn't stop the others."""
    p = F.from_json(column, PROMPT)
    rows = raw.select(*(keep or [column]), p.alias("p")).select(*(keep or [column]), "p.*")
    empty = F.coalesce(F.trim("prompt"), F.lit("")) == ""
    error = F.when(F.col("session_id").isNull() & F.col("prompt").isNull(), "unreadable record").when(empty, "no prompt").when(F.coalesce("session_id", F.lit("")) == "", "no session")
    return rows.withColumn("error", error).withColumn("verdict", F.when(F.col("error").isNotNull(), "safe"))
