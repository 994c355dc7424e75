"""The policy in force: versions of each scope's policy, joined as of the time of each row.

A policy is stored by scope and version and holds from the time it was written to the next
version of its scope; the deployment's own switches are a log of the same kind. Rows older
than the first version, and scopes without one, take the defaults, which never enforce.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrella.functions import scalars as S
from sentrella.operators import reads

HOUR = 3600
#: The deployment's switches; an operator's stop, whatever a scope's policy says.
GUARDS = ("global_kill", "tier2_kill", "tier3_kill", "enforcement")
DEPLOYMENT = "deployment"


def intervals(marks: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """Adds until, the time of the next mark of the key (null for the last). Of marks of one
    time only the last in ``order`` holds."""
    following = F.lead(at).over(Window.partitionBy(*by).orderBy(at, *order))
    return marks.withColumn("until", following).where(F.col("until").isNull() | (F.col("until") > F.col(at)))


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], time: str, at: str, order: list[str], bin_seconds: int = HOUR) -> DataFrame:
    """``rows`` with the other columns of the latest mark of their key at or before their time.

    Rows and marks meet in bins of time: a bin has the mark in force at its start, found by a
    window over the few (key, bin) pairs and marks, and those written inside it. Inside a bin
    both are sorted by time and each row takes the last mark before it, so the work grows with
    their number and not with their pairs. Rows with a null key or time, or before the first
    mark, get nulls."""
    values = [c for c in marks.columns if c not in by and c != at]
    mark = F.struct(F.col(at).alias("at"), "until", *values)
    held = intervals(marks.where(F.col(at).isNotNull()), by, at, order).select(*by, F.col(at).alias("at"), mark.alias("mark"))
    bin_of = lambda c: F.floor(F.col(c) / bin_seconds)
    needed = rows.select(*by, bin_of(time).alias("bin")).where("bin is not null").distinct()
    starts = needed.select(*by, (F.col("bin") * bin_seconds).alias("at"), "bin")
    seen = Window.partitionBy(*by).orderBy("at", F.col("bin").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = held.unionByName(starts, allowMissingColumns=True).withColumn("mark", F.last("mark", ignorenulls=True).over(seen))
    carried = both.where(F.col("bin").isNotNull() & F.col("mark").isNotNull()).select(*by, "bin", "mark")
    inside = held.select(*by, bin_of("at").alias("bin"), "mark").where(F.col("mark.at") > F.col("bin") * bin_seconds)
    found = carried.unionByName(inside).select(*by, F.col("bin").alias("as_of_bin"), F.col("mark.at").alias("as_of_at"), "mark")
    sought = rows.select(*by, bin_of(time).alias("as_of_bin"), F.col(time).alias("as_of_at"), F.struct(*rows.columns).alias("row"))
    # Rows without a key or time are dealt by chance and stay without a mark.
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, "as_of_at"]])
    before = Window.partitionBy(*by, "as_of_bin").orderBy("as_of_at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = found.unionByName(sought.where(known), allowMissingColumns=True).withColumn("mark", F.last("mark", ignorenulls=True).over(before)).where("row is not null")
    none = sought.where(~known).withColumn("mark", F.lit(None).cast(found.schema["mark"].dataType))
    return merged.unionByName(none, allowMissingColumns=True).select("row.*", *[F.col(f"mark.{v}").alias(v) for v in values])


def in_force(rows: DataFrame, stored: DataFrame, deployments: DataFrame, time: str = "epoch") -> DataFrame:
    """``rows`` (with scope_id) with the fields of the scope's policy and the deployment's
    switches at their time. ``stored`` has scope_id, updated_at and string fields,
    ``deployments`` updated_at and switches."""
    fields = reads.policy_fields(stored)
    raw = [c for c in reads.POLICY_NAMES if c in stored.columns]
    found = as_of(rows, stored.select("scope_id", F.col("updated_at").cast("long").alias("updated_at"), *raw), ["scope_id"], time, "updated_at", ["policy_version"])
    found = found.select(*rows.columns, *[v.alias(k) for k, v in fields.items()]).withColumn("all", F.lit(DEPLOYMENT))
    switches = deployments.select(F.lit(DEPLOYMENT).alias("all"), F.col("updated_at").cast("long").alias("updated_at"), *GUARDS)
    found = as_of(found, switches, ["all"], time, "updated_at", list(GUARDS)).drop("all")
    return found.withColumns({g: F.coalesce(S.to_bool(F.col(g), False), F.lit(False)) for g in GUARDS})


def tier2() -> dict[str, Column]:
    """The columns that the context stage's step reads (see ``context.Policy``)."""
    return {
        "tier2_mode": F.col("tier2_mode"), "kill_threshold": F.col("tier2_default_kill_threshold"), "min_malicious": F.col("tier2_min_malicious_verdicts_for_kill").cast("int"),
        "single_threshold": F.col("tier2_allow_single_verdict_kill_threshold"), "session_kill_score": F.lit(120.0), "global_kill": F.col("global_kill"), "tier2_kill": F.col("tier2_kill"), "enforcement": F.col("enforcement"),
    }
