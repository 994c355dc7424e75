"""The same analytics over unbounded prompts.

Stateless detection runs on a stream as it does on a table. The session fold keeps one small
state for each session through ``transformWithState``, with the batch fold's step, so
both give the same rows where events come in order. Windows use event time with a watermark;
rows later than it are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrella.operators.sessions import KEYS, RISK_OUT, risk_step

LATE, WINDOW, COOLDOWN = "10 minutes", "5 minutes", "30 minutes"
STATE = "data string"


def unique(prompts: DataFrame, time: str = "ts") -> DataFrame:
    """At-least-once delivery made once, inside the watermark."""
    return prompts.withWatermark(time, LATE).dropDuplicatesWithinWatermark(["scope_id", "session_id", "prompt_id"])


class Fold(StatefulProcessor):
    """Runs a step over each session's rows of a micro-batch, in (epoch, prompt_id) order."""

    step: Callable = staticmethod(risk_step)
    inputs = ["epoch", "session_input", "risk_intents", "stateless_block"]
    outputs = [x.strip().split(" ")[0] for x in RISK_OUT.split(",")]
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        # Most sessions have a few rows in a micro-batch: making frames of them costs more than the steps.
        last = self.state.get()
        state = json.loads(last[0]) if last else None
        for row in sorted(rows, key=lambda r: (r["epoch"] is None, r["epoch"] or 0, r["prompt_id"] is None, r["prompt_id"] or "")):
            state, got = type(self).step(state, {n: row[n] for n in self.inputs})
            yield Row(**{n: row[n] for n in (*KEYS, "prompt_id", "epoch")}, **{n: got[n] for n in self.outputs})
        self.state.update((json.dumps(state),))

    def close(self) -> None:
        pass


class StrictFold(Fold):
    """Forgets a session thirty minutes after its last prompt."""

    ttl_ms = 30 * 60 * 1000


def session_risk_stream(detected: DataFrame, strict_ttl: bool = False) -> DataFrame:
    """Session columns of a stream of detected prompts (needs the RocksDB state store)."""
    schema = "scope_id string, session_id string, prompt_id string, epoch bigint, " + RISK_OUT
    rows = detected.select(*KEYS, "prompt_id", *[c for c in Fold.inputs])
    return rows.groupBy(*KEYS).transformWithState(statefulProcessor=StrictFold() if strict_ttl else Fold(), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if strict_ttl else "None")


def timeline_stream(events: DataFrame, interval: str = "1 hour", time: str = "ts") -> DataFrame:
    w = F.window(time, interval)
    return events.withWatermark(time, LATE).groupBy(w.alias("w")).agg(F.count("*").alias("detections"), F.count_if(F.col("decision") == "block").alias("blocks")).select(F.unix_timestamp("w.start").alias("bucket"), "detections", "blocks")


def exact_repeats_stream(prompts: DataFrame, sessions: int = 3, time: str = "ts") -> DataFrame:
    """Prompts repeated over enough sessions inside a window (sessions are counted approximately
    within one percent, as exact distinct counts aren't kept over streams)."""
    g = prompts.withWatermark(time, LATE).groupBy(F.window(time, WINDOW).alias("w"), "scope_id", "prompt_hash")
    return g.agg(F.approx_count_distinct("session_id", 0.01).alias("sessions"), F.count("*").alias("prompts")).where(F.col("sessions") >= sessions).select(F.unix_timestamp("w.start").alias("window_start"), "scope_id", "prompt_hash", "sessions", "prompts")


def session_windows_stream(prompts: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Activity windows of each session, closed by a gap."""
    g = prompts.withWatermark(time, LATE).groupBy("scope_id", "session_id", F.session_window(time, gap).alias("w"))
    return g.agg(F.count("*").alias("prompts")).select("scope_id", "session_id", F.unix_timestamp("w.start").alias("started"), F.unix_timestamp("w.end").alias("ended"), "prompts")


def append_batches(path: str):
    """A foreachBatch sink that a repeated batch doesn't write twice: each batch has its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def cooling_stream(findings: DataFrame, time: str = "ts") -> DataFrame:
    """Findings without an equal one (scope, category, sessions) in the cooldown before them."""
    return findings.withWatermark(time, COOLDOWN).dropDuplicatesWithinWatermark(["scope_id", "group_category", "cluster_key"])
