"""Unbounded input run to its end: tables played as arrivals, stateful steps, exact sinks.

A table lands as files in parts of rising time. After each part a query starts from the same
checkpoint, reads what is new (``availableNow``) and stops, so every run but the first is a
restart. Source, checkpoint and sink lie in the shared folder; the file sink's log makes each
micro-batch appear once, whatever is repeated. The state processors hold typed state variables
(values, lists, maps) and timers that clear them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrella.functions.plan import fence, shared_folder
from sentrella.operators import context
from sentrella.operators.sessions import KEYS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS, LATE = 3, "10 minutes"


def drain(stream: DataFrame, folder: str) -> None:
    """Process all that has arrived, then stop."""
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    run.start().awaitTermination()


def played(rows: DataFrame, by: str, of: Callable[[DataFrame], DataFrame], name: str, parts: int = PARTS, again: bool = False) -> DataFrame:
    """What ``of`` (a query over a stream) has put out when ``rows`` have arrived in parts of
    rising ``by``, with a restart after each part. With ``again`` each part arrives a second
    time with the next one, as at-least-once delivery may have it."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    folder = f"{shared_folder(spark)}/sentrella-stream-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/whole")
    whole = spark.read.schema(rows.schema).parquet(f"{folder}/whole")
    cuts = whole.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)], 1000).alias("c")).first().c if parts > 1 else []
    cuts = [None, *(cuts or []), None]
    for k in range(len(cuts) - 1):
        low, high = cuts[k], cuts[k + 1]
        here = lambda a, b: (F.lit(True) if a is None else F.col(by) >= a) & (F.lit(True) if b is None else F.col(by) < b)
        part = whole.where(here(low, high))
        if again and k:
            part = part.unionByName(whole.where(here(cuts[k - 1], low)))
        part.write.mode("append").parquet(f"{folder}/in")
        drain(of(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder)
    return spark.read.parquet(f"{folder}/out")


# --- repeats with exact distinct sessions ---------------------------------------------------


class Repeats(StatefulProcessor):
    """Emits a group once, at the prompt that brings its sessions to the least number. Until
    then a map holds its sessions, fewer than that; a timer clears the group when its window
    can get no more rows."""

    least, keep_ms = 3, 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session string", "seen boolean")
        self.found = handle.getValueState("found", "sessions int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["epoch", "prompt_id"], kind="stable")
        out = []
        if not self.found.exists():
            for r in pdf.itertuples():
                if self.sessions.containsKey((r.session_id,)):
                    continue
                self.sessions.updateValue((r.session_id,), (True,))
                if sum(1 for _ in self.sessions.keys()) >= self.least:
                    self.found.update((self.least,))
                    self.sessions.clear()
                    out.append((*key, r.epoch, r.prompt_id, self.least))
                    break
        # Timers of one key fire once each; the last one registered outlives the window.
        self.handle.registerTimer(int(key[1]) * 1000 + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["scope_id", "window_start", "prompt_hash", "epoch", "prompt_id", "sessions"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sessions.clear()
        self.found.clear()
        return iter(())

    def close(self) -> None:
        pass


def exact_repeats(prompts: DataFrame, window_seconds: int, least: int = 3, time: str = "ts") -> DataFrame:
    """(scope_id, window_start, prompt_hash) whose prompts come from ``least`` different
    sessions, with the prompt that completed them; exact, with at most ``least`` sessions of
    state for a group."""
    rows = prompts.withWatermark(time, LATE).withColumn("window_start", F.col("epoch") - F.pmod("epoch", F.lit(window_seconds)))
    kind = type("Repeats", (Repeats,), {"least": least, "keep_ms": (window_seconds + 600) * 1000, "__module__": __name__})
    schema = "scope_id string, window_start long, prompt_hash string, epoch long, prompt_id string, sessions int"
    return rows.select("scope_id", "window_start", "prompt_hash", "session_id", "epoch", "prompt_id", time).groupBy("scope_id", "window_start", "prompt_hash").transformWithStateInPandas(statefulProcessor=kind(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


# --- context scoring --------------------------------------------------------------------------

SCORED_IN = [*KEYS, "prompt_id", "epoch", "prompt", "decision", "best_score", "label", "confidence"]


class Session(StatefulProcessor):
    """What a session keeps, one value that begins with its newest epoch, and a timer that forgets it
    ``idle_ms`` after that. A micro-batch costs a session one read and one write of its value: most
    have a few rows in it, so calls cost more than steps. The timer isn't moved by each prompt;
    where it finds the session in use, it is set for what is left.

    Each value that crosses to Python costs more than the parsing of a row, so a row comes as one
    JSON text, and a session's results leave as one row, which the JVM takes apart."""

    kept, idle_ms = "seen long", 90 * 86_400 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.session.get()
        ordered = sorted(((json.loads(r["row"]), r["row"]) for r in rows), key=lambda r: (r[0]["epoch"], r[0]["prompt_id"]))
        seen = max(ordered[-1][0]["epoch"], kept[0] if kept else 0)
        out, new = self.stepped(tuple(kept)[1:] if kept else None, ordered)
        self.session.update((seen, *new))
        if not kept:
            self.handle.registerTimer(seen * 1000 + self.idle_ms)
        yield Row(*KEYS, *out)(*key, *out.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = self.session.get()[0] * 1000 + self.idle_ms
        if until >= timerValues.getCurrentWatermarkInMs() and until != expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.session.clear()
        return iter(())

    def close(self) -> None:
        pass


class Turns(Session):
    """Puts out the last prompts of the session with those that have come, and their marks; nine are kept."""

    kept = "seen long, turns array<struct<prompt: string, mark: long>>"

    def stepped(self, kept: tuple | None, rows: list[tuple[dict, str]]) -> tuple[dict, tuple]:
        turns = [tuple(t) for t in kept[0]] if kept else []
        before = len(turns)
        turns += [(r["prompt"] or "", r["mark"]) for r, _ in rows]
        return {"before": before, "said": [t for t, _ in turns], "marked": [m for _, m in turns], "rows": [text for _, text in rows]}, (turns[-(context.HISTORY - 1) :],)


class Context(Session):
    """The context stage's step: score, time, whether terminated, and the last nine verdicts are
    kept. A prompt that comes late takes its place by arrival."""

    policy = context.Policy()
    kept = "seen long, score double, epoch long, terminated boolean, past array<struct<category: string, verdict: string, action: string>>"

    def stepped(self, kept: tuple | None, rows: list[tuple[dict, str]]) -> tuple[dict, tuple]:
        step, state = context.context_step(self.policy), None
        if kept:
            score, epoch, terminated, past = kept
            state = {"score": score, "epoch": epoch, "terminated": terminated, "past": [tuple(p) for p in past]}
        out = []
        for r, _ in rows:
            state, got = step(state, r)
            got["t2_category"] = got["category"]
            out.append(json.dumps({c: r[c] for c in ("prompt_id", "epoch", "confidence")} | got))
        past = [tuple(map(str, p)) for p in state["past"]]
        return {"rows": out}, (float(state["score"]), int(state["epoch"]), bool(state["terminated"]), past)


CONTEXT_OUT = "prompt_id string, epoch long, confidence double, " + context.STEP_OUT


def _processor(base: type, **settings) -> StatefulProcessor:
    return type(base.__name__, (base,), settings | {"__module__": __name__})()


def _stepped(rows: DataFrame, processor: StatefulProcessor, out: str) -> DataFrame:
    """What a ``Session`` puts out for rows with a ts (see there)."""
    texts = rows.select(*KEYS, F.to_json(F.struct(*[c for c in rows.columns if c not in (*KEYS, "ts")]), {"ignoreNullFields": "false"}).alias("row"), "ts").withWatermark("ts", LATE)
    return texts.groupBy(*KEYS).transformWithState(statefulProcessor=processor, outputStructType=f"scope_id string, session_id string, {out}", outputMode="Append", timeMode="EventTime")


def turns(prompts: DataFrame, idle_seconds: int = 90 * 86_400) -> DataFrame:
    """Prompts (columns SCORED_IN) with the last ten turns of their session."""
    known = set(context.MARKS) <= set(prompts.columns)
    rows = prompts.select(*SCORED_IN, *(context.MARKS if known else []), F.timestamp_seconds("epoch").alias("ts"))
    rows = rows if known else context.marked(rows)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in (*KEYS, "ts"))
    out = _stepped(rows, _processor(Turns, idle_ms=idle_seconds * 1000), "before int, said array<string>, marked array<long>, rows array<string>")
    one = out.select(*KEYS, "before", "said", "marked", F.posexplode("rows").alias("n", "row"))
    till = F.col("before") + F.col("n") + 1
    window = lambda c: F.slice(c, F.greatest(till - context.HISTORY, F.lit(0)) + 1, F.least(till, F.lit(context.HISTORY)))
    one = fence(one.select(*KEYS, F.from_json("row", kinds).alias("r"), window("said").alias("hist"), window("marked").alias("marks")))
    return one.select(*KEYS, "r.*", "hist", "marks").drop("mark")


def scored(with_turns: DataFrame, policy: context.Policy = context.Policy(), idle_seconds: int = 90 * 86_400) -> DataFrame:
    """Context scores of a stream that ``turns`` has put out."""
    rows = context.evidence(with_turns).select(*KEYS, "prompt_id", *context.STEP_IN, F.timestamp_seconds("epoch").alias("ts"))
    out = _stepped(rows, _processor(Context, policy=policy, idle_ms=idle_seconds * 1000), "rows array<string>")
    one = out.select(*KEYS, F.explode("rows").alias("row"))
    return fence(one.select(*KEYS, F.from_json("row", CONTEXT_OUT).alias("r")), *KEYS).select(*KEYS, "r.*")
