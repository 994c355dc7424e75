"""State that runs through a session, in event order.

``fold`` deals whole sessions to tasks, sorts each by time inside Spark, and streams the rows
of a partition through one pure step function, carrying one small state. Memory doesn't grow
with a session, and the streaming engine uses the same steps. The order is (epoch, prompt_id).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

HALF_LIFE, FLOOR, CAP, REPEAT_CAP = 900.0, 0.25, 20.0, 3
KEYS = ["scope_id", "session_id"]


def fold(rows: DataFrame, step: Callable[[dict | None, dict], tuple[dict, dict]], inputs: list[str], outputs: str, keys: list[str] = KEYS, order: tuple[str, ...] = ("epoch", "prompt_id")) -> DataFrame:
    """``rows`` with the output columns that ``step(state, row) -> (state, out)`` gives each row.

    Only the keys and inputs become Python values; the other columns pass as Arrow buffers."""
    names = [x.strip().split(" ")[0] for x in outputs.split(",")]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + outputs
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(outputs).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys + inputs]
            out: list[list] = []
            for values in map(list, zip(*columns)):
                k = values[: len(keys)]
                if k != key:
                    key, state = k, None
                state, got = step(state, dict(zip(inputs, values[len(keys) :])))
                out.append([got[n] for n in names])
            made = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return ordered.mapInArrow(run, schema)


def decay(elapsed: float) -> float:
    return 1.0 if elapsed <= 0 else max(FLOOR, min(1.0, 0.5 ** (elapsed / HALF_LIFE)))


def risk_step(state: dict | None, row: dict) -> tuple[dict, dict]:
    """One prompt of a session; the state keeps the rounded score, as stored between turns.

    A session that was blocked is terminated: later prompts are refused and change nothing."""
    s = state or {"score": 0, "epoch": None, "seen": 0, "intents": {}, "terminated": False}
    if s["terminated"]:
        return s, {"refused": True, "session_raw": None, "session_score": s["score"], "session_recommendation": None, "prompts_seen": s["seen"], "intent_counts": json.dumps(s["intents"], sort_keys=True), "decision": "refused"}
    score, intents = float(row["session_input"]), list(row["risk_intents"])
    elapsed = 0.0 if s["epoch"] is None else max(0.0, row["epoch"] - s["epoch"])
    again = min(REPEAT_CAP, sum(i in s["intents"] for i in intents))
    more = 1 if s["seen"] >= 2 and score >= 4 else 0
    raw = min(CAP, s["score"] * decay(elapsed) + score + again + more)
    advice = "block" if raw >= 12 else "escalate" if raw >= 6 else "allow"
    blocked = bool(row["stateless_block"]) or advice == "block"
    counts = dict(s["intents"])
    for i in intents:
        counts[i] = counts.get(i, 0) + 1
    new = {"score": round(raw), "epoch": row["epoch"], "seen": s["seen"] + 1, "intents": counts, "terminated": blocked and row.get("terminate", True)}
    return new, {"refused": False, "session_raw": raw, "session_score": new["score"], "session_recommendation": advice, "prompts_seen": new["seen"], "intent_counts": json.dumps(counts, sort_keys=True), "decision": "block" if blocked else "allow"}


RISK_IN = ["session_input", "risk_intents", "stateless_block"]
RISK_OUT = "refused boolean, session_raw double, session_score int, session_recommendation string, prompts_seen int, intent_counts string, decision string"


def session_risk(detected: DataFrame, terminate: bool = True) -> DataFrame:
    """Adds the session columns and the decision to detected prompts. With ``terminate`` a
    blocked session refuses its later prompts."""
    rows = detected.withColumn("terminate", F.lit(terminate))
    return fold(rows, risk_step, ["epoch", *RISK_IN, "terminate"], RISK_OUT).drop("terminate")


def last_state(judged: DataFrame) -> DataFrame:
    """The registry: one row for each session, by its last evaluated prompt. Partial maxima of
    the whole row are taken before the shuffle."""
    row = F.max(F.struct("epoch", "prompt_id", "source", "decision", "best_score", "session_score", "prompts_seen", "intent_counts", "matched_signatures")).alias("r")
    base = judged.where("not refused").groupBy(*KEYS).agg(row, F.min("epoch").alias("created_at"), F.bool_or(F.col("decision") == "block").alias("terminated"))
    return base.select(
        *KEYS, "r.source", F.when(F.col("terminated"), "terminated").otherwise("active").alias("status"), F.col("r.decision").alias("last_decision"), F.col("r.best_score").alias("last_risk_score"),
        F.col("r.session_score").alias("accumulated_risk_score"), F.col("r.prompts_seen").alias("prompts_seen"), "r.intent_counts", F.col("r.matched_signatures").alias("last_matched_signatures"),
        "created_at", F.col("r.epoch").alias("last_evaluated_at"), (F.col("r.epoch") + 1800).alias("ttl"),
    )


def actions(judged: DataFrame, mode: str = "sidecar") -> DataFrame:
    """What the gateway does with each prompt, and what becomes of the session's stop: a gate
    refuses the blocked prompt and stops at once, a sidecar lets it pass and defers the stop."""
    hit = F.col("decision") == "block"
    action = F.when(F.col("refused") | (hit & F.lit(mode == "gate")), "refuse").otherwise("pass")
    return judged.withColumns({"action": action, "kill_outcome": F.when(hit, F.lit("stopped" if mode == "gate" else "deferred"))})
