"""Correlation of prompts across sessions inside time windows.

Each detector yields memberships (method, window, group, category, prompt). From there one
plan serves all: the first prompt of each session in a group, its risk, the group's score,
decision and key. Groups are summed, never collected: a group's sessions are identified by
their number and the sum of 60-bit digests of their ids, and listed (``affected``) as rows.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrella.functions import fixed
from sentrella.functions import scalars as S
from sentrella.functions import text as T
from sentrella.functions.plan import written
from sentrella.operators.sessions import fold

MIN_SESSIONS, DISTANCE, PATTERN_MIN, CATEGORY_MIN, RISK_MIN, RISK_AT = 3, 3, 3, 5, 5, 65.0
COSINE, COOLDOWN, MAX_PROMPTS = 0.82, 1800, 2000
RANK = {"exact_hash": 0, "simhash": 1, "normalized_pattern_burst": 2, "category_burst": 3, "session_risk_burst": 4, "embedding": 5}
GROUP = ["method", "scope_id", "window_start", "group_key"]
UNKNOWN = ("unknown", "safe", "allow")


@dataclass(frozen=True)
class Policy:
    mode: str = "shadow"
    global_kill: bool = False
    tier3_kill: bool = False
    enforcement: bool = False
    min_sessions: int = 3
    similarity: float = 0.90
    kill: float = 0.95


def window_start(epoch: Column, minutes: int = 5) -> Column:
    seconds = max(60, minutes * 60)
    return epoch - F.pmod(epoch, F.lit(seconds))


def resolved_category(category: Column, signatures: Column) -> Column:
    """The stored category, or one that the signature ids suggest."""
    c = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    has = lambda *ws: F.exists(signatures, lambda s: T.contains_any(s, ws))
    return (
        F.when((c != "") & (c != "safe"), c).when(has("credential", "secret"), "credential_theft")
        .when(has("exfil"), "customer_data_exfiltration").when(has("jailbreak", "prompt"), "system_prompt_extraction").otherwise("unknown")
    )


def records(rows: DataFrame, minutes: int = 5) -> DataFrame:
    """Prompt records of history rows; rows without a session or a prompt don't count."""
    sigs = S.to_strings(F.col("matched_signatures"))
    return rows.where((F.coalesce("session_id", F.lit("")) != "") & (F.coalesce("prompt", F.lit("")) != "")).select(
        F.coalesce("scope_id", F.lit("local")).alias("scope_id"), F.coalesce("source", F.lit("")).alias("source"), "session_id", "prompt_id", F.col("epoch").alias("ingested_at"), "prompt",
        resolved_category(F.col("category"), sigs).alias("category"), F.coalesce("risk", F.lit(0.0)).alias("record_risk"), F.coalesce("repeated", F.lit(0)).alias("record_repeated"),
        F.exists(sigs, lambda s: T.contains_any(F.lower(s), fixed.CRITICAL_HINTS)).alias("critical_signature"),
        window_start(F.col("epoch"), minutes).alias("window_start"), S.prompt_hash(F.col("prompt")).alias("prompt_hash"), *[c for c in ("embedding",) if c in rows.columns],
    )


def _majority(members: DataFrame, otherwise: str) -> DataFrame:
    """The most frequent known category of each group; ties go to the smaller name."""
    known = members.where(~F.col("category").isin("unknown", "")).groupBy(*GROUP, "category").agg(F.count("*").alias("n"))
    best = known.groupBy(*GROUP).agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("b")).select(*GROUP, F.col("b.category").alias("group_category"))
    groups = members.select(*GROUP).distinct()
    return groups.join(best, GROUP, "left").withColumn("group_category", F.coalesce("group_category", F.lit(otherwise)))


def _members(rows: DataFrame, method: str, key: Column) -> DataFrame:
    return rows.withColumns({"method": F.lit(method), "group_key": key})


def _at_least(members: DataFrame, sessions: int) -> DataFrame:
    """Members of groups with enough distinct sessions."""
    big = members.select(*GROUP, "session_id").distinct().groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") >= sessions).drop("n")
    return members.join(big, GROUP)


def exact_hash(rows: DataFrame) -> DataFrame:
    return _at_least(_members(rows, "exact_hash", F.col("prompt_hash")), MIN_SESSIONS)


def pattern(rows: DataFrame) -> DataFrame:
    m = _members(rows, "normalized_pattern_burst", T.structure(F.col("prompt"))).where("group_key <> ''")
    return _at_least(m, PATTERN_MIN)


def category(rows: DataFrame) -> DataFrame:
    return _at_least(_members(rows.where(F.col("category").isin(*fixed.CRITICAL_CATEGORIES)), "category_burst", F.col("category")), CATEGORY_MIN)


def supported(rows: DataFrame, risks: DataFrame) -> DataFrame:
    """Records or members with the latest state of their session, where it has one."""
    if "session_known" in rows.columns:
        return rows
    r = risks.select("scope_id", "session_id", F.col("current_risk_score").alias("session_risk"), F.lower("status").alias("session_status"), F.col("repeated_suspicious_count").alias("session_repeated"), F.lit(True).alias("session_known"))
    return rows.join(r, ["scope_id", "session_id"], "left")


def session_risk(rows: DataFrame, risks: DataFrame) -> DataFrame:
    """The latest prompt of each session at risk, one group for a scope and window."""
    return _at_least(_at_risk(supported(rows, risks)), RISK_MIN).drop("session_risk", "session_status", "session_repeated", "session_known")


def _at_risk(rows: DataFrame) -> DataFrame:
    latest = F.row_number().over(Window.partitionBy("scope_id", "window_start", "session_id").orderBy(F.desc("ingested_at"), F.desc("prompt_id")))
    last = rows.withColumn("n", latest).where("n = 1").drop("n")
    risky = last.where(F.col("session_known") & (F.col("session_status").isin(*fixed.RISKY_STATUSES) | (F.greatest("session_risk", "record_risk") >= RISK_AT)))
    return _members(risky, "session_risk_burst", F.lit("scope"))


#: What scoring reads of a member; sessions that a detector asks of a group.
MEMBER = [*GROUP, "session_id", "prompt_id", "ingested_at", "source", "category", "record_risk", "record_repeated", "critical_signature", "session_risk", "session_status", "session_repeated", "session_known", "session_sum"]
LEAST = {"exact_hash": MIN_SESSIONS, "normalized_pattern_burst": PATTERN_MIN, "category_burst": CATEGORY_MIN, "session_risk_burst": RISK_MIN, "simhash": MIN_SESSIONS, "embedding": MIN_SESSIONS}


def prepared(rows: DataFrame, risks: DataFrame, *keep: str) -> DataFrame:
    """Records as the detectors read them, written: what they group by and what scoring reads,
    worked out once for each record, without the prompt (unless in ``keep``)."""
    rows = supported(rows, risks).withColumns({"structure": T.structure(F.col("prompt")), "session_sum": digest(F.col("session_id")).cast("bigint")})
    return written(rows.select("window_start", "prompt_hash", "structure", *[c for c in MEMBER if c not in ("method", "window_start", "group_key")], *keep), "t3-records")


def candidates(rows: DataFrame) -> DataFrame:
    """Members of all groups of prepared records by hash, pattern, category and risk; groups of too
    few sessions are among them (see LEAST)."""
    named = lambda method, key: F.struct(F.lit(method).alias("method"), key.alias("group_key"))
    keys = F.array_compact(F.array(
        named("exact_hash", F.col("prompt_hash")), F.when(F.col("structure") != "", named("normalized_pattern_burst", F.col("structure"))),
        F.when(F.col("category").isin(*fixed.CRITICAL_CATEGORIES), named("category_burst", F.col("category"))),
    ))
    own = [c for c in MEMBER if c not in ("method", "group_key")]
    return rows.select(*own, F.inline(keys)).select(*MEMBER).unionByName(_at_risk(rows.select(*own)).select(*MEMBER))


def simhash_pairs(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(scope_id, window_start, base, other): distinct fingerprints within the distance, each
    with itself too. Four 16-bit bands: fingerprints at most three bits apart share one. Copies
    of a prompt are one fingerprint, so a viral prompt adds no pairs."""
    prints = rows.select("scope_id", "window_start", "simhash").distinct()
    bands = prints.select("*", F.posexplode(F.array(*[F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)])).alias("band", "value"))
    a = bands.withColumnRenamed("simhash", "base")
    b = bands.withColumnRenamed("simhash", "other")
    near = a.join(b, ["scope_id", "window_start", "band", "value"]).where((F.col("base") < F.col("other")) & (S.hamming(F.col("base"), F.col("other")) <= distance)).select("scope_id", "window_start", "base", "other").distinct()
    own = prints.select("scope_id", "window_start", F.col("simhash").alias("base"), F.col("simhash").alias("other"))
    return near.unionByName(near.select("scope_id", "window_start", F.col("other").alias("base"), F.col("base").alias("other"))).unionByName(own)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Star neighbourhoods: every prompt within the distance of a base, once for equal neighbourhoods."""
    # Hashing costs Python: every distinct prompt is hashed once.
    prints = written(rows.select("prompt").distinct().withColumn("simhash", S.simhash(F.col("prompt"))), "t3-prints")
    rows = rows.join(prints, "prompt")
    pairs = simhash_pairs(rows)
    m = _members(rows.join(pairs.withColumnRenamed("other", "simhash"), ["scope_id", "window_start", "simhash"]).drop("simhash"), "simhash", F.col("base").cast("string")).drop("base")
    return _distinct_groups(_at_least(m, MIN_SESSIONS))


def _distinct_groups(members: DataFrame) -> DataFrame:
    """Of groups with the same prompts, the one of the smallest key."""
    sets = members.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum(digest(F.col("prompt_id"))).alias("d"))
    first = sets.groupBy("method", "scope_id", "window_start", "n", "d").agg(F.min("group_key").alias("group_key")).select(*GROUP)
    return members.join(first, GROUP)


PIVOTS = 64


def unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one (zero vectors have no direction)."""
    x = np.array(column.tolist(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1)
    return x[norm > 0] / norm[norm > 0, None], norm > 0


def blocks_of(vectors: DataFrame, at_least: float, block: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Vectors with their cell and block, and the pairs of blocks of a label that may hold a pair
    whose cosine reaches the bound: (label, dim, cell, block, other_cell, other_block).

    A cell is the nearest of up to PIVOTS vectors of the table. By the triangle inequality on the sphere
    no vectors of two cells are closer than the angle of their pivots less both radii (the largest
    angle of a vector of the label to its pivot); cells further apart than the bound don't meet."""
    v = vectors.select("vec_id", "label", "embedding").where("embedding is not null and label is not null and size(embedding) > 0").withColumn("dim", F.size("embedding"))
    # Cells of about a block of vectors at least: smaller ones cost more than they save.
    few = max(1, min(pivots, v.count() // block))
    chosen = v.orderBy(F.xxhash64("vec_id", F.to_json("embedding")), "vec_id").limit(few).select("dim", "embedding").toPandas()  # a bounded sample
    most = int(chosen["dim"].mode().iloc[0]) if len(chosen) else 0
    p, _ = unit(chosen[chosen["dim"] == most]["embedding"]) if len(chosen) else (np.zeros((0, 0)), None)

    def dealt(parts):
        for pdf in parts:
            for dim, rows in pdf.groupby("dim"):
                x, ok = unit(rows["embedding"])
                rows = rows[ok]
                cell, angle = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.pi)  # vectors of another length share one cell
                if dim == most and len(p):
                    c = x @ p.T
                    cell = c.argmax(1).astype(np.int32)
                    angle = np.arccos(np.clip(c.max(1), -1, 1))
                yield rows.assign(cell=cell, angle=angle)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema.fields)
    placed = written(v.mapInPandas(dealt, kinds + ", cell int, angle double"), "t3-cells")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"), F.max("angle").alias("radius"))
    between = np.arccos(np.clip(p @ p.T, -1, 1)) if len(p) else np.zeros((1, 1))
    apart = vectors.sparkSession.createDataFrame([(i, j, float(between[i, j])) for i in range(len(between)) for j in range(i, len(between))], "cell int, other_cell int, apart double")  # PIVOTS squared rows
    theta = float(np.arccos(np.clip(at_least, -1, 1)))
    one = sizes.select("label", "dim", "cell", F.col("blocks").alias("n"), F.col("radius").alias("r"))
    two = sizes.select("label", "dim", F.col("cell").alias("other_cell"), F.col("blocks").alias("other_n"), F.col("radius").alias("other_r"))
    cells = one.join(F.broadcast(apart), "cell").join(two, ["label", "dim", "other_cell"]).where(F.col("apart") - F.col("r") - F.col("other_r") <= theta + 1e-9)
    zero = F.lit(0).cast("bigint")
    pairs = cells.withColumn("block", F.explode(F.sequence(zero, F.col("n") - 1))).withColumn("other_block", F.explode(F.sequence(zero, F.col("other_n") - 1)))
    pairs = pairs.where((F.col("cell") < F.col("other_cell")) | (F.col("block") <= F.col("other_block"))).select("label", "dim", "cell", "block", "other_cell", "other_block")
    numbered = placed.join(sizes.drop("radius"), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks", "angle")
    return numbered, pairs


def similar_vectors(vectors: DataFrame, at_least: float = COSINE, block: int = 2048) -> DataFrame:
    """(label, a, b, cosine) of all pairs a < b of one label and length whose cosine reaches the bound.

    Vectors are dealt in cells and blocks (see ``blocks_of``); each pair of blocks that may hold
    such a pair is one matrix product in a task, which holds two blocks and returns the pairs
    found only."""
    numbered, pairs = blocks_of(vectors, at_least, block)
    named = pairs.withColumn("pair", F.struct("cell", "block", "other_cell", "other_block"))
    left = named.select("label", "dim", "cell", "block", "pair", F.lit(True).alias("low"))
    right = named.where("cell <> other_cell or block <> other_block").select("label", "dim", F.col("other_cell").alias("cell"), F.col("other_block").alias("block"), "pair", F.lit(False).alias("low"))
    sent = numbered.join(left.unionByName(right), ["label", "dim", "cell", "block"]).select("label", "dim", "vec_id", "embedding", "pair.*", "low")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ok = unit(pdf["embedding"])
        ids, low = pdf["vec_id"].to_numpy()[ok], pdf["low"].to_numpy(bool)[ok]
        i, j = np.flatnonzero(low), np.flatnonzero(~low)
        within = not len(j)
        if within:
            j = i
        s = x[i] @ x[j].T
        p, q = np.nonzero(s >= at_least)
        a, b, c = ids[i[p]], ids[j[q]], s[p, q]
        keep = (a < b) if within else (a != b)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": c[keep]})

    kind, key = (numbered.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    return sent.groupBy("label", "dim", "cell", "block", "other_cell", "other_block").applyInPandas(near, f"label {kind}, a {key}, b {key}, cosine double")


def embedding(rows: DataFrame, at_least: float = COSINE) -> DataFrame:
    """Star neighbourhoods of prompts of one category by the cosine of their vectors (column
    ``embedding``), once for equal neighbourhoods. Equal vectors are compared once. Vectors that
    are zero or hold null or non-finite numbers are like no other and take no part."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.transform("embedding", lambda x: x.cast("double"))).where(sound).drop("embedding")
    rows = written(rows.withColumn("label", F.to_json(F.struct("scope_id", "window_start", "category"))).withColumn("print", F.sha2(F.concat("label", F.to_json("vector")), 256)), "t3-vectors")
    prints = rows.groupBy("label", F.col("print").alias("vec_id")).agg(F.any_value("vector").alias("embedding"))
    pairs = similar_vectors(prints, at_least).select("label", F.col("a").alias("base"), F.col("b").alias("print"))
    pairs = written(pairs, "t3-pairs")
    near = pairs.unionByName(pairs.select("label", F.col("print").alias("base"), F.col("base").alias("print"))).unionByName(prints.select("label", F.col("vec_id").alias("base"), F.col("vec_id").alias("print")))
    m = _members(rows.drop("vector").join(near, ["label", "print"]), "embedding", F.col("base")).drop("label", "print", "base")
    return _distinct_groups(written(_at_least(m, MIN_SESSIONS), "t3-stars"))


#: Records of a label that one task reads for a block of stars, by sessions, and stars of a block.
SLICE, STARS = 65_536, 8192
STAR_OUT = "label string, base string, prompts long, prompts_high long, prompts_low long, sessions long, risk double, max_risk double, repeated int, critical long, status boolean, first_at long, sessions_high long, sessions_low long, least_session string, example string"


class _Stars:
    """Sums of the stars of a block of vectors over records that come by session and time: of a
    session's records the first that is near counts, so only the last session of each star is kept."""

    def __init__(self, at_least: float):
        self.at_least, self.waiting, self.label = min(at_least, 1 - 1e-12), [], None  # a vector is like itself, however it is rounded

    @staticmethod
    def vectors(part: pa.RecordBatch) -> np.ndarray:
        x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def add(self, part: pa.RecordBatch) -> None:
        own = int(np.count_nonzero(part.column("low").to_numpy(zero_copy_only=False)))  # they come first
        if own:
            self.label = part.column("label")[0].as_py()
            self.waiting.append((self.vectors(part.slice(0, own)), part.column("print").slice(0, own).to_pylist()))
        if own < part.num_rows:
            if self.waiting:
                self.begin()
            rows = part.slice(own)
            step = max(1, (1 << 22) // max(1, len(self.base)))
            for a in range(0, rows.num_rows, step):
                self.meet(rows.slice(a, step))

    def begin(self) -> None:
        self.x, self.base = np.concatenate([x for x, _ in self.waiting]), [b for _, bs in self.waiting for b in bs]
        n = len(self.base)
        self.sums = {c: np.zeros(n, dtype=np.int64) for c in ("prompts", "prompts_high", "prompts_low", "sessions", "critical", "sessions_high", "sessions_low")}
        self.risk, self.max_risk, self.repeated, self.status = np.zeros(n), np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        self.first_at, self.least, self.example = np.full(n, np.iinfo(np.int64).max), np.full(n, None, dtype=object), np.full(n, None, dtype=object)
        self.last, self.session, self.number, self.waiting = np.full(n, -1, dtype=np.int64), None, -1, []

    def meet(self, rows: pa.RecordBatch) -> None:
        value = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("session_id", "prompt_id", "ingested_at", "risk", "repeated", "critical", "status", "session_sum", "prompt_sum")}
        names = value["session_id"]
        begins = np.concatenate([[self.session is None or names[0] != self.session], names[1:] != names[:-1]])
        session = self.number + np.cumsum(begins)
        self.session, self.number = names[-1], int(session[-1])
        p, q = np.nonzero(self.x @ self.vectors(rows).T >= self.at_least)
        if not len(p):
            return
        n = len(self.base)

        def add(name, stars, numbers):  # sums of a step are below 2^53, so exact
            self.sums[name] += np.bincount(stars, weights=numbers, minlength=n).astype(np.int64)

        add("prompts", p, None)
        add("prompts_high", p, (value["prompt_sum"] >> 30)[q])
        add("prompts_low", p, (value["prompt_sum"] & (1 << 30) - 1)[q])
        of = session[q]
        before = np.concatenate([[-1], of[:-1]])
        opens = np.concatenate([[True], p[1:] != p[:-1]])
        before[opens] = self.last[p[opens]]
        closes = np.concatenate([opens[1:], [True]])
        self.last[p[closes]] = of[closes]
        first = of != before
        p, q = p[first], q[first]
        add("sessions", p, None)
        add("critical", p, value["critical"][q].astype(float))
        add("sessions_high", p, (value["session_sum"] >> 30)[q])
        add("sessions_low", p, (value["session_sum"] & (1 << 30) - 1)[q])
        self.risk += np.bincount(p, weights=value["risk"][q], minlength=n)
        np.maximum.at(self.max_risk, p, value["risk"][q])
        np.maximum.at(self.repeated, p, value["repeated"][q])
        np.logical_or.at(self.status, p, value["status"][q].astype(bool))
        np.minimum.at(self.first_at, p, value["ingested_at"][q])
        order = np.argsort(value["prompt_id"], kind="stable")
        rank, least = np.empty(len(order), dtype=np.int64), np.full(n, len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        np.minimum.at(least, p, rank[q])
        for i in np.flatnonzero(least < len(order)):
            mine = value["prompt_id"][order[least[i]]]
            self.example[i] = mine if self.example[i] is None else min(mine, self.example[i])
        for i, j in zip(*(a[np.unique(p, return_index=True)[1]] for a in (p, q))):  # sessions come in order
            if self.least[i] is None:
                self.least[i] = names[j]

    def rows(self) -> list[list]:
        if self.waiting:
            return [[] for _ in STAR_OUT.split(", ")]
        some = np.flatnonzero(self.sums["prompts"])
        s = {c: v[some] for c, v in self.sums.items()}
        return [
            [self.label] * len(some), [self.base[i] for i in some], s["prompts"], s["prompts_high"], s["prompts_low"], s["sessions"], self.risk[some], self.max_risk[some], self.repeated[some].astype(np.int32), s["critical"],
            self.status[some], self.first_at[some], s["sessions_high"], s["sessions_low"], self.least[some].tolist(), self.example[some].tolist(),
        ]


def stars(rows: DataFrame, risks: DataFrame | None = None, at_least: float = COSINE, block: int = STARS, slice_rows: int = SLICE) -> DataFrame:
    """The groups of ``embedding`` with what scoring asks of them, and their prompts' number.

    A star isn't listed, since all stars have more members than any disk holds: a task keeps a
    block of vectors and sums over the records that may be near (see ``blocks_of``), a slice of
    their sessions at a time. Records travel once for each block, so what is shuffled is the
    square of a label's size over ``block``."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    nothing = {"session_risk": F.lit(0.0), "session_repeated": F.lit(0), "session_status": F.lit("")}
    rows = (rows.withColumns(nothing) if risks is None else supported(rows, risks)).withColumn("vector", F.transform("embedding", lambda x: x.cast("double"))).where(sound)
    label = F.to_json(F.struct("scope_id", "window_start", "category"))
    rows = rows.withColumn("label", label).select(
        "label", F.sha2(F.concat("label", F.to_json("vector")), 256).alias("print"), "vector", "session_id", "prompt_id", "ingested_at", F.greatest("record_risk", F.coalesce("session_risk", F.lit(0.0))).alias("risk"),
        F.greatest("record_repeated", F.coalesce("session_repeated", F.lit(0))).alias("repeated"), F.col("critical_signature").alias("critical"), F.coalesce(F.col("session_status").isin(*fixed.RISKY_STATUSES), F.lit(False)).alias("status"),
        digest(F.col("session_id")).cast("bigint").alias("session_sum"), digest(F.col("prompt_id")).cast("bigint").alias("prompt_sum"),
    )
    kinds = "scope_id string, window_start long, category string"
    rows = written(rows, "t3-vectors")
    placed, pairs = blocks_of(rows.groupBy("label", F.col("print").alias("vec_id")).agg(F.any_value("vector").alias("embedding")), at_least, block)
    placed = written(placed.select("label", "dim", "cell", "block", F.col("vec_id").alias("print"), "embedding"), "t3-placed")
    one = pairs.select("label", "dim", "cell", "block", "other_cell")
    other = pairs.select("label", "dim", F.col("other_cell").alias("cell"), F.col("other_block").alias("block"), F.col("cell").alias("other_cell"))
    slices = rows.groupBy("label").agg(F.ceil(F.count("*") / slice_rows).alias("slices"))
    meets = one.unionByName(other).distinct().join(slices, "label")
    task = lambda n: F.concat_ws(":", "dim", "cell", "block", n.cast("string"), "label").alias("task")
    told = [c for c in rows.columns if c not in ("label", "print", "vector")]
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in told]
    low = placed.join(slices, "label").withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    low = low.select(task(F.col("n")), F.lit(True).alias("low"), "label", "print", F.col("embedding").alias("vector"), *empty)
    here = rows.join(placed.select("label", "print", "dim", F.col("cell").alias("other_cell")), ["label", "print"]).join(meets, ["label", "dim", "other_cell"])
    here = here.select(task(F.pmod(F.xxhash64("session_id"), F.col("slices"))), F.lit(False).alias("low"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("print"), "vector", *told)
    dealt = low.unionByName(here).repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, "task").sortWithinPartitions("task", F.desc("low"), "session_id", "ingested_at", "prompt_id")

    def summed(batches):
        key, stars = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column("task").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if tasks[a] != key:
                    if stars is not None:
                        yield made(stars)
                    key, stars = tasks[a], _Stars(at_least)
                stars.add(batch.slice(a, b - a))
        if stars is not None:
            yield made(stars)

    names = [c.split(" ")[0] for c in STAR_OUT.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.string(), pa.string()]

    def made(stars):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(stars.rows(), types)], names=names)

    whole = lambda c: F.sum(F.col(f"{c}_high").cast("decimal(38,0)") * F.lit(1 << 30) + F.col(f"{c}_low"))
    g = dealt.mapInArrow(summed, STAR_OUT).groupBy("label", F.col("base").alias("group_key")).agg(
        F.sum("prompts").alias("prompts"), whole("prompts").alias("prompt_digest"), F.sum("sessions").alias("sessions"), (F.sum("risk") / F.sum("sessions")).alias("average_risk"), F.max("max_risk").alias("max_risk"), F.max("repeated").alias("repeated"),
        (F.sum("critical") > 0).alias("any_critical_signature"), F.sum("critical").alias("critical_records"), F.bool_or("status").alias("status_support"), F.min("first_at").alias("first_at"), whole("sessions").cast("decimal(38,0)").alias("session_digest"), F.min("least_session").alias("least_session"), F.min("example").alias("example_prompt_id"),
    ).where(F.col("sessions") >= MIN_SESSIONS).withColumn("of", F.from_json("label", kinds)).select("*", "of.*").drop("of", "label")
    nth = F.row_number().over(Window.partitionBy("scope_id", "window_start", "prompts", "prompt_digest").orderBy("group_key"))
    g = g.withColumn("nth", nth).where("nth = 1").drop("nth", "prompt_digest")
    known = ~F.col("category").isin("unknown", "")
    return g.withColumns({"method": F.lit("embedding"), "known_member": ~F.col("category").isin(*UNKNOWN, ""), "group_category": F.when(known, F.col("category")).otherwise("unknown")}).drop("category")


def digest(value: Column) -> Column:
    """60 bits of an MD5, to be summed over a set."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def findings(members: DataFrame, risks: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """One row for each group, scored (see the module's head); with ``least``, of the groups of that
    many sessions by method."""
    return score(groups(members, risks, least))


def groups(members: DataFrame, risks: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """What scoring asks of each group."""
    categories = _majority(members.where("method <> 'category_burst'"), "unknown").unionByName(members.where("method = 'category_burst'").select(*GROUP, F.col("group_key").alias("group_category")).distinct())
    if "session_sum" not in members.columns:
        members = members.withColumn("session_sum", digest(F.col("session_id")).cast("bigint"))
    one = supported(members, risks).select(
        *GROUP, "session_id", "prompt_id", "ingested_at", "source", "category", "critical_signature", "session_sum", F.greatest("record_risk", F.coalesce("session_risk", F.lit(0.0))).alias("risk"),
        F.greatest("record_repeated", F.coalesce("session_repeated", F.lit(0))).alias("again"), F.coalesce(F.col("session_status").isin(*fixed.RISKY_STATUSES), F.lit(False)).alias("status_support"),
    )
    first = F.row_number().over(Window.partitionBy(*GROUP, "session_id").orderBy("ingested_at", "prompt_id"))
    one = one.withColumn("nth", first).where("nth = 1").drop("nth")
    g = one.groupBy(*GROUP).agg(
        F.count("*").alias("sessions"), F.avg("risk").alias("average_risk"), F.max("risk").alias("max_risk"), F.max("again").alias("repeated"), F.bool_or("critical_signature").alias("any_critical_signature"),
        F.sum(F.col("critical_signature").cast("int")).alias("critical_records"), F.bool_or(~F.col("category").isin(*UNKNOWN, "")).alias("known_member"), F.bool_or("status_support").alias("status_support"),
        F.min("ingested_at").alias("first_at"), F.sum(F.col("session_sum").cast("decimal(38,0)")).alias("session_digest"), F.min("session_id").alias("least_session"), F.min("prompt_id").alias("example_prompt_id"),
    )
    if least:
        g = g.where(F.col("sessions") >= F.try_element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("method")))
    g = g.join(categories, GROUP)
    return g.withColumn("group_category", F.when((F.col("method") == "session_risk_burst") & (F.col("group_category") == "unknown"), "session_risk").otherwise(F.col("group_category")))


def score(g: DataFrame) -> DataFrame:
    cat, method = F.col("group_category"), F.col("method")
    named = cat.isin(*fixed.CRITICAL_CATEGORIES)
    g = g.withColumns({
        "critical": named | F.col("any_critical_signature"), "has_category": ~cat.isin(*UNKNOWN) | F.col("known_member"),
        "risk_support": (F.col("max_risk") >= RISK_AT) | (F.col("average_risk") >= RISK_AT) | (F.col("repeated") >= 2),
    }).withColumn("has_risk", F.col("risk_support") | F.col("status_support"))
    by_pattern = (cat != "unknown") | F.col("known_member") | F.col("any_critical_signature") | F.col("has_risk")
    g = g.where((method != "normalized_pattern_burst") | by_pattern)
    confidence = (
        F.when(method == "exact_hash", F.when(F.col("critical"), 0.95).otherwise(0.70))
        .when(method == "simhash", F.when(F.col("has_category"), 0.90).when(F.col("has_risk"), 0.86).otherwise(0.78))
        .when(method == "normalized_pattern_burst", F.when(F.col("has_risk"), 0.90).otherwise(0.76))
        .when(method == "category_burst", F.when(F.col("has_risk"), 0.90).otherwise(F.least(F.lit(0.94), F.lit(0.70) + F.col("sessions") * 0.03)))
        .when(method == "session_risk_burst", F.when(F.col("has_category"), 0.90).otherwise(0.82))
        .when(method == "embedding", F.when(F.col("has_category") & F.col("has_risk"), 0.93).otherwise(0.91)).otherwise(0.70)
    )
    base = F.create_map(*[F.lit(x) for kv in fixed.METHOD_BASE.items() for x in kv])
    g = g.withColumns({"confidence": confidence, "critical_count": F.when(named, F.col("sessions")).otherwise(F.col("critical_records"))})
    penalty = F.when(cat.isin(*UNKNOWN, "session_risk") & method.isin("normalized_pattern_burst", "session_risk_burst"), 20).otherwise(0)
    raw = (
        F.col("confidence") * 45 + F.least(F.lit(25), F.col("sessions") * 5) + F.least(F.lit(15), F.col("critical_count") * 5) + F.least(F.lit(15.0), F.greatest("average_risk", "max_risk") / 8)
        + F.least(F.lit(10), F.col("repeated") * 3) + F.coalesce(F.try_element_at(base, method), F.lit(10)) - penalty
    )
    g = g.withColumn("group_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2))
    sure, enough = F.col("confidence") >= 0.90, F.col("sessions") >= MIN_SESSIONS
    kill = {
        "exact_hash": (sure & enough & F.col("critical"), "tier3_exact_critical_repeat", "tier3_exact_grouped_alert"),
        "simhash": (sure & enough & F.col("critical") & ((F.col("average_risk") >= 80) | (F.col("max_risk") >= 90)), "tier3_simhash_critical_burst", "tier3_simhash_grouped_alert"),
        "embedding": (sure & enough & F.col("critical") & (F.col("average_risk") >= 80) & (F.col("repeated") >= 2), "tier3_embedding_critical_cluster", "tier3_embedding_grouped_alert"),
        "normalized_pattern_burst": (sure & enough & (F.col("critical") | (F.col("max_risk") >= 90)), "tier3_pattern_supported_critical_burst", "tier3_pattern_grouped_alert"),
    }
    would, reason = F.lit(False), F.when(method == "session_risk_burst", "tier3_session_risk_grouped_alert").otherwise("tier3_category_grouped_alert")
    for m, (c, yes, no) in kill.items():
        would = F.when(method == m, c).otherwise(would)
        reason = F.when(method == m, F.when(c, yes).otherwise(no)).otherwise(reason)
    s = F.col("group_score")
    g = g.withColumns({"would_have_killed": would, "threshold_used": reason, "decision": S.ladder(s, [(85, "grouped_malicious"), (65, "grouped_high_risk")], "grouped_watch")})
    g = g.withColumn("cluster_key", F.concat_ws("-", F.col("sessions").cast("string"), F.col("session_digest").cast("string")))
    canonical = F.when(method == "exact_hash", F.col("group_key")).when(method == "category_burst", cat).otherwise(F.col("cluster_key"))
    return g.withColumn("burst_id", S.stable_hash("scope_id", F.col("window_start").cast("string"), method, cat, canonical))


def deduped(found: DataFrame) -> DataFrame:
    """Of findings over the same sessions of a window, the one of the strongest method."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    best = F.row_number().over(Window.partitionBy("scope_id", "window_start", "cluster_key").orderBy(F.try_element_at(rank, F.col("method")), F.desc("group_score"), "burst_id"))
    return found.withColumn("n", best).where("n = 1").drop("n")


def guarded(found: DataFrame, policy: Policy | None = Policy()) -> DataFrame:
    """Adds kill_triggered, action and the reason a kill was denied, by the scope's policy. With
    ``policy`` None the findings carry the policy in force (see ``policies.in_force``)."""
    names = {"mode": "tier3_mode", "min_sessions": "tier3_min_sessions_for_kill", "similarity": "tier3_similarity_threshold", "kill": "tier3_kill_threshold"}
    held = {f.name: F.lit(getattr(policy, f.name)) if policy else F.col(names.get(f.name, f.name)) for f in fields(Policy)}
    method, cat = F.col("method"), F.col("group_category")
    generic = method.isin("normalized_pattern_burst", "session_risk_burst") & cat.isin(*UNKNOWN, "session_risk")
    eligible = method.isin("exact_hash", "simhash", "category_burst", "embedding") | ((method == "normalized_pattern_burst") & cat.isin(*fixed.CRITICAL_CATEGORIES))
    denials = [
        (held["mode"] != "enforce", "tenant_mode_not_enforce"), (~held["global_kill"], "global_kill_disabled"), (~held["tier3_kill"], "tier3_kill_disabled"), (~held["enforcement"], "enforcement_not_configured"),
        (F.col("group_score") < 90, "group_score_below_threshold"), (F.col("sessions") < held["min_sessions"], "affected_sessions_below_threshold"), (F.col("confidence") < held["kill"], "confidence_below_threshold"),
        (F.col("confidence") < held["similarity"], "similarity_below_threshold"), (generic, "generic_pattern_alert_only"), (~eligible, "method_not_enforcement_eligible"),
    ]
    why = F.when(*denials[0])
    for d in denials[1:]:
        why = why.when(*d)
    g = found.withColumn("why", F.when(F.col("would_have_killed"), why))
    g = g.withColumn("kill_triggered", F.col("would_have_killed") & F.col("why").isNull())
    return g.withColumns({
        "kill_denied_reason": F.when(~F.col("would_have_killed"), F.col("threshold_used")).otherwise(F.coalesce("why", F.lit(""))), "action": F.when(F.col("kill_triggered"), "kill").otherwise("grouped_alert_only"),
        "event_type": F.when(F.col("kill_triggered"), "tier3_kill").otherwise("tier3_grouped_finding"), "decision": F.when(F.col("kill_triggered"), "grouped_kill_triggered").otherwise(F.col("decision")),
    }).drop("why")


def all_findings(rows: DataFrame, risks: DataFrame, near: bool = True, embedded: DataFrame | None = None) -> DataFrame:
    """All detectors over prompt records (or ``prepared`` ones), scored; the embedding detector runs
    over ``embedded``, records with a vector each, where given."""
    if "structure" not in rows.columns:
        rows = prepared(rows, risks, *(["prompt"] if near else []))  # read by every detector
    members = candidates(rows)
    if near:
        members = members.unionByName(written(near_duplicates(rows).select(*MEMBER), "t3-members"))
    g = groups(members, risks, LEAST)
    if embedded is not None:
        g = g.unionByName(stars(embedded, risks).select(*g.columns))
    return score(g)


def analyse(rows: DataFrame, risks: DataFrame, policy: Policy = Policy(), near: bool = True, embedded: DataFrame | None = None) -> DataFrame:
    """The findings of all detectors, deduplicated and guarded."""
    return guarded(deduped(all_findings(rows, risks, near, embedded)), policy)


def affected(members: DataFrame) -> DataFrame:
    """The sessions of each group as rows, with the last prompt seen: one action for each."""
    last = F.max(F.struct("ingested_at", "prompt_id")).alias("last")
    return members.groupBy(*GROUP, "session_id").agg(last).select(*GROUP, "session_id", F.col("last.prompt_id").alias("prompt_id"))


def not_cooling(found: DataFrame, earlier: DataFrame, now: Column, cooldown: int = COOLDOWN) -> DataFrame:
    """Findings without an equal one (scope, category, sessions) in the cooldown before them."""
    e = earlier.select("scope_id", F.col("group_category"), "cluster_key", F.col("event_ts").alias("earlier_ts"))
    f = found.withColumn("at", now)
    on = [f["scope_id"] == e["scope_id"], f["group_category"] == e["group_category"], f["cluster_key"] == e["cluster_key"], e["earlier_ts"] >= f["at"] - cooldown, e["earlier_ts"] < f["at"]]
    return f.join(e, on, "left_anti").drop("at")


def trailing(rows: DataFrame, runs: DataFrame, seconds: int) -> DataFrame:
    """Records once for each run that sees them, those of the ``seconds`` up to its time; the run
    takes the window's place. ``runs`` has the times (run_at) of the runs as they were. Records
    and runs meet in bins of ``seconds``, two for a run, so windows may overlap and drift."""
    # Runs are few: their number follows the time that the records cover, not the records.
    bins = runs.select("run_at").distinct().withColumn("bin", F.explode(F.sequence(F.floor((F.col("run_at") - seconds) / seconds), F.floor(F.col("run_at") / seconds))))
    here = rows.drop("window_start").withColumn("bin", F.floor(F.col("ingested_at") / seconds))
    return here.join(F.broadcast(bins), "bin").where(F.col("ingested_at").between(F.col("run_at") - seconds, F.col("run_at"))).drop("bin").withColumnRenamed("run_at", "window_start")


def examples(members: DataFrame, most: int = 10) -> DataFrame:
    """The first prompts of each group, ``most`` of them: cut before they are gathered."""
    nth = F.row_number().over(Window.partitionBy(*GROUP).orderBy("ingested_at", "prompt_id"))
    few = members.select(*GROUP, "prompt_id", nth.alias("n")).where(F.col("n") <= most)
    return few.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "prompt_id"))), lambda x: x["prompt_id"]).alias("examples"))


def cooldown_step(state: dict | None, row: dict) -> tuple[dict, dict]:
    """A finding is written unless an equal one was written in the cooldown before it; one that
    is suppressed doesn't prolong it."""
    if state is not None and state["at"] >= row["window_start"] - row["cooldown"]:
        return state, {"written": False}
    return {"at": row["window_start"]}, {"written": True}


def cooled(found: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """The findings of successive runs that are written, in the order of the runs."""
    return fold(found.withColumn("cooldown", F.lit(cooldown)), cooldown_step, ["window_start", "cooldown"], "written boolean", keys=["scope_id", "group_category", "cluster_key"], order=("window_start", "burst_id")).where("written").drop("written", "cooldown")


def eligible_scopes(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """Scopes whose mode isn't off and that have enough sessions in the window."""
    n = rows.select("scope_id", "session_id").distinct().groupBy("scope_id").agg(F.count("*").alias("sessions")).where(F.col("sessions") >= MIN_SESSIONS)
    return n.join(modes, "scope_id", "left").where(F.coalesce("tier3_mode", F.lit("shadow")) != "off").select("scope_id", "sessions")


def run_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("findings"), F.count_if("kill_triggered").alias("kills"), F.count_if("would_have_killed").alias("would_kill"), F.max("group_score").alias("max_score"), F.count_distinct("scope_id").alias("scopes"))
