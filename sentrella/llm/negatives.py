"""Hard-negative mining over an STR-packed R-tree.

Vectors are cut to integers, floor(256 x), and scored by their integer inner product. An
anchor's positives are its best other rows of the same label; for each positive the hard
negatives are the best rows of other labels whose score lies in a window below the positive's,
80 to 100 percent of it.

Packing (sort-tile-recursive): the vectors are cut in slabs by quantiles of the coordinate of
the largest variance, slabs by quantiles of the next one, and those by the third, which gives
tiles; a task packs a tile the same way over all coordinates into leaves of LEAF vectors, and
FAN leaves into a node. Nodes and leaves keep their minimum bounding box. For a query q and a
box [l, u] the inner product lies between the sums of min(q l, q u) and max(q l, q u), one
interval a coordinate.

Search: a priority queue gives boxes by falling upper bound. A box is left out if its interval
misses all score windows, or lies strictly below the k-th score found (or at it, where every id
in the box is larger). Positives are sought twice: first in each anchor's best tile alone,
which gives a k-th score to prune the other tiles by.

Scale: tiles have TILE vectors, more where there would be over BOXES of them, so the table of
their boxes (BOXES rows at most) can travel to the tasks; a tile is packed in parts of PART
rows, dealt by a hash of the id, so a vector that a third of the rows share makes no large
group. Anchors travel in lanes of LANE, tiles' parts in columns of COLUMN; a part is sent only
to lanes with an anchor that can't prune its tile, and a lane and a column meet in one task.
Where vectors have no structure no box can be pruned, and the work is anchors times rows, as
of any exact search.

Rows with a null id, label or vector, or with a null or non-finite component take no part;
neither do vectors whose scores could pass 64 bits (64 components of 2^20), and those of another
length than the most frequent (ties: the shorter). Of rows of one id the one of the largest
label and vector stays. Ties of scores go to the smaller id. An anchor without another row of
its label has no positive, a positive without a row in its window no row. Extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrella.llm.common import discard, saved, table

K = 5
TILE, BOXES, PART, LEAF, FAN = 8192, 65_536, 16_384, 128, 8
LANE, COLUMN = 512, 4
#: Bound of (largest component)^2 * length, by which scores of 256 x stay in 63 bits.
LARGEST = 1 << 46
#: Percentage of the positive's score from which a negative's lies.
LOW = 80


def usable(vectors: DataFrame, label=None) -> DataFrame:
    """vec_id, label and integer vector (array<long>) of rows that take part, one for each id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (c * c * F.size("x") < LARGEST))
    )
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))
    # The longest of equal prefixes is the larger; arrays and numbers are ordered as they are.
    return rows.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("best")).select("vec_id", "best.label", "best.v")


def matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=np.int64)


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest products of each query (rows of q) with any point of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


# ---------------------------------------------------------------- packing


def tiles(rows: DataFrame, total: int, dim: int) -> DataFrame:
    """The rows with their tile, from quantiles of the three coordinates of the largest variance."""
    spread = rows.agg(*(F.variance(F.col("v")[j]).alias(f"s{j}") for j in range(dim))).first()
    order = sorted(range(dim), key=lambda j: (-(spread[j] or 0.0), j))[:3]
    wanted = max(1, math.ceil(total / max(TILE, total / BOXES)))
    out, made = rows.withColumn("tile", F.lit(0)), 1
    for left, j in zip(range(len(order), 0, -1), order):
        cuts = max(1, round((wanted / made) ** (1 / left)))
        if cuts == 1:
            continue
        # One row for each slab so far, fewer than BOXES in all.
        quantiles = [k / cuts for k in range(1, cuts)]
        edges = {r.tile: r.e for r in out.groupBy("tile").agg(F.percentile_approx(F.col("v")[j], quantiles, 1000).alias("e")).collect()}
        at = F.create_map(*(c for t, e in edges.items() for c in (F.lit(t), F.array(*map(F.lit, e))))) if len(edges) <= 64 else None
        if at is not None:
            edge = at[F.col("tile")]
            out = out.withColumn("tile", F.col("tile") * cuts + F.size(F.filter(edge, lambda e, j=j: F.col("v")[j] > e)))
        else:
            table_ = rows.sparkSession.createDataFrame([(t, list(e)) for t, e in edges.items()], "tile int, e array<long>")
            out = out.join(F.broadcast(table_), "tile").withColumn("tile", F.col("tile") * cuts + F.size(F.filter("e", lambda e, j=j: F.col("v")[j] > e))).drop("e")
        made *= cuts
    return out


def sort_tile(v: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Places of the vectors of each leaf: slices by one coordinate after the other, the widest
    first, each in order of the next."""
    axes = np.argsort(-(v.max(0) - v.min(0)), kind="stable")

    def slices(at: np.ndarray, depth: int) -> list[np.ndarray]:
        if len(at) <= leaf:
            return [at]
        leaves = math.ceil(len(at) / leaf)
        left = min(len(axes) - depth, max(1, math.ceil(math.log2(leaves))))
        cuts = leaves if left <= 1 else math.ceil(leaves ** (1 / left))
        at = at[np.lexsort((ids[at], v[at, axes[depth]]))]
        size = math.ceil(math.ceil(leaves / cuts) * leaf)
        return [x for i in range(0, len(at), size) for x in slices(at[i : i + size], min(depth + 1, len(axes) - 1))]

    return slices(np.arange(len(ids)), 0)


PACKED = "tile long, part long, n long, ids binary, labels binary, v binary, ends binary, low binary, high binary"


def packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part of a tile as one row: vectors in leaf order, and the leaves' ends and boxes."""
    v, ids, labels = matrix(pdf["v"]), pdf["vec_id"].to_numpy("<i8"), pdf["label"].to_numpy("<i8")
    leaves = sort_tile(v, ids)
    order = np.concatenate(leaves)
    low, high = (np.array([f(v[x], axis=0) for x in leaves], dtype="<i8") for f in (np.min, np.max))
    row = {"tile": int(pdf["tile"].iloc[0]), "part": int(pdf["part"].iloc[0]), "n": len(ids), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "v": v[order].astype("<i4").tobytes()}
    return pd.DataFrame([row | {"ends": np.cumsum([len(x) for x in leaves]).astype("<i8").tobytes(), "low": low.tobytes(), "high": high.tobytes()}])


class Part:
    """A packed part as a tree: root, nodes of FAN leaves, leaves."""

    def __init__(self, row, dim: int):
        get = lambda name, kind="<i8": np.frombuffer(row[name], kind)
        self.ids, self.labels, self.v = get("ids"), get("labels"), get("v", "<i4").reshape(-1, dim).astype(np.int64)
        ends, low, high = get("ends"), get("low").reshape(-1, dim), get("high").reshape(-1, dim)
        self.spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        at = np.arange(0, len(low), FAN)
        self.low, self.high = np.vstack([low, np.minimum.reduceat(low, at)]), np.vstack([high, np.maximum.reduceat(high, at)])
        first = np.minimum.reduceat(self.ids, np.r_[0, ends[:-1]])
        self.first, self.leaves = np.r_[first, np.minimum.reduceat(first, at)].tolist(), len(low)
        self.nodes = [list(range(a, min(a + FAN, len(low)))) for a in at.tolist()]
        # Sums below 2^53 are exact in floating point, whatever the query.
        self.wide = float(np.abs(self.v).max(initial=0)) * 256 * math.sqrt(LARGEST * dim) >= 2**53
        self.f = None if self.wide else self.v.astype(np.float64)

    def scores(self, a: int, b: int, q: np.ndarray, qf: np.ndarray) -> np.ndarray:
        return self.v[a:b] @ q if self.wide else (self.f[a:b] @ qf).astype(np.int64)


class Wanted:
    """The k best rows found for one window [low, high] of one query."""

    __slots__ = ("low", "high", "ids", "scores", "k")

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k, self.ids, self.scores = low, high, k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def skips(self, least: int, most: int, first: int) -> bool:
        """Whether a box with products of least to most and ids from first on can't add a row."""
        if most < self.low or least > self.high:
            return True
        if len(self.ids) < self.k:
            return False
        return most < self.scores[-1] or most == self.scores[-1] and first > self.ids[-1]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = max(self.low, int(self.scores[-1])) if len(self.ids) == self.k else self.low
        on = np.flatnonzero((scores >= floor) & (scores <= self.high))
        if len(on):
            ids, scores = np.r_[self.ids, ids[on]], np.r_[self.scores, scores[on]]
            best = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[best], scores[best]


def best_first(part: Part, q: np.ndarray, least: np.ndarray, most: np.ndarray, own: int, label: int, same: bool, wanted: list[Wanted]) -> int:
    """Search a part for one query; the leaves read are counted."""
    least, most, qf, read = least.tolist(), most.tolist(), q.astype(np.float64), 0
    heap = [(-most[b], b) for b in range(part.leaves, part.leaves + len(part.nodes))]
    heapq.heapify(heap)
    while heap:
        up, box = heapq.heappop(heap)
        if all(w.skips(least[box], -up, part.first[box]) for w in wanted):
            continue
        if box >= part.leaves:
            for leaf in part.nodes[box - part.leaves]:
                heapq.heappush(heap, (-most[leaf], leaf))
            continue
        a, b = part.spans[box]
        ids, on = part.ids[a:b], part.labels[a:b] == label
        on = np.flatnonzero(on & (ids != own) if same else ~on)
        read += 1
        if len(on):
            ids, scores = ids[on], part.scores(a, b, q, qf)[on]
            for w in wanted:
                w.add(ids, scores)
    return read


# ---------------------------------------------------------------- lanes and columns

ASKED = "anchor_id long, label long, v array<long>, keys array<long>, lows array<long>, highs array<long>"
FOUND = "anchor_id long, key long, vec_id long, score long"


def asked_tiles(asked: DataFrame, tile_low: np.ndarray, tile_high: np.ndarray, names: np.ndarray, best: bool) -> DataFrame:
    """(lane, tile) of every lane with an anchor that can't prune the tile; with ``best`` for
    each anchor its tile of the largest bound only."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pairs = set()
            for at in range(0, len(pdf), 64):
                some = pdf.iloc[at : at + 64]
                least, most = bounds(tile_low, tile_high, matrix(some["v"]).astype(np.float64))
                least, most = least - 1 - abs(least) * 1e-12, most + 1 + abs(most) * 1e-12  # rounding never prunes
                for i, (lane, lows, highs) in enumerate(zip(some["lane"], some["lows"], some["highs"], strict=True)):
                    on = [int(most[i].argmax())] if best else np.flatnonzero(np.any([(most[i] >= a) & (least[i] <= b) for a, b in zip(lows, highs)], axis=0)).tolist() if len(lows) else []
                    pairs.update((int(lane), int(names[t])) for t in on)
            yield pd.DataFrame(sorted(pairs), columns=["lane", "tile"])

    return asked.mapInPandas(each, "lane long, tile long").distinct()


def searched(asked: DataFrame, parts: DataFrame, need: DataFrame, dim: int, columns: int, same: bool, k: int) -> DataFrame:
    """The k best rows of each anchor and window in every column."""
    sent = parts.join(need, "tile").withColumn("column", F.pmod(F.xxhash64("tile", "part"), F.lit(columns)))

    def cell(anchors: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(chunks):
            return pd.DataFrame({"anchor_id": [], "key": [], "vec_id": [], "score": []}, dtype="int64")
        anchors = anchors.sort_values("anchor_id")
        q = matrix(anchors["v"])
        wanted = [[Wanted(int(a), int(b), k) for a, b in zip(lows, highs)] for lows, highs in zip(anchors["lows"], anchors["highs"], strict=True)]
        for _, row in chunks.sort_values(["tile", "part"]).iterrows():
            part = Part(row, dim)
            # Bounds of integers up to 2^28 over any usual length are exact in 64 bits.
            least, most = bounds(part.low, part.high, q)
            for i, (own, label) in enumerate(zip(anchors["anchor_id"].tolist(), anchors["label"].tolist(), strict=True)):
                best_first(part, q[i], least[i], most[i], own, label, same, wanted[i])
        out = [(own, int(key), int(i), int(s)) for own, keys, ws in zip(anchors["anchor_id"].tolist(), anchors["keys"], wanted, strict=True) for key, w in zip(keys, ws, strict=True) for i, s in zip(w.ids, w.scores)]
        return pd.DataFrame(out, columns=["anchor_id", "key", "vec_id", "score"], dtype="int64")

    lanes = asked.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))
    return lanes.groupBy("lane", "column").cogroup(sent.groupBy("lane", "column")).applyInPandas(cell, FOUND)


def mine(vectors: DataFrame, anchors, label=None, k: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` is a
    condition on vec_id, ``label`` a column in place of the table's own."""
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    every = saved(usable(vectors, label), "negatives-vectors")
    lengths = every.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None or not lengths.dim:
        return spark.createDataFrame([], result)
    dim, total = lengths.dim, lengths.n
    rows = every.where(F.size("v") == dim)
    tiled = tiles(rows, total, dim)
    sizes = {r.tile: r.n for r in tiled.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # fewer than BOXES rows
    if max(sizes.values()) > PART:
        hot = spark.createDataFrame([(t, math.ceil(n / PART)) for t, n in sizes.items()], "tile int, parts int")
        tiled = tiled.join(F.broadcast(hot), "tile").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    else:
        tiled = tiled.withColumn("part", F.lit(0).cast("long"))
    parts = saved(tiled.groupBy("tile", "part").applyInPandas(packed, PACKED), "negatives-parts")

    def boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                low, high = (np.frombuffer(r[n], "<i8").reshape(-1, dim) for n in ("low", "high"))
                yield pd.DataFrame({"tile": [r["tile"]], "low": [low.min(0).tolist()], "high": [high.max(0).tolist()]})

    # A row for each part: at most BOXES and one for each PART rows of a hot tile, by tile.
    found = parts.select("tile", "low", "high").mapInPandas(boxed, "tile long, low array<long>, high array<long>")
    per = [F.min(F.col("low")[j]).alias(f"l{j}") for j in range(dim)] + [F.max(F.col("high")[j]).alias(f"h{j}") for j in range(dim)]
    boxes = found.groupBy("tile").agg(*per).toPandas()
    tile_low, tile_high, names = boxes[[f"l{j}" for j in range(dim)]].to_numpy(np.float64), boxes[[f"h{j}" for j in range(dim)]].to_numpy(np.float64), boxes["tile"].to_numpy()

    chosen = rows.where(anchors)
    lanes = max(1, math.ceil(chosen.count() / LANE))
    columns = max(1, math.ceil(sum(max(1, math.ceil(n / PART)) for n in sizes.values()) / COLUMN))
    lane = F.pmod(F.xxhash64("anchor_id"), F.lit(lanes)).alias("lane")
    base = chosen.select(F.col("vec_id").alias("anchor_id"), "label", "v").select("*", lane)
    most = (1 << 62) - 1

    def windows(df: DataFrame, low) -> DataFrame:
        return df.withColumn("keys", F.array(F.lit(0).cast("long"))).withColumn("lows", F.array(low.cast("long"))).withColumn("highs", F.array(F.lit(most)))

    def ranked(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    first = windows(base, F.lit(-most))
    near = ranked(searched(first, parts, asked_tiles(first, tile_low, tile_high, names, best=True), dim, columns, True, k), ["anchor_id"])
    # The k-th score of the best tile, where it has k.
    floors = saved(near.where(F.col("rank") == k).select("anchor_id", F.col("score").alias("floor")), "negatives-floors")
    second = windows(base.join(floors, "anchor_id", "left"), F.coalesce("floor", F.lit(-most))).drop("floor")
    positives = saved(ranked(searched(second, parts, asked_tiles(second, tile_low, tile_high, names, best=False), dim, columns, True, k), ["anchor_id"]).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # 80 p <= 100 n <= 100 p; a window below zero is empty.
    low = F.expr(f"(positive_score DIV 100) * {LOW} + ((positive_score % 100) * {LOW} + 99) DIV 100")
    window = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", low.alias("low"), "positive_score"))).alias("w"))  # k at most
    third = base.join(window, "anchor_id").select("anchor_id", "label", "v", "lane", F.col("w.positive_id").alias("keys"), F.col("w.low").alias("lows"), F.col("w.positive_score").alias("highs"))
    third = saved(third, "negatives-windows")
    discard(every, floors)
    negatives = ranked(searched(third, parts, asked_tiles(third, tile_low, tile_high, names, best=False), dim, columns, False, k), ["anchor_id", "key"])
    return negatives.withColumnRenamed("key", "positive_id").join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


OP12_SQL = """
WITH x AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""
