"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised separately by k-means on a bounded sample
(FIT_ROWS); a vector's cell is its pair of nearest centroids. A query walks the pairs in
falling order of summed inner products with a heap (the multi-sequence order) until the
cells it has passed hold a share of all vectors. Their vectors are reranked by the inner
product of the original vectors in double precision.

The share isn't a constant. PROBES vectors are drawn from the table as trial queries and
held against all vectors by brute force, in blocks; for each of their true neighbours the
share of vectors that the walk passes before its cell is read off, and the walk's share is
the one that would have found RECALL of them. Where vectors cluster it is a few per cent;
vectors without any structure, which no index can prune, need most of them.

Scale: cells are laid out in a fixed order and cut in shards of about SHARD vectors, large
cells over several, so neither a hot cell nor a hot vector makes a large group. A shard is
packed into one row, and so are the queries of a block that ask it; shards and blocks meet
in a join that ships each shard once for BLOCKS_A_LANE blocks. The cell sizes (at most
MAX_CELLS squared rows) reach the driver and the tasks; vectors and queries don't.

Vectors that are null, zero, of another length than the most frequent, or hold null or
non-finite components take no part, as candidates or queries. Rows of one vec_id: the
largest vector by its components stays. Ties go to the smaller vec_id. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrella.llm.common import discard, saved, table

K, FIT_ROWS, MAX_CELLS, PER_CELL = 20, 20_000, 256, 10
PROBES, RECALL = 256, 0.96
SHARD, QUERY_BLOCK, BLOCKS_A_LANE = 16_384, 1024, 64
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = assign(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        n = np.bincount(a, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)


def traverse(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(b) + j) in falling order of a[i] + b[j] until they hold enough vectors."""
    oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, held = [(-(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]) * len(b) + int(ob[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[oa[x]] + b[ob[y]]), x, y))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def best_of(q: np.ndarray, own: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, allowed=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and places and exact scores of its k best vectors."""
    for at in range(0, len(q), 128):
        scores = q[at : at + 128] @ v.T
        for i, s in enumerate(scores):
            on = ids != own[at + i]
            if allowed is not None:
                on &= allowed(at + i)
            on = np.flatnonzero(on)
            if not len(on):
                continue
            s = s[on]
            if len(on) > k:  # ties at the border stay: they are settled by the exact scores
                on = on[s >= np.partition(s, -k)[-k] - SLACK]
            exact = np.array([math.fsum(row) for row in q[at + i] * v[on]])
            best = np.lexsort((ids[on], -exact))[:k]
            yield at + i, on[best], exact[best]


def _packed_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("query_id")
    row = {"shard": pdf["shard"].iloc[0], "block": pdf["block"].iloc[0], "own": pdf["query_id"].to_numpy("<i8").tobytes(), "q": _matrix(pdf["vector"]).tobytes()}
    return pd.DataFrame([row | {"walks": np.concatenate(pdf["cells"].tolist()).astype("<i4").tobytes(), "ends": np.cumsum(pdf["cells"].map(len)).to_numpy("<i8").tobytes()}])


def _packed_vectors(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["cell", "vec_id"])
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "ids": pdf["vec_id"].to_numpy("<i8").tobytes(), "at": pdf["cell"].to_numpy("<i4").tobytes(), "v": _matrix(pdf["vector"]).tobytes()}])


class Cells:
    """The two codebooks and the number of vectors of each cell."""

    def __init__(self, rows: DataFrame, dim: int, total: int):
        x = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()["vector"])
        self.half, self.total = max(1, dim // 2), total
        side = min(MAX_CELLS, max(2, round(math.sqrt(total / PER_CELL))))
        self.a = kmeans(x[:, : self.half], side)
        self.b = kmeans(x[:, self.half :], side) if dim > self.half else np.zeros((1, 0))
        self.sizes = np.zeros(len(self.a) * len(self.b), dtype=np.int64)

    def of(self, m: np.ndarray) -> np.ndarray:
        return assign(m[:, : self.half], self.a) * len(self.b) + (assign(m[:, self.half :], self.b) if len(self.b) > 1 else 0)

    def walks(self, m: np.ndarray, enough: int) -> Iterator[list[int]]:
        sa, sb = m[:, : self.half] @ self.a.T, m[:, self.half :] @ self.b.T
        for a, b in zip(sa, sb, strict=True):
            yield traverse(a, b, self.sizes, enough)


def needed_share(index: DataFrame, cells: Cells, k: int, recall: float, probes: int) -> float:
    """The share of all vectors that the walk must pass to find ``recall`` of the true neighbours
    of ``probes`` vectors of the table (fewer in a smaller one)."""
    asked = index.orderBy(F.xxhash64("vec_id", F.lit("probe")), "vec_id").limit(probes).toPandas()
    q, own = _matrix(asked["vector"]), asked["vec_id"].to_numpy()

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                ids, cell = pdf["vec_id"].to_numpy(), pdf["cell"].to_numpy()
                for i, at, score in best_of(q, own, ids, _matrix(pdf["vector"]), k):
                    yield pd.DataFrame({"probe": i, "vec_id": ids[at], "cell": cell[at], "score": score})

    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    # At most probes times k rows come back.
    true = index.mapInPandas(nearest, "probe int, vec_id long, cell int, score double").withColumn("place", place).where(F.col("place") <= k).select("probe", "cell").toPandas()
    by_probe, passed = true.groupby("probe")["cell"].agg(list), []
    for i, walk in enumerate(cells.walks(q, cells.total)):
        before = dict(zip(walk, np.cumsum([0, *cells.sizes[walk]]).tolist()))
        passed += [before[c] + 1 for c in by_probe.get(i, [])]
    return float(np.quantile(passed, recall)) / cells.total if passed else 1.0


def search(vectors: DataFrame, queries, k: int = K, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score; ``queries`` is a condition on vec_id."""
    spark = vectors.sparkSession
    every = saved(usable(vectors), "ann-vectors")
    lengths = every.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = lengths.n
    rows = every.where(F.size("vector") == lengths.dim)
    cells = Cells(rows, lengths.dim, total)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cells.of(_matrix(v)) if len(v) else [], dtype="int32")

    index = saved(rows.withColumn("cell", cell("vector")), "ann-index")
    discard(every)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MAX_CELLS squared rows
        cells.sizes[r.cell] = r.n
    enough = max(k + 1, math.ceil(needed_share(index, cells, k, recall, probes) * total))
    shard = min(SHARD, max(256, math.ceil(total / 64)))
    begins = np.r_[0, np.cumsum(cells.sizes)[:-1]]

    @F.pandas_udf("long")
    def shard_of(cell: pd.Series, ids: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        spread = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return pd.Series((begins[c] + spread % cells.sizes[c]) // shard)

    asked = index.where(queries)
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def probed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                out = []
                for q, v, walk in zip(part["vec_id"].tolist(), part["vector"], cells.walks(_matrix(part["vector"]), enough), strict=True):
                    by: dict[int, list[int]] = {}
                    for c in walk:
                        for s in range(int(begins[c]) // shard, int(begins[c] + cells.sizes[c] - 1) // shard + 1):
                            by.setdefault(s, []).append(c)
                    out += [(s, q % blocks, q, v, cs) for s, cs in by.items()]
                yield pd.DataFrame(out, columns=["shard", "block", "query_id", "vector", "cells"])

    asking = asked.select("vec_id", "vector").mapInPandas(probed, "shard long, block long, query_id long, vector array<double>, cells array<int>")
    # A block has QUERY_BLOCK queries on average and a shard SHARD vectors: both groups are bounded.
    packs = asking.groupBy("shard", "block").applyInPandas(_packed_queries, "shard long, block long, own binary, q binary, walks binary, ends binary")
    shards = index.withColumn("shard", shard_of("cell", "vec_id")).select("shard", "vec_id", "cell", "vector").groupBy("shard").applyInPandas(_packed_vectors, "shard long, ids binary, at binary, v binary")
    lanes = max(1, math.ceil(blocks / BLOCKS_A_LANE))
    shards = shards.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))

    def rerank(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in parts:
            for r in range(batch.num_rows):
                own, q, walks, ends, ids, c, v = (np.frombuffer(batch.column(n)[r].as_buffer(), t) for n, t in (("own", "<i8"), ("q", "<f8"), ("walks", "<i4"), ("ends", "<i8"), ("ids", "<i8"), ("at", "<i4"), ("v", "<f8")))
                q, v = q.reshape(len(own), -1), v.reshape(len(ids), -1)
                present, starts = np.unique(c, return_index=True)
                lengths, begins_ = np.diff(np.r_[starts, len(c)]), np.r_[0, ends[:-1]]
                allowed = lambda i: np.repeat(np.isin(present, walks[begins_[i] : ends[i]]), lengths)  # noqa: B023, E731
                got = [(np.full(len(at), own[i]), ids[at], score) for i, at, score in best_of(q, own, ids, v, k, allowed)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], schema=kind)

    found = packs.withColumn("lane", F.pmod("block", F.lit(lanes))).join(shards, ["shard", "lane"]).drop("shard", "lane", "block").mapInArrow(rerank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)
