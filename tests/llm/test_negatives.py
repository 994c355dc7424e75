"""Hard negatives against brute force, pruning by boxes, and defined edge cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrella.llm import negatives as N

TABLE = "vec_id long, embedding array<double>, label int, tile int, v string"


def brute(rows, anchor, label):
    """All pairs, in Python's integers."""
    best = {}
    for i, e, y in rows:
        if i is None or e is None or label(i, y) is None or not all(c is not None and math.isfinite(c) and c * c * len(e) < N.LARGEST for c in e):
            continue
        row = (label(i, y), [math.floor(256 * c) for c in e])
        best[i] = max(best.get(i, row), row)
    sizes = [len(v) for _, v in best.values()]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), -n)) if sizes else 0
    use = {i: r for i, r in best.items() if len(r[1]) == dim}
    out = []
    for a, (y, q) in use.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, v)), i) for i, (_, v) in use.items() if i != a)
        for p, pos in [(-s, i) for s, i in scored if use[i][0] == y][:5]:
            found = [(i, -s) for s, i in scored if use[i][0] != y and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(a, pos, k, i, p, s) for k, (i, s) in enumerate(found, 1)]
    return sorted(out)


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def label(i, y):
    return None if y is None else (y + 1) % 10 if i % 7 == 0 else y


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile", [64, 100_000])
def test_mining_equals_brute_force(spark, monkeypatch, tile):
    for name, value in (("TILE", tile), ("PART", 150), ("LANE", 7), ("COLUMN", 2)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 0.2, 6) + (i % 4 == 1)).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(1000, 1450)]  # one vector of a third of the rows
    rows += [(2000, None, 1), (None, [1.0] * 6, 1), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2200, [float("nan")] * 6, 1), (2300, [math.inf] + [0.0] * 5, 1), (2400, [1.0] * 6, None)]
    rows += [(2500, [1.0] * 5, 1), (2600, [1e12] + [0.0] * 5, 1), (2700, [900_000.5] * 6, 1), (2701, [900_000.25] * 6, 2), (2800, [0.0] * 6, 1), (2900, [-1.0] * 6, 9), (100, [0.1] * 6, 0), (100, [0.1] * 6, 3), (-200, [0.3] * 6, 2), (3000, [], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TABLE).repartition(3)
    want = brute(rows, lambda i: i % 100 == 0, label)
    assert got(N.mine(df, F.col("vec_id") % 100 == 0, moved())) == want and len(want) > 60


def test_odd_tables(spark):
    mine = lambda rows: got(N.mine(spark.createDataFrame([(*r, 1, "x") for r in rows], TABLE), F.col("vec_id") % 100 == 0, moved()))
    assert mine([]) == [] and mine([(100, None, 1)]) == [] and mine([(100, [1.0], 1)]) == [] and mine([(100, [], 1), (200, [], 1)]) == []
    assert mine([(100, [1.0], 1), (101, [1.0], 1)]) == []  # a positive without negatives
    assert mine([(100, [1.0], 1), (101, [1.0], 1), (102, [0.8], 2), (103, [0.79], 2)]) == [(100, 101, 1, 102, 65536, 204 * 256)][: 80 * 65536 <= 100 * 204 * 256]


def test_registered_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({N.OP12_SQL})").fetchall())
    assert got(N.op12_hard_negatives(spark, sf)) == want and len(want) > 100


def test_boxes_bound_products_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (64, 8))
    v = np.round(centres[rng.integers(0, 64, 16_000)] + rng.normal(0, 8, (16_000, 8))).astype(np.int64)
    ids, labels = np.arange(16_000), rng.integers(0, 5, 16_000)
    pdf = __import__("pandas").DataFrame({"vec_id": ids, "label": labels, "v": list(v), "tile": 0, "part": 0})
    row = N.packed(pdf).iloc[0]
    part = N.Part(row, 8)
    assert sorted(part.ids) == list(ids) and part.spans[-1][1] == 16_000 and max(b - a for a, b in part.spans) <= N.LEAF
    q = v[:30]
    least, most = N.bounds(part.low, part.high, q)
    for leaf, (a, b) in enumerate(part.spans):
        exact = q @ part.v[a:b].T
        assert (least[:, leaf] <= exact.min(1)).all() and (most[:, leaf] >= exact.max(1)).all()
    read = 0
    for i in range(30):
        w = N.Wanted(-(1 << 60), 1 << 60, 5)
        read += N.best_first(part, q[i], least[i], most[i], i, int(labels[i]), True, [w])
        order = np.lexsort((ids, -(v @ q[i])))
        assert list(w.ids) == [j for j in order if j != i and labels[j] == labels[i]][:5]
    assert read < 0.25 * 30 * len(part.spans)
