"""A model that fails, hangs or answers oddly, and delivery to it."""

from pyspark.sql import functions as F

from sentrella.operators import scoring


def odd_model():
    """A loader (made here, so that it travels with the job) of a scorer that refuses one text,
    hangs on another and is one reply short on a third."""

    def score(texts):
        import json
        import time

        if "refuse" in texts:
            raise KeyError("refuse")
        if "hang" in texts:
            time.sleep(3)
        if "short" in texts:
            return []
        return [json.dumps([{"label": t, "score": 0.5}, {"label": "LOW", "score": 0.1}]) for t in texts]

    def load():
        return score

    return load


def test_a_bad_text_fails_alone(spark):
    texts = ["a", "b", "refuse", "hang", "short", "", None, "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    got = {r.id: r for r in scoring.scored(df, "t", odd_model(), batch=10, seconds=0.5).collect()}
    assert len(got) == len(texts)
    assert got[0].label == got[7].label == "a" and got[1].label == "b" and got[0].confidence == 0.5 and not got[0].degraded
    assert "refuse" in got[2].error and got[2].label is None and "TimeoutError" in got[3].error and "0 replies to 1" in got[4].error
    assert got[5].error is None and got[6].error is None
    tally = scoring.tally(scoring.scored(df, "t", odd_model(), 10, 0.5), F.col("label") == "b", F.coalesce("t", F.lit("")) == "").first()
    assert (tally.processed, tally.blocked, tally.skipped, tally.errors) == (3, 1, 2, 3)
    assert scoring.scored(df.limit(0), "t", odd_model()).count() == 0


def test_replies_of_every_shape(spark):
    shapes = {
        '[{"label": "X", "score": 0.9}, {"label": "Y", "score": 0.95}]': ("Y", 0.95, False), '[[{"label": "X", "score": 0.9}]]': ("X", 0.9, False), '[{"label": "X", "score": 0.9}, {"label": "Y", "score": 0.9}]': ("X", 0.9, False),
        '[{"label": "X"}]': ("SAFE", 0.0, True), '[{"score": 0.9}]': ("SAFE", 0.0, True), "[]": ("SAFE", 0.0, True), "{}": ("SAFE", 0.0, True), "no json": ("SAFE", 0.0, True), '[1, [{"label": "X", "score": 0.9}]]': ("SAFE", 0.0, True), '[{"label": "X", "score": 1}]': ("X", 1.0, False),
    }
    df = spark.createDataFrame([(r,) for r in shapes], "r string").withColumn("v", scoring.verdict(F.col("r")))
    for r in df.collect():
        assert tuple(r.v) == shapes[r.r], r.r


def test_delivery_counts_attempts_and_keeps_every_message(spark):
    df = spark.createDataFrame([(i,) for i in range(40)], "id int")
    calls = []

    def handle(messages, attempt):
        calls.append(attempt)
        return messages.withColumn("error", F.when(F.col("id") % 8 >= attempt, F.concat(F.lit("failed at "), F.lit(attempt).cast("string"))))

    got = {r.id: r for r in scoring.delivered(df, handle).collect()}
    assert len(got) == 40 and calls == [1, 2, 3, 4, 5]
    for i, r in got.items():
        assert (r.attempts, r.outcome) == ((i % 8 + 1, "delivered") if i % 8 < 5 else (5, "dead_letter"))
        assert (r.error is None) == (i % 8 < 5)
    calls.clear()
    assert scoring.delivered(df.where("id % 8 = 0"), handle).count() == 5 and calls == [1]
    assert scoring.delivered(df.limit(0), handle).count() == 0


def test_equal_chances_are_safe_in_every_order_of_the_reply(spark):
    from sentrella.plans import models

    texts = ["instructions" + "." * n for n in range(3)]  # chances of a half, by the three known shapes of a reply
    got = scoring.scored(spark.createDataFrame([(t,) for t in texts], "t string"), "t", models.linear).collect()
    assert [(r.label, r.confidence, r.degraded, r.error) for r in got] == [("SAFE", 0.5, False, None)] * 3
