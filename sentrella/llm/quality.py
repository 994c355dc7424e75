"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled training rows of class 1, all of them; the unlabelled are
all training documents, whatever their labels, which are not looked at. Each document is 25
statistics of its whole text in bins (quantiles of all training documents). A bin's evidence
is the log of its share among positives over its share among all.

The class prior is estimated from the unlabelled scores: documents are scored by the summed
evidence of the other half's counts, and the least ratio of the share of all to the share of
positives above a threshold, by its upper confidence limit, is the prior.

A logistic model over the summed evidence and its 25 parts (of the other half's counts, so
that a positive's own label isn't in its features) minimises the non-negative unbiased risk
over all rows

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

by Newton steps. Every sum over the rows is taken in the tasks; the driver sees arrays of
some thousand numbers. The model is one weight for each bin, for the evidence of all counts.

Null and empty texts are scored from the statistics of an empty text. Without positives
every score is 0.5. Very long texts are read whole, one at a time. Equal texts have equal
scores, which no tie needs to break. Documents without an id are scored but not learnt from; repeated rows
count as they come, repeated labels of a document once (the larger). Other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import discard, documents, remainder, saved, table

#: Bounds of the bins: twelfths, and the tails where rare shapes sit.
QUANTILES = (0.01, 0.03, *(k / 12 for k in range(1, 12)), 0.97, 0.99)
#: Histogram of the prior's scores; weight of the single parts against their sum.
GRID, SPAN, SMALLER = 4096, 64.0, 0.3
ROUNDS, RIDGE = 10, 0.03
#: Share of the positives above the threshold from which the prior is estimated, at least;
#: standard errors that are added to it.
LEAST, ERRORS = 0.7, 1.64


def statistics(text: str) -> list[float]:
    """Shape of a whole text: letters, case, punctuation, repetition, lengths."""
    n = len(text)
    words = text.split()
    k = len(words)
    counts = Counter(words)
    letters = Counter(text)
    alpha = sum(c for x, c in letters.items() if x.isalpha())
    upper = sum(c for x, c in letters.items() if x.isupper())
    digits = sum(c for x, c in letters.items() if x.isdigit())
    space = sum(c for x, c in letters.items() if x.isspace())
    marks = n - alpha - digits - space
    common = counts.most_common(4)
    same = sum(a == b for a, b in zip(words, words[1:]))
    runs = sum(1 for w in words if len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum())
    lines = text.split("\n")
    line_counts = Counter(x for x in lines if x)
    plain = sum(letters[x] for x in ".,")
    tails = Counter(w[-1] for w in words if not w[-1].isalnum())
    return [
        math.log1p(n), math.log1p(k), n / (k or 1), upper / (alpha or 1), marks / (n or 1), digits / (n or 1),
        (marks - plain) / (n or 1), len(counts) / (k or 1), len(counts) / math.sqrt(k or 1), sum(c for _, c in common) / (k or 1),
        (common[0][1] if common else 0) / (k or 1), same / (k or 1), runs / (k or 1), letters["|"] / (k or 1), letters["!"] / (k or 1),
        k / len(lines), len(line_counts) / len(lines), max((len(w) for w in counts), default=0), sum(1 for w in words if len(w) == 1) / (k or 1),
        sum(1 for w in words if w[0].isupper()) / (k or 1), letters["."] / (k or 1), letters[","] / (k or 1), max(tails.values(), default=0) / (k or 1),
        sum(c for w, c in counts.items() if len(w) <= 3) / (k or 1), sum(1 for w in words if len(w) >= 10) / (k or 1),
    ]


def codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each statistic, numbered side by side: columns of indices into one table."""
    bins = len(edges) + 1
    return np.stack([j * bins + np.searchsorted(edges[:, j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)


def _training(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """Statistics of all training documents, and whether each is a trusted positive."""
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(keep).groupBy("doc_id").agg(F.max("y").alias("y")).where("y = 1")

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})

    rows = documents(docs).where(keep & F.col("doc_id").isNotNull()).mapInPandas(shapes, "doc_id long, x array<double>")
    return saved(rows.join(trusted, "doc_id", "left").select("x", F.col("y").isNotNull().alias("trusted"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")), "quality-shapes")


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of ``of(x, trusted, fold)``, an array of ``size`` numbers for a
    batch. Each task sums its own; the driver gets ``size`` rows."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in parts:
            if len(pdf):
                total += of(np.array(pdf["x"].tolist()), pdf["trusted"].to_numpy(bool), pdf["fold"].to_numpy(np.int64))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total[at]})

    out = np.zeros(size)
    for r in rows.mapInPandas(each, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


def evidence(counts: np.ndarray, width: int) -> np.ndarray:
    """Log of each bin's share among positives over its share among all; counts is (2, bins)."""
    bins = counts.shape[1] // width
    n = counts.sum(axis=1) / width
    return np.log((counts[1] + 1) / (n[1] + bins)) - np.log((counts[0] + 1) / (n[0] + bins))


def estimated_prior(positive: np.ndarray, every: np.ndarray) -> float:
    """The share of class 1 among all rows, from both histograms of one score.

    Above any threshold lies at least prior times the positives' share, and little else where
    the threshold is high. Of the thresholds that leave LEAST of the positives or more above
    them (so that few positives give a settled ratio too) the one with the least upper
    confidence limit (one-sided, 95 %) of (share of all) / (share of positives) is chosen, and
    that limit is the estimate: the least of many ratios leans down, and a prior that is too
    low rejects good documents.
    """
    n, m = positive.sum(), every.sum()
    p, u = np.cumsum(positive[::-1])[::-1] / n, np.cumsum(every[::-1])[::-1] / m
    p, u = p[p >= LEAST], u[p >= LEAST]
    ratio = u / p
    error = ratio * np.sqrt(np.maximum(1 - p, 1 / n) / (p * n) + np.maximum(1 - u, 1 / m) / (np.maximum(u, 1 / m) * m))
    return float(np.clip((ratio + ERRORS * error).min(), 0.01, 0.99))


def newton_step(w: np.ndarray, unclamped: tuple, clamped: tuple, penalty: np.ndarray) -> np.ndarray:
    """The step to the least of the larger of two quadratic models (value, gradient, Hessian),
    plus the penalty. It is the least of one of them where that is the larger there, else of
    the mixture at whose least both are equal, found by bisection of its share."""

    def step(share: float) -> tuple[np.ndarray, float]:
        _, g, h = ((1 - share) * a + share * b for a, b in zip(unclamped, clamped, strict=True))
        d = -np.linalg.solve(h + np.diag(penalty), g + penalty * w)
        first, second = (v + g @ d + d @ h @ d / 2 for v, g, h in (unclamped, clamped))
        return d, first - second

    low, high = 0.0, 1.0
    d, gap = step(low)
    if gap >= 0:
        return d
    d, gap = step(high)
    if gap <= 0:
        return d
    for _ in range(40):
        d, gap = step(middle := (low + high) / 2)
        low, high = (middle, high) if gap < 0 else (low, middle)
    return d


def minimise(risk, size: int, prior: float, mean: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the last is the intercept) of least non-negative risk, by damped Newton steps.

    ``risk(w)`` has the mean of log(1 + e^g), its gradient and Hessian over all rows, and the
    same three over the positives; ``mean`` is the positives' mean row. For the logistic loss
    E_P[l(g)] - E_P[l(-g)] is linear, so the risk is the larger of two smooth convex functions:
    the unbiased risk, and where its term E_U[l(-g)] - prior * E_P[l(-g)] is negative and
    counts as zero, prior * E_P[l(g)] alone. A step minimises the larger of their quadratic
    models, which leads along the border where the least lies on it; it is shortened until the
    clamped risk falls. (Where ``risk`` lacks the last two, the first function's step is taken.)
    """
    w = np.zeros(size)
    w[-1] = math.log(prior / (1 - prior))
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6

    def models(w: np.ndarray) -> tuple[tuple, tuple]:
        n, g, h, n_p, *rest = risk(w)
        free = n - prior * (mean @ w), g - prior * mean, h
        g_p, h_p = rest or (None, None)
        return free, (prior * (n_p - mean @ w), *((prior * (g_p - mean), prior * h_p) if rest else free[1:]))

    def value(w: np.ndarray, both: tuple) -> float:
        return max(both[0][0], both[1][0]) + penalty @ (w * w) / 2

    both = models(w)
    for _ in range(rounds):
        d = newton_step(w, *both, penalty)
        d *= min(1.0, 5 / max(np.abs(d).max(), 1e-12))
        before, length = value(w, both), 1.0
        while value(w + length * d, after := models(w + length * d)) > before - 1e-6 * length:
            length /= 3
            if length < 1e-3:
                return w
        w, both = w + length * d, after
        if before - value(w, both) < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> dict:
    rows = _training(docs, labels, keep)
    sizes = {r.trusted: r.n for r in rows.groupBy("trusted").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True):
        return {"constant": 0.5}
    width = len(statistics(""))
    edges = np.array(rows.agg(*(F.percentile_approx(F.col("x")[j], list(QUANTILES), 1000).alias(f"q{j}") for j in range(width))).first()).T
    bins = width * (len(edges) + 1)

    def counted(x, trusted, fold):
        c = codes(x, edges)
        return np.concatenate([np.bincount(c[on].ravel(), minlength=bins) for f in (0, 1) for on in (fold == f, trusted & (fold == f))])

    counts = _summed(rows, counted, 4 * bins).reshape(2, 2, bins)
    crossed = [evidence(counts[1], width), evidence(counts[0], width)]  # a fold is scored by the other's counts

    size, n, n_p = width + 2, sum(sizes.values()), sizes[True]
    halves = counts.reshape(2, 2, width, -1)

    def parts_of(x, fold) -> np.ndarray:
        c = codes(x, edges)
        return np.where((fold == 0)[:, None], crossed[0][c], crossed[1][c])

    def spread(x, trusted, fold):
        z = parts_of(x, fold).sum(1)
        at = np.clip(((z + SPAN) * (GRID / 2 / SPAN)).astype(np.int64), 0, GRID - 1)
        return np.concatenate([np.bincount(at, minlength=GRID), np.bincount(at[trusted], minlength=GRID)])

    every, positive = _summed(rows, spread, 2 * GRID).reshape(2, GRID)
    prior = estimated_prior(positive, every)
    own = np.stack(crossed).reshape(2, width, -1)
    centre, centre_p = ((halves[:, k] * own).sum((0, 2)) / m for k, m in ((0, n), (1, n_p)))
    scale = np.sqrt((halves[:, 0] * (own - centre[:, None]) ** 2).sum((0, 2)) / n) + 1e-9
    grid = (np.arange(GRID) + 0.5) * 2 * SPAN / GRID - SPAN
    middle = (every * grid).sum() / every.sum()
    wide = math.sqrt((every * (grid - middle) ** 2).sum() / every.sum()) + 1e-9

    def features(parts: np.ndarray) -> np.ndarray:
        return np.c_[(parts.sum(1) - centre.sum()) / wide, (parts - centre) / scale * SMALLER, np.ones(len(parts))]

    def risk(w: np.ndarray) -> tuple:
        def summed(x, trusted, fold):
            f = features(parts_of(x, fold))
            g = f @ w
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            loss, curve = np.logaddexp(0, g), f * (s * (1 - s))[:, None]
            return np.concatenate([np.concatenate([[loss[on].sum()], s[on] @ f[on], (curve[on].T @ f[on]).ravel()]) for on in (slice(None), trusted)])

        got = _summed(rows, summed, 2 * (1 + size + size * size)).reshape(2, -1) / np.array([[n], [n_p]])
        return tuple(x for v in got for x in (v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)))

    w = minimise(risk, size, prior, features(centre_p[None, :])[0])
    discard(rows)
    log = evidence(counts.sum(axis=0), width)
    # The features are linear in the bins' evidence, so the model is one table of bin weights.
    weight = (w[0] / wide + w[1:-1] * SMALLER / scale).repeat(len(edges) + 1) * log
    return {"edges": edges, "w": weight, "b": float(w[-1] - w[0] * centre.sum() / wide - (w[1:-1] * centre * SMALLER / scale).sum()), "prior": prior}


def chance(text: Column, model: dict) -> Column:
    """The probability of class 1 of a text."""
    if "constant" in model:
        return F.lit(float(model["constant"]))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        x = np.array([statistics(t or "") for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(model["w"][codes(x, model["edges"])].sum(1) + model["b"], -30, 30))))

    return scored(text)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every document, in one pass without a shuffle."""
    return documents(docs).select("doc_id", chance(F.col("text"), model).alias("score"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return score(docs, model).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
