"""Scoring with log-bilinear language models trained by noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end for each document. Every token belongs to a
class: the K - 1 most frequent training words and the end are classes of their own, all
other words fall in S classes by their last two bytes, which tell languages and endings
apart. K grows with the cube root of the training tokens and S with K, so the pair tables
below grow with the input, and so do the training steps.

All training documents are counted: every word's count, and how often a class follows
another at distance one and two; both tables stay distributed. Every pair of the table trains
the model with its whole count: a frequent one is spread over many steps, a rare one has one
turn of a weight below one (see ``drawn``). Spark deals the turns to chunks of CHUNK_STEPS
steps and writes them; the driver reads one chunk at a time, so it never holds the pairs, only
the classes' vectors. On the turns numpy trains, at each of the two distances i, a model

    s_i(target | context) = (C_i r_context) . q_target + b_target

with shared r, q and b: minibatches against noise from the unigram distribution, Adam. Batched products of all contexts with all targets give each context's
normaliser. The two models are mixed; every document is scored with each of WEIGHTS, and the
one that suits all training documents best is taken. A word of a shared class gets its class's probability times the share of its count
plus a half in the class, which holds one unknown word. So the whole distribution sums to
one over the training vocabulary and one unknown word for each shared class.

HEAD frequent words travel to the tasks with their counts (a bounded list); counts of other
words are joined, after each document's repetitions are collapsed.

Null and empty texts consist of the end alone. Without training documents N and V are zero
and both scores are the base (log10 of 0.5 / 0.5, zero). Very long texts are read whole, one
at a time; equal texts have equal scores. Rows repeat as they come, with any
doc_id; a null doc_id is trained on. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import discard, documents, remainder, saved, sliced, table

HEAD = 65_536
DIM, BATCH, NOISE, RATE = 32, 4096, 256, 0.02
WEIGHTS = tuple(k / 10 for k in range(1, 11))
FLUSH, PAIRS = 200_000, 2_000_000
#: Classes for each cube root of the training tokens; steps whose turns the driver holds at once.
FACTOR, CHUNK_STEPS = 2.5, 64


def shape(tokens: int) -> tuple[int, int]:
    """K and S for a number of training tokens."""
    k = 1 << max(6, round(math.log2(FACTOR * max(tokens, 1) ** (1 / 3))))
    return k, k // 4


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:])


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for pdf in parts:
        for t in pdf["text"]:
            counts.update(words_of(t))
            if len(counts) >= FLUSH:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
    if counts:
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


class Words:
    """The head words and the class of every token: 0 to K - 2 the listed words, K - 1 the end,
    K to K + S - 1 the shared classes."""

    def __init__(self, top: list[tuple[bytes, int]], k: int, s: int):
        self.k, self.s = k, s
        self.head = {w: i for i, (w, _) in enumerate(top)}
        self.counts = np.array([n for _, n in top], dtype=np.float64)
        own = [i if i < k - 1 else k + suffix(w) % s for i, (w, _) in enumerate(top)]
        self.classes = np.array([*own, 0, k - 1], dtype=np.int64)  # by index; -1 is the end, -2 is set below

    def read(self, texts: pd.Series) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of a batch: the words by document, head indices (-2: not in it, -1: the
        end), classes, and where documents end."""
        split = [words_of(t) for t in texts]
        get = self.head.get
        index, ends = [], []
        for ws in split:
            index += [get(w, -2) for w in ws]
            index.append(-1)
            ends.append(len(index))
        ix = np.array(index, dtype=np.int64)
        own = self.classes[ix]
        far = np.flatnonzero(ix == -2)
        if len(far):
            flat = [w for ws in split for w in (*ws, b"")]
            crc, k, s = zlib.crc32, self.k, self.s
            own[far] = [k + crc(flat[i][-2:]) % s for i in far.tolist()]
        return split, ix, own, np.array(ends, dtype=np.int64)

    def before(self, own: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two tokens before each token; ends stand before a document."""
        one = np.r_[self.k - 1, own[:-1]]
        two = np.r_[self.k - 1, one[:-1]]
        starts = np.r_[0, ends[:-1]]
        two[starts] = self.k - 1
        return one, two


class PairSums:
    """Counts of pairs, kept sorted; what outgrows PAIRS is handed out."""

    def __init__(self):
        self.codes, self.n, self.held, self.new = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.held.append(codes)
        self.new += len(codes)
        if self.new >= PAIRS:
            self.merge()

    def merge(self) -> None:
        codes, n = np.unique(np.concatenate(self.held or [np.zeros(0, np.int64)]), return_counts=True)
        both, at = np.unique(np.r_[self.codes, codes], return_inverse=True)
        self.n = np.bincount(at, weights=np.r_[self.n, n], minlength=len(both)).astype(np.int64)
        self.codes, self.held, self.new = both, [], 0

    def take(self) -> pd.DataFrame:
        self.merge()
        out = pd.DataFrame({"pair": self.codes, "n": self.n})
        self.codes, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


def steps_of(k: int) -> int:
    return 300 + k


def drawn(pairs: DataFrame, total: int, k: int) -> tuple[DataFrame, int]:
    """(chunk, pair, times, weight): the turns of all pairs, and the number of chunks. A pair of n
    of ``total`` counts is due steps * BATCH * n / total turns; it gets that number rounded up,
    each of a weight that makes up for the rounding. So no pair is left out and each weighs as
    much as its count says."""
    due = steps_of(k) * BATCH / total
    chunks = math.ceil((steps_of(k) * BATCH + pairs.count()) / (CHUNK_STEPS * BATCH))
    expected = F.col("n") * due
    each = pairs.select("pair", (expected / F.ceil(expected)).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(expected))).alias("i"))
    dealt = each.select("pair", "weight", F.pmod(F.xxhash64("i", "pair", F.lit(7)), F.lit(chunks)).alias("chunk"))
    return dealt.groupBy("chunk", "pair").agg(F.count("*").alias("times"), F.any_value("weight").alias("weight")), chunks


def train(chunks: Iterator[tuple[np.ndarray, ...]], unigram: np.ndarray, k: int, s: int, steps: int | None = None, seed: int = 5) -> dict:
    """The model from chunks of turns (pairs, how often each and, unless one, the weight of a
    turn): a pair is (distance - 1) * C^2 + context * C + target for C = K + S. ``unigram``
    counts the targets; the rate falls over ``steps``."""
    rng = np.random.default_rng(seed)
    size, steps = k + s, steps or steps_of(k)
    unigram = unigram + 0.5
    unigram /= unigram.sum()
    noise_cum = np.cumsum(unigram)
    log_noise = np.log(unigram * NOISE)
    p = {"r": rng.normal(0, 0.1, (size, DIM)), "c": np.stack([np.eye(DIM)] * 2), "q": rng.normal(0, 0.1, (size, DIM)), "b": np.log(unigram)}
    m, v = ({x: np.zeros_like(y) for x, y in p.items()} for _ in range(2))

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pairs, times, *weight in chunks:
            order = rng.permutation(np.repeat(np.arange(len(pairs)), times))
            for at in range(0, len(order), BATCH):
                turn = order[at : at + BATCH]
                turn = turn[np.argsort(pairs[turn], kind="stable")]
                yield pairs[turn], weight[0][turn] if weight else np.ones(len(turn))

    for step, (batch, w) in enumerate(batches(), 1):
        fi, rest = batch // (size * size), batch % (size * size)
        ci, ti = rest // size, rest % size
        cut, n = int(np.searchsorted(fi, 1)), len(batch)
        ni = np.minimum(np.searchsorted(noise_cum, rng.random(NOISE)), size - 1)
        r = p["r"][ci]
        h = np.concatenate([r[:cut] @ p["c"][0], r[cut:] @ p["c"][1]])
        # The noise samples are shared by the batch: one product scores them all.
        up = 1 / (1 + np.exp(-np.clip((h * p["q"][ti]).sum(1) + p["b"][ti] - log_noise[ti], -30, 30))) - 1
        un = 1 / (1 + np.exp(-np.clip(h @ p["q"][ni].T + p["b"][ni] - log_noise[ni], -30, 30)))
        up, un = up * w / n, un * (w / n)[:, None]
        gh = up[:, None] * p["q"][ti] + un @ p["q"][ni]
        g = {"r": np.zeros_like(p["r"]), "c": np.stack([r[:cut].T @ gh[:cut], r[cut:].T @ gh[cut:]]), "q": np.zeros_like(p["q"]), "b": np.zeros_like(p["b"])}
        np.add.at(g["r"], ci, np.concatenate([gh[:cut] @ p["c"][0].T, gh[cut:] @ p["c"][1].T]))
        np.add.at(g["q"], ti, up[:, None] * h)
        np.add.at(g["q"], ni, un.T @ h)
        np.add.at(g["b"], ti, up)
        np.add.at(g["b"], ni, un.sum(0))
        rate = RATE * min(1.0, 2 * (1 - min(step, steps) / (steps + 1)))
        for x in p:
            m[x] = 0.9 * m[x] + 0.1 * g[x]
            v[x] = 0.99 * v[x] + 0.01 * g[x] ** 2
            p[x] = p[x] - rate * (m[x] / (1 - 0.9**step)) / (np.sqrt(v[x] / (1 - 0.99**step)) + 1e-9)
    hidden = np.stack([p["r"] @ p["c"][0], p["r"] @ p["c"][1]])
    return {"h": hidden.astype(np.float32), "q": p["q"].astype(np.float32), "b": p["b"], "z": np.stack([normalisers(h, p["q"], p["b"]) for h in hidden])}


def normalisers(h: np.ndarray, q: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """log of the summed exponentials of all targets, for each context."""
    out = []
    for at in range(0, len(h), block):
        s = h[at : at + block] @ q.T + b
        top = s.max(1, keepdims=True)
        out.append((top + np.log(np.exp(s - top).sum(1, keepdims=True))).ravel())
    return np.concatenate(out)


def chances(model: dict, i: int, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """P_i(target class | context class) for many pairs."""
    dots = np.einsum("nd,nd->n", model["h"][i][context], model["q"][target])
    return np.exp(dots + model["b"][target] - model["z"][i][context])


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; rows for which
    ``training`` (an expression over doc_id) holds are learnt from."""
    spark = docs.sparkSession
    rows = documents(docs)
    learn = rows.where(training)
    vocabulary = saved(learn.select("text").mapInPandas(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-vocabulary")
    n_docs = learn.count()
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, size = (sums.n or 0) + n_docs, sums.v + (n_docs > 0)
    k, s = shape(total)
    top = [(bytes(r.word), r.n) for r in vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    words = Words(top, k, s)
    short = spark.sparkContext.broadcast(words)

    # Of each shared class: the counts of its words and how many they are. S rows.
    held = np.zeros((2, s))
    for r in vocabulary.groupBy(F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(s)).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        held[:, r.s] = r.n, r.v
    for w, n in top[: k - 1]:
        held[:, suffix(w) % s] -= n, 1
    share = np.log10(held[0] + 0.5 * (held[1] + 1))

    def pair_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, sums = short.value, PairSums()
        c = w.k + w.s
        for pdf in (x for p in parts for x in sliced(p)):
            _, _, own, ends = w.read(pdf["text"])
            one, two = w.before(own, ends)
            sums.add(one * c + own)
            sums.add(c * c + two * c + own)
            if len(sums.codes) >= PAIRS:
                yield sums.take()
        yield sums.take()

    pairs = saved(learn.select("text").mapInPandas(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "lm-pairs")
    unigram = np.zeros(k + s)
    for r in pairs.groupBy((F.col("pair") % (k + s)).alias("target")).agg(F.sum("n").alias("n")).collect():  # K + S rows
        unigram[r.target] = r.n
    model = None
    if unigram.any():
        samples, count = drawn(pairs, int(unigram.sum()), k)
        dealt = saved(samples.repartition("chunk").sortWithinPartitions("chunk", "pair"), "lm-samples")

        def read() -> Iterator[tuple[np.ndarray, ...]]:
            for i in range(count):
                got = dealt.where(F.col("chunk") == i).select("pair", "times", "weight").toArrow().sort_by("pair")
                yield got["pair"].to_numpy(), got["times"].to_numpy(), got["weight"].to_numpy()

        model = train(read(), unigram, k, s, count * CHUNK_STEPS)
        discard(dealt)
    discard(pairs)
    learned = spark.sparkContext.broadcast(model)

    base = math.log10(total + 0.5 * (size + 1))

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m = short.value, learned.value
        own_log = np.append(np.log10(w.counts + 0.5), [0.0, math.log10(n_docs + 0.5)])  # -2: not in the head, -1: the end
        known = np.append(np.ones(len(w.counts), dtype=np.int64), [0, int(n_docs > 0)])
        for pdf in (x for p in parts for x in sliced(p)):
            split, ix, own, ends = w.read(pdf["text"])
            if not len(ends):
                continue
            begins = np.r_[0, ends[:-1]]
            count_log = own_log[ix]
            b = np.add.reduceat(count_log - base, begins)
            if m is None:
                s_ = np.repeat(b[:, None], len(WEIGHTS), axis=1)
            else:
                one, two = (chances(m, i, c, own) for i, c in enumerate(w.before(own, ends)))
                shared = own >= w.k
                within = np.where(shared, count_log - share[np.where(shared, own - w.k, 0)], 0.0)
                s_ = np.stack([np.add.reduceat(np.log10(x * one + (1 - x) * two) + within, begins) for x in WEIGHTS], axis=1)
            far = [Counter(x for x in ws if x not in w.head) for ws in split]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "n_tokens": ends - begins, "known": np.add.reduceat(known[ix], begins), "base": b, "scores": list(s_), "words": [list(f) for f in far], "times": [list(f.values()) for f in far]})

    part = rows.mapInPandas(scored, "doc_id long, n_tokens long, known long, base double, scores array<double>, words array<binary>, times array<long>")
    part = saved(part.withColumn("row", F.monotonically_increasing_id()), "lm-part")
    sums = part.where(training).agg(*[F.sum(F.get("scores", F.lit(i))).alias(str(i)) for i in range(len(WEIGHTS))]).first()
    best = max(range(len(WEIGHTS)), key=lambda i: (sums[i] or 0.0, i))
    far = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times").withColumnRenamed("words", "word")
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    more = far.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more_or = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.drop("words", "times").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more_or("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more_or("more")).alias("base_score"), (F.get("scores", F.lit(best)) + more_or("more")).alias("score")
    )


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return score(table(spark, sf_dir, "documents"), ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
