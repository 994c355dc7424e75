"""BPE encoding and decoding in batched numpy merge rounds.

Texts are read as the tokenizer file says: special tokens are cut out first, the rest is
brought to NFC, white space runs become one space, letters are lower-cased one by one, and
words are the pattern's matches. New words of a batch go to one flat array of symbols. In
each round every word's lowest-rank pair is found by binary search over the sorted pair
keys, all its non-overlapping occurrences merge from the left, and words without a pair
leave the array. A very long word has rounds of its own that touch only the places of their
pair. Words already seen come from a bounded table of the Python worker.

Only the settings of the word-level BPE file are implemented (end-of-word suffix, NFC,
lower-casing, byte symbols, no decoder); another file is refused. Null and empty texts have
no tokens. Rows repeat as they come, with any doc_id; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import documents, table

CACHE = 400_000
#: Bytes from which a word is merged by itself.
LONG = 512
NONE = np.int64(1 << 40)

_loaded: dict[str, Encoder] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["unk_token"] or model["ignore_merges"]:
            raise ValueError(f"{path}: not the kind of tokenizer file that this encoder implements")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.known: dict[str, tuple[str, str, int]] = {"": ("", "", 0)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE where they don't merge."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the same rounds over a linked list of symbols, where a round
        looks at the places of its pair only, so a round costs what it merges."""
        raw = np.frombuffer(word, dtype=np.uint8)
        sym, n = self.inner[raw], len(raw)
        sym[-1] = self.last[raw[-1]]
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            r = self.ranks(sym[at], sym[after[at]])
            at, r = at[r < NONE], r[r < NONE]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else []
            for k, part in zip(r[cuts].tolist() if len(r) else [], np.split(at, cuts[1:]) if len(r) else [], strict=True):
                if k not in places:
                    places[k] = []
                    heapq.heappush(heap, k)
                places[k].append(part)

        note(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            at = at[self.ranks(sym[at], sym[after[at]]) == r]
            # Pairs of a run of equal symbols overlap: take every other one, from the left.
            first = np.r_[True, at[1:] != after[at[:-1]]][: len(at)]
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            sym[at], alive[gone], after[at] = self.merged[r], False, after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            both = np.unique(np.r_[before[at][before[at] >= 0], inner])
            note(both[alive[both] & (after[both] < n)])
        return sym[alive]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty word."""
        if any(len(w) > LONG for w in words):
            short = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [self.merge_long(w) if len(w) > LONG else next(short) for w in words]
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        out: list[np.ndarray | None] = [None] * len(words)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(sym), NONE)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pair = sym[inside] << 20 | sym[inside + 1]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            hit = self.key[at] == pair
            rank[inside[hit]] = self.rank[at[hit]]
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            for i in np.flatnonzero(low == NONE):
                out[owner[starts[i]]] = sym[starts[i] : starts[i] + lengths[i]]
            lows = np.repeat(low, lengths)
            chosen = np.flatnonzero((rank == lows) & (lows < NONE))
            # Pairs of a run of equal symbols overlap: take every other one, from the left.
            first = np.r_[True, chosen[1:] != chosen[:-1] + 1][: len(chosen)]
            run = np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            sym[chosen] = self.merged[rank[chosen]]
            keep = np.repeat(low < NONE, lengths)
            keep[chosen + 1] = False
            sym, owner = sym[keep], owner[keep]
        return out

    def pieces(self, text: str) -> list[str | int]:
        """Chunks between spaces of a normalised text; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                t = part if part.isascii() else unicodedata.normalize("NFC", part)
                t = self.space.sub(" ", t)
                out += (t.lower() if "Σ" not in t else "".join(map(str.lower, t))).split(" ")
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks, all their words together."""
        chunks = sorted(chunks)
        found = [self.words.findall(c) for c in chunks]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in found for w in ws))}
        ids = self.merge([w.encode("utf-8", "surrogatepass") for w in distinct]) if distinct else []
        lists = [i.tolist() for i in ids]
        for c, ws in zip(chunks, found, strict=True):
            own = [i for w in ws for i in lists[distinct[w]]]
            self.known[c] = " ".join(map(str, own)), " ".join(self.names[i] for i in own), len(own)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """For each text: its ids and its tokens, joined by spaces, and their number."""
        cut = [self.pieces(t) for t in texts]
        new = {c for p in cut for c in p if isinstance(c, str)} - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known = {"": ("", "", 0)}
            new = {c for p in cut for c in p if isinstance(c, str) and c}
        if new:
            self.learn(new)
        for p in cut:
            got = [self.known[c] if isinstance(c, str) else (str(c), self.names[c], 1) for c in p]
            got = [g for g in got if g[2]]
            yield " ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list[str]]:
    """A batch in parts of bounded size (a longer text is a part of its own)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_decode(docs: DataFrame, path: str, ids: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Given columns (doc_id by default), n_tokens, ids_sha256, decoded_sha256; with ids also
    the token ids and the decoded text. One pass without a shuffle."""
    rows = documents(docs) if columns is None else docs.withColumn("text", F.coalesce("text", F.lit("")))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    @F.pandas_udf(kind)
    def coded(texts: pd.Series) -> pd.DataFrame:
        e, out = encoder(path), []
        for part in _slices(texts):
            for a, b, n in e.encode(part):
                row = (n, hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest())
                out.append(row + ([int(x) for x in a.split()], b) if ids else row)
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if ids else 3])

    return rows.select(*(columns or ["doc_id"]), coded("text").alias("coded")).select(*(columns or ["doc_id"]), "coded.*")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
