"""Packing of token sequences by cutting-stock column generation.

Documents are encoded by the tokenizers library, with an end id. Whole sequences of a long
document stand by themselves; what is left over, its tail of 1 to CAPACITY - 1 ids, is an item.
Sequences are padded to CAPACITY, except at a length that is a power of two.

Plan: the histogram of tail lengths (CAPACITY numbers, whatever the corpus) goes to the driver.
A pattern is a multiset of lengths of CAPACITY ids at most, its cost the padded length. A
greedy plan, which uses up one length with every pattern, is a triangular basis of the linear
program: least cost of patterns that take every item. Columns are priced by the knapsack's
dynamic program over the duals, whose best fillings enter by revised simplex pivots, until no
filling lowers the cost, padding is below ENOUGH of all ids, or PIVOTS have been done (the plan
is feasible throughout). Multiples of patterns are rounded, what remains is packed greedily,
and patterns that would pad more than SLACK are given up: their items and all others without a
place form one stream that is cut at every CAPACITY ids, its end into powers of two.

Assignment: the items of a length are ranked (by task and place in it; the tasks' counts are
summed by a window for each length), and a rank names its sequence and offset by arithmetic on
the plan, which is a few thousand numbers and travels to the tasks. So no length's documents
meet in one task, however many they are, and nothing of the size of the corpus reaches the
driver. Ids are encoded once; tails lie in the shared folder with the checksums.

Null and empty texts are the end id alone. Very long texts are encoded whole. Rows with equal
or null doc_ids are packed each; ties of length go by rank. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrella.llm.bpe import byte_symbols
from sentrella.llm.common import documents, saved, table

CAPACITY, END = 2048, 1
#: Bounds of the linear program: pivots, columns priced at once, share of padding that is enough.
PIVOTS, COLUMNS, ENOUGH = 400, 24, 1e-4
#: Largest share of padding in a pattern.
SLACK = 0.02
CACHE, CHARS = 400_000, 1_000_000
MARKS = ".,!?;:"
ENCODED = "doc_id long, n long, fulls array<long>, tail binary, tail_crc long, size int, part int, place long, full_place long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# ---------------------------------------------------------------- encoding


class Encoder(dict):
    """Ids (16-bit, little-endian) of texts. Nothing of the tokenizer reaches over a space, so a
    text is its chunks between spaces; those met before come from a bounded table. A new word of
    letters goes to the library's model alone, any other chunk through the whole library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])], [x.get("type") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path}: white space may matter to this tokenizer")
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        word = chunk.rstrip(MARKS)
        if len(word) < len(chunk) and word and word.isalpha():  # a word and its marks
            ids = self[word] + self[chunk[len(word) :]]
        elif word and len(word) == len(chunk) and chunk.isalpha() and max(chunk) < "\u0100":
            # Letters up to U+00FF are composed, and lower-case alike everywhere.
            low = chunk.lower()
            ids = self[low] if low != chunk else array(self.code, [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.symbols))]).tobytes()
        else:
            ids = array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each document: checksums of its whole sequences, its tail, and the tail's
    rank among those of its length in this task. Written to the shared folder."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, ranks, fulls_before = encoder(tokenizer), TaskContext.get().partitionId(), [0] * capacity, 0
        stop = array(e.code, [end]).tobytes()
        names = [x.split()[0] for x in ENCODED.replace("array<long>", "list").split(", ")]
        kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])))
        rows, held = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids = np.frombuffer(e.encode(text) + stop, f"<u{e.width}")
                whole = len(ids) // capacity
                fulls = [checksum(ids[k * capacity : (k + 1) * capacity]) for k in range(whole)]
                tail = ids[whole * capacity :]
                rows.append((key.as_py(), len(ids), fulls, tail.tobytes(), checksum(tail), len(tail), part, ranks[len(tail)], fulls_before))
                ranks[len(tail)] += 1
                fulls_before += whole
                held += len(text)
                if held >= CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    return saved(documents(docs).mapInArrow(each, ENCODED), "packing-encoded")


# ---------------------------------------------------------------- plan


def cost(size: int, capacity: int = CAPACITY) -> int:
    """The padded length of a sequence."""
    return size if size & (size - 1) == 0 else capacity


Pattern = dict  # length -> how many


def filled(pattern: Pattern) -> int:
    return sum(k * n for k, n in pattern.items())


def greedy(counts: np.ndarray, capacity: int = CAPACITY, whole: bool = True) -> list[tuple[Pattern, float]]:
    """Patterns of the largest items that fit, each as often as its items last: whole times, or
    (for the linear program) in fractions, so that each pattern uses up a length."""
    left, out = counts.astype(np.int64 if whole else float), []
    while left.any():
        present = np.flatnonzero(left)
        pattern: Pattern = {}
        room, top = capacity, len(present)
        while room and top:
            top = int(np.searchsorted(present[:top], room, side="right"))
            if not top:
                break
            size = int(present[top - 1])
            pattern[size] = min(max(1, int(left[size])), room // size)
            room -= pattern[size] * size
            top -= 1
        last = min(pattern, key=lambda s: left[s] / pattern[s])
        copies = int(left[last]) // pattern[last] if whole else left[last] / pattern[last]
        for s, n in pattern.items():
            left[s] -= n * copies
        if not whole:
            left[last] = 0
            left[left < 1e-9] = 0
        out.append((pattern, copies))
    return out


def fillings(sizes: np.ndarray, value: np.ndarray, capacity: int, most: int) -> list[Pattern]:
    """The knapsack: of each filled length the multiset of the largest total value; those whose
    value exceeds their cost by the most."""
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
    best[0] = 0.0
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        k = fit[room]
        total = best[room - sizes[:k]] + value[:k]
        at = int(total.argmax())
        best[room], last[room] = total[at], sizes[at]
    gain = best - np.array([cost(s, capacity) for s in range(capacity + 1)])
    gain[0] = -np.inf
    out = []
    for room in np.argsort(-gain)[:most]:
        if gain[room] < 1e-6 * capacity:
            break
        pattern: Pattern = {}
        left = int(room)
        while left:
            pattern[int(last[left])] = pattern.get(int(last[left]), 0) + 1
            left -= int(last[left])
        out.append(pattern)
    return out


def linear_program(counts: np.ndarray, capacity: int = CAPACITY, pivots: int = PIVOTS) -> list[tuple[Pattern, float]]:
    """Patterns and their multiples that take every item at the least padded length."""
    sizes = np.flatnonzero(counts)
    place = {int(s): i for i, s in enumerate(sizes)}
    tokens = int((counts * np.arange(len(counts))).sum())
    chosen, left = [], counts.astype(float)
    for pattern, copies in greedy(counts, capacity, whole=False):
        chosen.append((pattern, copies))
        for s, n in pattern.items():
            left[s] -= n * copies
        # A pattern that uses up several lengths leaves room for columns of one item, at zero.
        gone = [s for s in pattern if left[s] < 1e-9 and left[s] > -np.inf]
        left[gone] = -np.inf
        chosen += [({s: 1}, 0.0) for s in gone[1:]]

    def column(pattern: Pattern) -> np.ndarray:
        a = np.zeros(len(sizes))
        for s, n in pattern.items():
            a[place[s]] = n
        return a

    basis, x = [p for p, _ in chosen], np.array([c for _, c in chosen])
    price = np.array([cost(filled(p), capacity) for p in basis], dtype=float)
    inverse = np.linalg.inv(np.stack([column(p) for p in basis], axis=1))
    left_pivots = pivots
    while left_pivots > 0 and price @ x > tokens * (1 + ENOUGH):
        entered = False
        for pattern in fillings(sizes, price @ inverse, capacity, COLUMNS):
            a, c = column(pattern), cost(filled(pattern), capacity)
            on = np.flatnonzero(a)
            d = inverse[:, on] @ a[on]
            if c - price @ d > -1e-6 * capacity or left_pivots == 0:
                continue
            up = np.flatnonzero(d > 1e-9)
            if not len(up):
                continue
            out = up[np.argmin(x[up] / d[up])]
            step = x[out] / d[out]
            x -= step * d
            x[out] = step
            np.maximum(x, 0, out=x)
            inverse[out] /= d[out]
            d[out] = 0
            rows = np.flatnonzero(np.abs(d) > 1e-12)
            inverse[rows] -= np.outer(d[rows], inverse[out])
            basis[out], price[out] = pattern, c
            left_pivots, entered = left_pivots - 1, True
        if not entered:
            break
    return list(zip(basis, x.tolist()))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Patterns with whole multiples, and the items of each length that are left to the stream."""
    left, out = counts.copy(), []
    if not left.any():
        return out, left

    def take(pattern: Pattern, copies: int) -> None:
        size = filled(pattern)
        copies = min([copies, *(int(left[s]) // n for s, n in pattern.items())])
        if copies > 0 and cost(size, capacity) - size <= SLACK * capacity:
            out.append((pattern, copies))
            for s, n in pattern.items():
                left[s] -= n * copies

    for pattern, times in sorted(linear_program(counts, capacity), key=lambda p: -p[1]):
        take(pattern, int(times + 0.5))
    for pattern, times in greedy(left, capacity):
        take(pattern, times)
    return out, left


class Places:
    """Where the item of a length and rank goes: the plan as arithmetic."""

    def __init__(self, counts: np.ndarray, first_sequence: int, capacity: int = CAPACITY):
        patterns, rest = plan(counts, capacity)
        self.capacity, now = capacity, first_sequence
        taken = np.zeros(len(counts), dtype=np.int64)
        segments: dict[int, list[tuple[int, int, int, int]]] = {}
        for pattern, copies in patterns:
            offset = 0
            for size, n in pattern.items():
                segments.setdefault(size, []).append((int(taken[size]), n, now, offset))
                taken[size] += n * copies
                offset += n * size
            now += copies
        self.segments = {s: (np.array([x[0] for x in xs]), xs) for s, xs in segments.items()}
        self.taken, self.stream = taken.tolist(), now
        self.base = (np.cumsum(rest * np.arange(len(rest))) - rest * np.arange(len(rest))).tolist()
        total = int((rest * np.arange(len(rest))).sum())
        # The stream's last, partial sequence is cut into powers of two.
        self.whole, left = total // capacity, total % capacity
        self.ends, at = [], self.whole * capacity
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                at += 1 << bit
                self.ends.append(at)
        self.sequences, self.padding = now + self.whole + len(self.ends), sum((cost(filled(p), capacity) - filled(p)) * c for p, c in patterns)

    def of(self, size: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the item, length, sequence, offset) of each of its pieces."""
        if rank < self.taken[size]:
            starts, segments = self.segments[size]
            start, n, sequence, offset = segments[int(np.searchsorted(starts, rank, side="right")) - 1]
            return [(0, size, sequence + (rank - start) // n, offset + (rank - start) % n * size)]
        at, out = self.base[size] + (rank - self.taken[size]) * size, []
        end = at + size
        begin = at
        while at < end:
            k = at // self.capacity
            if k < self.whole:
                first, stop, sequence = k * self.capacity, (k + 1) * self.capacity, self.stream + k
            else:
                i = next(i for i, e in enumerate(self.ends) if at < e)
                first, stop, sequence = ([self.whole * self.capacity, *self.ends][i]), self.ends[i], self.stream + self.whole + i
            length = min(end, stop) - at
            out.append((at - begin, length, sequence, at - first))
            at += length
        return out


# ---------------------------------------------------------------- packing


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows = encoded(docs, tokenizer, capacity, end)
    width = encoder(tokenizer).width
    by = rows.groupBy("part", "size").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity, dtype=np.int64)
    for r in by.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r["size"]] = r.n
    # One number for each task that encoded.
    fulls = {r.part: r.n or 0 for r in rows.groupBy("part").agg(F.sum(F.size("fulls")).alias("n")).orderBy("part").collect()}
    before, total = {}, 0
    for part in sorted(fulls):
        before[part], total = total, total + fulls[part]
    places = Places(counts, total, capacity)
    ranks = by.select("part", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("base"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc, n, crcs, tail, tail_crc, size, part, place, full_place, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "fulls", "tail", "tail_crc", "size", "part", "place", "full_place", "base")), strict=True):
                first = before[part] + full_place
                out += [(doc, k * capacity, capacity, crc, n, first + k, 0) for k, crc in enumerate(crcs)]
                if size:
                    pieces = places.of(size, base + place)
                    for start, length, sequence, offset in pieces:
                        crc = tail_crc if length == size else checksum(np.frombuffer(tail, f"<u{width}")[start : start + length])
                        out.append((doc, len(crcs) * capacity + start, length, crc, n, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names=names)

    return rows.join(ranks, ["part", "size"]).mapInArrow(each, PIECES)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
