"""Token ids in binary files with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id (ties by the text's hash and the text; null ids
first) and each partition is written as records of about CHUNK ids, in Parquet files whose
columns are the fields below, so that Spark commits, retries and finds them like any table:

    part, chunk   place in the order of doc_id
    n_docs, n_tokens, n_null, first_id
    first_token   ids of this part's records before it
    ids           all ids, little-endian unsigned; 2 bytes each where the vocabulary fits, else 4
    width         bytes of an id
    ends          Elias-Fano code of each document's end within the record
    doc_ids       Elias-Fano code of doc_id - first_id of the documents after the null ones

An Elias-Fano code keeps l low bits of each value in a packed array and the rest in unary,
about 2 + log2(universe / n) bits a value; every 256th one-bit's place is stored in 32 bits,
so that ``select`` finds one offset without decoding the others. Readers take every offset and
doc_id from it (Record), whichever document they want.

Texts are encoded by the tokenizers library. A text without double spaces is encoded by its
space-separated chunks, each with its leading space, since the byte-level pattern always
starts a piece there; chunks and pieces that the Python worker has met come from bounded
tables. New chunks are cut by the library's pre-tokenizer (ASCII ones by its pattern), and
new pieces go through the library's model. Other texts go to it whole. Tests
compare both ways.

Null text: empty, a single end id. Repeated rows are each written. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrella.llm.bpe import byte_symbols
from sentrella.llm.common import documents, shared_dir, table

CHUNK = 1 << 20
CACHE, PIECES = 400_000, 600_000
SAMPLE = 256
END = 0
SCHEMA = "part int, chunk int, n_docs long, n_tokens long, n_null long, first_id long, first_token long, width int, ids binary, ends binary, doc_ids binary"


class EliasFano:
    """A non-decreasing list of unsigned values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        unary[places] = 1
        pack = lambda b: np.packbits(b, bitorder="little")
        return cls(n, low_bits, pack(bits.ravel()), pack(unary), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b = (int(x) for x in np.frombuffer(raw, "<u4", 4))
        body = np.frombuffer(raw, np.uint8, offset=16)
        return cls(n, low_bits, body[:a], body[a : a + b], np.frombuffer(body[a + b :].tobytes(), "<u4"))

    def _low(self, i: int) -> int:
        byte, inside = divmod(i * self.low_bits, 8)
        return int.from_bytes(self.low[byte : byte + 9].tobytes(), "little") >> inside & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value alone: from the nearest sampled one-bit, by counts of bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, inside = divmod(place + 1, 8)
            now = int(self.high[byte]) >> inside << inside if byte < len(self.high) else 0
            while (ones := now.bit_count()) < left:
                left -= ones
                byte += 1
                now = int(self.high[byte])
            for _ in range(left - 1):
                now &= now - 1
            place = byte * 8 + (now & -now).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


_SYMBOLS = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
#: Marks that end a word and are one piece together, and the pieces of ASCII text.
MARKS = ".,!?;:"
_ASCII = re.compile("'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\\t\\n\\x0b\\f\\r A-Za-z0-9]+|[\\t\\n\\x0b\\f\\r ]+(?![^\\t\\n\\x0b\\f\\r ])|[\\t\\n\\x0b\\f\\r ]+")


def byte_level(piece: str) -> str:
    """A piece as the printable characters that stand for its bytes."""
    if piece.isascii():
        return ("Ġ" + piece[1:]) if piece[0] == " " and piece[1:].isalnum() else piece.translate(_SYMBOLS)
    return piece.encode("utf-8").decode("latin-1").translate(_SYMBOLS)


class Pieces(dict):
    """Ids of pieces met before; a new one is encoded by the library's model."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.tokenize, self.code = encoder.model.tokenize, encoder.code

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        ids = self[piece] = array(self.code, [t.id for t in self.tokenize(byte_level(piece))]).tobytes()
        return ids


class Known(dict):
    """Ids of chunks met before; a new one is cut in pieces."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.pieces = encoder, Pieces(encoder)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        word, pieces = chunk.rstrip(MARKS), self.pieces
        if word[1:].isalpha() and word[0] == " ":  # one piece of letters, and one of marks
            ids = pieces[word] + pieces[chunk[len(word) :]] if len(word) < len(chunk) else pieces[word]
        elif any(s in chunk for s in self.encoder.special):
            ids = self.encoder.whole([chunk])[0]
        elif chunk.isascii():
            ids = b"".join(map(pieces.__getitem__, _ASCII.findall(chunk)))
        else:
            ids = b"".join([array(self.encoder.code, [t.id for t in self.encoder.model.tokenize(p)]).tobytes() for p, _ in self.encoder.cut(chunk)])
        self[chunk] = ids
        return ids


class Encoder:
    """The ids of whole texts, by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Chunks may be encoded apart where nothing but the byte-level cut comes before the model.
        self.by_chunk = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and sys.byteorder == "little"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_chunk = self.by_chunk and not any(s.strip().rstrip(MARKS).isalpha() for s in self.special)
        self.cut, self.model = (self.tokenizer.pre_tokenizer.pre_tokenize_str if self.by_chunk else None), self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.known = Known(self)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        cut = [self.by_chunk and "  " not in t and "\x00" not in t for t in texts]
        rest = iter(self.whole([t for t, c in zip(texts, cut, strict=True) if not c]))
        return [b"".join(map(get, t.replace(" ", "\x00 ").split("\x00"))) if c else next(rest) for t, c in zip(texts, cut, strict=True)]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _record(part: int, chunk: int, before: int, ids: list[bytes], keys: list, width: int) -> tuple:
    ends = np.cumsum([len(x) // width for x in ids])
    known = [k for k in keys if k is not None]
    first = known[0] if known else 0
    gaps = (np.array(known, dtype=np.int64) - np.int64(first)).view(np.uint64) if known else np.zeros(0, np.uint64)
    return part, chunk, len(ids), int(ends[-1]), len(keys) - len(known), first, before, width, b"".join(ids), EliasFano.of(ends).to_bytes(), EliasFano.of(gaps).to_bytes()


class Record:
    """Random access to the documents of one record: offsets and ids come from ``select``."""

    def __init__(self, row):
        self.n_docs, self.n_null, self.first_id = row.n_docs, row.n_null, row.first_id
        self.flat = np.frombuffer(row.ids, f"<u{row.width}")
        self.ends, self.keys = EliasFano.from_bytes(row.ends), EliasFano.from_bytes(row.doc_ids)

    def offset(self, i: int) -> int:
        """Where document i begins; that of n_docs is the end of the last."""
        return self.ends.select(i - 1) if i else 0

    def doc_id(self, i: int) -> int | None:
        if i < self.n_null:
            return None
        found = (self.keys.select(i - self.n_null) + self.first_id) % (1 << 64)
        return found - (1 << 64) if found >> 63 else found

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.offset(i) : self.offset(i + 1)]


def write(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None, end: int = END, chunk_ids: int = CHUNK) -> None:
    """Encode and write every document, in ascending doc_id order."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, part, chunk, before, ids, keys, held = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, [], [], 0
        stop = np.array([end], dtype=e.kind).tobytes()
        for pdf in parts:
            for key, got in zip(pdf["doc_id"], e.encode(list(pdf["text"])), strict=True):
                ids.append(got + stop)
                keys.append(None if pd.isna(key) else int(key))
                held += len(ids[-1]) // e.width
                if held >= chunk_ids:
                    yield pd.DataFrame([_record(part, chunk, before, ids, keys, e.width)], columns=names)
                    chunk, before, ids, keys, held = chunk + 1, before + held, [], [], 0
        if ids:
            yield pd.DataFrame([_record(part, chunk, before, ids, keys, e.width)], columns=names)

    # Ranges are bounded by the text's hash too, so many rows of one id (or none) aren't one task's.
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc()]
    rows = documents(docs).withColumn("key", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    # doc_id travels as text, so that large ids beside nulls keep all their bits.
    rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(records, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # One row for each write partition, a number chosen by the writer.
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base = dict(zip([r.part for r in sizes], np.cumsum([0, *(r.n for r in sizes)]).tolist()))

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                record = Record(r)
                bounds = np.array([record.offset(i) for i in range(record.n_docs + 1)], dtype=np.int64)
                crcs = [zlib.crc32(record.flat[a:b].astype("<u4")) for a, b in zip(bounds, bounds[1:])]
                keys = [record.doc_id(i) for i in range(record.n_docs)]
                yield pd.DataFrame({"doc_id": pd.array(keys, dtype="Int64"), "start": base[r.part] + int(r.first_token) + bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": crcs})

    return files.mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/sentrella-token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
