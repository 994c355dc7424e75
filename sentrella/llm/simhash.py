"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprints: texts are lower-cased (A-Z), cut into words at ASCII white space and into
shingles of three words (all words if fewer), repeats included; a bit is 1 where more than
half of the shingles' XXH64 (seed 42) have it. A text without words, null included, has
fingerprint zero and links like any other.

Candidates: the 64 bits are cut in three segments of 22, 21 and 21 bits. Two differing bits
at most leave one segment equal and the next one (A-B, B-C or C-A, one of these three always
serves) with one error at most. The equal segment is keyed as it is. The other, as a word of
the (23, 12) Golay code, is decoded: its nearest codeword lies within three bits; where it
lies at exactly three, the five codewords at distance four count too. Words one bit apart
always share one of these one or six indices (tested over all cosets). That makes about 16
keys for each distinct fingerprint.

Verification: keys held by SMALL fingerprints at most list them and compare each pair. Any
fingerprint in a fuller bucket instead lists the 65 fingerprints within one bit of itself:
two fingerprints differ in two bits or fewer exactly where these balls meet, and no ball
point belongs to more than 65 fingerprints. So links stay complete and their number linear
in the rows, whatever the bucket's size.

Copies of one fingerprint are one node. Components go by alternating stars over tables in
the shared folder. component_id is the least non-null doc_id of the component (null if it
has none). Rows repeat as they come; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import discard, documents, fresh, join_evenly, saved, table
from sentrella.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SMALL = 16
#: The generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BLOCK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        fps = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})


def _keyed_fingerprints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        fps = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_key": pdf["text_key"], "fp": fps.view(np.int64)})


class Golay:
    """Codeword indices near a 23-bit word, by tables over its 2,048 syndromes."""

    def __init__(self):
        self.syndrome = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 11, dtype=np.int32)
        for table_, shift in zip(self.syndrome, (0, 12)):
            for v in range(len(table_)):
                table_[v] = self.divide(v << shift)
        self.error = np.zeros(2048, dtype=np.int64)
        weights = {w: [] for w in (1, 2, 3)}
        bits = [1 << i for i in range(23)]
        for i in range(23):
            weights[1].append(bits[i])
            for j in range(i):
                weights[2].append(bits[i] | bits[j])
                weights[3] += [bits[i] | bits[j] | bits[k] for k in range(j)]
        for w in (1, 2, 3):
            for e in weights[w]:
                self.error[self.divide(e)] = e
        words = np.array([self.codeword(m) for m in range(1 << 12)], dtype=np.int64)
        sevens = words[np.bitwise_count(words) == 7]
        self.more = np.full((2048, 5), -1, dtype=np.int64)
        for e in weights[3]:
            self.more[self.divide(e)] = sorted(int(c) >> 11 for c in sevens[(sevens & e) == e])

    @staticmethod
    def divide(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    @classmethod
    def codeword(cls, index: int) -> int:
        return index << 11 | cls.divide(index << 11)

    def indices(self, words: np.ndarray) -> np.ndarray:
        """One row of six for each word; -1 fills the row."""
        s = self.syndrome[0][words & 4095] ^ self.syndrome[1][words >> 12]
        nearest = (words ^ self.error[s]) >> 11
        more = self.more[s]
        return np.c_[nearest, np.where(more < 0, -1, more ^ nearest[:, None])]


_golay: list[Golay] = []


def keys(fps: np.ndarray) -> np.ndarray:
    """The fuzzy keys of each fingerprint (rows of 18; -1 fills them)."""
    if not _golay:
        _golay.append(Golay())
    fps = fps.astype(np.uint64)
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    out = []
    for i in range(3):
        near = _golay[0].indices(parts[(i + 1) % 3])
        out.append(np.where(near < 0, -1, (i << 34 | parts[i] << 12)[:, None] | near))
    return np.concatenate(out, axis=1)


def _keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        fps = pdf["fp"].to_numpy()
        k = keys(fps.view(np.uint64))
        on = k >= 0
        yield pd.DataFrame({"key": k[on], "fp": np.repeat(fps, on.sum(axis=1))})


def _balls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    near = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
    for pdf in parts:
        fps = pdf["fp"].to_numpy()
        yield pd.DataFrame({"point": (fps.view(np.uint64)[:, None] ^ near).ravel().view(np.int64), "fp": np.repeat(fps, 65)})


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within two bits."""
    keyed = distinct.select("fp").mapInPandas(_keyed, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = saved(keyed.join(shared, "key"), "simhash-buckets")
    near = F.filter("fps", lambda b: (b > F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= MAX_BITS))
    pairs = (
        buckets.where(F.col("n") <= small).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("a"), "fps").select("a", F.explode(near).alias("b"))
    )
    full = buckets.where(F.col("n") > small).select("fp").distinct()
    # A point belongs to 65 balls at most.
    points = full.mapInPandas(_balls, "point long, fp long").groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = points.select(F.explode("fps").alias("a"), "b").where("a <> b")
    return pairs.unionByName(stars).distinct()


def roots(prints: DataFrame) -> tuple[DataFrame, int]:
    """Of each distinct fingerprint of ``prints`` (doc_id, fp): its component (the least
    fingerprint linked to it, itself included), component_id and rows (n); and all rows."""
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    linked = components(links(distinct)).withColumnRenamed("node", "fp")
    joined = saved(distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("root", "fp")).drop("root"), "simhash-roots")
    sums = saved(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    discard(distinct)
    # The rows of a component are many where copies are few: this join is dealt evenly too.
    return join_evenly(joined.drop("least"), sums.drop("n"), "component", sums.select("component", "n"), sums.agg(F.sum("n")).first()[0] or 0), total


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component and component_id of every row."""
    prints = saved(documents(docs).mapInPandas(_fingerprints, "doc_id long, fp long"), "simhash-prints")
    found, total = roots(prints)
    found = saved(found, "simhash-components")
    return join_evenly(prints, found.drop("n"), "fp", found.select("fp", "n"), total)


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: of the component's least doc_id (a null
    one only where it has no other), and among those the first by the text's hash."""
    (key,) = fresh(docs.columns, "text_key")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _text_key(docs).alias("text_key"))
    prints = saved(keyed.mapInPandas(_keyed_fingerprints, "doc_id long, text_key long, fp long"), "simhash-prints")
    found, total = roots(prints)
    found = saved(found.select("fp", "component", "n"), "simhash-components")
    own = join_evenly(prints, found.drop("n"), "fp", found.select("fp", "n"), total)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "rows")
    first = own.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("rows")).groupBy("component").agg(F.min(order).alias("first"))
    kept = saved(first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias(key), F.col("first.rows").alias("kept_rows")), "simhash-kept")
    discard(prints, found)
    rows = docs.withColumn(key, _text_key(docs))

    def chosen(of: DataFrame) -> DataFrame:
        # One row of each component grows with the input, so it isn't broadcast at any size.
        return rows.join(of.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(of["kept_id"]) & (rows[key] == of[key]), "left_semi")

    # Rows that repeat both id and text are settled apart: few are, so few are dealt anew.
    once, often = chosen(kept.where("kept_rows = 1")), chosen(kept.where("kept_rows > 1"))
    return once.unionByName(often.dropDuplicates(["doc_id", key])).drop(key)


def _text_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
