"""Exact dedup with an extendible-hash index on shared files.

1. Every text has a key, its 64-bit xxHash. The rows of each key are counted (partly in the
   map tasks) and the counts written to shared files.
2. The directory has 2^depth slots, named by the first bits of the key. It doubles while a
   bucket holds more rows than its capacity; slots whose bucket wasn't split go on sharing
   it, with their smaller local depth. Its bits are bounded by MAX_DEPTH, so it has 2^18
   slots at most and travels to all tasks; where the input outgrows that, buckets hold more.
3. Rows are sent to the owner task of their bucket, looked up in the directory by slot. An
   owner sorts whole key ranges; rows of equal key are a chain, and within it texts are
   compared byte by byte, so texts that collide under one key stay apart. This one pass
   gives the result: nothing is dealt again by key.
4. A key with more rows than a bucket may hold can't be split by more bits. There are fewer
   than 2^(MAX_DEPTH - 2) such keys. Their rows are grouped by the text itself, collapsed in
   the map tasks first, and look their group up by key and SHA-256; two texts under both
   would be a SHA-256 collision, which stops the job rather than merge them.

Everything is DataFrame code. Null text counts as empty. Rows with a null doc_id take
part, and stay only where every doc_id of their group is null (then kept is true on each
such row). Rows that repeat a doc_id and a text are copies: ``dedup`` returns each, and all
that carry the staying doc_id are marked kept; ``survivors`` returns one of them. ``dedup``
reads no other columns, ``survivors`` returns them all, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrella.llm.common import documents, saved, table

#: Rows of a bucket, and the most bits of a slot.
CAPACITY, MAX_DEPTH = 1024, 18


def slot(depth: int):
    """The first bits of the key, as a number from 0 to 2^depth - 1."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(counts: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, directory_depth, local_depth, prefix) from key and n (rows). A prefix is a bucket
    where it isn't overfull (or has all bits) and its parent is; it owns all slots below it."""
    fine = counts.groupBy(slot(max_depth).alias("fine")).agg(F.sum("n").alias("n"))
    levels = fine.select("fine", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("local_depth"))
    nodes = levels.groupBy("local_depth", F.expr(f"shiftrightunsigned(fine, {max_depth} - local_depth)").alias("prefix")).agg(F.sum("n").alias("n"))
    parents = nodes.where((F.col("n") > capacity) & (F.col("local_depth") < max_depth)).select((F.col("local_depth") + 1).alias("local_depth"), F.col("prefix").alias("parent"))
    leaves = nodes.where((F.col("n") <= capacity) | (F.col("local_depth") == max_depth)).withColumn("parent", F.shiftrightunsigned("prefix", 1))
    buckets = leaves.where("local_depth = 0").unionByName(leaves.join(parents, ["local_depth", "parent"], "left_semi")).select("local_depth", "prefix")
    deepest = buckets.agg(F.max("local_depth").alias("directory_depth"))  # one row
    first, many = F.expr("shiftleft(prefix, directory_depth - local_depth)"), F.expr("shiftleft(1L, directory_depth - local_depth)")
    return buckets.crossJoin(F.broadcast(deepest)).select(F.explode(F.sequence(first, first + many - 1)).alias("slot"), "directory_depth", "local_depth", "prefix")


class Index:
    """The index of a table: its saved counts, hot keys and directory."""

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH):
        self.counts = saved(docs.groupBy(text_key(docs).alias("key")).agg(F.count("*").alias("n")), "exact-counts")
        total = self.counts.agg(F.sum("n")).first()[0] or 0
        self.capacity = max(capacity, math.ceil(total / (1 << max_depth - 2)))
        self.hot = self.counts.where(F.col("n") > self.capacity).select("key")
        self.directory = saved(directory(self.counts.where(F.col("n") <= self.capacity), self.capacity, max_depth), "exact-directory")
        self.depth = (self.directory.agg(F.max("directory_depth")).first() or [0])[0] or 0

    def owned(self, rows: DataFrame) -> DataFrame:
        """Rows of ordinary keys with their bucket, dealt to the owner tasks."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = self.directory.select("slot", (F.shiftleft(F.col("local_depth").cast("long"), 32) + F.col("prefix")).alias("bucket"))
        cold = rows.join(F.broadcast(self.hot), "key", "left_anti")
        return cold.withColumn("slot", slot(self.depth)).join(F.broadcast(buckets), "slot").drop("slot").repartition(n, "bucket")

    def crowded(self, rows: DataFrame) -> DataFrame:
        """Rows of hot keys, where they are."""
        return rows.join(F.broadcast(self.hot), "key", "left_semi")


def text_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


CHAIN = ("bucket", "key", "text")


def dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    index = Index(docs, capacity, max_depth)
    rows = documents(docs).select("doc_id", "text", F.xxhash64("text").alias("key"))
    chain = Window.partitionBy(*CHAIN)
    cold = index.owned(rows).select("doc_id", F.max("doc_id").over(chain).alias("keep_id"), F.count("*").over(chain).alias("group_size"), F.sha2("text", 256).alias("text_sha256"))
    crowded = index.crowded(rows)
    apart = F.when(F.count("*") == 1, F.max("group_size")).otherwise(F.raise_error(F.lit("different texts under one SHA-256 digest")).cast("long"))
    groups = saved(
        crowded.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .groupBy("key", F.sha2("text", 256).alias("text_sha256")).agg(F.max("keep_id").alias("keep_id"), apart.alias("group_size")), "exact-hot")
    hot = crowded.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")).join(groups, ["key", "text_sha256"]).select(*cold.columns[:3], "text_sha256")
    return cold.unionByName(hot).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Of rows with equal texts, the one of the largest doc_id, with all its columns. Rows that
    repeat both are settled by a hash of the other columns."""
    index = Index(docs, capacity, max_depth)
    others = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.struct(docs["doc_id"].cast("long"), F.xxhash64(*others))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"), text_key(docs).alias("key"), place.alias("place"))
    first = F.row_number().over(Window.partitionBy(*CHAIN).orderBy(F.desc("place")))
    cold = index.owned(rows).withColumn("nth", first).where("nth = 1").select("row.*")
    hot = index.crowded(rows).groupBy("key", "text").agg(F.max_by("row", "place").alias("row")).select("row.*")
    return cold.unionByName(hot)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text)
"""
