"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrella.functions.plan import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach (see ``shared_folder``)."""
    return shared_folder(spark)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again, which cuts the lineage
    and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sentrella-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like the given ones that differ from those taken (case aside)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def join_evenly(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """Inner join with ``right`` (one row for each key) where a key may hold a large share of
    ``left``. ``sizes`` has the rows (n) of each key in left. Keys of more than a thousandth of
    the rows, 1,024 at most, are joined in the map tasks; the others are dealt by key."""
    hot = sizes.where(F.col("n") > total / 1024).select(key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    return left.join(F.broadcast(few), key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sliced(pdf, chars: int = 1_000_000):
    """A batch of rows in parts of bounded text (a longer text is a part of its own), so that
    what Python holds for each word doesn't grow with the batch."""
    sizes = pdf["text"].str.len().to_numpy()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > chars:
            yield pdf.iloc[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(pdf):
        yield pdf.iloc[begin:]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Texts of a bounded sample of labelled rows, and the count of each class over all labels kept.

    ``per_class`` bounds the rows of each class; rows are taken in the order of a hash of
    their doc_id, so that the choice doesn't depend on partitions. Repeated labels of a
    document count once (the larger value).
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    counts = {r.y: r.n for r in known.where(F.col("y").isin(*per_class)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # Bounded by per_class, so it may be broadcast.
    return documents(docs).join(F.broadcast(chosen), "doc_id"), counts
