"""Mixing sources to target weights by iterative proportional fitting.

Every document falls in a cell (source, language, topic); null or missing values count as
'(none)'. Its weight is its number of tokens: white-space separated words and one end.

Targets: for each dimension the weights wanted of its values, as given (a dictionary of
value to weight; a value that isn't named keeps its share of all weight). A dimension that
is given as a number instead gets tempered shares: each value's share raised to that power
and normalised, which raises small values whatever they are called. The cell weights are
raked to the marginals of the dimensions in turn, in sweeps, until no marginal is off by
more than TOLERANCE of its target (MAX_SWEEPS at most; targets that exclude one another,
as two dimensions that always coincide can give, stop there at the last sweep's fit).

A cell's ratio is its fitted over its observed weight (1 on average); each of its documents
stays floor(ratio) times, and once more where its draw is below the rest of the ratio. So
the expected weight of every cell is its fitted one, with no ratio cut. The draw of a
document is the first 48 bits of the MD5 of its doc_id's decimal text over 2^48, so it
doesn't depend on partitions; rows of one doc_id share their draw, and a null doc_id draws 0.

Everything is DataFrame code. The topic's rule is plain text searches, so reading the documents
twice, for the cells and for the sample, costs less than a copy of them. Rows are summed to cells in the map tasks before any shuffle, so hot
sources cost one row for each task; the sweeps touch the cell table only and each is written
to the shared folder. The cell table isn't hinted: Spark broadcasts it only below its size
threshold, and otherwise splits skewed join partitions.

The topic is a rule over the whole text: 'legal' where it names a licence or copyright,
'contact' where it holds an address or link, 'numeric' where it holds three digits in a
row, else 'prose'. Null and empty texts are 'prose' of weight one. Other columns pass
through ``sample`` whatever their names: the added ones live in the column it is told.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import discard, saved, table

#: What the query asks for: tempered shares of each dimension.
TARGETS: dict[str, float | Mapping[str, float]] = {"source": 0.5, "lang": 0.7, "topic": 0.6}
TOLERANCE, MAX_SWEEPS = 1e-9, 25
WORD = "[^ \\t\\n\\r\\f\\x0B]+"
TOPICS = (("legal", ("license", "licence", "copyright"), None), ("contact", ("@", "http://", "https://", "www."), None), ("numeric", (), "[0-9]{3}"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, parts, pattern in reversed(TOPICS):
        of = F.lower(text) if name == "legal" else text
        rule = text.rlike(pattern) if pattern else F.contains(of, F.lit(parts[0]))
        for p in parts[1:]:
            rule = rule | F.contains(of, F.lit(p))
        out = F.when(rule, name).otherwise(out)
    return out


def with_cells(docs: DataFrame) -> DataFrame:
    """Every document as the struct ``row``, with source, lang, topic, weight and draw beside it."""
    text = F.coalesce(docs["text"], F.lit(""))
    draw = F.coalesce(F.conv(F.substring(F.md5(docs["doc_id"].cast("string").cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48), F.lit(0.0))
    return docs.select(
        F.struct("*").alias("row"), F.coalesce(docs["source"], F.lit("(none)")).alias("source"), F.coalesce(docs["lang"], F.lit("(none)")).alias("lang"),
        topic_of(text).alias("topic"), (F.regexp_count(text, F.lit(WORD)).cast("long") + 1).alias("weight"), draw.alias("draw"),
    )


def marginal(cells: DataFrame, dim: str, want: float | Mapping[str, float]) -> DataFrame:
    """(dim, target): the weight wanted of each value; they sum to the observed weight."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("observed").alias("total"))  # one row
    share = cells.groupBy(dim).agg(F.sum("observed").alias("s")).crossJoin(F.broadcast(total))
    if isinstance(want, Mapping):
        given = spark.createDataFrame([(k, float(v)) for k, v in want.items()], f"{dim} string, given double")
        raw = share.join(F.broadcast(given), dim, "left").select(dim, "total", F.coalesce("given", F.col("s") / F.col("total")).alias("raw"))
    else:
        raw = share.select(dim, "total", F.pow(F.col("s") / F.col("total"), F.lit(want)).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all")))).select(dim, (F.col("raw") / F.col("all") * F.col("total")).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """cells (one row each: the dimensions and observed) with the fitted weight."""
    fitted = cells.withColumns({"observed": F.col("observed").cast("double"), "fitted": F.col("observed").cast("double")})
    for d, want in targets.items():
        fitted = fitted.join(marginal(cells.withColumn("observed", F.col("observed").cast("double")), d, want).withColumnRenamed("target", f"target_{d}"), d)
    fitted = saved(fitted, "mix-targets")
    for _ in range(max_sweeps):
        now, off = fitted, F.lit(0.0)
        for d in targets:
            sums = now.groupBy(d).agg(F.sum("fitted").alias("now"))
            now = now.join(sums, d)
            off = F.greatest(off, F.col(f"off_{d}"))
            now = now.withColumn(f"off_{d}", F.abs(F.col("now") / F.col(f"target_{d}") - 1)).withColumn("fitted", F.col("fitted") * F.col(f"target_{d}") / F.col("now")).drop("now")
        now = saved(now.withColumn("off", off).drop(*(f"off_{d}" for d in targets)), "mix-sweep")
        worst = now.agg(F.max("off")).first()[0]
        discard(fitted)
        fitted = now.drop("off")
        fitted.saved_path = now.saved_path
        if worst is None or worst <= tolerance:
            break
    return fitted.select(*targets, "observed", "fitted")


def ratios(rows: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS) -> DataFrame:
    """Rows with source, lang, topic, weight and draw get their cell's ratio and their copies."""
    dims = list(targets)
    cells = saved(rows.groupBy(*dims).agg(F.sum("weight").alias("observed")), "mix-cells")
    ratio = rake(cells, targets).select(*dims, (F.col("fitted") / F.col("observed")).alias("ratio"))
    whole = F.floor("ratio")
    return rows.join(ratio, dims).withColumn("copies", (whole + (F.col("draw") < F.col("ratio") - whole).cast("long")).cast("long"))


def sample(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS) -> DataFrame:
    """The documents, with all their columns, each as often as its cell's ratio asks."""
    rows = ratios(with_cells(docs), targets)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows = saved(with_cells(docs).withColumn("doc_id", F.col("row.doc_id")).drop("row"), "mix-rows")
    return ratios(rows).select("doc_id", "source", "lang", "topic", "weight", F.round("ratio", 6).alias("ratio"), F.round("draw", 9).alias("draw"), "copies")


def _sql() -> str:
    text = {"legal": "regexp_matches(t, '(?i)licen[cs]e|copyright')", "contact": "regexp_matches(t, '@|https?://|www[.]')", "numeric": "regexp_matches(t, '[0-9]{3}')"}
    cases = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in text.items())
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE {cases} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '{WORD}'))::BIGINT + 1 AS weight FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(weight)::DOUBLE AS observed FROM d GROUP BY ALL)",
        "tot AS (SELECT sum(observed) AS total FROM c)",
    ]
    for k, p in TARGETS.items():
        parts.append(f"r_{k} AS MATERIALIZED (SELECT {k}, pow(sum(observed) / any_value(total), {p}) AS raw FROM c, tot GROUP BY {k})")
        parts.append(f"t_{k} AS MATERIALIZED (SELECT {k}, raw / sum(raw) OVER () * total AS target FROM r_{k}, tot)")
    # One sweep is a step of the recursion; MAX_SWEEPS steps fit at least as closely as TOLERANCE asks.
    now = "SELECT n + 1 AS n, source, lang, topic, observed, fitted FROM f WHERE n < " + str(MAX_SWEEPS)
    for k in TARGETS:
        now = f"SELECT n, source, lang, topic, observed, fitted * target / sum(fitted) OVER (PARTITION BY n, {k}) AS fitted FROM ({now}) JOIN t_{k} USING ({k})"
    parts.append(f"f AS (SELECT 0 AS n, source, lang, topic, observed, observed AS fitted FROM c UNION ALL {now})")
    return "WITH RECURSIVE " + ",\n".join(parts) + f""",
p AS (SELECT source, lang, topic, fitted / observed AS ratio FROM f WHERE n = {MAX_SWEEPS}),
q AS (SELECT *, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0, 0.0) AS u FROM d)
SELECT doc_id, source, lang, topic, weight, round(ratio, 6) AS ratio, round(u, 9) AS draw, floor(ratio)::BIGINT + (u < ratio - floor(ratio))::BIGINT AS copies
FROM q JOIN p USING (source, lang, topic)
"""


OP9_SQL = _sql()
