"""Line dedup by site-relative frequency.

A page's lines come from its HTML: scripts, styles and comments go, block tags (the title's
among them) end a line, other tags go, the five common entities are decoded, runs of white
space collapse, empty lines go. For each host, a line's ratio is the number of its pages that
contain it over the host's pages. Lines whose ratio exceeds RATIO are boilerplate and are
dropped from every page of that host; a line of a single page is never boilerplate, since on
a host of one page every line would be (MIN_PAGES, 2).

Scale: pages are parsed once, into a table in the shared folder. Lines are made distinct
inside their page and counted in the map tasks before the shuffle, so a hot host or line
costs one row for each task. A host's boilerplate lines fewer than its mean number of
distinct lines a page / RATIO, whatever the host's size, so they travel as one short array
for each host. Pages meet it by host and part: a host of more than 1/4,096 of all pages
(at most 4,096 hosts, whose parts every task knows) is cut in parts of that size, each
with its own copy of the array, so no task holds a whole hot host.

Null url: host ''. Null html: a page without lines. Repeated rows count as pages. Hosts are
lower-cased; a url without '//' has host ''. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import saved, table

RATIO, MIN_PAGES, PARTS = 0.2, 2, 4096
BLOCK = "p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|nav|header|footer|article|section|title|body|html|main|aside|form|pre|blockquote|hr|dd|dt|dl|option|select|button|figure|figcaption"
STEPS = (
    ("(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>", " "),
    ("(?s)<!--.*?-->", " "),
    (f"(?i)</?({BLOCK})(\\s[^>]*)?/?>", "\n"),
    ("<[^>]*>", " "),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def lines_of(html: Column) -> Column:
    """The non-empty lines of a page, in order."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    for name, by in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(by))
    text = F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, parts: int = PARTS) -> DataFrame:
    """page_id, host, lines (kept), n_lines, n_dropped of every page."""
    rows = saved(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("all_lines")), "lines-pages")
    totals = saved(rows.groupBy("host").agg(F.count("*").alias("host_pages")), "lines-hosts")
    counts = rows.select("host", F.explode(F.array_distinct("all_lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = (
        counts.join(totals, "host").where(F.col("n") > ratio * F.col("host_pages"))
        .groupBy("host").agg(F.collect_list("line").alias("boilerplate"))
    )
    share = max(1, -(-(totals.agg(F.sum("host_pages")).first()[0] or 0) // parts))
    hot = F.broadcast(totals.where(F.col("host_pages") > share).select("host", F.ceil(F.col("host_pages") / share).cast("int").alias("host_parts")))
    cut = F.coalesce("host_parts", F.lit(1))
    rows = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "all_lines"), cut).cast("int")).drop("host_parts")
    common = common.join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), cut - 1))).drop("host_parts")
    kept = F.when(F.col("boilerplate").isNull(), F.col("all_lines")).otherwise(F.filter("all_lines", lambda x: ~F.array_contains(F.col("boilerplate"), x)))
    return (
        rows.join(common, ["host", "part"], "left").withColumn("lines", kept)
        .select("page_id", "host", "lines", F.size("all_lines").cast("long").alias("n_lines"), (F.size("all_lines") - F.size("lines")).cast("long").alias("n_dropped"))
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "pages")).select("page_id", "host", "n_lines", "n_dropped", F.array_join("lines", "\n").alias("text"))


def _sql() -> str:
    text = "coalesce(html, '')"
    for pattern, by in STEPS:
        opts = "gs" if "s" in pattern[: pattern.find(")")] and pattern.startswith("(?") else "g"
        text = f"regexp_replace({text}, '{pattern}', '{by}', '{opts}')".replace("\n", "' || chr(10) || '") if by == "\n" else f"regexp_replace({text}, '{pattern}', '{by}', '{opts}')"
    for name, by in ENTITIES:
        text = f"replace({text}, '{name}', '{by}')"
    text = f"regexp_replace({text}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls
  FROM pages),
t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
u AS (SELECT DISTINCT rid, host, unnest(ls) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM u GROUP BY host, line HAVING count(*) >= {MIN_PAGES}),
b AS (SELECT host, list(line) AS bad FROM c JOIN t USING (host) WHERE n > {RATIO} * host_pages GROUP BY host),
k AS (SELECT page_id, p.host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""


OP7_SQL = _sql()
