"""URL filters by a temporal list join, in DataFrame functions alone.

A list is a table of dated entries: ``pattern`` (a host or a parent domain),
``category``, ``listed`` (true: put on the list, false: taken off) and ``at``.
Entries become half-open validity intervals per pattern and category; a capture
is evaluated against the entries that are active at its fetch time. The join's
keys are the host and its parent domains, once for each host and fetch time, so
that a host with very many captures meets the list once; hot domains fall to
adaptive skew splitting, and nothing is broadcast unseen.

Captures without a readable host or without a time match nothing and are kept.
Entries with a null pattern, flag or time are void. Of several entries at one
instant, taking off wins. Repeated entries change nothing; repeated captures
each get their verdict; empty lists block nothing. Extra columns of captures
pass through under their own names; the added ones start with ``url_`` and take
the place of input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(host != "", F.rtrim(host, F.lit(".")))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: still listed)."""
    usable = entries.filter("pattern IS NOT NULL AND listed IS NOT NULL AND at IS NOT NULL")
    usable = usable.groupBy(F.lower("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), "at").agg(F.min("listed").alias("listed"))
    order = Window.partitionBy("pattern", "category").orderBy("at")
    return usable.withColumn("valid_to", F.lead("at").over(order)).filter("listed").select("pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with url_host, url_entries (active ones), url_categories, url_pattern (the longest) and url_blocked."""
    url_c, fetched_c, (at,) = F.col(url), F.col(fetched), fresh(captures, "url_at")
    added = ["url_host", "url_entries", "url_categories", "url_pattern", "url_blocked"]
    kept = [c for c in captures.columns if c.lower() not in added]
    captures = captures.select(*kept, host_of(url_c).alias("url_host"), fetched_c.alias(at))
    visits = captures.select("url_host", F.col(at).alias("url_at")).filter("url_host IS NOT NULL AND url_at IS NOT NULL").distinct()
    parts = F.split("url_host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = visits.select("url_host", "url_at", F.explode(keys).alias("pattern"))
    active = (F.col("url_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("url_at") < F.col("valid_to")))
    found = keyed.join(intervals(entries), "pattern").filter(active)
    found = found.groupBy("url_host", "url_at").agg(
        F.count("*").alias("url_entries"), F.count_distinct("category").alias("url_categories"), F.max_by("pattern", F.length("pattern")).alias("url_pattern")
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    joined = captures.join(found.withColumnRenamed("url_at", at), ["url_host", at], "left")
    return joined.select(*kept, "url_host", zero("url_entries"), zero("url_categories"), "url_pattern", F.col("url_entries").isNotNull().alias("url_blocked"))


EPOCH = "2024-01-01"


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the table has no fetch time, so a day of 2024 follows from page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit(EPOCH).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched_at"))


def host_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: a quarter is listed, half of those leave after 60 days and a part returns."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern IS NOT NULL").distinct()
    n = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    hosts = hosts.withColumn("n", n).filter("n % 4 = 0")
    day = lambda more: F.date_add(F.lit(EPOCH).cast("date"), (F.floor(F.col("n") / 4) % 240 + more).cast("int"))
    row = lambda more, listed: F.struct(day(more).alias("at"), F.lit(listed).alias("listed"))
    leaves, returns = F.col("n") % 8 == 0, F.col("n") % 16 == 0
    rows = F.concat(F.array(row(0, True)), F.when(leaves, F.array(row(60, False))).otherwise(F.array()), F.when(returns, F.array(row(120, True))).otherwise(F.array()))
    own = hosts.select("pattern", F.explode(rows).alias("r")).select("pattern", F.lit("host").alias("category"), "r.listed", "r.at")
    fixed = [("example.com", 90, True), ("example.com", 120, False), ("example.net", 200, True), ("example.org", 40, True), ("example.org", 60, False), ("example.org", 300, True)]
    spark = pages.sparkSession
    domains = spark.createDataFrame(fixed, "pattern string, d int, listed boolean")
    domains = domains.select("pattern", F.lit("domain").alias("category"), "listed", F.date_add(F.lit(EPOCH).cast("date"), F.col("d")).alias("at"))
    return own.unionByName(domains)


ORACLE = r"""
WITH p AS (SELECT page_id, url, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS url_host,
                  CAST(DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS fetched_at FROM pages),
h AS (SELECT DISTINCT url_host AS pattern, CAST('0x' || substr(md5(url_host), 1, 6) AS INTEGER) AS n FROM p WHERE url_host IS NOT NULL),
e AS (SELECT pattern, 'host' AS category, true AS listed, (n // 4) % 240 AS d FROM h WHERE n % 4 = 0
      UNION ALL SELECT pattern, 'host', false, (n // 4) % 240 + 60 FROM h WHERE n % 8 = 0
      UNION ALL SELECT pattern, 'host', true, (n // 4) % 240 + 120 FROM h WHERE n % 16 = 0
      UNION ALL SELECT * FROM (VALUES ('example.com', 'domain', true, 90), ('example.com', 'domain', false, 120), ('example.net', 'domain', true, 200),
                                      ('example.org', 'domain', true, 40), ('example.org', 'domain', false, 60), ('example.org', 'domain', true, 300))),
f AS (SELECT *, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS valid_from,
             lead(CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE)) OVER (PARTITION BY pattern, category ORDER BY d) AS valid_to FROM e),
a AS (SELECT p.page_id, f.pattern, f.category FROM p JOIN f ON f.listed AND (p.url_host = f.pattern OR p.url_host LIKE '%.' || f.pattern)
      AND p.fetched_at >= f.valid_from AND (f.valid_to IS NULL OR p.fetched_at < f.valid_to)),
g AS (SELECT page_id, count(*) AS n, count(DISTINCT category) AS c, arg_max(pattern, length(pattern)) AS url_pattern FROM a GROUP BY page_id)
SELECT p.page_id, p.url, CAST(p.fetched_at AS VARCHAR) AS fetched_at, p.url_host, coalesce(g.n, 0)::BIGINT AS url_entries, coalesce(g.c, 0)::BIGINT AS url_categories, g.url_pattern,
       g.n IS NOT NULL AS url_blocked
FROM p LEFT JOIN g USING (page_id)
"""
