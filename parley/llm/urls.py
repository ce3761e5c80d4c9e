"""URL filters whose list entries have dates.

Dated changes of a list become validity intervals; every capture is judged by
the entries active when it was fetched. Captures meet intervals by an
equi-join on the entry's key with the time in the condition. Captures of one
key and day are joined once, so a host with a third of all pages joins as many
rows as it has days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of the derived capture dates and list changes.
DAYS = 1461
FOREVER = 2**31 - 1
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def intervals(changes: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): when each entry held.

    ``changes``: key, day, seq, change (add or remove), action (block or
    allow). A key's change holds from its day up to the next change of the
    key; of several on a day the one with the highest seq (then action, then
    change) counts. Rows with a null key or day are left out.
    """
    c = changes.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "day").agg(F.max(F.struct("seq", "action", "change")).alias("c"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    c = c.select("key", "c.*", F.col("day").alias("valid_from"), F.coalesce(until, F.lit(FOREVER)).alias("valid_to"))
    return c.where("change = 'add'").select("key", "action", "valid_from", "valid_to")


def capture_keys(url: str = "url"):
    """An array of (key, rank) that entries can have for a URL: host and first path segment, then the host and its parent domains down to two labels."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    segment = F.regexp_extract(url, SEGMENT, 1)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (F.lit(100) - i).alias("rank")))
    first = F.array(F.struct(F.concat(host, F.lit("/"), segment).alias("key"), F.lit(100).alias("rank")))
    return F.when(host == "", F.array().cast("array<struct<key:string,rank:int>>")).when(segment == "", suffixes).otherwise(F.concat(first, suffixes))


def judge(captures: DataFrame, valid: DataFrame) -> DataFrame:
    """(page_id, url, day, decision, matched_key, listed_since) for every capture.

    The most specific active entry decides; without one, and for null or
    malformed URLs and null days, the decision is ``allow`` with null key.
    Repeated captures give repeated rows.
    """
    c = captures.select("page_id", "url", "day")
    keys = c.select("url", "day").where("url IS NOT NULL AND day IS NOT NULL").distinct().withColumn("k", F.explode(capture_keys()))
    keys = keys.select("url", "day", "k.key", "k.rank")
    hit = keys.select("key", "day").distinct().alias("c").join(valid.alias("v"), (F.col("c.key") == F.col("v.key")) & (F.col("v.valid_from") <= F.col("c.day")) & (F.col("c.day") < F.col("v.valid_to")))
    hit = hit.select("c.key", "c.day", "action", "valid_from")
    best = keys.join(hit, ["key", "day"]).groupBy("url", "day").agg(F.max(F.struct("rank", "action", "key", "valid_from")).alias("b"))
    out = c.join(best, ["url", "day"], "left")
    return out.select("page_id", "url", "day", F.coalesce("b.action", F.lit("allow")).alias("decision"), F.col("b.key").alias("matched_key"), F.col("b.valid_from").cast("long").alias("listed_since"))


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """pages with a fetch day derived from the id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("long").alias("day"))


def changes_from_pages(pages: DataFrame) -> DataFrame:
    """A dated list derived from the pages: hosts are blocked, unblocked and blocked again; path heads get exceptions; parent domains are blocked for a while."""
    p = pages.select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.regexp_extract("url", SEGMENT, 1).alias("segment")).where("host <> ''")
    hosts = p.groupBy("host").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    start = F.pmod(F.col("low") * 31, F.lit(DAYS))
    step = lambda day, seq, change, action: F.struct(day.cast("long").alias("day"), F.lit(seq).alias("seq"), F.lit(change).alias("change"), F.lit(action).alias("action"))
    by_host = hosts.select(F.col("host").alias("key"), F.explode(F.array(step(start, 0, "add", "block"), step(start + 200 + F.col("n") % 100, 1, "remove", "block"), step(start + 500, 2, "add", "block"))).alias("e"))
    heads = p.where("segment <> ''").groupBy("host", "segment").agg(F.min("page_id").alias("low"))
    by_head = heads.select(F.concat_ws("/", "host", "segment").alias("key"), F.explode(F.array(step(F.pmod(F.col("low") * 17, F.lit(DAYS)), 0, "add", "allow"))).alias("e"))
    domains = hosts.select(F.substring_index("host", ".", -2).alias("key")).distinct()
    by_domain = domains.select("key", F.explode(F.array(step(F.lit(1200), 3, "add", "block"), step(F.lit(1260), 4, "remove", "block"))).alias("e"))
    return by_host.unionByName(by_head).unionByName(by_domain).select("key", "e.*")


ORACLE = r"""
WITH p AS (SELECT page_id, url, CAST((page_id * 7919) % 1461 AS BIGINT) AS day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment FROM pages),
h AS (SELECT host, min(page_id) AS low, count(*) AS n FROM p WHERE host <> '' GROUP BY host),
e AS (SELECT host AS key, (low * 31) % 1461 AS day, 0 AS seq, 'add' AS change, 'block' AS action FROM h
  UNION ALL SELECT host, (low * 31) % 1461 + 200 + n % 100, 1, 'remove', 'block' FROM h
  UNION ALL SELECT host, (low * 31) % 1461 + 500, 2, 'add', 'block' FROM h
  UNION ALL SELECT host || '/' || segment, (min(page_id) * 17) % 1461, 0, 'add', 'allow' FROM p WHERE host <> '' AND segment <> '' GROUP BY host, segment
  UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.'), 1200, 3, 'add', 'block' FROM h
  UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.'), 1260, 4, 'remove', 'block' FROM h),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY seq DESC, action DESC, change DESC) AS r FROM e) x WHERE r = 1),
v AS (SELECT * FROM (SELECT key, action, change, day AS valid_from, lead(day, 1, 2147483647) OVER (PARTITION BY key ORDER BY day) AS valid_to FROM d) x WHERE change = 'add'),
k AS (SELECT page_id, day, host || '/' || segment AS key, 100 AS rank FROM p WHERE host <> '' AND segment <> ''
  UNION ALL SELECT page_id, day, array_to_string(string_split(host, '.')[i:], '.'), 100 - i
    FROM (SELECT page_id, day, host, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM p WHERE host <> '') x),
m AS (SELECT * FROM (SELECT k.page_id, v.action, k.key, v.valid_from, row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC, v.action DESC, k.key DESC) AS r
  FROM k JOIN v ON k.key = v.key AND v.valid_from <= k.day AND k.day < v.valid_to) x WHERE r = 1)
SELECT p.page_id, p.url, p.day, coalesce(m.action, 'allow') AS decision, m.key AS matched_key, CAST(m.valid_from AS BIGINT) AS listed_since
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
