"""Operator 2, URL filters: a temporal list join.

List changes (list, rule, pattern, action, at) become validity intervals: an ``add`` opens
one, the next ``remove`` of that list and pattern closes it (a second add or remove changes
nothing). A capture is matched against the entries active when it was fetched: its host
and every parent domain, and its host with every leading part of the path, are equi-join
keys, and the interval is a residual condition of that join (from <= fetched < to).

Of the active entries the most specific decides (path before host before parent domain,
longer before shorter), then allow before block, then the list's name.

Scale: one shuffle by key, in which AQE splits a hot host; Spark broadcasts the intervals
only where it knows them to be small. Matches are reduced to one per capture by a partial
aggregate. All is native: no Python runs on the executors.

Defined cases: a null or host-less URL matches nothing (verdict ``invalid``); a null fetch
time matches nothing (``unmatched``); equal captures give one row with their number in
``copies``; changes with a null pattern or time are ignored; no changes: all unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(authority), r"^.*@|:\d*$|\.(?=:\d*$|$)", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Patterns that may hold for a capture: host, parent domains of two labels or more, host with leading paths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.array_remove(F.split(path, "/"), "")
    leading = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(parents, F.when(F.size(steps) > 0, leading).otherwise(none))))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, rule, pattern, from, to): validity of every entry; ``to`` is null while it stands."""
    known = changes.where("pattern is not null and at is not null and action in ('add', 'remove')").distinct()
    w = Window.partitionBy("list", "rule", "pattern").orderBy("at", F.desc("action"))
    first = known.withColumn("before", F.lag("action").over(w)).where("before is distinct from action")
    closed = first.withColumn("to", F.lead("at").over(w)).where("action = 'add'")
    return closed.where("to is null or to > at").select("list", "rule", "pattern", F.col("at").alias("from"), "to")


def filter_captures(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per distinct capture: its verdict, the deciding entry and the number of active entries."""
    picked = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    rows = picked.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("copies")).withColumn("host", host_of(F.col("url")))
    keyed = rows.select("*", F.explode_outer(keys_of(F.col("host"), path_of(F.col("url")))).alias("key"))
    spans = intervals(changes)
    active = (F.col("key") == F.col("pattern")) & (F.col("from") <= F.col("fetched")) & (F.col("to").isNull() | (F.col("fetched") < F.col("to")))
    rank = F.struct(F.col("pattern").contains("/").alias("p"), F.length("pattern").alias("n"), (F.col("rule") == "allow").alias("a"), F.col("list").alias("list"), "rule", "pattern", "from")
    joined = keyed.join(spans, active, "left").withColumn("best", F.when(F.col("pattern").isNotNull(), rank))
    out = joined.groupBy("page_id", "url", "fetched", "host", "copies").agg(F.max("best").alias("best"), F.count("pattern").alias("n_active"))
    verdict = F.when(F.col("host") == "", "invalid").when(F.col("best").isNull(), "unmatched").otherwise(F.col("best.rule"))
    return out.select("page_id", "url", "host", "fetched", "copies", "n_active", verdict.alias("verdict"), F.col("best.list").alias("list"), F.col("best.pattern").alias("pattern"), F.col("best.from").alias("since"))


def kept_captures(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Captures that are not blocked when fetched; all columns and all other rows stay."""
    blocked = filter_captures(captures, changes, id_col, url_col, time_col).where("verdict = 'block'")
    gone = blocked.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(time_col))
    return captures.join(gone, [id_col, url_col, time_col], "left_anti")


def captures_and_changes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's input from ``pages``: fetch days, and list changes derived from the hosts that occur.

    A page is fetched on a day set by its id. Hosts, their registered domains and first path
    steps get dated entries by a digest of their name: on a block list, an allow list or both.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select("page_id", "url", day(F.pmod(F.col("page_id") * 37, F.lit(730))).alias("fetched"))
    rows = captures.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    names = rows.select(F.explode(keys_of(F.col("host"), F.regexp_extract("path", "^/[^/]*", 0))).alias("pattern")).distinct()
    digest = F.md5("pattern")
    part = lambda i: F.conv(F.substring(digest, i, 4), 16, 10).cast("long")
    seeds = names.select("pattern", part(1).alias("a"), part(5).alias("b"), part(9).alias("c"))
    steps = F.array(
        *(F.struct(F.lit(name).alias("list"), F.lit(rule).alias("rule"), F.lit(action).alias("action"), day(when).alias("at"), keep.alias("keep")) for name, rule, action, when, keep in (
            ("abuse", "block", "add", F.col("b") % 400, F.col("a") % 3 == 0),
            ("abuse", "block", "remove", F.col("b") % 400 + F.col("c") % 200 + 1, F.col("a") % 6 == 0),
            ("abuse", "block", "add", F.col("b") % 400 + F.col("c") % 200 + 91, F.col("a") % 12 == 0),
            ("trusted", "allow", "add", F.col("c") % 500, F.col("a") % 5 == 0),
            ("trusted", "allow", "remove", F.col("c") % 500 + F.col("b") % 100 + 1, F.col("a") % 10 == 0),
        ))
    )
    changes = seeds.select("pattern", F.explode(steps).alias("s")).where("s.keep").select("s.list", "s.rule", "pattern", "s.action", "s.at")
    return captures, changes


ORACLE = r"""
WITH cap AS (SELECT page_id, url, DATE '2024-01-01' + cast(page_id * 37 % 730 AS integer) AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@|:\d*$', '', 'g') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rows_ AS (SELECT page_id, url, fetched, host, path, count(*) AS copies FROM cap GROUP BY ALL),
lab AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM rows_ WHERE host <> ''),
keys AS (SELECT DISTINCT page_id, url, fetched, host, copies, key FROM (
    SELECT *, unnest(list_concat(
      list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')),
      list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(list_slice(steps, 1, i), '/')))) AS key FROM lab)),
names AS (SELECT DISTINCT pattern FROM (
    SELECT unnest(list_concat(
      list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')),
      CASE WHEN regexp_extract(path, '^/([^/]*)', 1) <> '' THEN [host || '/' || regexp_extract(path, '^/([^/]*)', 1)] ELSE [] END)) AS pattern FROM lab)),
seeds AS (SELECT pattern, cast('0x' || substr(md5(pattern), 1, 4) AS bigint) AS a, cast('0x' || substr(md5(pattern), 5, 4) AS bigint) AS b, cast('0x' || substr(md5(pattern), 9, 4) AS bigint) AS c FROM names),
changes AS (
  SELECT 'abuse' AS list, 'block' AS rule, pattern, 'add' AS action, DATE '2024-01-01' + cast(b % 400 AS integer) AS day FROM seeds WHERE a % 3 = 0
  UNION ALL SELECT 'abuse', 'block', pattern, 'remove', DATE '2024-01-01' + cast(b % 400 + c % 200 + 1 AS integer) FROM seeds WHERE a % 6 = 0
  UNION ALL SELECT 'abuse', 'block', pattern, 'add', DATE '2024-01-01' + cast(b % 400 + c % 200 + 91 AS integer) FROM seeds WHERE a % 12 = 0
  UNION ALL SELECT 'trusted', 'allow', pattern, 'add', DATE '2024-01-01' + cast(c % 500 AS integer) FROM seeds WHERE a % 5 = 0
  UNION ALL SELECT 'trusted', 'allow', pattern, 'remove', DATE '2024-01-01' + cast(c % 500 + b % 100 + 1 AS integer) FROM seeds WHERE a % 10 = 0),
spans AS (SELECT list, rule, pattern, day AS start_, to_ FROM (SELECT *, lead(day) OVER (PARTITION BY list, rule, pattern ORDER BY day) AS to_ FROM changes) WHERE action = 'add'),
hit AS (SELECT k.*, s.list, s.rule, s.pattern, s.start_, row_number() OVER (PARTITION BY page_id, url, fetched
      ORDER BY contains(s.pattern, '/') DESC, length(s.pattern) DESC, (s.rule = 'allow') DESC, s.list DESC, s.rule DESC, s.pattern DESC, s.start_ DESC) AS r,
      count(*) OVER (PARTITION BY page_id, url, fetched) AS n
    FROM keys k JOIN spans s ON k.key = s.pattern AND s.start_ <= k.fetched AND (s.to_ IS NULL OR k.fetched < s.to_))
SELECT r.page_id, r.url, r.host, r.fetched, r.copies, coalesce(h.n, 0) AS n_active,
  CASE WHEN r.host = '' THEN 'invalid' WHEN h.rule IS NULL THEN 'unmatched' ELSE h.rule END AS verdict, h.list AS list, h.pattern AS pattern, h.start_ AS since
FROM rows_ r LEFT JOIN (SELECT * FROM hit WHERE r = 1) h ON r.page_id = h.page_id AND r.url = h.url AND r.fetched = h.fetched
"""
