"""URL filters: a temporal join of captures with dated list entries.

A list is a log of changes: at some time an entry is added to or removed from it. Changes become validity
intervals ``[valid_from, valid_to)``, and every capture is evaluated against the entries that were valid
when it was fetched. An entry is a domain (it covers its subdomains), a host, or a host with a first path
segment. An entry on an allow list overrides any block entry.

Time is cut into hours. Captures say which (entry, hour) pairs are asked for; only these get intervals, made of
the hour's own changes and the state at its beginning, which is that of the last earlier hour with a change. So
neither an entry with very many changes nor one with a long life gathers in one place, and an entry that stays on
a list costs nothing in the hours nobody asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import durable

BLOCK, ALLOW = "block", "allow"
ADD, REMOVE = "add", "remove"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and trailing dot; NULL if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def segment(url: Column) -> Column:
    """First path segment of an absolute URL; NULL if it is empty."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1), F.lit(""))


def keys(url: Column) -> Column:
    """All entries that would cover a URL: its host, the domains above it down to two labels, and host
    with first segment. Empty for NULL and for text that is not an absolute URL."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.concat(host(url), F.lit("/"), segment(url))
    return F.when(host(url).isNotNull(), F.array_compact(F.array_distinct(F.concat(domains, F.array(path))))).otherwise(
        F.array().cast("array<string>"))


def _cell(at: Column) -> Column:
    """Number of an hour; it never falls as time goes on, whatever the time zone does."""
    return (F.datediff(at, F.lit("1970-01-01").cast("date")) * 24 + F.hour(at)).cast("long")


def intervals(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """(``list``, ``entry``, ``cell``, ``valid_from``, ``valid_to``) of a log (``list``, ``entry``, ``action``, ``at``)
    in the different (``entry``, ``cell``) pairs of ``asked``.

    NULL as ``valid_from`` means from the beginning of the cell, as ``valid_to`` to its end. Of changes at one
    time a removal wins. Rows with a NULL entry, list, action or time are not changes.
    """
    known = changes.where("list is not null and entry is not null and action is not null and at is not null")
    moments = known.groupBy("list", "entry", "at").agg(F.min(F.col("action") == ADD).alias("on")).withColumn("cell", _cell(F.col("at")))
    ends = moments.groupBy("list", "entry", "cell").agg(F.max_by("on", "at").alias("on"), F.lit(False).alias("asked"))
    wanted = ends.select("list", "entry").distinct().join(asked, "entry").select(
        "list", "entry", "cell", F.lit(None).cast("boolean").alias("on"), F.lit(True).alias("asked"))
    cells = ends.unionByName(wanted).groupBy("list", "entry", "cell").agg(F.max("on").alias("on"), F.max("asked").alias("asked"))
    earlier = Window.partitionBy("list", "entry").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("before", F.last("on", ignorenulls=True).over(earlier)).where("asked and before").select(
        "list", "entry", "cell", F.lit(None).cast(changes.schema["at"].dataType).alias("at"), F.lit(True).alias("on"))
    states = moments.join(asked, ["entry", "cell"], "left_semi").select("list", "entry", "cell", "at", "on").unionByName(carried)
    # The state at the beginning has no time and so comes first.
    order = Window.partitionBy("list", "entry", "cell").orderBy("at")
    return states.withColumn("valid_to", F.lead("at").over(order)).where("on").select(
        "list", "entry", "cell", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    time_col: str = "fetched_at") -> DataFrame:
    """One row per different capture (``id``, ``url``, ``fetched_at``) with ``n_block`` and ``n_allow``, the
    numbers of entries valid at that time that cover it, and ``blocked``.

    Captures with a NULL or relative URL or without a time are covered by nothing. Repeated rows are one
    capture. Empty lists block nothing.
    """
    seen = durable(captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")).distinct())
    asked = seen.withColumn("entry", F.explode_outer(keys(F.col("url")))).withColumn("cell", _cell(F.col("fetched_at")))
    valid = intervals(changes, asked.select("entry", "cell").where("entry is not null and cell is not null").distinct()).alias("v")
    asked = asked.alias("a")
    covers = ((F.col("a.entry") == F.col("v.entry")) & (F.col("a.cell") == F.col("v.cell"))
              & (F.col("v.valid_from").isNull() | (F.col("a.fetched_at") >= F.col("v.valid_from")))
              & (F.col("v.valid_to").isNull() | (F.col("a.fetched_at") < F.col("v.valid_to"))))
    met = asked.join(valid, covers, "left").groupBy("a.id", "a.url", "a.fetched_at").agg(
        F.count(F.when(F.col("v.list") == BLOCK, 1)).alias("n_block"), F.count(F.when(F.col("v.list") == ALLOW, 1)).alias("n_allow"))
    return met.withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))


def page_captures(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Pages with the time of the event of the same number as their time of fetching."""
    return pages.join(events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at")), "page_id", "left")


def page_list_changes(pages: DataFrame, events: DataFrame) -> DataFrame:
    """A change log made of the events about the page whose number is the event's user: errors add and
    sign-ups remove an entry; every fourth event is about the allow list. The entry is the page's domain,
    host, or host with first segment, in turn."""
    turn = F.col("event_id") % 3
    page_host, labels = host(F.col("url")), F.split(host(F.col("url")), r"\.")
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(page_host)
    told = events.where("event_type in ('error', 'signup')").join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id")
    return told.select(
        F.when(F.col("event_id") % 4 == 0, ALLOW).otherwise(BLOCK).alias("list"),
        F.when(turn == 0, domain).when(turn == 1, page_host).otherwise(F.concat(page_host, F.lit("/"), segment(F.col("url")))).alias("entry"),
        F.when(F.col("event_type") == "error", ADD).otherwise(REMOVE).alias("action"), F.col("ts").alias("at"))


FILTER_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages),
told AS (
  SELECT CASE WHEN e.event_id % 4 = 0 THEN 'allow' ELSE 'block' END AS list, e.ts AS since, e.event_type = 'error' AS adds,
         CASE e.event_id % 3 WHEN 0 THEN CASE WHEN len(string_split(p.host, '.')) > 2 THEN array_to_string(string_split(p.host, '.')[-2:], '.') ELSE p.host END
                             WHEN 1 THEN p.host ELSE p.host || '/' || p.segment END AS entry
  FROM events e JOIN parsed p ON p.page_id = e.user_id WHERE e.event_type IN ('error', 'signup')),
moments AS (SELECT list, entry, since, bool_and(adds) AS adds FROM told WHERE entry IS NOT NULL AND since IS NOT NULL GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, entry ORDER BY since) AS until FROM moments),
captures AS (SELECT DISTINCT p.page_id, p.url, p.host, p.segment, e.ts AS fetched_at FROM parsed p LEFT JOIN events e ON e.event_id = p.page_id),
keyed AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    [host || '/' || segment])) AS entry
  FROM captures WHERE host IS NOT NULL),
met AS (
  SELECT k.page_id, k.url, k.fetched_at, s.list FROM keyed k JOIN spans s
    ON k.entry = s.entry AND s.adds AND k.fetched_at >= s.since AND (s.until IS NULL OR k.fetched_at < s.until))
SELECT c.page_id AS id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at, count(*) FILTER (m.list = 'block') AS n_block, count(*) FILTER (m.list = 'allow') AS n_allow,
       count(*) FILTER (m.list = 'block') > 0 AND count(*) FILTER (m.list = 'allow') = 0 AS blocked
FROM captures c LEFT JOIN met m ON c.page_id IS NOT DISTINCT FROM m.page_id AND c.url IS NOT DISTINCT FROM m.url
  AND c.fetched_at IS NOT DISTINCT FROM m.fetched_at
GROUP BY c.page_id, c.url, c.fetched_at
"""
