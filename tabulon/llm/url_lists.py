"""URL filter by a temporal join with dated list entries.

A list is a log of dated events: an entry is added or removed.  The events of
an entry become validity intervals, and each capture is held against the
entries that were active when it was fetched.

An entry is a domain (``example.com``, which covers its subdomains) or a host
with a directory (``www.example.com/ads/``, which covers what lies below).  A
capture has one key for each parent domain and each directory of its URL, so
the join is an equality on the key; a hash of the capture salts the key, as one
host may hold a third of all captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.registry import query, table

SALTS = 16
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def list_keys(url: Column) -> Column:
    """Keys of a URL: its host and parent domains, and its host with each directory."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(F.regexp_extract(url, _PATH, 1), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))),
                          lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, folders)))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) from events (entry, action, at).

    ``action`` is ``add`` or ``remove``; of several events of an entry at one
    time the removal holds.  An interval ends where the next event of its entry
    begins and is open (null) after the last; rows with a null are left out.
    """
    firm = events.select("entry", "action", "at").na.drop()
    state = firm.groupBy("entry", "at").agg(F.max("action").alias("action"))  # "remove" sorts after "add"
    log = state.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("at", "action"))).alias("log"))
    spans = F.transform("log", lambda e, i: F.struct(
        e["at"].alias("valid_from"), F.get(F.col("log"), i + 1)["at"].alias("valid_to"), e["action"].alias("action")))
    return (log.select("entry", F.explode(spans).alias("s")).where(F.col("s.action") == "add")
            .select("entry", "s.valid_from", "s.valid_to"))


def filter_captures(
    captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at",
    salts: int = SALTS,
) -> DataFrame:
    """One row per distinct (key, url, fetch time) with what the list said then.

    Adds ``host``, ``n_entries`` (active entries that cover it), ``entry`` (the
    longest of them, the first in order on ties) and ``blocked``.  A null or
    malformed URL and a null fetch time are covered by nothing.  Repeated rows
    give one row; other columns are not read.  An empty list blocks nothing.
    """
    rows = captures.select(F.col(key).alias("__k"), F.col(url).alias("__u"), F.col(fetched).alias("__t")).distinct()
    salted = rows.where(F.col("__t").isNotNull()).select(
        "*", F.explode(list_keys(F.col("__u"))).alias("entry"),
        F.pmod(F.xxhash64("__k", "__u", "__t"), F.lit(salts)).alias("__s"))
    spans = validity_intervals(events).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    active = (F.col("valid_from") <= F.col("__t")) & (F.col("valid_to").isNull() | (F.col("__t") < F.col("valid_to")))
    hits = (salted.join(spans, ["entry", "__s"]).where(active).groupBy("__k", "__u", "__t")
            .agg(F.count("*").alias("n_entries"), F.min(F.struct(-F.length("entry"), "entry")).alias("__e")))
    hits = hits.withColumnsRenamed({"__k": "__hk", "__u": "__hu", "__t": "__ht"})
    same = (F.col("__k").eqNullSafe(F.col("__hk")) & F.col("__u").eqNullSafe(F.col("__hu"))
            & F.col("__t").eqNullSafe(F.col("__ht")))
    return rows.join(hits, same, "left").select(
        F.col("__k").alias(key), F.col("__u").alias(url), F.col("__t").alias(fetched), host_of(F.col("__u")).alias("host"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.col("__e.entry").alias("entry"),
        F.col("n_entries").isNotNull().alias("blocked"))


def _digit(column: str, at: int) -> Column:
    return F.conv(F.substring(F.md5(F.col(column)), at, 2), 16, 10).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, which carry no list of their own.

    By a hash of the name, a part of the parent domains and of the first
    directories is added on some day of 2024, a part of those is removed 60
    days later and added again after another 120.
    """
    host = F.when(F.col("host").isNotNull(), F.col("host"))
    named = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", _PATH, 1).alias("path"))
    named = named.where(host.isNotNull())
    parent = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    folder = F.concat("host", F.lit("/"), F.get(F.split("path", "/"), F.lit(1)), F.lit("/"))
    deep = F.size(F.split("path", "/")) > 2
    three = F.size(F.split("host", r"\.")) >= 3
    names = (named.where(three).select(parent.alias("entry")).union(named.where(deep).select(folder.alias("entry")))
             .distinct().where(_digit("entry", 1) < 96))
    start = F.date_add(F.to_date(F.lit("2024-01-01")), _digit("entry", 3))
    again = F.array(F.struct(F.lit("add").alias("action"), start.alias("at")),
                    F.struct(F.lit("remove").alias("action"), F.date_add(start, 60).alias("at")),
                    F.struct(F.lit("add").alias("action"), F.date_add(start, 180).alias("at")))
    events = F.slice(again, F.lit(1), 1 + F.pmod(_digit("entry", 5), F.lit(3)))
    return names.select("entry", F.explode(events).alias("e")).select("entry", "e.action", "e.at")


@query("op10_url_lists", """
    WITH p AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS t,
            regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)),
                           '\\.+$', '') AS h,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
    q AS (SELECT page_id, url, t, nullif(h, '') AS host, string_split(h, '.') AS labels,
            string_split(path, '/') AS steps FROM p),
    k AS (SELECT DISTINCT page_id, url, t, unnest(list_concat(
            list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
            list_transform(range(1, greatest(len(steps), 2)),
                           lambda i: host || array_to_string(steps[1:i], '/') || '/'))) AS entry
          FROM q WHERE host IS NOT NULL),
    names AS (SELECT array_to_string(labels[-3:], '.') AS entry FROM q WHERE host IS NOT NULL AND len(labels) >= 3
              UNION SELECT host || '/' || steps[2] || '/' FROM q WHERE host IS NOT NULL AND len(steps) > 2),
    drawn AS (SELECT entry, DATE '2024-01-01' + CAST(('0x' || substr(md5(entry), 3, 2)) AS INTEGER) AS d,
                1 + CAST(('0x' || substr(md5(entry), 5, 2)) AS INTEGER) % 3 AS n
              FROM names WHERE CAST(('0x' || substr(md5(entry), 1, 2)) AS INTEGER) < 96),
    spans AS (SELECT entry, d AS a, CASE WHEN n > 1 THEN d + 60 END AS b FROM drawn
              UNION ALL SELECT entry, d + 180, NULL FROM drawn WHERE n = 3),
    hits AS (SELECT page_id, url, t, count(*) AS n, arg_min(entry, (-length(entry), entry)) AS entry
             FROM k JOIN spans USING (entry) WHERE a <= t AND (b IS NULL OR t < b) GROUP BY page_id, url, t)
    SELECT page_id, q.url AS url, CAST(q.t AS VARCHAR) AS fetched_at, host, coalesce(n, 0) AS n_entries, entry,
           n IS NOT NULL AS blocked
    FROM q LEFT JOIN hits USING (page_id, url, t)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    found = filter_captures(pages.withColumn("fetched_at", day), dated_list(pages))
    return found.withColumn("fetched_at", F.col("fetched_at").cast("string"))
