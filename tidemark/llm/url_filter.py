"""URL filters as a temporal list join, in DataFrame functions only.

List entries are dated: (key, list, action, at) adds or removes a key at a time. A key is a host (``example.com``; covers its subdomains) or a
host with a path prefix that ends at a slash (``example.com/ads/``). ``intervals`` turns the entries of a (key, list) into validity intervals [from, to)
that don't overlap. ``judge`` explodes a capture into the keys that could cover it, joins them with the
intervals on key and month, and keeps what was active at fetch time: an as-of join with no more than a few candidates a row. Intervals are cut at month bounds up
to the last capture, so that a key with a long history is many small groups; captures of one busy host are spread over months, and beyond that the planner
splits skewed partitions, as nothing here needs the rows of a key together.

A capture takes the most specific entry (the longest key); among equals an allowing list goes before a blocking one, then the name of the list decides.

Defined cases: a null or hostless url, or a null fetch time, matches nothing; hosts are compared in lower case without port, user and a final dot; repeated add or
remove entries have no effect, and of entries with equal time removes count first; entries with a null in key, list, action or time are ignored; repeated captures
give a row each; extra columns pass through ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH = "month"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, or null."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1))
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def keys_of(url: Column) -> Column:
    """All list keys that cover a URL: its host, parent domains of two labels or more, and the host with each directory of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    parts = F.split(F.regexp_extract(path, r"^/(.*)/[^/]*$", 1), "/")
    parts = F.when(F.length(path) > 1, F.filter(parts, lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.array_distinct(F.concat(domains, F.when(F.size(parts) > 0, dirs).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, allow, from, to) from entries (key, list, allow, action, at); to is null while the entry holds."""
    known = entries.where("key is not null and list is not null and action in ('add', 'remove') and at is not null").withColumn("allow", F.coalesce("allow", F.lit(False)))
    # of entries with equal key and time the additions count: removes first
    one = known.groupBy("key", "list", "at").agg(F.max(F.col("action") == "add").alias("add"), F.max("allow").alias("allow"))
    w = Window.partitionBy("key", "list").orderBy("at")
    turns = one.withColumn("before", F.lag("add").over(w)).where("add != coalesce(before, false)")
    ends = turns.withColumn("to", F.lead("at").over(w))
    return ends.where("add").select("key", "list", "allow", F.col("at").alias("from"), "to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, blocked, key, list, since) for every capture (url, fetched_at), the row as a struct; key, list and since are null where no entry holds."""
    rows = captures.select(F.struct(*[captures[c] for c in captures.columns]).alias("row"), captures["url"].alias("url"), captures["fetched_at"].alias("at"))
    asked = rows.select("url", "at").where("at is not null").distinct().withColumn("keys", keys_of(F.col("url"))).where("keys is not null")
    span = asked.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    held = intervals(entries).crossJoin(F.broadcast(span))  # one row: the time range of all captures
    held = held.where("lo is not null and from <= hi and (to is null or to > lo)")
    first, last = F.date_trunc(MONTH, F.greatest("from", "lo")), F.date_trunc(MONTH, F.least(F.coalesce("to", "hi"), F.col("hi")))
    held = held.withColumn(MONTH, F.explode(F.sequence(first, last, F.expr("interval 1 month")))).drop("lo", "hi")
    wanted = asked.select("url", "at", F.explode("keys").alias("key")).withColumn(MONTH, F.date_trunc(MONTH, "at"))
    hit = wanted.join(held, ["key", MONTH]).where("from <= at and (to is null or at < to)")
    rank = F.struct(F.length("key").alias("size"), F.col("allow").alias("allow"), F.col("list").alias("list"), F.col("key").alias("key"), F.col("from").alias("since"))
    best = hit.groupBy("url", "at").agg(F.max(rank).alias("best"))
    both = rows.join(best, ["url", "at"], "left")
    return both.select("row", F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"), F.col("best.key").alias("key"), F.col("best.list").alias("list"), F.col("best.since").alias("since"))
