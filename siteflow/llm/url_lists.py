"""URL filters over dated lists.

A list is a log of dated entries: (key, action, date), action ``block``, ``allow`` or ``remove``, key a host, a parent
domain or host/path prefix. Each entry holds from its date until the key's next entry (validity intervals). A capture
asks for all keys that cover its URL; the as-of join finds the entry of each key that is active at fetch time, and
the longest key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, tick

#: Above this many bytes the intervals are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 8 << 20


def url_host(url: Column) -> Column:
    """Lower-case host without port and user; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def keys_of(host: Column, path: Column) -> Column:
    """The host, its parent domains of two labels at least, and the host with each leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): until is exclusive, null while the entry holds. Of entries of one key and date the
    last by action (remove over block over allow) counts; entries without key, action or date are left out."""
    good = entries.where("key is not null and action is not null and date is not null")
    one = good.groupBy("key", "date").agg(F.max("action").alias("action"))
    until = F.lead("date").over(Window.partitionBy("key").orderBy("date"))
    return one.select("key", "action", F.col("date").alias("since"), until.alias("until")).where("action != 'remove'")


def filter_captures(captures: DataFrame, entries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add host, blocked, decided_by and active_since to captures(url, fetched), by the entries active at fetch time.

    The longest matching key decides; a tie in length goes to allow, then to the lesser key. Null or odd URLs and null
    times match nothing. Rows are kept as they are, repeats too; columns of the new names are replaced.
    """
    new = ("host", "blocked", "decided_by", "active_since")
    captures = captures.select(*map(tick, others(captures, *new)))
    spans = intervals(entries)
    # one row for each key and its whole history: joins by key give one row for each capture and key
    history = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("since", "until", "action"))).alias("__spans"))
    # captures of one URL and time ask once: hot hosts and repeats shrink before anything is dealt out by key
    asked = captures.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    asked = asked.withColumn("__host", url_host(F.col("url")))
    rows = asked.select("url", "fetched", F.explode(keys_of(F.col("__host"), url_path(F.col("url")))).alias("key"))
    size = history.select(F.sum(F.length("key") + 40 * F.size("__spans"))).first()[0] or 0
    joined = rows.join(F.broadcast(history) if size <= broadcast_bytes else history, "key")
    active = F.filter("__spans", lambda s: (s.since <= F.col("fetched")) & (s.until.isNull() | (s.until > F.col("fetched"))))
    hits = joined.withColumn("__hit", F.get(active, F.lit(0))).where("__hit is not null")
    best = hits.groupBy("url", "fetched").agg(F.min(F.struct((-F.length("key")).alias("n"), F.col("__hit.action").alias("action"), F.col("key"), F.col("__hit.since").alias("since"))).alias("__best"))
    out = captures.join(best, ["url", "fetched"], "left")
    return out.select(*map(tick, captures.columns), url_host(F.col("url")).alias("host"), F.coalesce(F.col("__best.action") == "block", F.lit(False)).alias("blocked"), F.col("__best.key").alias("decided_by"), F.col("__best.since").alias("active_since"))
