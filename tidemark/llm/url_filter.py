"""Temporal URL filters, with DataFrame operations only.

A list's dated entries say what holds for a key from a day on: a verdict, or null for a removal. They become intervals up to the key's next entry, and a key's
intervals a timeline. A key is a host, which its subdomains match too, or a host and a path prefix that ends in a slash. Each capture is held against the
timelines of its keys: a binary search finds the interval in which it was fetched, so a key's many dates make no more rows. The longest key that has one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, hot_join, small_enough

#: Shares that a hot key's captures are dealt to when the list is too long to broadcast, and the intervals that a list may have to be broadcast (some 100 bytes each).
SALTS, BROADCAST_INTERVALS = 16, 500_000
#: Steps of the binary search: a timeline has at most one interval a day, less than 2**24 of them.
_STEPS = 24


def intervals(entries: DataFrame) -> DataFrame:
    """(key, verdict, valid_from, valid_to) of entries (key, verdict, dated): half-open, valid_to null for the last. Keys are compared in lower case, without dots at
    the host's end. Of a key's entries of one day, a removal holds, else the greater verdict. Entries without key or day are left out."""
    key = F.regexp_replace(F.lower(F.trim("key")), r"^([^/]*?)\.+(/|$)", "$1$2")
    kept = entries.where("key is not null and dated is not null").select(key.alias("key"), "dated", "verdict")
    daily = kept.groupBy("key", "dated").agg(F.when(F.count("verdict") == F.count(F.lit(1)), F.max("verdict")).alias("verdict"))
    until = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    return daily.select("key", "verdict", F.col("dated").alias("valid_from"), until.alias("valid_to")).where("verdict is not null")


def _clean(url: Column) -> Column:
    """In lower case, without blanks and control characters around it or line ends and tabs in it."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", ""))


def host_of(url: Column) -> Column:
    """What a browser would ask: without user and password, port, and dots at the end; backslashes are slashes. Empty for what isn't a URL with a host."""
    authority = F.regexp_extract(_clean(url), r"^[a-z][a-z0-9+.\-]*:[/\\]{2,}([^/\\?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def keys_of(url: Column, labels: int = 127, folders: int = 64, longest: int = 1 << 20) -> Column:
    """The host, its parent domains, and the host with each path prefix that ends in a slash: those with at most so many labels, folders and characters. Null
    without a host."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    path = F.regexp_extract(_clean(url), r"^[a-z][a-z0-9+.\-]*:[/\\]{2,}[^/\\?#]*([/\\][^?#]*)", 1)
    folder = F.split(F.regexp_replace(path, r"\\", "/"), "/", folders + 2)
    count = F.least(F.size(folder) - 1, F.lit(folders))
    prefixes = F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(host, F.array_join(F.slice(folder, 1, i), "/"), F.lit("/")))
    return F.when(host != "", F.array_distinct(F.filter(F.concat(domains, prefixes), lambda k: F.length(k) <= longest)))


def _active(spans: Column, at: Column) -> Column:
    """The verdict of the interval of spans (sorted by valid_from) that at lies in; null if there is none. By a binary search for the last that has begun."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        begun = F.get(spans, middle)["valid_from"] <= at
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(begun, middle + 1).otherwise(s["low"]).alias("low"), F.when(begun, s["high"]).otherwise(middle).alias("high")))

    first = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    begun = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), first, halve, lambda s: s["low"])
    span = F.get(spans, begun - 1)
    return F.when(span["valid_to"].isNull() | (at < span["valid_to"]), span["verdict"])


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All rows and columns of captures (url, fetched) with verdict and matched_key: both null where no entry was active.

    Null or malformed URLs and null times match nothing. Repeated captures are answered as often. Columns verdict and matched_key of captures are replaced.
    A URL's prefixes are worked out as far as the list's longest keys go, so URLs may be of any length. Each pair of URL and day is looked up once.
    """
    kept = [c for c in captures.columns if c not in ("verdict", "matched_key")]
    listed = durable(intervals(entries), "intervals")
    most = listed.agg(F.max(F.size(F.split("key", r"\."))), F.max(F.size(F.split("key", "/"))), F.max(F.length("key"))).first()
    labels, folders, longest = (x or 1 for x in most)
    lines = listed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "verdict"))).alias("spans"))
    known = F.col("url").isNotNull() & F.col("fetched").isNotNull()
    asked = durable(captures.where(known).groupBy("url", "fetched").agg(F.count(F.lit(1)).alias("_rows")), "asked")
    keyed = asked.select("url", "fetched", F.explode(keys_of(F.col("url"), labels, folders, longest)).alias("key"))
    on = ["key"]
    if small_enough(listed, BROADCAST_INTERVALS):
        lines = F.broadcast(lines)
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS)))
        lines = lines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = ["key", "salt"]
    active = keyed.join(lines, on).select("url", "fetched", "key", _active(F.col("spans"), F.col("fetched")).alias("verdict")).where("verdict is not null")
    best = active.groupBy("url", "fetched").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    found = asked.join(best, ["url", "fetched"], "left").select(F.struct("url", "fetched").alias("_asked"), "_rows", F.col("best.verdict").alias("verdict"), F.col("best.key").alias("matched_key"))
    rows = captures.select(kept)
    answered = hot_join(rows.where(known).withColumn("_asked", F.struct("url", "fetched")), durable(found, "found"), "_asked", "_rows")
    nothing = rows.where(~known).select(*kept, F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("matched_key"))
    return answered.select(*kept, "verdict", "matched_key").unionByName(nothing)
