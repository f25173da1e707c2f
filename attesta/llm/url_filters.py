"""Judging captures by the block-list entries that were active when they were fetched.

List entries are dated: an entry says that from its date on, a host (with all its sub-hosts) or a host and path prefix is
blocked or allowed. Entries of one pattern become validity intervals, each ending where the next begins. A capture meets
the entries of its host, of the hosts above it and of its path prefixes as of its fetch time; the most specific active
entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.shared import shared_table

PERIOD_SECONDS = 30 * 86400


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user, port and a closing dot; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path of an address without query and fragment; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def patterns(host: Column, path: Column, path_parts: int | None = None) -> Column:
    """Patterns a capture can meet, most specific first: host with path prefixes (whole parts), host, hosts above it."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts) if path_parts is None else F.least(F.size(parts), F.lit(path_parts))
    below = F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), i))))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(below, above))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, action, category, valid_from, valid_to) from dated entries (pattern, listed_at, action, category).

    Times are seconds. Of entries with the same pattern and time the last by (action, category) counts. Entries without
    pattern or time are never active. valid_to is null for the newest entry of a pattern. Hosts are lower-cased, paths are not.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substring("pattern", F.length(host) + 1, F.length("pattern")))
    one = entries.where("pattern IS NOT NULL AND listed_at IS NOT NULL").groupBy(pattern.alias("pattern"), "listed_at").agg(
        F.max(F.struct("action", "category")).alias("last"))
    following = F.lead("listed_at").over(W.partitionBy("pattern").orderBy("listed_at"))
    return one.select("pattern", "last.action", "last.category", F.col("listed_at").alias("valid_from"), following.alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, path_parts: int | None = None) -> DataFrame:
    """Per capture: page_id, host, fetched_at, pattern, action, category (of the deciding entry, null where none), blocked.

    captures has page_id, url, fetched_at. A capture without a host or fetch time meets no entry and is not blocked; an
    empty list blocks nothing; repeated captures are judged one by one. An entry is active from its own second on.

    The as-of join runs on pattern and period: an interval is listed under each period it touches, so a capture is
    compared only with the few intervals of its own period however often a hot host is listed. Only captures that meet
    an entry take part in the choice of the most specific one.
    """
    seen = shared_table(captures.select(
        F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "fetched_at"), "captures")
    period = F.floor(F.col("fetched_at") / PERIOD_SECONDS)
    asked = seen.where("fetched_at IS NOT NULL").select("row", "fetched_at", period.alias("period"), F.posexplode(patterns(F.col("host"), F.col("path"), path_parts)).alias("rank", "pattern"))
    latest = seen.agg(F.max("fetched_at")).first()[0]
    from_period = F.floor(F.col("valid_from") / PERIOD_SECONDS)
    to_period = F.greatest(F.floor((F.coalesce(F.col("valid_to"), F.lit((latest or 0) + 1)) - 1) / PERIOD_SECONDS), from_period)
    active = shared_table(intervals(entries).select("*", F.explode(F.sequence(from_period, to_period)).alias("period")), "intervals")
    met = asked.join(active, ["pattern", "period"]).where(
        (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    chosen = met.groupBy("row").agg(F.min(F.struct("rank", "pattern", "action", "category")).alias("entry"))
    return seen.join(chosen, "row", "left").select(
        "page_id", "host", "fetched_at", "entry.pattern", "entry.action", "entry.category", F.coalesce(F.col("entry.action") == "block", F.lit(False)).alias("blocked"))
