"""Upserts, staleness, cache lookups, recovery, schema growth and archiving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.ranking import last_before

KEY = ["case_id", "variable"]


def review_history(actions: DataFrame) -> DataFrame:
    """Every action with the value before and after it; defer keeps the value, reset removes it."""
    value = lambda v: F.struct(v.alias("v"))
    own = (F.when(F.col("action") == "reset", value(F.lit(None).cast("string"))).when(F.col("action") == "clear", value(F.lit("")))
           .when(F.col("action") != "defer", value(F.col("value"))))
    df = last_before(actions, KEY, "id", {"held": own, "previous": F.col("action")})
    old = F.when(F.col("previous") == "defer", F.coalesce("held.v", F.lit(""))).otherwise(F.col("held.v"))
    new = F.when(F.col("action") == "defer", F.coalesce(old, F.lit(""))).otherwise(own["v"])
    return df.withColumns({"old_value": old, "new_value": new}).drop("held", "previous", "value")


def review_current(history: DataFrame) -> DataFrame:
    """Current review per case and variable: the last action wins, a reset leaves none."""
    last = history.groupBy(*KEY).agg(F.max(F.struct("id", "action", "new_value", "reviewer")).alias("l"))
    name = F.col("l.action")
    action = F.when(name == "accept", "accepted").when(name == "edit", "edited").when(name == "clear", "cleared").otherwise("deferred")
    return last.where(name != "reset").select(*KEY, F.col("l.id").alias("id"), action.alias("action"), F.col("l.new_value").alias("value"), F.col("l.reviewer").alias("reviewer"))


def stale_propagation(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Results that cite an excluded or irrelevant source become stale, with the reason; already stale ones stay as they are."""
    bad = sources.where("excluded OR relevance_status = 'irrelevant'").select(F.col("source_id").alias("cited"))
    cites = results.where("NOT stale").select("id", F.explode("evidence_sources").alias("cited"))
    hit = cites.join(bad, "cited").groupBy("id").agg(F.min("cited").alias("cited"))
    return results.join(hit, "id").select("id", *KEY, F.concat(F.lit("cites excluded source S"), "cited").alias("stale_reason"))


def affected_variables(stale: DataFrame) -> DataFrame:
    return stale.groupBy("case_id", "variable").agg(F.count("*").alias("results"))


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(request_id, keys array in order of preference) -> first stored reply and how it was found."""
    keys = requests.select("request_id", F.posexplode("keys").alias("tier", "cache_key"))
    hit = keys.join(cache, "cache_key").groupBy("request_id").agg(F.min(F.struct("tier", "cache_key", "reply_id")).alias("h"))
    label = F.when(F.col("h").isNull(), "new").when(F.col("h.tier") == 0, "hit").when(F.col("h.tier") <= 2, "legacy_v2_hit").otherwise("legacy_hit")
    return requests.select("request_id").join(hit, "request_id", "left").select("request_id", label.alias("cache_status"), F.col("h.reply_id").alias("reply_id"))


def in_flight_recovery(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with the interrupted ones marked, and the worst-case usage rows to append for them."""
    sending = F.col("status") == "sending"
    marked = calls.withColumn("status", F.when(sending, "interrupted_possibly_billed").otherwise(F.col("status")))
    usage = calls.where(sending).select("case_id", F.lit("model").alias("kind"), "provider", F.col("worst_cost").alias("cost_usd"), F.lit(True).alias("estimated"),
                                        F.col("id").alias("call_id"))
    return marked, usage


def schema_evolve(old: DataFrame, wanted: T.StructType) -> DataFrame:
    """Add the missing columns as null; existing columns are not touched and a second run changes nothing."""
    have = set(old.columns)
    return old.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in have])


def merge_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def archive(rows: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the others packed as JSON with their id."""
    test = F.coalesce(predicate, F.lit(False))
    packed = rows.where(test).select("id", F.to_json(F.struct(*rows.columns)).alias("row_json"))
    return rows.where(~test), packed


def restore(kept: DataFrame, packed: DataFrame) -> DataFrame:
    """Archived rows back in their table; ids that exist again are left alone."""
    rows = packed.join(kept.select("id"), "id", "left_anti").select(F.from_json("row_json", kept.schema).alias("r")).select("r.*")
    return kept.unionByName(rows)
