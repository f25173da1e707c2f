"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, gone through up to ``epochs`` times. A document's
virtual finish time is the number of words its queue has served up to and including it, divided by the source's weight.
All queues are merged by finish time and cut where the words reach the budget. A queue that runs out leaves its share to
the others, which is just how targets above ``epochs`` times a source's size are reshared.

Nothing is sorted in one place: running sums are taken inside (source, shuffle bucket) and inside ranges of finish time,
with offsets from one combined sum per bucket or range, so a source holding a third of all rows is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.shared import shared_table, source_rank
from attesta.llm.words import count_words

WEIGHTS = (5, 2, 1)
TIME_RANGES = 4096


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = 2) -> DataFrame:
    """Adds source_rank, weight, target, budget and the latest finish time to one row (source, source_size) per source.

    Water filling: ordered by how much virtual time a source can last, the sources that run out are a leading part of the
    list; the rest share what those leave, by weight.
    """
    ranked = source_rank(source_sizes)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    by_last = W.orderBy(F.col("cap") / F.col("weight"), "source_rank")  # one row per source
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_last.rowsBetween(W.unboundedPreceding, -1)
    filled = ranked.select(
        "*", (F.sum("source_size").over(whole) * percent / 100.0).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    runs_out = F.col("cap") / F.col("weight") <= level
    open_level = F.min(F.when(~runs_out, F.struct(F.col("cap") / F.col("weight"), "source_rank", level.alias("level")))).over(whole)["level"]
    target = F.when(runs_out, F.col("cap").cast("double")).otherwise(F.col("weight") * open_level)
    latest = F.max(F.col("cap") / F.col("weight")).over(whole)
    return filled.select("source", "source_rank", "source_size", "weight", target.alias("target"), "budget", latest.alias("latest"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Running sum of a value through the buckets of a group, the row included."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    earlier = (W.partitionBy(*group) if group else W.partitionBy()).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_inside", F.sum(value).over(inside)).join(F.broadcast(offsets) if not group else offsets, [*group, bucket]).withColumn(
        out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def _shuffle_key(seed: int) -> Column:
    """Hexadecimal digest that orders a queue; its first three digits are the shuffle bucket."""
    return F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = 2, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size counts the words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: 0); taken is size times how often the mix takes
    the document (0 to ``epochs``). A null source is a source of its own, ranked last; a document without words takes
    nothing. Repeated rows are queued one by one. An empty table gives no rows. The order depends on doc_id, size and
    ``seed`` only, so reruns agree.
    """
    sized = shared_table(
        count_words(documents.select("doc_id", "source", "text")).select(
            "doc_id", "source", "size", _shuffle_key(seed).alias("shuffle_key"),
            F.monotonically_increasing_id().alias("row")), "sized")
    plan = shared_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs), "targets")
    served = sized.where("size > 0").join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"]).select(
        "row", "doc_id", "size", "shuffle_key", "source_rank", "source_size", "weight", "budget", "latest",
        F.substring("shuffle_key", 1, 3).alias("bucket"))
    queued = _running(served, ["source_rank"], "bucket", [F.col("shuffle_key"), F.col("doc_id"), F.col("row")], "size", "served")
    turns = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).select(
        "row", "size", "source_rank", "epoch", "budget", "latest", ((F.col("served") + F.col("epoch") * F.col("source_size")) / F.col("weight")).alias("finish"))
    ranged = turns.withColumn("finish_range", F.least(F.floor(F.col("finish") / F.col("latest") * TIME_RANGES), F.lit(TIME_RANGES - 1))).drop("latest")
    ranged = shared_table(ranged, "turns")
    merged = _running(ranged, [], "finish_range", [F.col("finish"), F.col("source_rank"), F.col("epoch"), F.col("row")], "size", "position")
    # the word at the budget belongs to the turn that crosses it: take the turn if most of it lies below
    used = merged.where(F.col("position") - F.col("size") / 2.0 <= F.col("budget")).groupBy("row").agg(F.sum("size").alias("taken"))
    return (
        sized.join(used, "row", "left").join(plan, sized["source"].eqNullSafe(plan["source"]))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
