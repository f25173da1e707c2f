"""Ordered logic per case: budgets, repeated errors, numbering, resuming and timelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.operators.ranking import full_rank, last_before
from attesta.session import cut_lineage


ADMISSION_BLOCK_ROWS = 100_000
STATE = ["spent", "spent_b", "tries", "tries_b"]


@dataclass(frozen=True)
class Limits:
    """What a case may spend and try, in all and with provider B."""

    cap: float = fixed.CASE_BUDGET_USD
    cap_b: float = fixed.PROVIDER_B_BUDGET_USD
    max_attempts: int = fixed.MAX_ATTEMPTS_PER_CASE
    max_attempts_b: int = fixed.MAX_PROVIDER_B_ATTEMPTS

    def refusal(self, is_b: Column, cost: Column, state: Callable[[str], Column]) -> Column:
        """Why a call of this cost is refused in this state; null if it fits."""
        return (
            F.when(state("spent") + cost > self.cap + 1e-9, "case budget")
            .when(is_b & (state("spent_b") + cost > self.cap_b + 1e-9), "provider budget")
            .when(is_b & (state("tries_b") >= self.max_attempts_b), "provider attempt limit")
            .when(state("tries") >= self.max_attempts, "attempt limit"))

    def why(self, is_b: bool, cost: float, state: tuple[float, float, int, int]) -> str:
        """The refusal of a single call that does not fit."""
        spent, spent_b, _, tries_b = state
        if spent + cost > self.cap + 1e-9:
            return "case budget"
        if is_b and spent_b + cost > self.cap_b + 1e-9:
            return "provider budget"
        return "provider attempt limit" if is_b and tries_b >= self.max_attempts_b else "attempt limit"

    def admit(self, is_b: list[bool], cost: list[float], state: tuple[float, float, int, int]) -> Iterator[tuple[int, tuple]]:
        """(place, state after it) of every call that is admitted, calls in order."""
        spent, spent_b, tries, tries_b = state
        for i, (b, c) in enumerate(zip(is_b, cost)):
            if tries >= self.max_attempts:
                return
            if spent + c > self.cap + 1e-9 or (b and (spent_b + c > self.cap_b + 1e-9 or tries_b >= self.max_attempts_b)):
                continue
            spent, tries = spent + c, tries + 1
            if b:
                spent_b, tries_b = spent_b + c, tries_b + 1
            yield i, (spent, spent_b, tries, tries_b)


def _blocks(calls: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(calls with ``block``, one row per case and block with the least cost of either kind of provider).

    Blocks are runs of a case's ids with at most 2 * block_rows rows: short runs of ids are counted, and as many
    neighbouring ones as hold about block_rows rows make a block.
    """
    least = [F.min(F.when(F.col("is_b") == b, F.col("cost"))).alias(n) for b, n in ((False, "least_a"), (True, "least_b"))]
    short = calls.withColumn("run", F.floor(F.col("id") / block_rows))
    runs = short.groupBy("case_id", "run").agg(F.count("*").alias("rows"), *least)
    so_far = F.sum("rows").over(W.partitionBy("case_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    runs = cut_lineage(runs.withColumn("block", F.floor(F.coalesce(so_far, F.lit(0)) / block_rows)))
    blocks = runs.groupBy("case_id", "block").agg(F.min("least_a").alias("least_a"), F.min("least_b").alias("least_b"))
    return short.join(runs.select("case_id", "run", "block"), ["case_id", "run"]).drop("run"), blocks


def budget_admission(requests: DataFrame, cap: float = fixed.CASE_BUDGET_USD, cap_b: float = fixed.PROVIDER_B_BUDGET_USD,
                     max_attempts: int = fixed.MAX_ATTEMPTS_PER_CASE, max_attempts_b: int = fixed.MAX_PROVIDER_B_ATTEMPTS,
                     block_rows: int = ADMISSION_BLOCK_ROWS) -> DataFrame:
    """(case_id, id, reason): requests in order; one that does not fit is refused (reason) and the next is still tried.

    Each decision depends on the ones before it, but at most ``max_attempts`` requests of a case are ever admitted, and
    only those change the state. So a case's log is cut into blocks that know their least cost per kind of provider. Each round
    jumps, for all cases at once, to the next block that has a request that still fits, and reads only that block in
    order; every round admits at least one request of each case that is not finished. In the end every request is
    decided by itself from the state that the last admitted request before it left. No task reads more than a block of a case.

    An unknown cost counts as nothing. Jobs run while the frame is built (two per round, two rounds where cases are
    shorter than a block).
    """
    limits = Limits(cap, cap_b, max_attempts, max_attempts_b)
    calls = requests.select("case_id", "id", F.coalesce(F.col("provider") == fixed.PROVIDER_B, F.lit(False)).alias("is_b"), F.coalesce("worst_cost", F.lit(0.0)).cast("double").alias("cost"))
    calls, blocks = (cut_lineage(part) for part in _blocks(calls, block_rows))
    found = "case_id long, block long, id long, spent double, spent_b double, tries long, tries_b long"

    def read_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, state = None, None
        for batch in batches:
            rows = []
            for case_id, part in batch.groupby("case_id", sort=False):
                if case_id != case:
                    case, state = case_id, tuple(part[STATE].iloc[0])
                ids, block = part["id"].tolist(), int(part["block"].iloc[0])
                for i, state in limits.admit(part["is_b"].tolist(), part["cost"].tolist(), state):
                    rows.append((case_id, block, ids[i], *state))
            yield pd.DataFrame(rows, columns=["case_id", "block", "id", *STATE])

    nothing = [F.lit(0.0).alias("spent"), F.lit(0.0).alias("spent_b"), F.lit(0).cast("long").alias("tries"), F.lit(0).cast("long").alias("tries_b")]
    state = blocks.select("case_id", F.lit(-1).cast("long").alias("at"), *nothing).distinct()
    rounds = []
    while True:
        ahead = blocks.join(state, "case_id").where("block > at")
        fits = [(F.col(least).isNotNull() & limits.refusal(F.lit(b), F.col(least), F.col).isNull()) for b, least in ((False, "least_a"), (True, "least_b"))]
        # one block per case at most
        chosen = cut_lineage(ahead.where(fits[0] | fits[1]).groupBy("case_id", *STATE).agg(F.min("block").alias("block")))
        if chosen.isEmpty():
            break
        rows = calls.join(chosen, ["case_id", "block"]).repartition("case_id").sortWithinPartitions("case_id", "id")
        rounds.append(cut_lineage(rows.mapInPandas(read_blocks, found)))
        state = rounds[-1].groupBy("case_id").agg(F.max_by(F.struct(F.col("block").alias("at"), *STATE), "tries").alias("s")).select("case_id", "s.*")
    admitted = rounds[0] if rounds else blocks.select("case_id", "block", F.lit(None).cast("long").alias("id"), *nothing).where("false")
    for more in rounds[1:]:
        admitted = admitted.unionByName(more)
    # at most max_attempts requests of a case
    inside = admitted.groupBy("case_id", "block").agg(F.sort_array(F.collect_list(F.struct("id", *STATE))).alias("inside"))
    earlier = W.partitionBy("case_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blank = F.struct(F.lit(None).cast("long").alias("id"), *nothing)
    known = blocks.select("case_id", "block").join(inside, ["case_id", "block"], "left").withColumn("entry", F.coalesce(F.last(F.element_at("inside", -1), ignorenulls=True).over(earlier), blank))
    decided = calls.join(known, ["case_id", "block"])
    before = F.filter(F.coalesce("inside", F.array().cast(known.schema["inside"].dataType)), lambda a: a["id"] < F.col("id"))
    decided = decided.withColumn("before", F.coalesce(F.try_element_at(before, F.lit(-1)), F.col("entry")))
    return decided.select("case_id", "id", limits.refusal(F.col("is_b"), F.col("cost"), lambda n: F.col("before")[n]).alias("reason"))


def repeat_error_abort(calls: DataFrame) -> DataFrame:
    """(run_id, id, outcome): after the same client error twice in a row the run's later calls are not sent.

    The signature of the last failed call is carried over calls that succeed.
    """
    df = last_before(calls.select("run_id", "id", "error_signature"), ["run_id"], "id", {"last_error": F.col("error_signature")})
    twice = F.col("error_signature").startswith("HTTP 4") & (F.col("error_signature") == F.col("last_error"))
    stop = df.where(twice).groupBy("run_id").agg(F.min("id").alias("stop_id"))
    late = F.coalesce(F.col("id") > F.col("stop_id"), F.lit(False))
    return df.join(stop, "run_id", "left").select(
        "run_id", "id", F.when(late, "not sent").when(F.col("error_signature").isNotNull(), "failed").otherwise("sent").alias("outcome"))


def sequence_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, prefix) -> the next free PREFIXnn after the highest number in use, in the order of the keys.

    A code in use belongs to a known prefix that is followed by digits only, two at least, so numbers beyond 99 count.
    """
    known = new.select("prefix").distinct()
    tails = F.regexp_extract("case_code", r"(\d*)$", 1)
    splits = existing.select("case_code", F.explode(F.when(F.length(tails) >= 2, F.sequence(F.lit(2), F.length(tails)))).alias("digits"))
    used = splits.select(
        F.col("case_code").substr(F.lit(1), F.length("case_code") - F.col("digits")).alias("prefix"), F.col("case_code").substr(-F.col("digits"), F.col("digits")).alias("tail"),
    ).where((F.length("tail") == 2) | ~F.col("tail").startswith("0")).join(known, "prefix", "left_semi").groupBy("prefix").agg(
        F.max(F.expr("try_cast(tail AS BIGINT)")).alias("used"))
    placed = full_rank(new, ["prefix"], [("block", F.floor(F.col("key") / 100_000))], [F.col("key")], "place")
    number = F.col("place") + F.coalesce("used", F.lit(0))
    return placed.join(used, "prefix", "left").select("key", F.concat("prefix", F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(2)), F.lit("0"))).alias("case_code"))


def resume_todo(results: DataFrame) -> DataFrame:
    """Variables whose newest result in a group is 'stopped'."""
    return results.groupBy("group_id", "provider", "variable").agg(F.max_by("status", "id").alias("status")).where("status = 'stopped'").drop("status")


def variable_history(results: DataFrame, history: DataFrame) -> DataFrame:
    """Suggestions and then reviews of each variable as one timeline, numbered within the variable in two levels, so a
    variable with a very long history is not sorted by one task."""
    s = results.select("case_id", "variable", F.lit("suggestion").alias("event"), "id", "value", F.col("status").alias("what"))
    r = history.select("case_id", "variable", F.lit("review").alias("event"), "id", "value", F.col("action").alias("what"))
    coarse = [("later", (F.col("event") == "review").cast("int")), ("block", F.floor(F.col("id") / 100_000))]
    return full_rank(s.unionByName(r), ["case_id", "variable"], coarse, [F.col("id")], "step")
