"""Streaming twins of the ledger, de-duplication, citation and review jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators import validation as V
from attesta.operators.ordered import Limits
from attesta.session import scratch_folder


def file_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A stream over one table of a data directory, be it a file or a folder of files; new files of that name pattern, or
    within such a folder, become new micro-batches."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{directory}/{name}*.parquet")


def exact_dedup(sources: DataFrame, horizon: str = "7 days") -> DataFrame:
    """First arrival of every content hash per case; state older than the horizon is dropped."""
    hashed = sources.withColumn("content_hash", X.content_hash(F.col("text")))
    return hashed.withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(["case_id", "content_hash"])


def spend_by_case(usage: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Daily spend per case; rows later than the watermark are left out."""
    timed = usage.withColumn("at", F.col("at").cast("timestamp"))
    return timed.withWatermark("at", lateness).groupBy("case_id", F.window("at", "1 day").alias("day")).agg(
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("spent"), F.count("*").alias("requests")).select(
        "case_id", F.col("day.start").alias("day"), "spent", "requests")


def budget_alert(usage: DataFrame, cap: float) -> DataFrame:
    """(case_id, total) of cases beyond the cap, an update for each batch that changes the total."""
    return usage.groupBy("case_id").agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("total")).where(F.col("total") > cap)


def budget_admission(calls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(case_id, id, reason) for every arriving call (case_id, id, provider, worst_cost), in order of arrival.

    The state of a case is what it has spent and tried so far, in all and with provider B; it outlives batches and restarts. Calls
    of one micro-batch are decided by ascending id, so a case's rows of one micro-batch are sorted in its task; the
    trigger's options (``maxFilesPerTrigger``) bound them.
    """

    def decide(key, batches, state):
        now = state.get if state.exists else (0.0, 0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        is_b, cost = (rows["provider"] == fixed.PROVIDER_B).tolist(), rows["worst_cost"].fillna(0.0).tolist()
        reasons = []
        for b, c in zip(is_b, cost):
            spent, spent_b, tries, tries_b = now
            for _, now in limits.admit([b], [c], now):
                reasons.append(None)
                break
            else:
                reasons.append(limits.why(b, c, (spent, spent_b, tries, tries_b)))
        state.update(now)
        yield pd.DataFrame({"case_id": key[0], "id": rows["id"].to_numpy(), "reason": pd.Series(reasons, dtype=object).to_numpy()})

    narrow = calls.select("case_id", "id", "provider", F.col("worst_cost").cast("double").alias("worst_cost"))
    return narrow.groupBy("case_id").applyInPandasWithState(
        decide, "case_id long, id long, reason string", "spent double, spent_b double, tries long, tries_b long", "append", GroupStateTimeout.NoTimeout)


def citation_check(citations: DataFrame, passages: DataFrame) -> DataFrame:
    """Arriving citations against the stored passages."""
    return V.check_citations(citations, passages)


def review_current(actions: DataFrame) -> DataFrame:
    """Newest action per (case, variable) of one micro-batch."""
    return actions.groupBy("case_id", "variable").agg(F.max(F.struct("id", "action", "value")).alias("l")).select("case_id", "variable", "l.*")


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes what each micro-batch brings into a folder of its own. A batch that is run again replaces its own folder and
    nothing else, so neither a repetition nor a restart loses or repeats a row."""
    return lambda batch, batch_id: review_current(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def current_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Newest action per (case, variable) over all batches written so far."""
    return review_current(spark.read.parquet(path).drop("batch"))


def run_to_end(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], mode: str) -> None:
    """Process everything that is there and stop."""
    folder = scratch_folder(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{uuid.uuid4().hex}").trigger(
        availableNow=True).foreachBatch(each_batch).start()
    query.awaitTermination()


def collect_appends(stream: DataFrame) -> DataFrame:
    """Run an append stream to its end and return what it wrote."""
    spark, path = stream.sparkSession, f"{scratch_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    run_to_end(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"), "append")
    return spark.read.parquet(path).drop("batch")


def collect_updates(stream: DataFrame, *keys: str) -> DataFrame:
    """Run an update stream to its end and return the last row of every key."""
    spark, path = stream.sparkSession, f"{scratch_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    run_to_end(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"), "update")
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("l")).select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest])
