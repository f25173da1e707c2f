"""Budget admission by blocks, its stateful stream, and sessions without a checkpoint folder of their own."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.operators.ordered import Limits, budget_admission
from attesta.session import scratch_folder
from attesta.streaming import jobs as S

SCHEMA = "case_id long, id long, provider string, worst_cost double"


def want(rows, limits):
    out, states = {}, {}
    for case, i, provider, cost in sorted(rows, key=lambda r: r[1]):
        s, sb, n, nb = states.get(case, (0.0, 0.0, 0, 0))
        b, c = provider == fixed.PROVIDER_B, cost or 0.0
        if s + c > limits.cap + 1e-9:
            out[case, i] = "case budget"
        elif b and sb + c > limits.cap_b + 1e-9:
            out[case, i] = "provider budget"
        elif b and nb >= limits.max_attempts_b:
            out[case, i] = "provider attempt limit"
        elif n >= limits.max_attempts:
            out[case, i] = "attempt limit"
        else:
            out[case, i] = None
            states[case] = (s + c, sb + (c if b else 0.0), n + 1, nb + b)
    return out


def calls(seed, n=600):
    random.seed(seed)
    # a third of the calls belong to one case; its costs fall over time, so single calls fit late in its log
    rows = []
    for i in range(n):
        case = 1 if random.random() < 0.34 else random.randint(2, 12)
        cost = random.choice([None, 0.0, round(random.random() * (2.0 if case > 1 else 2.0 - 1.9 * i / n), 5)])
        rows.append((case, i * (1 if case < 6 else 1000), random.choice([fixed.PROVIDER_B, "a", None]), cost))
    return rows


def as_dict(df):
    return {(r.case_id, r.id): r.reason for r in df.collect()}


@pytest.mark.parametrize("limits", [Limits(3.0, 1.5, 12, 5), Limits(6.0, 0.2, 100, 50), Limits(0.0, 0.0, 3, 1)])
def test_block_search_equals_the_plain_order(spark, limits):
    rows = calls(limits.max_attempts)
    got = budget_admission(spark.createDataFrame(rows, SCHEMA), *limits.__dict__.values(), block_rows=20)
    assert as_dict(got) == want(rows, limits)


def test_one_hot_case_is_spread_over_blocks(spark):
    from attesta.operators.ordered import _blocks

    frame = spark.range(20_000).select(F.lit(7).cast("long").alias("case_id"), "id", (F.col("id") % 2 == 0).alias("is_b"), F.lit(0.5).alias("cost"))
    blocked, blocks = _blocks(frame, 1000)
    assert blocks.count() == 20 and blocked.groupBy("block").count().agg(F.max("count")).first()[0] <= 2000


def test_admission_of_nothing(spark):
    assert budget_admission(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_decides_like_the_batch_over_micro_batches_and_a_restart(spark):
    limits, rows = Limits(3.0, 1.5, 12, 5), sorted(calls(3), key=lambda r: r[1])
    folder, state, out = (scratch_folder(spark) for _ in range(3))

    def arrive(part, number):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number:03d}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        S.budget_admission(stream, limits).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()

    arrive(rows[:200], 0)
    arrive(rows[200:350], 1)
    run()
    arrive(rows[350:], 2)
    run()
    assert as_dict(spark.read.parquet(out)) == want(rows, limits)


def test_a_local_session_needs_no_checkpoint_setting(tmp_path):
    (tmp_path / "conf").mkdir()
    code = ("from attesta.session import local_session, cut_lineage, scratch_folder\n"
            "s = local_session(2)\nassert not s.conf.get('spark.checkpoint.dir', None)\n"
            "assert cut_lineage(s.range(3)).count() == 3 and scratch_folder(s).startswith('/tmp/')\n")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
