"""Session helpers: a local session for tests and benchmarks, and lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "attesta", memory: str = "8g") -> SparkSession:
    """A session for one machine. On a cluster, pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_BASE: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session may go without that setting; it gets one
    temporary folder per process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL_BASE[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor only costs its own tasks."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str | None = None, options: dict[str, str] | None = None, settings: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """The rows of df, written as Parquet into the shared folder and read back. Unlike a checkpoint's, its size is known to
    the planner, so it is broadcast only when it is really small. What was shuffled for it is freed when it is written.
    ``options`` are the writer's; ``settings`` of the session hold while it writes; ``by`` names columns whose values get folders."""
    spark, path = df.sparkSession, path or scratch_folder(df.sparkSession)
    settings = {FREED: "true", **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.options(**(options or {})).partitionBy(*(by or [])).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Takes away a table of the shared folder, once nothing is made from it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the shared folder, for streaming state and what streams write."""
    return f"{shared_base(spark)}/attesta-{uuid.uuid4().hex}"
