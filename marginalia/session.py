"""Session settings shared by tests, the bench and scripts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, app: str = "marginalia") -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one under the warehouse where that is unset.

    A folder of one machine serves local sessions only; on a cluster without a
    shared folder nothing is written and the caller is told.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    own = sc.getConf().get("spark.checkpoint.dir", None)
    if own is None:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if own.startswith(("file:", "/")) and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage through a reliable checkpoint in ``shared_dir``; its shuffle files go once it is written."""
    shared_dir(df.sparkSession)
    df = df.select("*")  # a plan of its own, whose shuffles nothing else reads
    out = df.checkpoint(eager=True)
    _without_shuffle_files(df)
    return out


def _without_shuffle_files(df: DataFrame) -> None:
    """Delete the shuffle files of a plan that has run and will not run again, on every executor."""
    plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc().cleaner()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec" or cleaner.isEmpty():
        return  # they go when the JVM finds that nothing refers to them
    ids = plan.context().shuffleIds().keySet().iterator()
    while ids.hasNext():
        cleaner.get().doCleanupShuffle(ids.next(), True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to ``shared_dir`` and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what ``checkpointed`` and ``stored`` wrote for these results; nothing may read them any more."""
    for df in frames:
        plan, spark = df._jdf.queryExecution().logical(), df.sparkSession
        if plan.getClass().getSimpleName() == "LogicalRDD":
            held = plan.rdd().getCheckpointFile()
            paths = [] if held.isEmpty() else [held.get()]
        else:
            paths = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
            paths = [x for x in paths if "/tables/" in x]
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the JVM find shuffles and broadcasts that nothing refers to any more, so that their files go before the next large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
