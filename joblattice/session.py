"""Session defaults and the shared working folder for checkpoints and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "joblattice", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings every operator assumes (UTC, AQE with skew joins)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed key even where the next operator then needs its own shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # No Python call sites in plans: they dominate the build time of wide expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    that setting gets a temporary folder; any other master must configure one,
    because a machine-local path would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="joblattice-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a fresh, not yet existing folder below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write are removed at once, not when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder; survives the loss of executors.

    Unlike a checkpointed plan the table is columnar (later passes read only their
    columns) and its size is known to the planner. The write plans its own shuffles, which
    nothing reads afterwards; their files go with it.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Empty a table that ``cut_lineage`` returned and that nothing will read again."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[1].startswith("stage-"):
            raise ValueError(f"not a table of cut_lineage: {folder}")
        table.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(folder)
