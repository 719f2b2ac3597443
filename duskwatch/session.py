"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "duskwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC time.

    On a cluster leave ``master`` unset: memory, executors, shuffle partitions
    and ``spark.checkpoint.dir`` come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for frozen intermediate results: ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder below the
    warehouse; on a cluster the setting names a folder all executors share.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            current = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(current)
        current = context.getCheckpointDir()
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables and stream state."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
