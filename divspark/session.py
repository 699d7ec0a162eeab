"""Session construction and lineage cutting.

Lineage is cut only with reliable checkpoints (``DataFrame.checkpoint``) into
the shared folder named by ``spark.checkpoint.dir``; a machine-local folder is
used only when the session runs in local mode and nothing is configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF_KEY = "spark.checkpoint.dir"
#: A folder to use in local mode when ``spark.checkpoint.dir`` is not set.
WORK_DIR_VARIABLE = "DIVSPARK_WORK_DIR"


def get_session(master: str | None = None, app: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    Where it runs, how many shuffle partitions it has and how much memory it gets
    are the submitter's choice: they are set here only when passed (memory through
    ``extra``).  What is always set changes results or opens a port: the session
    time zone, and the UI, which stays off.
    """
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master:
        settings["spark.master"] = master
    if app:
        settings["spark.app.name"] = app
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = SparkSession.builder.config(map={**settings, **(extra or {})}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get(_CONF_KEY, None)
    if not conf and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(
            f"{_CONF_KEY} is not set: a cluster job needs a shared folder to cut lineage")
    path = conf or os.environ.get(WORK_DIR_VARIABLE) or tempfile.mkdtemp(prefix="divspark-work-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint: the result survives executor loss and the
    lineage above it is not recomputed by later actions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as compressed Parquet and read back: for tables that a checkpoint,
    which is neither compressed nor in columns, would make too large."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
