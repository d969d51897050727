"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tallymark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution re-plans joins from measured sizes and splits skewed
    shuffle partitions; UTC keeps timestamps independent of the host.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, as the cluster names it.

    ``spark.checkpoint.dir`` wins.  Only a local master without that setting
    gets a folder of its own; a cluster without it is an error, because a
    machine-local folder would be lost with the machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused table folder beside the checkpoints."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete a scratch table, or all of this session's, once no result is read from them any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path or os.path.join(ensure_checkpoint_dir(spark), "tables"))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
