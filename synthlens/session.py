"""Session construction and the shared scratch folder.

Intermediate tables (CSV sheets, report tables, lineage cuts) go under the
folder the cluster names in ``spark.checkpoint.dir``. Only a local session
with no such setting gets a private folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "synthlens", extra: dict | None = None) -> SparkSession:
    """A session with the engine's settings; what ``spark-submit`` has set
    (master, memory, partitions or any other) stays as it is."""
    settings = {
        "spark.master": master, "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", **(extra or {}),
    }
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its settings come first
        from pyspark import SparkConf, SparkContext

        SparkContext._ensure_initialized()
        given = SparkConf()
        settings = {k: v for k, v in settings.items() if not given.contains(k)}
    builder = SparkSession.builder
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    return None


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must be set (a shared file system);
    only a local-mode session without it gets a private temporary folder.
    """
    base = _checkpoint_dir(spark)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="synthlens-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh sub-folder of the session's shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
