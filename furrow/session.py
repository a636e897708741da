"""Spark session helpers.

Library functions never create a session themselves; they take one. These
helpers are for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "furrow") -> SparkSession:
    """A local session tuned for small test data (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FURROW_DRIVER_MEMORY", "8g"))
        .config("spark.python.worker.reuse", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local tests) a private scratch folder is
    created and registered; on a cluster an unset folder is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (a machine-local "
                           "folder does not survive executor loss on a cluster)")
    local_dir = tempfile.mkdtemp(prefix="furrow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return local_dir


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever
    the driver loaded it from: a zip of its sources goes out with the job."""
    sc = spark.sparkContext
    if getattr(sc, "_furrow_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="furrow-zip-"), "furrow_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._furrow_shipped = True


def materialize(df):
    """Cut lineage: eager ``checkpoint()`` into the session's shared
    checkpoint folder (created only when the session names none)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
