"""Session builder for local runs and the bench; a cluster brings its own session."""

import os
import tempfile

from pyspark.sql import SparkSession

OWN = {}  # folders of local runs, by application


def spark_session(cpus=None, app="rentroll", memory="16g"):
    cores = str(cpus or os.cpu_count() or 4)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark):
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local run where the setting is absent gets a fresh folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in OWN:
        OWN[app] = tempfile.mkdtemp(prefix="rentroll-")
    return OWN[app]
