"""What the corpus operators share: intermediate tables in the folder the cluster names, and words."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

LOCAL = {}


def folder(spark):
    """``spark.checkpoint.dir``; only a local session without it (as in tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL:
        LOCAL[app] = tempfile.mkdtemp(prefix="rentroll-")
    return LOCAL[app]


def place(spark, name):
    """A fresh path below the shared folder, one subfolder per application, so that a run can be cleared whole."""
    return f"{folder(spark)}/rentroll-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def save(df, name):
    """Write a table to the shared folder and read it back: later steps re-read files, not the lineage."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark):
    """Delete every intermediate table of this application; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/rentroll-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reachable(spark):
    """Let Python workers import this package from where the driver has it (a cluster installs it or uses --py-files)."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (here, path) if p)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def whole(column):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
