"""Tables that are published whole or not at all.

A published table is a folder with one subfolder of Parquet files per version and a log, ``_log``, with a row per version.
A version is written beside the others, its metrics are observed by that same write, and only a version within its limits
gets a row in the log. That row is one small file, put in place by the commit of its own write: readers see the old version or
the new one. A write that fails half-way, or numbers out of bounds, leave the old version as it is; and a frame
may read the table it will replace.
"""

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

LOG = "version bigint, path string, metrics map<string,double>, digests map<string,string>"


class Rejected(Exception):
    """A version whose metrics are out of bounds; ``metrics`` has them all."""

    def __init__(self, wrong, metrics):
        super().__init__("; ".join(wrong))
        self.metrics = metrics


def log(spark, root):
    """The versions of the table; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_log")
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{root}/_log")


def latest(spark, root):
    """The log's row of the newest version, or None."""
    return log(spark, root).orderBy(F.desc("version"), F.desc("path")).first()


def read(spark, root, version=None):
    """The newest version, or the given one."""
    row = latest(spark, root) if version is None else log(spark, root).filter(F.col("version") == version).first()
    if row is None:
        raise ValueError(f"{root}: no such version")
    return spark.read.parquet(row.path)


def write_observed(df, path, metrics, partition_by=()):
    """Write ``df`` and return the metrics ``{name: aggregate}`` of the rows written, from the same job."""
    if metrics:
        seen = Observation()
        df = df.observe(seen, *[m.cast("double").alias(n) for n, m in metrics.items()])
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return dict(seen.get) if metrics else {}


def out_of_bounds(metrics, limits):
    """What is wrong with the metrics; a missing value is out of any bounds."""
    wrong = []
    for name, (low, high) in limits.items():
        value = metrics[name]
        if value is None or low is not None and value < low or high is not None and value > high:
            wrong.append(f"{name} is {value}, not from {low} to {high}")
    return wrong


def add_version(spark, root, path, metrics, digests=None):
    """Switch readers over to ``path``: one row, one file, committed as a whole."""
    newest = latest(spark, root)
    row = ((newest.version if newest else 0) + 1, path, metrics, digests or {})
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{root}/_log")
    return row[0]


def publish(df, root, metrics=None, limits=None, partition_by=()):
    """Write ``df`` as the next version of the table at ``root`` and switch readers over to it.

    ``metrics``: ``{name: aggregate}``, kept in the log. ``limits``: ``{name: (low, high)}``, both included, None for no
    bound; a version outside is ``Rejected`` and never read. Returns the number of the version.
    """
    path = f"{root}/{uuid.uuid4().hex}"
    found = write_observed(df, path, metrics or {}, partition_by)
    wrong = out_of_bounds(found, limits or {})
    if wrong:
        raise Rejected(wrong, found)
    return add_version(df.sparkSession, root, path, found)


# Refresh by increments


def digests_of(source, bucket):
    """Per bucket an order-free digest of its rows: their number, and sum and exclusive or of their hashes."""
    columns = [F.to_json(F.struct(c)) if k.startswith("map") else F.col(f"`{c}`") for c, k in source.dtypes]
    places = [F.when(c.isNull(), F.lit(i)) for i, c in enumerate(columns)]  # a null changes no hash of its own
    row = F.xxhash64(*columns, *places)
    told = source.groupBy(bucket.cast("string").alias("bucket")).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).alias("digest")
    )
    return told.select(F.coalesce("bucket", F.lit("null")).alias("bucket"), "digest")


def escaped(name):
    """A partition value as the writer spells it in a folder's name."""
    unsafe = set('"#%\'*/:=?\\{[]^') | {chr(c) for c in (*range(1, 32), 127)}
    return "".join(f"%{ord(c):02X}" if c in unsafe else c for c in name)


def refresh(source, bucket, build, root, others=()):
    """Bring the table at ``root`` up to date with ``source``; returns the buckets that were built.

    ``bucket`` cuts the source (a bounded number of parts: months, or a hash of a key); ``build(rows)`` makes the result of
    some buckets from their rows alone (they carry ``_bucket``, which the result keeps), and from the ``others``. Buckets whose digest is that of the last refresh
    keep their files; a change in one of the ``others`` builds all. Files go to a folder of their own and the log switches last,
    as in ``publish``; the folder of each bucket is in the log beside its digest.
    """
    spark = source.sparkSession
    now = {r.bucket: r.digest for r in digests_of(source, bucket).collect()}  # one row per bucket
    frames = "+".join(digests_of(o, F.lit("all")).first().digest if not o.isEmpty() else "0" for o in others)
    newest = latest(spark, root)
    before = newest.digests if newest else {}
    places = {}
    for name, digest in now.items():
        known, _, place = before.get(name, "").partition("@")
        if known == f"{digest}/{frames}":
            places[name] = place
    changed = sorted(set(now) - set(places))
    if newest and not changed and set(now) == set(before):
        return []
    path = f"{root}/{uuid.uuid4().hex}"
    if changed:
        named = source.withColumn("_bucket", F.coalesce(bucket.cast("string"), F.lit("null")))
        built = build(named.filter(F.col("_bucket").isin(changed)))
        built.write.partitionBy("_bucket").parquet(path)
        filled = {r[0] for r in spark.read.schema("_bucket string").parquet(path).distinct().collect()}
        places |= {name: f"{path}/_bucket={escaped(name)}" if name in filled else "" for name in changed}
    add_version(spark, root, path, {}, {name: f"{now[name]}/{frames}@{place}" for name, place in places.items()})
    return changed


def read_refreshed(spark, root):
    """The rows of all buckets, from the folders where each was last built."""
    row = latest(spark, root)
    if row is None:
        raise ValueError(f"{root}: never refreshed")
    folders = sorted({d.partition("@")[2] for d in row.digests.values()} - {""})
    return spark.read.parquet(*folders) if folders else None
