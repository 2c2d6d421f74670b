"""Exact dedup against immutable snapshots.

The rows seen so far are a snapshot: its distinct digests lie in buckets, and each bucket has a static binary-fuse
filter that is built once, stored beside it and never changed. An incoming batch is grouped by digest on its own, so
copies inside the batch meet there; each digest of the batch is then screened by the filter of its bucket. A negative
is new for certain and goes no further. A positive is joined to the exact bucket. Digests with more than one row are
checked byte by byte: the texts of a digest are grouped by the text itself, and a digest that stands for several texts
is taken apart by text.

Every grouping is a sum that Spark makes partly before the shuffle, so a text with a third of all rows is one row per
task when it is shuffled; a bucket holds about ``per_bucket`` digests at any size.
"""

import pandas as pd
from pyspark.sql import functions as F

from rentroll.llm import fuse
from rentroll.llm.shared import save, whole

FILTERS = "bucket int, filter binary"
SCREENED = "d string, keep_id bigint, n bigint, maybe boolean"


def normalised(column="text"):
    """Every run of white space (space, tab to carriage return) as one space; null as empty."""
    runs = r"[\x20\x09-\x0D]*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"  # a single space stands for itself
    return F.regexp_replace(whole(column), runs, " ")


def grouped(digests):
    """One row per digest: smallest doc_id (null if all are null) and number of rows."""
    return digests.groupBy("d").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def bucketed(groups, buckets):
    return groups.withColumns({
        "bucket": F.pmod(F.xxhash64("d"), F.lit(buckets)).cast("int"),
        "key": F.conv(F.substring("d", 1, 15), 16, 10).cast("bigint"),
    })


def build_filters(snapshot):
    """One static filter per bucket of a snapshot's distinct digests."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "filter": [fuse.build(rows["key"].to_numpy())]})

    return snapshot.select("bucket", "key").groupBy("bucket").applyInPandas(build, FILTERS)


def screen(batch, filters):
    """``maybe``: the filter of its bucket can't rule the digest out."""

    def ask(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        known = fuse.contains(stored["filter"].iloc[0], rows["key"].to_numpy()) if len(stored) and len(rows) else False
        return rows[["d", "keep_id", "n"]].assign(maybe=known)

    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, SCREENED)


def merged(snapshot, batch, filters):
    """Groups of snapshot and batch together: negatives pass, positives meet their exact bucket."""
    asked = save(screen(batch, filters), "screened")
    positive = asked.filter("maybe").select("d", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    old = snapshot.select("d", "keep_id", "n").join(positive, "d", "full")
    both = old.select(
        "d",
        F.least("keep_id", "new_id").alias("keep_id"),  # least skips nulls
        (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"),
    )
    return both.unionByName(asked.filter(~F.col("maybe")).select("d", "keep_id", "n"))


def byte_groups(documents, repeated):
    """(d, text) groups of the digests in ``repeated``: one per text that really differs."""
    texts = documents.select("doc_id", normalised().alias("text")).withColumn("d", F.sha2("text", 256))
    return (
        texts.join(repeated.select("d"), "d", "left_semi")
        .groupBy("d", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )


def deduplicate(documents, per_bucket=200_000):
    """One row per row of ``documents`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    The lower half of the doc_ids is the snapshot, the rest (and rows without a doc_id) the incoming batch. Null text
    counts as empty; empty texts are copies of one another. A row without doc_id is dropped for any equal row that has
    one; if none has, all stay and keep_id is null. Rows that repeat a doc_id with the same text are one document: both
    carry the same ``kept``. An empty table gives an empty result; further columns are ignored.
    """
    rows = documents.select("doc_id", F.sha2(normalised(), 256).alias("d"))
    digests = save(rows, "digests")
    middle, total = digests.agg(F.percentile_approx("doc_id", 0.5), F.count(F.lit(1))).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    buckets = -(-total // per_bucket) + 8

    snapshot = save(bucketed(grouped(digests.filter(old)), buckets), "snapshot")
    filters = save(build_filters(snapshot), "filters")
    batch = bucketed(grouped(digests.filter(~old)), buckets)
    groups = save(merged(snapshot, batch, filters), "groups")

    repeated = groups.filter("n > 1")
    texts = save(byte_groups(documents, repeated).select("d", F.sha2("text", 512).alias("long"), "keep_id", "n"), "checked")
    mixed = texts.groupBy("d").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")

    members = digests.join(groups, "d")
    if not mixed.isEmpty():  # digests that stand for several texts: their rows are grouped by text
        apart = documents.select("doc_id", normalised().alias("text")).select(
            "doc_id", F.sha2("text", 256).alias("d"), F.sha2("text", 512).alias("long")
        )
        members = members.join(mixed, "d", "left_anti").unionByName(
            apart.join(mixed, "d", "left_semi").join(texts, ["d", "long"]).drop("long")
        )
    return members.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("d").alias("text_sha256"),
    )
