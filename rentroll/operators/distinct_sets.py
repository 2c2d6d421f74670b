"""Exact distinct counts from stored sets that merge to any coarser level.

A set is a bitmap of dense ids, cut into buckets of 32,768 ids (4 KB each). Sets are built once at the finest level and
stored; a coarser level is the bitwise or of the sets below it, never another pass over the rows. A value costs one bit
however often it comes, so counts at different levels, which can't be added up, all come from one base.

Use ids that lie close together: surrogate keys as they are, other values through ``dense_ids``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.operators.hot import dealt_by_range
from rentroll.sources.tables import materialise


def dense_ids(values, column, out, parts=None):
    """Table (column, out): the distinct non-null values numbered from 0 without gaps, in their order.

    Values are dealt by range and numbered inside each part; one row per part supplies the offsets. The table is stored, so
    the numbers stay the same for whoever reads it.
    """
    spark = values.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    dealt = materialise(dealt_by_range(distinct, [column], [], parts), "dealt_values")
    sizes = dealt.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = sizes.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(column)) - 1
    numbered = dealt.withColumn("_place", place).join(F.broadcast(offsets), "_slot")
    return materialise(numbered.select(column, (F.col("_before") + F.col("_place")).alias(out)), "dense_ids")


def bucketed(df, member):
    """``_bucket`` and ``_bit`` of each member, both null where the member is null."""
    # Bucket numbers of the built-in function start at 1 for the ids 1 to 32,768.
    return df.withColumn("_bucket", F.bitmap_bucket_number(member)).withColumn("_bit", F.bitmap_bit_position(member))


def member_sets(df, keys, member, **sums):
    """One row per key and bucket: the members' bitmap, the row count and ``sums`` (``{new name: column}``).

    Rows without a member count in ``n_rows`` and in the sums, in a bucket of their own whose bitmap is empty. One shuffle of
    the rows, with a bitmap per key, bucket and task before it.
    """
    added = [F.sum(c).alias(o) for o, c in sums.items()]
    return bucketed(df, member).groupBy(*keys, "_bucket").agg(
        F.bitmap_construct_agg("_bit").alias("members"), F.count(F.lit(1)).alias("n_rows"), *added
    )


def merged(sets, keys, *sums):
    """Sets of a finer level merged to ``keys`` (columns, or expressions with an alias)."""
    return sets.groupBy(*keys, "_bucket").agg(
        F.bitmap_or_agg("members").alias("members"), F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in sums]
    )


def counted(sets, keys, out, *sums):
    """Distinct members, rows and sums per key."""
    return sets.groupBy(*keys).agg(
        F.sum(F.bitmap_count("members")).alias(out), F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in sums]
    )
