"""History tables: current versions, latest record per key, first events, opening and closing values."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.operators.hot import split_join


def current(df, flag="is_current"):
    """Only the current version of each dimension row."""
    return df.filter(F.col(flag) == 1)


def first_per_key(df, keys, *order):
    """One row per key: the first in ``order``. End ``order`` with a unique column.

    The filter on the row number becomes a per-task top-1 before the shuffle, so a hot key
    sends one row per task.
    """
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") == 1).drop("_rank")


def latest_by_business_key(fact, versions, sk, bk, *order):
    """Latest fact row of each business key over all versions of the dimension."""
    return first_per_key(fact.join(versions.select(sk, bk), sk), [bk], *order)


def to_current(fact, versions, sk, bk, flag="is_current"):
    """Swap a fact's link to an old version for the current version of the same business key."""
    old = versions.select(F.col(sk), F.col(bk))
    now = versions.filter(F.col(flag) == 1).withColumnRenamed(sk, f"current_{sk}")
    return split_join(fact.join(old, sk), now, [bk])


def opening_and_closing(df, keys, value, *order):
    """First and last value per key in one pass; pre-aggregated before the shuffle."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(value, rank).alias("opening_value"), F.max_by(value, rank).alias("closing_value")
    )


def first_events(df, keys, whens, at):
    """Day of the earliest row per key that meets each condition (``{new name: condition}``), in one pass."""
    return df.groupBy(*keys).agg(*[F.min(F.when(when, F.col(at))).alias(name) for name, when in whens.items()])
