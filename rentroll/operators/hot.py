"""Groups too large for one task.

A group that holds a large share of all rows must not reach a single task. The tools:

* ``ordered_columns`` - ordinals, running sums and neighbours inside a group. Rows of hot groups are dealt by range into
  pieces of about ``ROWS`` rows, each piece is scanned alone, and one row per piece supplies what the others carry.
* ``spread_join`` - join rows to one row per key. A key gets one salt for every ``ROWS`` rows.
* ``split_join`` - the same without counts, for a right side that was grouped or ranked by the key; it leaves the
  splitting to adaptive execution.
* ``attach_many`` - left join of one row per key to many, where the many may be hot.

The number of pieces of a key is its rows over ``ROWS``, whatever the data volume: a piece never grows with the data.
The list of hot keys is broadcast while it has at most ``BROADCAST_KEYS`` rows, else Spark joins it like any table. Where no
key is hot the plans are the plain ones.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.sources.tables import materialise

ROWS = 1_000_000  # per piece
BROADCAST_KEYS = 50_000


def hot_keys(counts, keys, rows=ROWS):
    """Keys of more than ``rows`` rows with their number of pieces, and the rows they hold together.

    ``counts`` has one row per key and its row count in ``n``. None and 0 when no key is hot: one job tells, so that
    ordinary tables get an ordinary plan.
    """
    hot = counts.filter(F.col("n") > rows).select(*keys, "n", F.ceil(F.col("n") / rows).cast("int").alias("_pieces"))
    found = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if not found["keys"]:
        return None, 0
    hot = hot.drop("n")
    return (F.broadcast(hot) if found["keys"] <= BROADCAST_KEYS else hot), found["rows"]


def _null_safe(left, right, keys):
    return reduce(and_, [left[k].eqNullSafe(right[f"_hot_{k}"]) for k in keys])


def mark_hot(df, hot, keys, how="left"):
    """Join the list of hot keys; in a left join its columns are null for ordinary keys."""
    added = [c for c in hot.columns if c not in keys]
    small = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *added)
    return df.join(small, _null_safe(df, small, keys), how).drop(*[f"_hot_{k}" for k in keys])


def spread_join(rows, per_key, keys, how="left", per_piece=ROWS):
    """Join ``rows`` to ``per_key`` (one row per key, row count in ``n``) without a hot task."""
    renamed = {k: f"_hot_{k}" for k in keys}
    hot, _ = hot_keys(per_key, keys, per_piece)
    if hot is None:
        right = per_key.withColumnsRenamed(renamed)
        return rows.join(right, _null_safe(rows, right, keys), how).drop(*renamed.values())
    # A running number: equal rows get different salts. Any salt finds its key, so a rerun may deal them otherwise.
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_pieces")).cast("int"), F.lit(0))
    left = mark_hot(rows, hot, keys).withColumn("_salt", salt).drop("_pieces")
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    right = mark_hot(per_key, hot, keys).withColumn("_right_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    right = right.drop("_pieces").withColumnsRenamed(renamed)
    on = _null_safe(left, right, keys) & (F.col("_salt") == F.col("_right_salt"))
    return left.join(right, on, how).drop("_salt", "_right_salt", *renamed.values())


def split_join(rows, per_key, keys, how="inner"):
    """Join ``rows`` to one row per key so that adaptive execution can split a hot key.

    A right side that was just grouped by the key keeps its partitioning, and a join without a fresh
    shuffle on both sides is never split. A second key column, one bit of a hash of the first, asks for that shuffle; a whole
    hash would be the one column that doesn't compress.
    """
    extra = F.shiftright(F.xxhash64(*keys), 63)
    return rows.withColumn("_split", extra).join(per_key.withColumn("_split", extra), [*keys, "_split"], how).drop("_split")


def attach_many(base, many, keys):
    """Left join from one row per key to many: the many side leads the join, keys without any are added.

    A left join cannot split a hot key of its right side; the inner join with the many on the left can. Both sides are read
    twice, so they are stored once: name only the columns that are needed.
    """
    base, many = materialise(base, "base"), materialise(many, "many")
    alone = base.join(many.select(*keys).distinct(), keys, "left_anti")
    return split_join(many, base, keys).unionByName(alone, allowMissingColumns=True)


def count_per_key(df, keys, out="n_in_key"):
    """``count(*)`` of each key on every row, by aggregate and join instead of a window."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return spread_join(df, per_key, keys).withColumnRenamed("n", out)


def distinct_per_key(df, keys, value, out="n_distinct", source=None):
    """Distinct values of each key on every row; the pre-distinct keeps a hot key out of one task.

    The counts are stored: one row per key takes less than to build them once for the hot keys and once for the join.
    ``source``: a cheaper frame of the same rows to count on.
    """
    per_value = (df if source is None else source).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    per_key = materialise(per_value.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(value).alias(out)), "counts")
    return spread_join(df, per_key, keys).drop("n")


def dealt_by_range(df, keys, order, parts):
    """Rows dealt by ranges of key and order, with the number of their range in ``_slot``: later ranges hold later rows."""
    return df.repartitionByRange(parts, *keys, *order).withColumn("_slot", F.spark_partition_id())


def in_groups(df, keys, order, rows=ROWS, source=None):
    """(frame, columns): the rows, and the columns by which windows over them are partitioned.

    Without a hot key these are ``df`` and its keys. Rows of hot keys are dealt by range into pieces of about ``rows`` rows
    and stored with the number of their piece, so that every later step finds the same pieces; then windows go by
    ``_group``, the key and the number of the piece, null where the key is one piece. A row's work doesn't depend on the
    size of its key. ``source``: a cheaper frame of the same rows to count keys on.
    """
    counts = (df if source is None else source).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot, total = hot_keys(counts, keys, rows)
    if hot is None:
        return df, list(keys)
    held = mark_hot(df, hot.select(*keys), keys, "left_semi")
    held = materialise(dealt_by_range(held, keys, order, -(-total // rows)), "hot_rows")
    rest = mark_hot(df, hot.select(*keys), keys, "left_anti").withColumn("_slot", F.lit(None).cast("int"))
    both = rest.unionByName(held).withColumn("_group", F.struct(*keys, "_slot")).drop("_slot")
    return both, ["_group"]


def along_slots(keys):
    """Window over the pieces of one key, in order; one row per piece."""
    return Window.partitionBy(*[F.col(f"_group.{k}") for k in keys]).orderBy(F.col("_group._slot"))


def ordered_columns(
    df,
    keys,
    order,
    ordinal=None,
    reverse_ordinal=None,
    running=None,
    previous=None,
    following=None,
    first=None,
    last=None,
    per_piece=ROWS,
    source=None,
):
    """Add columns that depend on the order of rows inside each key.

    ``order``: ascending column names that identify a row within its key (nulls come first).
    ``running``/``previous``/``following``/``first``/``last``: ``{new name: column name}``.
    Running sums expect exact types (integer or decimal).
    ``source``: a cheaper frame of the same rows (before joins or earlier ordinals) on which keys are counted.

    Ordinary keys take one shuffle and one sort. Of a hot key each piece is scanned alone; a piece sends one row with its
    totals and ends, these are scanned in order, and what a piece carries from those before and after it is added back.
    """
    running, previous, following = running or {}, previous or {}, following or {}
    first, last = first or {}, last or {}
    tagged, by = in_groups(df, keys, order, per_piece, source)

    # Inside one piece (for an ordinary key: the whole key).
    asc = Window.partitionBy(*by).orderBy(*order)
    so_far = asc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {}
    if ordinal or reverse_ordinal:
        near["_rn"] = F.row_number().over(asc)
    if reverse_ordinal:
        near["_n"] = F.count(F.lit(1)).over(whole)
    near |= {f"_run_{o}": F.sum(c).over(so_far) for o, c in running.items()}
    near |= {f"_prev_{o}": F.lag(F.struct(c)).over(asc) for o, c in previous.items()}
    near |= {f"_next_{o}": F.lead(F.struct(c)).over(asc) for o, c in following.items()}
    near |= {f"_first_{o}": F.first(F.struct(c)).over(whole) for o, c in first.items()}
    near |= {f"_last_{o}": F.last(F.struct(c)).over(whole) for o, c in last.items()}
    local = tagged.withColumns(near)

    if by == list(keys):
        out = {}
        if ordinal:
            out[ordinal] = F.col("_rn").cast("bigint")
        if reverse_ordinal:
            out[reverse_ordinal] = (F.col("_n") - F.col("_rn") + 1).cast("bigint")
        out |= {o: F.col(f"_run_{o}") for o in running}
        out |= {o: F.col(f"_prev_{o}")[c] for o, c in previous.items()}
        out |= {o: F.col(f"_next_{o}")[c] for o, c in following.items()}
        out |= {o: F.col(f"_first_{o}")[c] for o, c in first.items()}
        out |= {o: F.col(f"_last_{o}")[c] for o, c in last.items()}
        return local.withColumns(out).select(*df.columns, *out)

    # Across the pieces of a hot key: one row per piece.
    rank = F.struct(*order)
    edges = {"_slot_n": F.count(F.lit(1))}
    edges |= {f"_slot_sum_{o}": F.sum(c) for o, c in running.items()}
    edges |= {f"_slot_last_{o}": F.max_by(F.struct(c), rank) for o, c in (previous | last).items()}
    edges |= {f"_slot_first_{o}": F.min_by(F.struct(c), rank) for o, c in (following | first).items()}
    slots = tagged.filter(F.col("_group._slot").isNotNull()).groupBy("_group").agg(
        *[e.alias(n) for n, e in edges.items()]
    )
    along = along_slots(keys)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    far = {"_n_before": F.sum("_slot_n").over(earlier), "_n_after": F.sum("_slot_n").over(later)}
    far |= {f"_sum_before_{o}": F.sum(f"_slot_sum_{o}").over(earlier) for o in running}
    far |= {f"_far_prev_{o}": F.lag(f"_slot_last_{o}").over(along) for o in previous}
    far |= {f"_far_next_{o}": F.lead(f"_slot_first_{o}").over(along) for o in following}
    far |= {f"_far_first_{o}": F.first(f"_slot_first_{o}").over(every) for o in first}
    far |= {f"_far_last_{o}": F.last(f"_slot_last_{o}").over(every) for o in last}
    offsets = slots.select("_group", *[e.alias(n) for n, e in far.items()])

    both = local.join(offsets, "_group", "left")
    zero = F.lit(0)
    out = {}
    if ordinal:
        out[ordinal] = (F.col("_rn") + F.coalesce("_n_before", zero)).cast("bigint")
    if reverse_ordinal:
        out[reverse_ordinal] = (F.col("_n") - F.col("_rn") + 1 + F.coalesce("_n_after", zero)).cast("bigint")
    for o in running:
        here, before = F.col(f"_run_{o}"), F.col(f"_sum_before_{o}")
        out[o] = F.when(here.isNull(), before).otherwise(here + F.coalesce(before, zero))
    out |= {o: F.coalesce(f"_prev_{o}", f"_far_prev_{o}")[c] for o, c in previous.items()}
    out |= {o: F.coalesce(f"_next_{o}", f"_far_next_{o}")[c] for o, c in following.items()}
    out |= {o: F.coalesce(f"_far_first_{o}", f"_first_{o}")[c] for o, c in first.items()}
    out |= {o: F.coalesce(f"_far_last_{o}", f"_last_{o}")[c] for o, c in last.items()}
    return both.withColumns(out).select(*df.columns, *out)
