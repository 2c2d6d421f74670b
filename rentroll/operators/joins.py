"""Join shapes that need care: interval, either-key, as-text, day-part and star joins."""

from datetime import date

from pyspark.sql import functions as F


def star_join(fact, *dims):
    """Chain of ``(dim, on, how)`` joins; the optimizer picks broadcast by checked size."""
    for dim, on, how in dims:
        fact = fact.join(dim, on, how)
    return fact


def large(df):
    """A join side with a row for every asset, customer or line: sorted and merged, never broadcast.

    Spark takes a side for small by the compressed size of its files. Dense keys and repeated texts of a million rows take a
    few MB there and a hundred in the driver that builds the broadcast.
    """
    return df.hint("merge")


def either_key_join(left, right, first, second):
    """Inner join on ``first OR second`` as two hash joins.

    The second join leaves out pairs the first has found already, so no pair comes twice and no
    distinct is needed.
    """
    a = left.join(right, first)
    b = left.join(right, second & ~F.coalesce(first, F.lit(False)))
    return a.unionByName(b)


def text_key_join(left, right, left_key, right_key, how="inner"):
    """Join an integer id to the same id kept as text."""
    return left.withColumn("_text_key", F.col(left_key).cast("string")).join(
        right.withColumn("_text_key", F.col(right_key).cast("string")), "_text_key", how
    ).drop("_text_key")


def day_join(rows, calendar, at, day="day", how="inner"):
    """Join a timestamp to a calendar by its day part."""
    return rows.withColumn(day, F.to_date(at)).join(calendar, day, how)


def day_number(at):
    return F.unix_date(F.to_date(at))


FINE = 3  # blocks are at least an eighth of the interval


def block_cover(intervals, low, high, out_level="_level", out_block="_block"):
    """Each interval of whole days once per block it touches: ``_block`` is a number of blocks of 2 ** ``_level`` days.

    The level grows with the interval, so an interval of n days touches at most ``2 ** FINE + 1`` blocks, whether it lasts a
    day or a century, and at most two of them reach beyond its ends. Empty intervals have no block.
    """
    days = intervals.withColumns({"_from": day_number(low), "_to": day_number(high)}).filter("_from <= _to")
    # Bits of the length less one: the power of two that holds it. The logarithm would be inexact.
    bits = F.expr("if(_from = _to, 0, length(bin(_to - _from)))")
    days = days.withColumn(out_level, F.greatest(bits - FINE, F.lit(0)))
    blocks = F.expr(f"sequence(shiftright(_from, {out_level}), shiftright(_to, {out_level}))")
    return days.withColumn(out_block, F.explode(blocks)).drop("_from", "_to")


def interval_join(rows, intervals, keys, at, low, high, horizon, closed=False):
    """Rows to the intervals of the same key that hold ``at``.

    Intervals are covered by blocks of days (``block_cover``); a row probes one block for every level in use. So the join
    runs on (key, level, block) as a hash join, a hot key is spread over its blocks, and the rows that an interval is copied
    to don't grow with its length. ``low``, ``high`` and ``horizon`` are expressions; open intervals stop at ``horizon``, a
    day on or after every ``at``.
    """
    if isinstance(horizon, date):
        horizon = F.lit(horizon)
    live = block_cover(intervals, low, F.least(F.to_date(high), F.to_date(horizon)))
    # At most one level for every bit of a day number, whatever the intervals: a set of some twenty numbers.
    levels = live.agg(F.collect_set("_level")).scalar()
    inside = (F.col(at) >= low) & (F.col(at) <= high if closed else F.col(at) < high)
    probes = rows.withColumn("_level", F.explode(levels)).withColumn("_block", F.expr(f"shiftright(unix_date(to_date(`{at}`)), _level)"))
    return probes.join(live, [*keys, "_level", "_block"]).filter(inside).drop("_level", "_block")
