"""From version history to change points, weekly snapshots and carried balances."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.functions.dates import OPEN_END, friday_on_or_after, on_or_before
from rentroll.functions.nulls import changed
from rentroll.operators.hot import along_slots, in_groups, ordered_columns


def change_points(versions, keys, order, state, **hot):
    """Only the versions where ``state`` differs from the version before, closed by the next change."""
    first_of_key = "_is_first"
    seen = ordered_columns(versions, keys, order, ordinal=first_of_key, previous={"_before": state}, **hot)
    kept = seen.filter((F.col(first_of_key) == 1) | changed(F.col(state), F.col("_before")))
    return kept.drop(first_of_key, "_before")


def state_intervals(versions, keys, order, state, at, ends, last=None, unset=None, **hot):
    """Change points as closed intervals ``valid_from``..``valid_to``, in one shuffle of the history.

    A state ends where the next one starts, and never later than the end ``ends`` of the key's last
    version. ``last`` adds other values of the key's last version: ``{new name: column}``. ``unset``
    tells, from a state, that nothing was known before; the row after such a state opens a new one.

    A hot key is cut into pieces; the first row of a piece is a change only if the piece before ended in
    another state, which one row per piece is enough to tell.
    """
    last = last or {}
    tail = F.struct(ends, *dict.fromkeys(c for c in last.values() if c != ends))
    groups, by = in_groups(versions, keys, order, **hot)
    asc = Window.partitionBy(*by).orderBy(*order)
    whole = asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now, opens = F.struct(state), F.col("_rn") == 1

    def is_new(value, before):
        differs = changed(value, before)
        return differs if unset is None else differs | unset(before[state])

    seen = groups.withColumns(
        {"_rn": F.row_number().over(asc), "_before": F.lag(now).over(asc), "_tail": F.last(tail).over(whole)}
    )
    # A candidate opens a group or differs from the row before it.
    steps = seen.filter(opens | is_new(now, F.col("_before"))).withColumn("_next", F.lead(at).over(asc))

    if by == list(keys):  # no hot key: a candidate opens its key or differs from the row before
        return steps.select(
            *keys,
            state,
            F.col(at).alias("valid_from"),
            F.least(F.coalesce(F.to_date("_next"), F.lit(OPEN_END)), F.coalesce(F.to_date(F.col("_tail")[ends]), F.lit(OPEN_END))).alias("valid_to"),
            *[F.col("_tail")[c].alias(out) for out, c in last.items()],
        )

    rank = F.struct(*order)
    slots = seen.filter(F.col("_group._slot").isNotNull()).groupBy("_group").agg(
        F.min_by(now, rank).alias("_opening"),
        F.min(at).alias("_opening_at"),
        F.min(F.when(~opens & is_new(now, F.col("_before")), F.col(at))).alias("_inner_at"),
        F.max_by(now, rank).alias("_closing"),
        F.first("_tail").alias("_slot_tail"),
    )
    along = along_slots(keys)
    back = Window.partitionBy(*[F.col(f"_group.{k}") for k in keys]).orderBy(F.col("_group._slot").desc())
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = slots.withColumn("_prior", F.lag("_closing").over(along)).withColumn(
        "_first_change",
        F.when(F.col("_prior").isNull() | is_new(F.col("_opening"), F.col("_prior")), F.col("_opening_at")).otherwise(F.col("_inner_at")),
    )
    edges = edges.select(
        "_group",
        "_prior",
        F.last("_first_change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
        F.last("_slot_tail").over(every).alias("_key_tail"),
    )
    first_of_key = opens & F.col("_prior").isNull()
    points = steps.join(edges, "_group", "left").filter(~opens | first_of_key | is_new(now, F.col("_prior")))
    next_at = F.coalesce(F.to_date("_next"), F.to_date("_later"), F.lit(OPEN_END))
    at_last = F.coalesce("_key_tail", "_tail")
    return points.select(
        *keys,
        state,
        F.col(at).alias("valid_from"),
        F.least(next_at, F.coalesce(F.to_date(at_last[ends]), F.lit(OPEN_END))).alias("valid_to"),
        *[at_last[c].alias(out) for out, c in last.items()],
    )


def friday_snapshots(intervals, start, end, as_of, out="snapshot"):
    """One row per Friday inside each closed interval, up to ``as_of``.

    The Fridays are made per interval, so there is no join against a calendar.
    """
    first = friday_on_or_after(start)
    last = F.least(F.to_date(end), F.lit(as_of))
    weeks = F.when(first <= last, F.sequence(first, last, F.expr("interval 7 days")))
    return intervals.withColumn(out, F.explode(weeks))


def balance_at(snapshots, moves, keys, day, moved_on, value, out, facts=None):
    """What had been moved before each snapshot day, with other facts carried forward to it.

    ``moves`` are summed per key and day, ``facts`` (one row per key and day, ``{new name: column}``)
    are as few, so a window holds at most the days of the calendar per key. A move on the snapshot
    day counts from the next snapshot on.
    """
    daily = moves.groupBy(*keys, F.to_date(moved_on).alias("_day")).agg(F.sum(value).alias("_moved"))
    rows = snapshots.withColumns({"_day": F.to_date(day), "_is_snapshot": F.lit(0)})
    rows = rows.unionByName(daily.withColumn("_is_snapshot", F.lit(1)), allowMissingColumns=True)
    named = {}
    if facts:
        frame, fact_day, named = facts
        told = frame.select(*keys, F.to_date(fact_day).alias("_day"), *[F.col(c).alias(f"_fact_{o}") for o, c in named.items()])
        rows = rows.unionByName(told.withColumn("_is_snapshot", F.lit(1)), allowMissingColumns=True)
    along = Window.partitionBy(*keys).orderBy("_day", "_is_snapshot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = {out: F.coalesce(F.sum("_moved").over(along), F.lit(0))}
    carried |= {o: F.last(f"_fact_{o}", ignorenulls=True).over(along) for o in named}
    told = rows.withColumns(carried).filter(F.col("_is_snapshot") == 0)
    return told.select(*snapshots.columns, *carried)


def weekly_balance(events, keys, at, value, as_of, out="balance"):
    """Balance of each key at every Friday from its first event on, quiet weeks carried forward.

    Events are summed per key and week before any window, so a key never holds more rows in a
    window than there are weeks.
    """
    week = friday_on_or_after(at)
    moves = events.filter(on_or_before(F.col(at), as_of)).groupBy(*keys, week.alias("week_end")).agg(
        F.sum(value).alias("moved")
    )
    along = Window.partitionBy(*keys).orderBy("week_end")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    settled = moves.withColumn("_settled", F.sum("moved").over(so_far))
    weeks = settled.groupBy(*keys).agg(F.min("week_end").alias("_from")).withColumn(
        "week_end",
        F.explode(F.sequence("_from", friday_on_or_after(F.lit(as_of)), F.expr("interval 7 days"))),
    )
    grid = weeks.drop("_from").join(settled, [*keys, "week_end"], "left")
    return grid.withColumn(out, F.last("_settled", ignorenulls=True).over(so_far)).drop("_settled")
