"""Roll-ups over charges and money, pivots and group totals."""

from pyspark.sql import functions as F

from rentroll.functions.money import amount
from rentroll.operators.distinct_sets import counted, member_sets, merged
from rentroll.sources.tables import materialise


def roll_up(df, levels, *values):
    """Cascade: sum to the first key list, then each coarser list from the one before."""
    steps = []
    for keys in levels:
        df = df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        steps.append(df)
    return steps


def pivot_sum(df, keys, by, values, value, names=None):
    """One summed column per fixed value; absent combinations are zero. Rows are shuffled once, already summed."""
    names = names or [str(v) for v in values]
    sums = [F.sum(F.when(F.col(by) == F.lit(v), F.col(value))) for v in values]
    return df.groupBy(*keys).agg(*[amount(F.coalesce(s, F.lit(0))).alias(n) for s, n in zip(sums, names)])


def with_totals(df, keys, *aggs):
    """Group rows plus subtotals and the grand total; ``level`` is 0 for a plain group row."""
    return df.rollup(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *aggs)


def totals_of_states(df, keys, member, n_distinct, **sums):
    """Group rows, subtotals and grand total of measures that don't add up.

    The rows are read and shuffled once, into partial states per group: sums, row counts and bitmaps of members. Each
    coarser level merges the states of the one below. Per row: ``keys`` (null above their level), ``level`` as in
    ``with_totals``, ``n_distinct``, ``n_rows`` and ``sums`` (``{new name: column}``); an average is a sum over a count,
    taken after merging. A null key is a group like any other; ``level`` tells it from a subtotal.
    """
    kinds = dict(df.dtypes)
    states = materialise(member_sets(df, keys, member, **sums), "states")
    levels = []
    for kept in range(len(keys), -1, -1):
        above = [F.lit(None).cast(kinds[k]).alias(k) for k in keys[kept:]]
        if kept < len(keys):
            states = merged(states, keys[:kept], *sums)
        level = F.lit((1 << len(keys) - kept) - 1).cast("bigint").alias("level")
        told = counted(states, keys[:kept], n_distinct, *sums)
        levels.append(told.select(*keys[:kept], *above, level, n_distinct, "n_rows", *sums))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
