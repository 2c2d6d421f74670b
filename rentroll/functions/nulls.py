"""Null handling and first-match ladders."""

from pyspark.sql import functions as F


def changed(now, before):
    """True when a value differs from the one before it; null to null is no change."""
    return ~now.eqNullSafe(before)


def default_to(col, value, dtype):
    """Replace null by ``value``; the result keeps the column's own type ``dtype``."""
    return F.coalesce(col, F.lit(value).cast(dtype))


def first_match(*rules, otherwise=None):
    """Ordered ``(condition, value)`` ladder; the first true condition wins."""
    (cond, value), *rest = rules
    ladder = F.when(cond, value)
    for cond, value in rest:
        ladder = ladder.when(cond, value)
    return ladder if otherwise is None else ladder.otherwise(otherwise)
