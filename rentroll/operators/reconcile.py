"""Reconciliation between two systems, duplicates and data-quality reports."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F

from rentroll.operators.hot import count_per_key


def difference(first, *others):
    """First amount less the others; a blank counts as zero."""
    result = F.coalesce(first, F.lit(0))
    for o in others:
        result = result - F.coalesce(o, F.lit(0))
    return result


def compare_feeds(ours, theirs, key, our_amount, their_amount):
    """Every row of either system with flags for rows the other one lacks and for amounts that differ.

    A row with a null amount is there; its amount counts as zero.
    """
    here, there = F.lit(True).alias("_ours"), F.lit(True).alias("_theirs")
    both = ours.select("*", here).join(theirs.select("*", there), key, "full")
    in_ours, in_theirs = F.col("_ours").isNotNull(), F.col("_theirs").isNotNull()
    diff = difference(F.col(our_amount), F.col(their_amount))
    flagged = both.withColumns(
        {
            "missing": (~in_theirs).cast("int"),
            "missing_in_ours": (~in_ours).cast("int"),
            "mismatch": (in_ours & in_theirs & (diff != 0)).cast("int"),
            "difference": diff,
        }
    )
    return flagged.drop("_ours", "_theirs")


def keep_or_remove(df, keys, system, trusted):
    """Rows that exist in several copies stay; a single copy stays only if the trusted system has it."""
    counted = count_per_key(df, keys, "copies")
    return counted.withColumn(
        "verdict", F.when((F.col("copies") > 1) | (F.col(system) == trusted), "keep").otherwise("remove")
    )


def quality_report(df, value):
    """One row: rows, total, nulls, score and the two pass flags, in a single pass over the raw rows."""
    rows = F.count(F.lit(1))
    nulls = F.count_if(value.isNull())
    return df.agg(
        rows.alias("total_records"),
        F.sum(value).alias("total_amount"),
        nulls.alias("null_records"),
    ).withColumns(
        {
            "quality_score": F.round((F.col("total_records") - F.col("null_records")) * 100.0 / F.nullif(F.col("total_records"), F.lit(0)), 2).cast("double"),
            "no_nulls": F.col("null_records") == 0,
            "has_rows": F.col("total_records") > 0,
        }
    )


def digest_of(rows, key, amount, low, width):
    """Per key range an order-free digest: rows, sum and exclusive or of the hashes of key and amount (null as zero)."""
    row = F.xxhash64(F.col(key), F.coalesce(F.col(amount), F.lit(0)).cast("decimal(38,6)"))
    place = F.floor((F.col(key) - low) / width).cast("bigint")
    return rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("sum"), F.bit_xor(row).alias("xor"))


def within(rows, key, ranges):
    """Rows whose key lies in one of the half-open ranges: bounds on the bare column, so that they reach the scan."""
    return rows.filter(reduce(or_, [(F.col(key) >= a) & (F.col(key) < b) for a, b in ranges], F.lit(False)))


def differing_ranges(ours, theirs, key, our_amount, their_amount, fanout=64, leaf=100_000):
    """Half-open ranges of the integer ``key`` outside of which both systems have the same rows and amounts.

    A checksum tree, built only where it is needed: each level cuts the ranges that still differ into ``fanout`` parts, digests
    both systems there, and goes on with the parts that differ until they hold at most ``leaf`` keys each. A level that
    leaves most parts differing ends the search: going on would read everything again. The driver sees at most
    ``fanout`` ranges per level.
    """
    bounds = [s.agg(F.min(key).alias("low"), F.max(key).alias("high")).first() for s in (ours, theirs)]
    known = [(b.low, b.high) for b in bounds if b.low is not None]
    if not known:
        return []
    ranges = [(min(a for a, _ in known), max(b for _, b in known) + 1)]
    while True:
        size = sum(b - a for a, b in ranges)
        if max(b - a for a, b in ranges) <= leaf:
            return ranges
        width = max(1, -(-size // fanout))
        low = ranges[0][0]
        told = [digest_of(within(s, key, ranges), key, a, F.lit(low), F.lit(width)) for s, a in ((ours, our_amount), (theirs, their_amount))]
        both = told[0].alias("a").join(told[1].alias("b"), F.col("a.place") == F.col("b.place"), "full")
        same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "sum", "xor")])
        places = sorted(r.place for r in both.filter(~same).select(F.coalesce("a.place", "b.place").alias("place")).collect())
        parts = [(max(a, low + p * width), min(b, low + (p + 1) * width)) for p in places for a, b in ranges]
        found = [(a, b) for a, b in parts if a < b]
        left = sum(b - a for a, b in found)
        if not found or left > size / 2 or max(b - a for a, b in found) <= leaf:
            return found
        ranges = joined_up(found)


def joined_up(ranges):
    """Neighbouring ranges as one."""
    out = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def differences(ours, theirs, key, our_amount, their_amount, **tree):
    """The rows of ``compare_feeds`` that one system lacks or whose amounts differ; where the digests agree, neither system is
    joined."""
    ranges = joined_up(differing_ranges(ours, theirs, key, our_amount, their_amount, **tree))
    flagged = compare_feeds(within(ours, key, ranges), within(theirs, key, ranges), key, our_amount, their_amount)
    return flagged.filter("missing + missing_in_ours + mismatch > 0")
