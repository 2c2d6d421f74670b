"""Money: exact decimals inside, rounded doubles at the edge of a report."""

from decimal import Decimal

from pyspark.sql import functions as F


def money(col, scale=4):
    """Exact amount from a double that stands for a decimal.

    Scaled to whole units first: a cast from double to decimal goes through text for every row.
    """
    units = F.rint(col * 10**scale).cast("bigint").cast("decimal(18,0)")
    return (units * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(18,{scale})")


def rounded(col, scale=4):
    """Amount from a quotient, which may have more digits than are kept; halves go up."""
    return col.cast(f"decimal(18,{scale})")


def amount(col, digits=2):
    """Report form of an exact amount."""
    return F.round(col, digits).cast("double")


def total(col):
    """Sum that is zero, not null, over no rows."""
    return F.coalesce(F.sum(col), F.lit(0))


def mean(col):
    """Average as one division of exact sum by count, so it repeats on any partitioning."""
    return F.sum(col).cast("double") / F.count(col)


def floor_zero(col):
    """Negative becomes zero; null stays null."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(0)))


def ratio(num, den):
    """Null instead of an error or infinity when the divisor is zero."""
    return F.when(den != 0, num / den)


def whole_ratio(num, den):
    """Integer division, cut towards zero; null on a zero divisor."""
    return F.when(den != 0, F.call_function("div", num, den))


def gain(result):
    return F.when(result > 0, result).otherwise(F.lit(0))


def loss(result):
    return F.when(result < 0, result).otherwise(F.lit(0))
