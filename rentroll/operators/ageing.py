"""Ageing of open balances against an as-of day, and ladders by days to go."""

from datetime import timedelta

from pyspark.sql import functions as F

from rentroll.functions.money import amount
from rentroll.functions.nulls import first_match

# Band labels and the widest day of each band.
CURRENT = "Current"
OLDEST = "120+ Days"
BANDS = [("1-30 Days", 30), ("31-60 Days", 60), ("61-90 Days", 90), ("91-120 Days", 120)]
CHASE_BANDS = [("1-30 Days", 1, 30), ("31-60 Days", 31, 60), ("61-90 Days", 61, 90)]
CHASE_OLDEST = "91+ Days"
LADDER = [
    ("Already Matured", 0),
    ("1 Month or Less", 30),
    ("1-2 Months", 60),
    ("2-3 Months", 90),
    ("3-6 Months", 180),
    ("6-12 Months", 365),
]
BEYOND = "More than 1 Year"


def age_band(due, as_of):
    """Band of a due day. Due today is current, a missing due day falls to the oldest band."""
    bounds = [(due >= F.lit(as_of), F.lit(CURRENT))]
    bounds += [(due >= F.lit(as_of - timedelta(days=n)), F.lit(label)) for label, n in BANDS]
    return first_match(*bounds, otherwise=F.lit(OLDEST))


def chase_band(due, as_of):
    """Variant for chasing cash: bands start the day after the due day, due today has no band."""
    late = F.datediff(F.lit(as_of), due)
    rules = [(late.between(low, high), F.lit(label)) for label, low, high in CHASE_BANDS]
    return first_match(*rules, (late > CHASE_BANDS[-1][2], F.lit(CHASE_OLDEST)))


def _name(label):
    if label == CURRENT:
        return "current_due"
    return "days_" + label.split()[0].replace("-", "_").replace("+", "_plus")


BAND_COLUMNS = [_name(label) for label in [CURRENT, *[b for b, _ in BANDS], OLDEST]]


def _banded(open_items, due, value, as_of):
    """Items with their band in ``_band`` and their value, null for none, in ``_value``.

    Zero balances become null instead of being filtered: a filter would compute the value twice.
    """
    return open_items.withColumns({"_band": age_band(due, as_of), "_value": F.nullif(value, F.lit(0))})


def band_sums(open_items, keys, due, value, as_of):
    """One row per key and band: a single sum per item, for joins before the bands are spread."""
    sums = _banded(open_items, due, value, as_of).groupBy(*keys, "_band").agg(F.sum("_value").alias("_value"))
    return sums.filter(F.col("_value").isNotNull())


def spread_bands(banded, keys):
    """One row per key with an exact sum per band; a band without items is null, a key without any is left out."""

    def of(cond):
        return F.sum(F.when(cond, F.col("_value")))

    labels = [CURRENT, *[b for b, _ in BANDS], OLDEST]
    sums = banded.groupBy(*keys).agg(
        *[of(F.col("_band") == label).alias(_name(label)) for label in labels],
        of(F.col("_band") != CURRENT).alias("overdue"),
        F.sum("_value").alias("outstanding"),
    )
    return sums.filter(F.col("outstanding").isNotNull())


def ageing(open_items, keys, due, value, as_of):
    """Ageing in a single grouped pass. ``open_items`` holds balances with tax; zero balances are left out."""
    return spread_bands(_banded(open_items, due, value, as_of), keys)


SUM_COLUMNS = [*BAND_COLUMNS, "overdue", "outstanding"]


def ageing_report(aged):
    """Report form: every band rounded to pennies."""
    return aged.withColumns({c: amount(F.col(c)) for c in SUM_COLUMNS})


CHASE_COLUMNS = {_name(label): label for label in [*[b for b, _, _ in CHASE_BANDS], CHASE_OLDEST]}


def chase_columns(due, value, as_of):
    """Columns of an item's value by chase band, zero in the bands it is not in."""
    band = chase_band(due, as_of)
    return {c: F.when(band == label, value).otherwise(F.lit(0)) for c, label in CHASE_COLUMNS.items()}


def terms_due(due, credit_days, gets_terms):
    """Due day moved by the credit terms where the item earns them; an unknown kind stays null."""
    return F.when(gets_terms, F.date_add(due, credit_days)).when(~gets_terms, due)


def days_to_go(end, as_of):
    return F.datediff(end, F.lit(as_of))


def days_ladder(days):
    """Label for the days left to maturity."""
    return first_match(*[(days <= n, F.lit(label)) for label, n in LADDER], (days.isNotNull(), F.lit(BEYOND)))
