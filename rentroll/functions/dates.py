"""Calendar arithmetic with an explicit as-of day; nothing here reads the wall clock."""

from datetime import date, timedelta

from pyspark.sql import functions as F

# Sentinel days with a meaning in the lease data.
UNKNOWN_START = date(1900, 1, 1)
NOT_TERMINATED = date(9999, 1, 1)
OPEN_END = date(9999, 12, 31)


def day(col):
    return F.to_date(col)


def on_or_before(col, as_of):
    """Timestamp up to the end of a day, as a bound on the bare column that the scan can use."""
    return col < F.lit(as_of + timedelta(days=1))


def on_or_after(col, as_of):
    return col >= F.lit(as_of)


def days_between(start, end):
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(F.to_date(end), F.to_date(start))


def month_steps(start, end):
    """Month boundaries crossed, whatever the day of the month."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def plus_days(col, n):
    return F.date_add(F.to_date(col), n)


def plus_years(col, n):
    return F.add_months(F.to_date(col), 12 * n)


def same_month(col, as_of):
    """Same calendar month as ``as_of``, as a range so that a scan can use it."""
    first = as_of.replace(day=1)
    after = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return (col >= F.lit(first)) & (col < F.lit(after))


def month_key(col):
    return F.date_format(col, "yyyy-MM")


def uk_date(col):
    return F.date_format(col, "dd/MM/yyyy")


def sunday_week(col):
    """Week number where week 1 holds 1 January and weeks start on Sunday."""
    d = F.to_date(col)
    lead_in = F.dayofweek(F.trunc(d, "year")) - 1
    return F.ceil((F.dayofyear(d) + lead_in) / F.lit(7)).cast("int")


def friday_on_or_after(col):
    """Friday of the Saturday-to-Friday week that holds the day."""
    d = F.to_date(col)
    return F.date_add(d, F.pmod(F.lit(6) - F.dayofweek(d), F.lit(7)))


def known_start(start, *fallbacks):
    """Start day, with the unknown-start sentinel replaced by the first fallback present."""
    return F.when(F.to_date(start) == F.lit(UNKNOWN_START), F.coalesce(*fallbacks)).otherwise(start)


def real_date_key(key):
    """Date keys above zero stand for real days; -1 means none."""
    return key > 0
