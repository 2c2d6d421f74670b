"""Generated calendars."""

from pyspark.sql import functions as F

from rentroll.functions.dates import sunday_week


def calendar(spark, start, end, day="day"):
    """One row per day of a closed range given as literals."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias(day))


def calendar_of(df, *dates, day="day"):
    """Whole years that span every date in the given columns: one grouped row, then its days."""
    ends = F.array(*[F.min(F.to_date(d)) for d in dates], *[F.max(F.to_date(d)) for d in dates])
    span = df.agg(F.array_min(ends).alias("low"), F.array_max(ends).alias("high"))
    until = F.date_sub(F.add_months(F.trunc("high", "year"), 12), 1)
    return span.select(F.explode(F.sequence(F.trunc("low", "year"), until)).alias(day))


def with_parts(df, day="day"):
    """Year, quarter, month and sort columns of a calendar."""
    d = F.col(day)
    return df.select(
        "*",
        F.year(d).alias("year_no"),
        F.concat(F.lit("Q"), F.quarter(d)).alias("quarter_label"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.month(d).alias("month_no"),
        (F.year(d) * 100 + F.month(d)).alias("month_serial"),
    )


def with_hierarchy(df, day="day"):
    """Drill-down columns Year > Quarter > Month > Day."""
    d = F.col(day)
    quarter_no = F.floor((F.month(d) + 2) / 3).cast("int")
    return df.select(
        "*",
        F.year(d).alias("year_no"),
        quarter_no.alias("quarter_no"),
        F.concat(F.lit("Qtr "), quarter_no.cast("string")).alias("quarter_label"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day_no"),
    )


def date_dimension(df, day="day"):
    """Wide date table: key, parts, names and week of year (Sunday weeks)."""
    d = F.col(day)
    return with_parts(df, day).select(
        "*",
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        sunday_week(d).alias("week_of_year"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "EEE").alias("day_short"),
        F.date_format(d, "MMM").alias("month_short"),
    )
