"""Report measures: named aggregate expressions, applied under any filter and grouping."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.functions.money import amount


def report(df, by, measures, where=None):
    """A visual: rows under ``where``, grouped by ``by``, one column per measure."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])


def year_to_date(df, by, day, value, out="ytd"):
    """Running sum inside each year; days are summed first, so a window holds 366 rows at most per key."""
    daily = df.groupBy(*by, F.to_date(day).alias("day")).agg(F.sum(value).alias("_day_total"))
    inside = (
        Window.partitionBy(*by, F.year("day"))
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.select(
        *by, "day", amount(F.col("_day_total")).alias("day_total"), amount(F.sum("_day_total").over(inside)).alias(out)
    )


def top_with_ties(df, n, value):
    """The ``n`` highest rows plus every row equal to the last of them."""
    cut = df.select(value).orderBy(F.col(value).desc()).limit(n).agg(F.min(value)).scalar()
    return df.filter(F.col(value) >= cut)


def summarise_by_default(df, by, numeric):
    """Every numeric column marked as summable, summed under the grouping."""
    return df.groupBy(*by).agg(*[amount(F.sum(c)).alias(f"sum_{c}") for c in numeric])


def freshness(feeds, at):
    """Latest day per feed, one partial aggregate each."""
    parts = [df.agg(F.max(F.to_date(at[name])).alias("latest")).select(F.lit(name).alias("feed"), "latest")
             for name, df in feeds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
