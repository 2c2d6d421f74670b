"""Daily sales pipeline: cleaning, summaries, quality report, and the three stacked sales views."""

from pyspark.sql import functions as F

from rentroll.functions.dates import plus_years
from rentroll.functions.money import amount, mean, money, rounded
from rentroll.operators.reconcile import quality_report

RAW_SCHEMA = "date string, amount double, quantity int, region string, category string"


def clean(raw):
    """Rows with positive amount and quantity, the day parsed, and a unit price."""
    good = raw.filter((F.col("amount") > 0) & (F.col("quantity") > 0))
    return good.withColumns(
        {"sale_date": F.to_date("date", "yyyy-MM-dd"), "unit_price": F.col("amount") / F.col("quantity")}
    )


def regional_daily(cleaned):
    exact = money(F.col("amount"))
    per_day = cleaned.groupBy("region", "sale_date").agg(
        amount(F.sum(exact)).alias("total_sales"),
        F.count(F.lit(1)).alias("transaction_count"),
        mean(exact).alias("avg_transaction_value"),
    )
    return per_day.orderBy("region", "sale_date")


def by_category(cleaned):
    per_category = cleaned.groupBy("category").agg(
        amount(F.sum(money(F.col("amount")))).alias("total_sales"),
        F.sum("quantity").alias("total_quantity"),
        mean(rounded(F.col("unit_price"))).alias("avg_unit_price"),
    )
    return per_category.orderBy(F.col("total_sales").desc())


def quality(raw):
    """Nulls are counted on the raw rows; after the amount filter there could be none."""
    return quality_report(raw, money(F.col("amount")))


def daily_sales(fact, as_of, years=2):
    """Sales by product, region and day over the last ``years`` years."""
    recent = fact.filter(F.col("sale_date") >= plus_years(F.lit(as_of), -years))
    exact = money(F.col("amount"))
    return recent.groupBy("product_id", "region", "sale_date").agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum(exact).alias("total_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        mean(exact).alias("avg_amount"),
    )


def product_performance(daily, product):
    """Product and region totals; the average is over the daily averages, unweighted."""
    per_pair = daily.groupBy("product_id", "region").agg(
        F.sum("total_quantity").alias("units_sold"),
        F.sum("total_amount").alias("revenue"),
        mean(rounded(F.col("avg_amount"))).alias("avg_order_value"),
        F.count("sale_date").alias("days_with_sales"),
    )
    return product.join(per_pair, "product_id")


def region_performance(daily):
    """Region totals; best and worst are over one product's day."""
    return daily.groupBy("region").agg(
        F.countDistinct("product_id").alias("unique_products"),
        F.sum("total_quantity").alias("units_sold"),
        amount(F.sum("total_amount")).alias("revenue"),
        mean(rounded(F.col("avg_amount"))).alias("avg_transaction_value"),
        amount(F.max("total_amount")).alias("best_day"),
        amount(F.min("total_amount")).alias("worst_day"),
    )
