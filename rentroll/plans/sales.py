"""Sales pipeline and views over order lines."""

from pyspark.sql import functions as F

from rentroll.functions.money import amount
from rentroll.operators import sales
from rentroll.plans.base import AS_OF, DAY, customer_place
from rentroll.plans.registry import query

PRICE = "CAST(amount AS DECIMAL(18,4))"
RAW_SQL = """
    SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, CASE WHEN l_tax > 0 OR l_linenumber > 1 THEN l_extendedprice END AS amount,
           CAST(l_quantity AS INTEGER) - 1 AS quantity, r_name AS region, p_type AS category, l_partkey AS product_id,
           CAST(l_shipdate AS DATE) AS sale_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""


def raw_sales(t):
    """Raw sales rows: some amounts missing, some quantities zero."""
    lines = t("lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("product_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when((F.col("l_tax") > 0) | (F.col("l_linenumber") > 1), F.col("l_extendedprice")).alias("amount"),
        (F.col("l_quantity").cast("int") - 1).alias("quantity"),
    )
    place = customer_place(t).select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"))
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(place, "o_custkey")
    part = t("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    return lines.join(part, "product_id").join(orders.select("l_orderkey", "region"), "l_orderkey").drop("l_orderkey")


def fact_sales(t):
    return raw_sales(t).withColumn("sale_date", F.to_date("date"))


@query(
    "sales_clean",
    "N01 P10 T11 M05",
    f"SELECT date, amount, quantity, region, category, sale_date, amount / quantity AS unit_price FROM ({RAW_SQL}) WHERE amount > 0 AND quantity > 0",
)
def sales_clean(t):
    return sales.clean(raw_sales(t).drop("product_id"))


@query(
    "sales_regional_daily",
    "N02 A01 A02 A05 O01",
    f"""
    SELECT region, sale_date, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total_sales, COUNT(*) AS transaction_count,
           CAST(SUM({PRICE}) AS DOUBLE) / COUNT(*) AS avg_transaction_value
    FROM ({RAW_SQL}) WHERE amount > 0 AND quantity > 0 GROUP BY region, sale_date ORDER BY region, sale_date
    """,
)
def sales_regional_daily(t):
    return sales.regional_daily(sales.clean(raw_sales(t)))


@query(
    "sales_by_category",
    "N03 O02",
    f"""
    SELECT category, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total_sales, SUM(quantity)::BIGINT AS total_quantity,
           CAST(SUM(CAST(amount / quantity AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS avg_unit_price
    FROM ({RAW_SQL}) WHERE amount > 0 AND quantity > 0 GROUP BY category ORDER BY total_sales DESC
    """,
)
def sales_by_category(t):
    return sales.by_category(sales.clean(raw_sales(t)))


@query(
    "dq_report",
    "N04 A11",
    f"""
    SELECT COUNT(*) AS total_records, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total_amount, COUNT(*) FILTER (WHERE amount IS NULL) AS null_records,
           CAST(ROUND(CAST(COUNT(amount) * 100.0 AS DECIMAL(38,6)) / COUNT(*), 2) AS DOUBLE) AS quality_score,
           COUNT(*) = COUNT(amount) AS no_nulls, COUNT(*) > 0 AS has_rows FROM ({RAW_SQL})
    """,
)
def dq_report(t):
    return sales.quality(raw_sales(t)).withColumn("total_amount", amount(F.col("total_amount")))


DAILY_SQL = f"""
    SELECT product_id, region, sale_date, SUM(quantity)::BIGINT AS total_quantity, SUM({PRICE}) AS total_amount,
           COUNT(*) AS transaction_count, CAST(SUM({PRICE}) AS DOUBLE) / COUNT(amount) AS avg_amount
    FROM ({RAW_SQL}) WHERE sale_date >= {DAY} - INTERVAL 2 YEAR GROUP BY product_id, region, sale_date"""


@query(
    "sales_summary",
    "N05 A01 A02 A05 T09",
    f"SELECT * REPLACE (CAST(ROUND(total_amount, 2) AS DOUBLE) AS total_amount) FROM ({DAILY_SQL})",
)
def sales_summary(t):
    return sales.daily_sales(fact_sales(t), AS_OF).withColumn("total_amount", amount(F.col("total_amount")))


@query(
    "product_analysis",
    "N06 S09 J01 A03 A05",
    f"""
    SELECT product_id, p_name, p_type, region, SUM(total_quantity)::BIGINT AS units_sold, CAST(ROUND(SUM(total_amount), 2) AS DOUBLE) AS revenue,
           CAST(SUM(CAST(avg_amount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(avg_amount) AS avg_order_value, COUNT(DISTINCT sale_date) AS days_with_sales
    FROM ({DAILY_SQL}) JOIN part ON product_id = p_partkey GROUP BY product_id, p_name, p_type, region
    """,
)
def product_analysis(t):
    product = t("part").select(F.col("p_partkey").alias("product_id"), "p_name", "p_type")
    done = sales.product_performance(sales.daily_sales(fact_sales(t), AS_OF), product)
    return done.withColumn("revenue", amount(F.col("revenue")))


@query(
    "regional_performance",
    "N07 A03 A04 A05",
    f"""
    SELECT region, COUNT(DISTINCT product_id) AS unique_products, SUM(total_quantity)::BIGINT AS units_sold,
           CAST(ROUND(SUM(total_amount), 2) AS DOUBLE) AS revenue,
           CAST(SUM(CAST(avg_amount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(avg_amount) AS avg_transaction_value,
           CAST(ROUND(MAX(total_amount), 2) AS DOUBLE) AS best_day, CAST(ROUND(MIN(total_amount), 2) AS DOUBLE) AS worst_day
    FROM ({DAILY_SQL}) GROUP BY region
    """,
)
def regional_performance(t):
    return sales.region_performance(sales.daily_sales(fact_sales(t), AS_OF))
