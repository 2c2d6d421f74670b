"""Model measures, visuals, calendars and report parameters."""

from datetime import date

from pyspark.sql import functions as F

from rentroll.functions.money import amount, mean, money
from rentroll.operators import calendars, measures
from rentroll.plans.base import AS_OF, DAY, GROSS, NET, customer_place, gross, net, open_items
from rentroll.plans.registry import query

PRICE = "CAST(o_totalprice AS DECIMAL(18,4))"


def price():
    return money(F.col("o_totalprice"))


@query(
    "model_measures",
    "X01 X02 X04 X15",
    f"""
    SELECT c_mktsegment, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total_sales, COUNT(*) AS n_sales,
           CAST(SUM({PRICE}) AS DOUBLE) / COUNT(*) AS avg_sale FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)
def model_measures(t):
    segment = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    named = {"total_sales": amount(F.sum(price())), "n_sales": F.count(F.lit(1)), "avg_sale": mean(price())}
    return measures.report(t("orders").join(segment, "o_custkey"), ["c_mktsegment"], named)


@query(
    "ytd_sales",
    "X03 W08",
    f"""
    WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, SUM({PRICE}) AS v FROM orders GROUP BY ALL)
    SELECT o_orderpriority, day, CAST(ROUND(v, 2) AS DOUBLE) AS day_total,
           CAST(ROUND(SUM(v) OVER (PARTITION BY o_orderpriority, year(day) ORDER BY day), 2) AS DOUBLE) AS ytd FROM d
    """,
)
def ytd_sales(t):
    orders = t("orders").select("o_orderpriority", "o_orderdate", price().alias("price"))
    return measures.year_to_date(orders, ["o_orderpriority"], "o_orderdate", "price")


@query(
    "overdue_measure",
    "X05 T01",
    f"""
    SELECT c_mktsegment, CAST(ROUND(COALESCE(SUM(CASE WHEN CAST(l_shipdate AS DATE) < {DAY} THEN {GROSS} END), 0), 2) AS DOUBLE) AS overdue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)
def overdue_measure(t):
    """Filtered sum: bills due before the as-of day. Lines are summed per order before the joins."""
    late = F.when(F.col("due") < F.lit(AS_OF), F.col("open"))
    per_order = open_items(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(late).alias("late"))
    owner = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    segment = t("customer").select("c_custkey", "c_mktsegment")
    joined = per_order.join(owner, "o_orderkey").join(segment, "c_custkey")
    return measures.report(joined, ["c_mktsegment"], {"overdue": amount(F.coalesce(F.sum("late"), F.lit(0)))})


@query(
    "feed_freshness",
    "X06 U01 A04",
    """
    SELECT 'orders' AS feed, CAST(MAX(o_orderdate) AS DATE) AS latest FROM orders
    UNION ALL SELECT 'shipments', CAST(MAX(l_shipdate) AS DATE) FROM lineitem
    UNION ALL SELECT 'events', CAST(MAX(ts) AS DATE) FROM events
    UNION ALL SELECT 'returns', CAST(MAX(l_shipdate) AS DATE) FROM lineitem WHERE l_returnflag = 'R'
    """,
)
def feed_freshness(t):
    feeds = {
        "orders": t("orders"),
        "shipments": t("lineitem"),
        "events": t("events"),
        "returns": t("lineitem").filter(F.col("l_returnflag") == "R"),
    }
    at = {"orders": "o_orderdate", "shipments": "l_shipdate", "events": "ts", "returns": "l_shipdate"}
    return measures.freshness(feeds, at)


@query(
    "months_overdue_hist",
    "X07 X22 X17 M05",
    f"""
    SELECT CAST(floor(date_diff('day', CAST(l_shipdate AS DATE), {DAY}) / 30) AS BIGINT) AS months_overdue, COUNT(*) AS n_items
    FROM lineitem WHERE {GROSS} > 0 GROUP BY months_overdue
    """,
)
def months_overdue_hist(t):
    late = F.floor(F.datediff(F.lit(AS_OF), F.col("due")) / 30).alias("months_overdue")
    return open_items(t).filter(F.col("open") > 0).groupBy(late).agg(F.count(F.lit(1)).alias("n_items"))


@query(
    "calendar_auto",
    "X09 S07 A04",
    """
    WITH b AS (SELECT date_trunc('year', MIN(o_orderdate)) AS lo, date_trunc('year', MAX(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS hi FROM orders),
    d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
    SELECT day, year(day)::INTEGER AS year_no, 'Q' || quarter(day) AS quarter_label, monthname(day) AS month_name,
           month(day)::INTEGER AS month_no, (year(day) * 100 + month(day))::INTEGER AS month_serial FROM d
    """,
)
def calendar_auto(t):
    return calendars.with_parts(calendars.calendar_of(t("orders"), "o_orderdate"))


@query(
    "calendar_between",
    "X10",
    """
    SELECT day, COUNT(o_orderkey) AS n_orders FROM (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS day)
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY day
    """,
)
def calendar_between(t):
    """Every day of a fixed range, with the orders of the day if there are any."""
    first = date(2001, 1, 1)
    recent = t("orders").filter((F.col("o_orderdate") >= F.lit(first)) & (F.col("o_orderdate") < F.lit(date(2001, 7, 1))))
    counted = recent.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("o_orderkey").alias("n"))
    days = calendars.calendar(t.spark, first, AS_OF)
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_orders"))


@query(
    "date_hierarchy",
    "X11 X19",
    """
    SELECT year(o_orderdate)::INTEGER AS year_no, ((month(o_orderdate) + 2) // 3)::INTEGER AS quarter_no,
           'Qtr ' || ((month(o_orderdate) + 2) // 3) AS quarter_label, monthname(o_orderdate) AS month_name,
           day(o_orderdate)::INTEGER AS day_no, COUNT(*) AS n_orders FROM orders GROUP BY ALL
    """,
)
def date_hierarchy(t):
    days = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    parts = calendars.with_hierarchy(days)
    return parts.groupBy("year_no", "quarter_no", "quarter_label", "month_name", "day_no").agg(F.sum("n").alias("n_orders"))


@query(
    "calendar_to_max",
    "X12",
    """
    WITH b AS (SELECT date_trunc('year', MIN(o_orderdate)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders)
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b
    """,
)
def calendar_to_max(t):
    """Calendar cut at the last origination day."""
    orders = t("orders")
    latest = orders.agg(F.max(F.to_date("o_orderdate"))).scalar()
    return calendars.calendar_of(orders, "o_orderdate").filter(F.col("day") <= latest)


@query(
    "date_dimension",
    "X09 T10 K01",
    """
    WITH b AS (SELECT date_trunc('year', MIN(ts)) AS lo, date_trunc('year', MAX(ts)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS hi FROM events),
    d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
    SELECT day, strftime(day, '%Y%m%d')::INTEGER AS date_key, (dayofweek(day) + 1)::INTEGER AS day_of_week, dayofyear(day)::INTEGER AS day_of_year,
           ((dayofyear(day) + dayofweek(date_trunc('year', day)) + 6) // 7)::INTEGER AS week_of_year, dayname(day) AS day_name,
           strftime(day, '%a') AS day_short, strftime(day, '%b') AS month_short FROM d
    """,
)
def date_dimension(t):
    wide = calendars.date_dimension(calendars.calendar_of(t("events"), "ts"))
    return wide.select(
        "day", "date_key", "day_of_week", "day_of_year", "week_of_year", "day_name", "day_short", "month_short"
    )


@query(
    "filtered_text_measure",
    "X13 F04",
    f"""
    SELECT l_suppkey, CAST(ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'R' AND lower(p_name) LIKE '%ring%' THEN {NET} END), 0), 2) AS DOUBLE) AS ring_returns
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey
    """,
)
def filtered_text_measure(t):
    """Sum under a kind and a name pattern."""
    name = t("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").like("%ring%").alias("is_ring"))
    lines = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", net())).alias("returned")
    )
    hit = F.when(F.col("is_ring"), F.col("returned"))
    return measures.report(lines.join(name, "l_partkey"), ["l_suppkey"], {"ring_returns": amount(F.coalesce(F.sum(hit), F.lit(0)))})


@query(
    "default_sums",
    "X14",
    f"""
    SELECT l_returnflag, l_linestatus, {", ".join(f"CAST(ROUND(SUM(CAST({c} AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_{c}" for c in ("l_quantity", "l_extendedprice", "l_tax"))}
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def default_sums(t):
    numeric = ["l_quantity", "l_extendedprice", "l_tax"]
    exact = t("lineitem").select("l_returnflag", "l_linestatus", *[money(F.col(c)).alias(c) for c in numeric])
    return measures.summarise_by_default(exact, ["l_returnflag", "l_linestatus"], numeric)


@query(
    "summarize_month",
    "X15 X23 S11",
    f"""
    SELECT year(o_orderdate)::INTEGER AS year_no, month(o_orderdate)::INTEGER AS month_no, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total,
           COUNT(*) AS quantity FROM orders WHERE year(o_orderdate) = 2000 AND month(o_orderdate) IN (3, 4) GROUP BY 1, 2
    """,
)
def summarize_month(t, year=2000, first=3, last=4):
    """Report with year and month parameters; groups come from the fact, so empty months do not show."""
    low, high = date(year, first, 1), date(year + last // 12, last % 12 + 1, 1)
    at = F.col("o_orderdate")
    named = {"total": amount(F.sum(price())), "quantity": F.count(F.lit(1))}
    by = [F.year(at).alias("year_no"), F.month(at).alias("month_no")]
    return measures.report(t("orders"), by, named, (at >= F.lit(low)) & (at < F.lit(high)))


@query(
    "visual_filters",
    "X16 X17",
    """
    SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
        AND o_totalprice BETWEEN 50000 AND 250000 AND o_custkey > 10 GROUP BY o_orderpriority
    """,
)
def visual_filters(t):
    context = (
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
        & F.col("o_totalprice").between(50000, 250000)
        & (F.col("o_custkey") > 10)
    )
    return measures.report(t("orders"), ["o_orderpriority"], {"n_orders": F.count(F.lit(1))}, context)


@query(
    "sales_trend",
    "X19 A01",
    f"""
    SELECT year(o_orderdate)::INTEGER AS year_no, month(o_orderdate)::INTEGER AS month_no, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total_sales
    FROM orders GROUP BY 1, 2
    """,
)
def sales_trend(t):
    at = F.col("o_orderdate")
    by = [F.year(at).alias("year_no"), F.month(at).alias("month_no")]
    return measures.report(t("orders"), by, {"total_sales": amount(F.sum(price()))})


@query(
    "sales_by_region",
    "X20",
    f"""
    SELECT r_name, CAST(ROUND(SUM({PRICE}), 2) AS DOUBLE) AS total_sales FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """,
)
def sales_by_region(t):
    per_customer = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(price()).alias("price"))
    return measures.report(
        per_customer.join(customer_place(t), "c_custkey"), ["r_name"], {"total_sales": amount(F.sum("price"))}
    )


@query(
    "due_area_chart",
    "X21",
    f"""
    SELECT year(l_shipdate)::INTEGER AS year_no, month(l_shipdate)::INTEGER AS month_no, CAST(ROUND(SUM({NET}), 2) AS DOUBLE) AS net_due,
           CAST(ROUND(SUM({GROSS} - {NET}), 2) AS DOUBLE) AS tax_due, CAST(ROUND(SUM({GROSS}), 2) AS DOUBLE) AS all_due FROM lineitem GROUP BY 1, 2
    """,
)
def due_area_chart(t):
    by = [F.year("l_shipdate").alias("year_no"), F.month("l_shipdate").alias("month_no")]
    named = {
        "net_due": amount(F.sum(net())),
        "tax_due": amount(F.sum(gross() - net())),
        "all_due": amount(F.sum(gross())),
    }
    return measures.report(t("lineitem"), by, named)
