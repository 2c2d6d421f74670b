"""Join shapes on the fixture tables."""

from datetime import date

from pyspark.sql import functions as F

from rentroll.functions.dates import OPEN_END
from rentroll.functions.money import amount
from rentroll.operators import joins
from rentroll.operators.calendars import calendar_of, with_parts
from rentroll.operators.timeline import friday_snapshots
from rentroll.plans.base import AS_OF, NET, customer_place, net
from rentroll.plans.registry import query

LAST_DAY = date(2099, 12, 31)  # on or after every day in the tables

@query(
    "inner_join_dims",
    "J01 P01 S05",
    """
    SELECT c_custkey AS "Account", c_name AS "Customer Name", n_name AS "Country", c_acctbal AS "Balance"
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def inner_join_dims(t):
    return customer_place(t).select(
        F.col("c_custkey").alias("Account"),
        F.col("c_name").alias("Customer Name"),
        F.col("n_name").alias("Country"),
        F.col("c_acctbal").alias("Balance"),
    )


@query(
    "left_join_filtered_right",
    "J02 J03 A02 V082",
    """
    SELECT c_custkey, COUNT(o_orderkey) AS urgent_orders
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey
    """,
)
def left_join_filtered_right(t):
    """The right side is filtered and counted before the join; customers without a match stay."""
    urgent = t("orders").filter(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("c_custkey"))
    counted = urgent.agg(F.count("o_orderkey").alias("n"))
    return t("customer").join(counted, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0).cast("bigint")).alias("urgent_orders")
    )


@query(
    "anti_join_no_orders",
    "J04 P05 V012",
    """
    SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01'
    WHERE o_orderkey IS NULL
    """,
)
def anti_join_no_orders(t):
    recent = t("orders").filter(F.col("o_orderdate") >= F.lit(date(2001, 1, 1)))
    return t("customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "semi_join_buyers",
    "J05 P04 V112",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 400000)
    """,
)
def semi_join_buyers(t):
    big = t("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 400000))
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "interval_join_orders",
    "J06 T05",
    """
    WITH spans AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_day, CAST(o_orderdate AS DATE) + 45 AS to_day FROM orders)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_day, from_day, to_day
    FROM lineitem JOIN spans ON l_orderkey = o_orderkey
        AND CAST(l_shipdate AS DATE) >= from_day AND CAST(l_shipdate AS DATE) < to_day
    """,
)
def interval_join_orders(t):
    """Lines shipped inside the half-open window that starts at the order day."""
    lines = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_day")
    )
    start = F.to_date("o_orderdate")
    spans = t("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), start.alias("from_day"), F.date_add(start, 45).alias("to_day")
    )
    low, high = F.col("from_day"), F.col("to_day")
    return joins.interval_join(lines, spans, ["l_orderkey"], "ship_day", low, high, high)


@query(
    "interval_join_closed",
    "J06 D05 V099",
    """
    WITH spans AS (SELECT c_custkey, MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi
                   FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_custkey)
    SELECT c_custkey, strftime(o_orderdate, '%Y-%m') AS month_key, COUNT(*) AS n_orders
    FROM orders JOIN spans ON o_custkey = c_custkey AND o_orderdate BETWEEN lo AND hi GROUP BY c_custkey, month_key
    """,
)
def interval_join_closed(t):
    """Orders between a customer's first and last closed order, both days included."""
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderstatus")
    spans = orders.filter(F.col("o_orderstatus") == "F").groupBy("c_custkey").agg(
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")
    )
    inside = joins.interval_join(
        orders, spans, ["c_custkey"], "o_orderdate", F.col("lo"), F.col("hi"), F.col("hi"), closed=True
    )
    return inside.groupBy("c_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month_key")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )


@query(
    "interval_join_decades",
    "J06 T05",
    """
    WITH terms AS (
        SELECT s_suppkey, CAST(s_suppkey % 3 AS INTEGER) AS term,
               DATE '1975-01-01' + CAST(s_suppkey * 37 % 9000 AS INTEGER) AS from_day,
               CASE WHEN s_suppkey % 11 = 0 THEN DATE '9999-12-31'
                    ELSE DATE '1975-01-01' + CAST(s_suppkey * 37 % 9000 + s_suppkey * 53 % 14000 AS INTEGER) END AS to_day
        FROM supplier)
    SELECT s_suppkey, term, from_day, to_day, COUNT(*) AS n_lines, MIN(CAST(l_shipdate AS DATE)) AS first_day
    FROM lineitem JOIN terms ON l_suppkey = s_suppkey
        AND CAST(l_shipdate AS DATE) >= from_day AND CAST(l_shipdate AS DATE) < to_day
    GROUP BY s_suppkey, term, from_day, to_day
    """,
)
def interval_join_decades(t):
    """Lines shipped inside a supplier's term: terms of days, of decades and without an end."""
    start, key = F.lit("1975-01-01").cast("date"), F.col("s_suppkey")
    terms = t("supplier").select(
        "s_suppkey",
        (key % 3).cast("int").alias("term"),
        F.date_add(start, (key * 37 % 9000).cast("int")).alias("from_day"),
        F.when(key % 11 == 0, F.lit(OPEN_END)).otherwise(F.date_add(start, (key * 37 % 9000 + key * 53 % 14000).cast("int"))).alias("to_day"),
    )
    lines = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("ship_day"))
    inside = joins.interval_join(lines, terms, ["s_suppkey"], "ship_day", F.col("from_day"), F.col("to_day"), LAST_DAY)
    return inside.groupBy("s_suppkey", "term", "from_day", "to_day").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("ship_day").alias("first_day")
    )


@query(
    "spine_expansion",
    "J07 T05",
    """
    WITH spans AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + 20 AS hi
                   FROM orders),
    days AS (SELECT CAST(d AS DATE) AS snapshot FROM generate_series(DATE '1990-01-05', DATE '2001-06-30', INTERVAL 7 DAY) g(d))
    SELECT snapshot, COUNT(*) AS open_orders FROM spans JOIN days ON snapshot BETWEEN lo AND hi GROUP BY snapshot
    """,
)
def spine_expansion(t):
    """Range join to a Friday calendar, as one generated list per interval."""
    day = F.to_date("o_orderdate")
    spans = t("orders").select(day.alias("lo"), F.date_add(day, 20).alias("hi"))
    weeks = friday_snapshots(spans, F.col("lo"), F.col("hi"), AS_OF)
    return weeks.groupBy("snapshot").agg(F.count(F.lit(1)).alias("open_orders"))


@query(
    "or_join_customers",
    "J08 V094",
    """
    SELECT c_custkey, s_suppkey, c_name, s_name FROM customer JOIN supplier
    ON c_custkey = s_suppkey OR replace(c_name, 'Customer', 'Supplier') = s_name
    """,
)
def or_join_customers(t):
    """Match on the id or on the name; a pair that meets both comes once."""
    customer = t("customer").select("c_custkey", "c_name")
    supplier = t("supplier").select("s_suppkey", "s_name")
    same_id = F.col("c_custkey") == F.col("s_suppkey")
    same_name = F.replace("c_name", F.lit("Customer"), F.lit("Supplier")) == F.col("s_name")
    return joins.either_key_join(customer, supplier, same_id, same_name)


@query(
    "text_key_join",
    "J09 K04",
    """
    SELECT o_orderkey, o_custkey, c_name FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders)
    JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name FROM customer) ON o_custkey = k
    """,
)
def text_key_join(t):
    """One system keeps the id as text, the other as a number."""
    texts = t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    return joins.text_key_join(texts, t("customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey").drop(
        "c_custkey"
    )


@query(
    "self_join_roles",
    "J10 V118",
    """
    SELECT o_orderkey, c.n_name AS customer_nation, s.n_name AS supplier_nation, COUNT(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation c ON c.n_nationkey = c_nationkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY ALL
    """,
)
def self_join_roles(t):
    """The same dimension under two roles."""
    nation = t("nation").select("n_nationkey", "n_name")
    buyer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("customer_nation")
    )
    seller = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("supplier_nation")
    )
    per_order = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    wide = joins.star_join(
        per_order, (orders, "o_orderkey", "inner"), (buyer, "o_custkey", "inner"), (seller, "l_suppkey", "inner")
    )
    return wide.groupBy("o_orderkey", "customer_nation", "supplier_nation").agg(F.sum("n").alias("n_lines"))


@query(
    "star_join_wide",
    "J11 X15 A01",
    f"""
    SELECT r_name, c_mktsegment, p_brand, s_nationkey, COUNT(*) AS n_lines, CAST(ROUND(SUM({NET}), 2) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY r_name, c_mktsegment, p_brand, s_nationkey
    """,
)
def star_join_wide(t):
    place = customer_place(t).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "r_name")
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", net().alias("net"))
    wide = joins.star_join(
        lines,
        (part, "l_partkey", "inner"),
        (supplier, "l_suppkey", "inner"),
        (orders, "l_orderkey", "inner"),
        (place, "o_custkey", "inner"),
    )
    return wide.groupBy("r_name", "c_mktsegment", "p_brand", "s_nationkey").agg(
        F.count(F.lit(1)).alias("n_lines"), amount(F.sum("net")).alias("revenue")
    )


@query(
    "outer_forced_inner",
    "J12 P05",
    """
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    WHERE o_orderkey IS NOT NULL AND o_totalprice > 450000
    """,
)
def outer_forced_inner(t):
    """A left join whose right side must be present is an inner join, and is written as one."""
    dear = t("orders").filter(F.col("o_totalprice") > 450000)
    return t("customer").join(dear, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query(
    "preaggregated_join",
    "J13 A01 A02 V017",
    f"""
    SELECT o_orderkey, o_orderstatus, n_lines, order_net FROM orders LEFT JOIN (
        SELECT l_orderkey, COUNT(*) AS n_lines, CAST(ROUND(SUM({NET}), 2) AS DOUBLE) AS order_net
        FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
    """,
)
def preaggregated_join(t):
    totals = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), amount(F.sum(net())).alias("order_net")
    )
    return t("orders").select("o_orderkey", "o_orderstatus").join(totals, "o_orderkey", "left")


@query(
    "date_part_join",
    "J14 X09",
    """
    SELECT CAST(ts AS DATE) AS day, monthname(ts) AS month_name, COUNT(*) AS n_events
    FROM events GROUP BY 1, 2
    """,
)
def date_part_join(t):
    """Events to a generated calendar by the day part of the timestamp; days are counted before the join."""
    events = t("events").select("ts")
    days = events.groupBy(F.to_date("ts").alias("at")).agg(F.count(F.lit(1)).alias("n_events"))
    calendar = with_parts(calendar_of(events, "ts")).select("day", "month_name")
    return joins.day_join(days, calendar, "at").select("day", "month_name", "n_events")


@query(
    "model_relationships",
    "J15 X17",
    """
    SELECT c_mktsegment, COUNT(DISTINCT c_custkey) AS buyers, COUNT(o_orderkey) AS orders_placed
    FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
    GROUP BY c_mktsegment
    """,
)
def model_relationships(t):
    """Active link orders-customer, and a filter on lines that flows both ways as a semi-join."""
    lines = t("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_orderkey")
    hit = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    per_customer = hit.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return per_customer.join(t("customer"), "c_custkey").groupBy("c_mktsegment").agg(
        F.count("c_custkey").alias("buyers"), F.sum("n").alias("orders_placed")
    )


@query(
    "inactive_link",
    "J15 J14",
    """
    SELECT month_key, COALESCE(ordered, 0) AS ordered, COALESCE(shipped, 0) AS shipped
    FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month_key, COUNT(*) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS month_key, COUNT(*) AS shipped FROM lineitem GROUP BY 1) USING (month_key)
    """,
)
def inactive_link(t):
    """One calendar, two links: lines by the day of their order (active) and, where asked for, by the day they left."""
    placed = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month_key"))
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    ordered = per_order.join(placed, "l_orderkey").groupBy("month_key").agg(F.sum("n").alias("ordered"))
    shipped = t("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month_key")).agg(F.count(F.lit(1)).alias("shipped"))
    return ordered.join(shipped, "month_key", "full").na.fill(0)


@query(
    "one_to_one_link",
    "J15 J13",
    """
    SELECT c_custkey, c_name, n_orders FROM customer
    FULL JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    """,
)
def one_to_one_link(t):
    """Two tables with one row per customer each; either side may lack the other."""
    totals = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t("customer").select("c_custkey", "c_name").join(totals, "c_custkey", "full")
