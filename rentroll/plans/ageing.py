"""Aged-debt reports over order lines."""

from pyspark.sql import functions as F

from rentroll.functions.dates import on_or_before
from rentroll.functions.money import amount
from rentroll.functions.text import initial_in
from rentroll.operators import ageing as ag
from rentroll.plans.base import AS_OF, DAY, GROSS, customer_place, open_items, order_owner
from rentroll.plans.registry import query

BAND_SQL = f"""CASE WHEN due >= {DAY} THEN 'Current'
            WHEN due >= {DAY} - 30 THEN '1-30 Days'
            WHEN due >= {DAY} - 60 THEN '31-60 Days'
            WHEN due >= {DAY} - 90 THEN '61-90 Days'
            WHEN due >= {DAY} - 120 THEN '91-120 Days'
            ELSE '120+ Days' END"""


def sums_sql(value="open"):
    bands = [
        ("Current", "current_due"),
        ("1-30 Days", "days_1_30"),
        ("31-60 Days", "days_31_60"),
        ("61-90 Days", "days_61_90"),
        ("91-120 Days", "days_91_120"),
        ("120+ Days", "days_120_plus"),
    ]
    cols = [
        f"CAST(ROUND(SUM({value}) FILTER (WHERE band = '{b}'), 2) AS DOUBLE) AS {c}" for b, c in bands
    ]
    cols.append(
        f"CAST(ROUND(SUM({value}) FILTER (WHERE band <> 'Current'), 2) AS DOUBLE) AS overdue"
    )
    cols.append(f"CAST(ROUND(SUM({value}), 2) AS DOUBLE) AS outstanding")
    return ",\n".join(cols)


ITEMS_SQL = f"""
    SELECT o_custkey AS c_custkey, l_orderkey, l_returnflag, CAST(l_shipdate AS DATE) AS due, {GROSS} AS open
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def owned_bands(t, items):
    """Lines to orders to their customer: one sum per line, and one row per order and band meets the join."""
    per_order = ag.band_sums(items, ["l_orderkey"], F.col("due"), F.col("open"), AS_OF)
    return per_order.join(order_owner(t), "l_orderkey")


def by_customer(t, items):
    return ag.spread_bands(owned_bands(t, items), ["c_custkey"])


@query(
    "ageing_by_customer",
    "D02 A01 A06 A07 T01 T05 J01 J11 V036",
    f"""
    WITH items AS ({ITEMS_SQL}),
    banded AS (SELECT *, {BAND_SQL} AS band FROM items WHERE open <> 0)
    SELECT c_custkey, c_name, n_name, r_name, {sums_sql()}
    FROM banded JOIN customer USING (c_custkey)
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY c_custkey, c_name, n_name, r_name
    """,
)
def ageing_by_customer(t):
    aged = ag.ageing_report(by_customer(t, open_items(t)))
    place = customer_place(t).select("c_custkey", "c_name", "n_name", "r_name")
    return aged.join(place, "c_custkey").select("c_custkey", "c_name", "n_name", "r_name", *ag.SUM_COLUMNS)


@query(
    "ageing_overdue_only",
    "D02 A06 T05 P02 V037",
    f"""
    WITH items AS ({ITEMS_SQL}),
    banded AS (SELECT *, {BAND_SQL} AS band FROM items WHERE open <> 0 AND due <= {DAY})
    SELECT c_custkey, {sums_sql()} FROM banded GROUP BY c_custkey
    """,
)
def ageing_overdue_only(t):
    """Only items due on or before the as-of day; the filter reaches the scan as a bound on the timestamp."""
    return ag.ageing_report(by_customer(t, open_items(t, on_or_before(F.col("l_shipdate"), AS_OF))))


@query(
    "ageing_with_credits",
    "D02 U01 C02 P06 V083",
    f"""
    WITH items AS ({ITEMS_SQL}),
    signed AS (
        SELECT 'invoice' AS kind, c_custkey, due, open FROM items
        UNION ALL
        SELECT 'credit', c_custkey, due, -open FROM items WHERE l_returnflag = 'R'),
    banded AS (SELECT *, {BAND_SQL} AS band FROM signed WHERE open <> 0)
    SELECT kind, band, COUNT(*) AS n_items, CAST(ROUND(SUM(open), 2) AS DOUBLE) AS balance,
           CAST(ROUND(SUM(CASE WHEN band = 'Current' THEN 0 ELSE open END), 2) AS DOUBLE) AS overdue
    FROM banded GROUP BY kind, band
    """,
)
def ageing_with_credits(t):
    """Returned lines counted again as negative, unallocated credits."""
    items = open_items(t)
    credits = items.filter(F.col("l_returnflag") == "R").withColumn("open", -F.col("open"))
    signed = items.withColumn("kind", F.lit("invoice")).unionByName(credits.withColumn("kind", F.lit("credit")))
    banded = signed.filter(F.col("open") != 0).withColumn("band", ag.age_band(F.col("due"), AS_OF))
    return banded.groupBy("kind", "band").agg(
        F.count(F.lit(1)).alias("n_items"),
        amount(F.sum("open")).alias("balance"),
        amount(F.sum(F.when(F.col("band") == ag.CURRENT, 0).otherwise(F.col("open")))).alias("overdue"),
    )


@query(
    "terms_adjusted_ageing",
    "D04 F07 T05 D02 W01 C01 V086",
    f"""
    WITH items AS (
        SELECT c_custkey, c_name, open,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN due + terms
                    WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN due END AS due,
               CASE WHEN substr(c_mktsegment, 1, 1) BETWEEN 'A' AND 'E' THEN 'desk 1'
                    WHEN substr(c_mktsegment, 1, 1) BETWEEN 'F' AND 'H' THEN 'desk 2' ELSE 'desk 3' END AS owner
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS due, {GROSS} AS open,
                     CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 30 WHEN 'BUILDING' THEN 45 WHEN 'MACHINERY' THEN 60
                          ELSE 14 END AS terms
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)),
    late AS (SELECT *, date_diff('day', due, {DAY}) AS n FROM items WHERE due <= {DAY} AND open <> 0)
    SELECT c_custkey, c_name, owner, CAST(ROUND(SUM(CASE WHEN n BETWEEN 1 AND 30 THEN open ELSE 0 END), 2) AS DOUBLE) AS days_1_30,
           CAST(ROUND(SUM(CASE WHEN n BETWEEN 31 AND 60 THEN open ELSE 0 END), 2) AS DOUBLE) AS days_31_60,
           CAST(ROUND(SUM(CASE WHEN n BETWEEN 61 AND 90 THEN open ELSE 0 END), 2) AS DOUBLE) AS days_61_90,
           CAST(ROUND(SUM(CASE WHEN n > 90 THEN open ELSE 0 END), 2) AS DOUBLE) AS days_91_plus
    FROM late GROUP BY c_custkey, c_name, owner
    """,
)
def terms_adjusted_ageing(t):
    """Due day moved by credit terms; items due today pass the filter but fall in no band."""
    segments = [("AUTOMOBILE", 30), ("BUILDING", 45), ("MACHINERY", 60)]
    terms = t.spark.createDataFrame(segments, "c_mktsegment string, terms int")
    customer = t("customer").join(terms, "c_mktsegment", "left").select(
        "c_custkey",
        "c_name",
        F.coalesce("terms", F.lit(14)).alias("terms"),
        F.when(initial_in(F.col("c_mktsegment"), "A", "E"), "desk 1")
        .when(initial_in(F.col("c_mktsegment"), "F", "H"), "desk 2")
        .otherwise("desk 3")
        .alias("owner"),
    )
    # Order level first: a due day per order and ship day is enough for every later step.
    lines = open_items(t).filter(F.col("open") != 0).groupBy("l_orderkey", "due").agg(F.sum("open").alias("open"))
    kind = F.col("o_orderpriority")
    gets_terms = F.when(kind.isin("1-URGENT", "2-HIGH"), True).when(
        kind.isin("3-MEDIUM", "4-NOT SPECIFIED"), False
    )
    orders = t("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), gets_terms.alias("gets_terms")
    )
    items = lines.join(orders, "l_orderkey").join(customer, "c_custkey").withColumn(
        "due", ag.terms_due(F.col("due"), F.col("terms"), F.col("gets_terms"))
    )
    late = items.filter(F.col("due") <= F.lit(AS_OF)).withColumns(
        ag.chase_columns(F.col("due"), F.col("open"), AS_OF)
    )
    sums = [amount(F.sum(c)).alias(c) for c in ag.CHASE_COLUMNS]
    return late.groupBy("c_custkey", "c_name", "owner").agg(*sums)


@query(
    "ageing_sorted_report",
    "X24 O05 D02 P01",
    f"""
    WITH items AS ({ITEMS_SQL}),
    banded AS (SELECT *, {BAND_SQL} AS band FROM items WHERE open <> 0)
    SELECT r_name AS "Region", n_name AS "Nation", {sums_sql()}
    FROM banded JOIN customer USING (c_custkey)
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name ORDER BY r_name, n_name
    """,
)
def ageing_sorted_report(t):
    place = customer_place(t).select("c_custkey", F.col("r_name").alias("Region"), F.col("n_name").alias("Nation"))
    owned = owned_bands(t, open_items(t)).groupBy("c_custkey", "_band").agg(F.sum("_value").alias("_value"))
    return ag.ageing_report(ag.spread_bands(owned.join(place, "c_custkey"), ["Region", "Nation"])).orderBy("Region", "Nation")


@query(
    "maturity_ladder",
    "D03 C04 T02 T05 V084",
    f"""
    WITH m AS (SELECT o_orderkey, o_custkey, date_diff('day', {DAY}, CAST(o_orderdate AS DATE) + 730) AS days_left
               FROM orders)
    SELECT o_orderkey, o_custkey, days_left,
           CASE WHEN days_left <= 0 THEN 'Already Matured' WHEN days_left <= 30 THEN '1 Month or Less'
                WHEN days_left <= 60 THEN '1-2 Months' WHEN days_left <= 90 THEN '2-3 Months' WHEN days_left <= 180 THEN '3-6 Months'
                WHEN days_left <= 365 THEN '6-12 Months' WHEN days_left > 365 THEN 'More than 1 Year' END AS ladder
    FROM m
    """,
)
def maturity_ladder(t):
    end = F.date_add(F.to_date("o_orderdate"), 730)
    left = t("orders").select("o_orderkey", "o_custkey", ag.days_to_go(end, AS_OF).cast("bigint").alias("days_left"))
    return left.withColumn("ladder", ag.days_ladder(F.col("days_left")))
