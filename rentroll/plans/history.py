"""Versions, latest records and ordered columns over orders and user events."""

from pyspark.sql import functions as F

from rentroll.functions.dates import OPEN_END, days_between, on_or_before
from rentroll.functions.money import amount, money
from rentroll.functions.nulls import changed
from rentroll.operators import hot, timeline, versions
from rentroll.operators.profit import monthly_profit
from rentroll.plans.base import AS_OF, EVENT_DAY, EVENTS_AS_OF, NET, net
from rentroll.plans.registry import query

PRICE = "CAST(o_totalprice AS DECIMAL(18,4))"


def price():
    return money(F.col("o_totalprice"))


def status_versions(t):
    """User events as a history table: the event type is the status, the next event closes the version."""
    seen = t("events").select(
        F.col("event_id").alias("sk"), F.col("user_id").alias("bk"), F.col("event_type").alias("status"), "ts"
    )
    closed = hot.ordered_columns(
        seen, ["bk"], ["ts", "sk"], reverse_ordinal="_back", following={"valid_to": "ts"}
    )
    return closed.withColumn("is_current", (F.col("_back") == 1).cast("int")).drop("_back")


VERSIONS_SQL = """
    SELECT event_id AS sk, user_id AS bk, event_type AS status, ts,
           lead(ts) OVER w AS valid_to,
           CASE WHEN lead(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS is_current
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query(
    "latest_order_per_customer",
    "W01 D10 D22 J12",
    """
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """,
)
def latest_order_per_customer(t):
    orders = t("orders").drop("o_orderpriority")
    return versions.first_per_key(orders, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query(
    "first_order_per_customer",
    "W01",
    """
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
    """,
)
def first_order_per_customer(t):
    return versions.first_per_key(
        t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey"
    )


@query(
    "best_order_mixed_keys",
    "W01 W03 C03",
    """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY COALESCE(NULLIF(o_orderstatus, 'P'), 'A') DESC, o_orderpriority, o_totalprice DESC, o_orderkey) = 1
    """,
)
def best_order_mixed_keys(t):
    """Several order keys, mixed directions, one with a default for null."""
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    known = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    best = versions.first_per_key(
        orders,
        ["o_custkey"],
        F.coalesce(known, F.lit("A")).desc(),
        F.col("o_orderpriority"),
        F.col("o_totalprice").desc(),
        F.col("o_orderkey"),
    )
    return best.drop("o_totalprice")


@query(
    "opening_closing_value",
    "D18 W12 V003",
    """
    SELECT c_custkey, opening_value, closing_value FROM customer LEFT JOIN (
        SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS opening_value,
               arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS closing_value
        FROM orders WHERE o_orderdate <= DATE '2001-06-30' GROUP BY o_custkey) ON c_custkey = o_custkey
    """,
)
def opening_closing_value(t):
    due = t("orders").filter(on_or_before(F.col("o_orderdate"), AS_OF))
    ends = versions.opening_and_closing(due, ["o_custkey"], "o_totalprice", "o_orderdate", "o_orderkey")
    return t("customer").select("c_custkey").join(ends.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")


@query(
    "current_versions",
    "D09 W04 P02",
    f"SELECT sk, bk, status, ts FROM ({VERSIONS_SQL}) WHERE is_current = 1",
)
def current_versions(t):
    return versions.current(status_versions(t)).select("sk", "bk", "status", "ts")


@query(
    "fact_to_current_version",
    "D11 J10 J01",
    f"""
    WITH v AS ({VERSIONS_SQL})
    SELECT e.event_id, e.value, n.bk, o.status AS status_then, n.sk AS current_sk, n.status AS status_now
    FROM events e JOIN v o ON e.event_id = o.sk JOIN v n ON n.bk = o.bk AND n.is_current = 1
    """,
)
def fact_to_current_version(t):
    """A fact linked to the version of its day, resolved to the entity's current version."""
    seen = t("events").select(F.col("event_id").alias("sk"), F.col("user_id").alias("bk"), F.col("event_type").alias("status"), "ts")
    now = versions.first_per_key(seen, ["bk"], F.col("ts").desc(), F.col("sk").desc()).withColumn("is_current", F.lit(1))
    old = seen.withColumn("is_current", F.lit(0)).unionByName(now).groupBy("sk", "bk", "status").agg(
        F.max("is_current").alias("is_current")
    )
    fact = t("events").select(F.col("event_id").alias("sk"), "value", F.col("event_type").alias("status_then"))
    return versions.to_current(fact, old, "sk", "bk").select(
        F.col("sk").alias("event_id"), "value", "bk", "status_then", "current_sk", F.col("status").alias("status_now")
    )


@query(
    "latest_fact_per_business_key",
    "D10 J12 W01 V001 V050",
    """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY l_suppkey
        ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1
    """,
)
def latest_fact_per_business_key(t):
    """Lines are the fact, orders its dimension versions, the supplier the business key."""
    lines = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    dated = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    order = [F.col(c).desc() for c in ("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey")]
    return versions.first_per_key(dated, ["l_suppkey"], *order)


@query(
    "latest_child_attribute",
    "D22 J13 W01 J02 V008",
    """
    SELECT c_custkey, c_name, o_orderpriority AS last_priority FROM customer LEFT JOIN (
        SELECT o_custkey, o_orderpriority FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    ) ON c_custkey = o_custkey
    """,
)
def latest_child_attribute(t):
    child = versions.first_per_key(
        t("orders"),
        ["o_custkey"],
        F.col("o_orderdate").desc(),
        F.col("o_orderkey").desc(),
    ).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("last_priority"))
    return t("customer").select("c_custkey", "c_name").join(child, "c_custkey", "left")


@query(
    "exposed_ordinals",
    "W02 W12 V004 V022 V023",
    """
    SELECT o_custkey, o_orderkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_first,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS from_last
    FROM orders
    """,
)
def exposed_ordinals(t):
    """Both ordinals from one ordered pass: the second is counted back from the end."""
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return hot.ordered_columns(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        ordinal="from_first",
        reverse_ordinal="from_last",
    ).drop("o_orderdate")


@query(
    "running_sum_rows",
    "W07",
    f"""
    SELECT o_custkey, o_orderkey, CAST(ROUND(SUM({PRICE}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS running_price FROM orders
    """,
)
def running_sum_rows(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", price().alias("price"))
    run = hot.ordered_columns(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], running={"run": "price"}
    )
    return run.select("o_custkey", "o_orderkey", amount(F.col("run")).alias("running_price"))


@query(
    "previous_and_next_order",
    "W04 T02",
    """
    SELECT o_custkey, o_orderkey,
           date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days_since_previous,
           COALESCE(CAST(lead(o_orderdate) OVER w AS DATE), DATE '9999-12-31') AS next_day
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def previous_and_next_order(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    near = hot.ordered_columns(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        previous={"before": "o_orderdate"},
        following={"after": "o_orderdate"},
    )
    return near.select(
        "o_custkey",
        "o_orderkey",
        days_between(F.col("before"), F.col("o_orderdate")).cast("bigint").alias("days_since_previous"),
        F.coalesce(F.to_date("after"), F.lit(OPEN_END)).alias("next_day"),
    )


@query(
    "first_and_last_value",
    "W11 W05",
    """
    SELECT o_custkey, o_orderkey, first_value(o_orderpriority) OVER w AS first_priority,
           last_value(o_orderpriority) OVER (w RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_priority
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY (o_orderdate, o_orderkey))
    """,
)
def first_and_last_value(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    ends = hot.ordered_columns(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        first={"first_priority": "o_orderpriority"},
        last={"last_priority": "o_orderpriority"},
    )
    return ends.select("o_custkey", "o_orderkey", "first_priority", "last_priority")


@query(
    "count_over_key",
    "W09",
    """
    SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS orders_of_customer FROM orders
    """,
)
def count_over_key(t):
    return hot.count_per_key(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "orders_of_customer")


@query(
    "distinct_parts_in_order",
    "W10 V117",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey)
           + dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC) - 1 AS parts_in_order
    FROM lineitem
    """,
)
def distinct_parts_in_order(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return hot.distinct_per_key(lines, ["l_orderkey"], "l_partkey", "parts_in_order")


@query(
    "status_history",
    "P07 W04 D07",
    f"""
    WITH v AS ({VERSIONS_SQL}),
    p AS (SELECT *, lag(status) OVER (PARTITION BY bk ORDER BY ts, sk) AS before,
                 row_number() OVER (PARTITION BY bk ORDER BY ts, sk) AS rn FROM v)
    SELECT sk, bk, status, ts FROM p WHERE rn = 1 OR status IS DISTINCT FROM before
    """,
)
def status_history(t):
    """Versions that change the status; repeats of the same status are dropped."""
    seen = t("events").select(F.col("event_id").alias("sk"), F.col("user_id").alias("bk"), F.col("event_type").alias("status"), "ts")
    return timeline.change_points(seen, ["bk"], ["ts", "sk"], "status")


@query(
    "value_changed",
    "P07 C01",
    """
    SELECT o_custkey, o_orderkey, before_status, o_orderstatus,
           CASE WHEN o_orderstatus IS DISTINCT FROM before_status THEN 1 ELSE 0 END AS is_change
    FROM (SELECT o_custkey, o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
              lag(NULLIF(o_orderstatus, 'P')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_status
          FROM orders)
    """,
)
def value_changed(t):
    """Change flag where a status may be set, unset or set again."""
    orders = t("orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    )
    near = hot.ordered_columns(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        previous={"before_status": "o_orderstatus"},
    )
    return near.drop("o_orderdate").withColumn(
        "is_change", changed(F.col("o_orderstatus"), F.col("before_status")).cast("int")
    )


@query(
    "weekly_snapshot",
    "D07 J07 W05 T01 M04 V107",
    f"""
    WITH v AS ({VERSIONS_SQL}),
    p AS (SELECT *, lag(status) OVER (PARTITION BY bk ORDER BY ts, sk) AS before,
                 row_number() OVER (PARTITION BY bk ORDER BY ts, sk) AS rn FROM v),
    points AS (SELECT bk, sk, status, ts FROM p WHERE rn = 1 OR status IS DISTINCT FROM before),
    spans AS (SELECT bk, status, CAST(ts AS DATE) AS valid_from,
                 LEAST(COALESCE(CAST(lead(ts) OVER (PARTITION BY bk ORDER BY ts, sk) AS DATE), DATE '9999-12-31'),
                       DATE '9999-12-31') AS valid_to
              FROM points),
    fridays AS (SELECT CAST(d AS DATE) AS snapshot FROM generate_series(DATE '2024-01-05', {EVENT_DAY}, INTERVAL 7 DAY) g(d))
    SELECT snapshot, status, count(*) AS n_rows, count(DISTINCT bk) AS n_users
    FROM spans JOIN fridays ON snapshot BETWEEN valid_from AND valid_to GROUP BY snapshot, status
    """,
)
def weekly_snapshot(t):
    """Status counts at every Friday; both ends of an interval count, as in the report it rebuilds."""
    seen = t("events").select(
        F.col("event_id").alias("sk"),
        F.col("user_id").alias("bk"),
        F.col("event_type").alias("status"),
        "ts",
        F.lit(OPEN_END).alias("ends"),
    )
    spans = timeline.state_intervals(seen, ["bk"], ["ts", "sk"], "status", "ts", "ends")
    weeks = timeline.friday_snapshots(spans, F.to_date("valid_from"), F.col("valid_to"), EVENTS_AS_OF)
    return weeks.groupBy("snapshot", "status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("bk").alias("n_users")
    )


@query(
    "carry_forward_balance",
    "D08 W06 W07 J06 T10 V113",
    f"""
    WITH moves AS (
        SELECT user_id, CAST(ts AS DATE) + CAST((6 - (dayofweek(ts) + 1) + 7) % 7 AS INTEGER) AS week_end,
               SUM(CAST(value AS DECIMAL(18,4))) AS moved
        FROM events WHERE ts < {EVENT_DAY} + 1 GROUP BY ALL),
    settled AS (SELECT *, SUM(moved) OVER (PARTITION BY user_id ORDER BY week_end) AS bal FROM moves),
    span AS (SELECT user_id, MIN(week_end) AS w0 FROM moves GROUP BY user_id),
    grid AS (SELECT user_id, CAST(unnest(generate_series(w0, DATE '2024-02-02', INTERVAL 7 DAY)) AS DATE) AS week_end
             FROM span)
    SELECT user_id, week_end, CAST(ROUND(moved, 2) AS DOUBLE) AS moved,
           CAST(ROUND(last_value(bal IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY week_end
               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS balance
    FROM grid LEFT JOIN settled USING (user_id, week_end)
    """,
)
def carry_forward_balance(t):
    moves = t("events").select("user_id", "ts", money(F.col("value")).alias("value"))
    weekly = timeline.weekly_balance(moves, ["user_id"], "ts", "value", EVENTS_AS_OF)
    return weekly.select(
        "user_id", "week_end", amount(F.col("moved")).alias("moved"), amount(F.col("balance")).alias("balance")
    )


@query(
    "first_event_gap",
    "D06 D20 T02 T04 V090 V093",
    """
    WITH f AS (SELECT user_id, MIN(ts) FILTER (WHERE event_type = 'signup') AS s,
                      MIN(ts) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id)
    SELECT user_id, CAST(s AS DATE) AS signup_day, CAST(p AS DATE) AS purchase_day,
           date_diff('day', CAST(s AS DATE), CAST(p AS DATE)) AS days_between
    FROM f WHERE s IS NOT NULL AND p IS NOT NULL
    """,
)
def first_event_gap(t):
    kinds = {"s": F.col("event_type") == "signup", "p": F.col("event_type") == "purchase"}
    both = versions.first_events(t("events"), ["user_id"], kinds, "ts").filter("s is not null and p is not null")
    return both.select(
        "user_id",
        F.to_date("s").alias("signup_day"),
        F.to_date("p").alias("purchase_day"),
        days_between(F.col("s"), F.col("p")).cast("bigint").alias("days_between"),
    )


@query(
    "monthly_pnl_running",
    "D05 W08 U01 T07 A06 V039 V099",
    f"""
    WITH moves AS (
        SELECT p_brand, strftime(l_shipdate, '%Y-%m') AS month_key,
               CASE WHEN l_returnflag = 'R' THEN 0 ELSE {NET} END AS income,
               CASE WHEN l_returnflag = 'R' THEN {NET} ELSE 0 END AS expense
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT p_brand, month_key, SUM(income) AS income, SUM(expense) AS expense FROM moves GROUP BY ALL)
    SELECT p_brand, month_key, CAST(ROUND(income, 2) AS DOUBLE) AS income, CAST(ROUND(expense, 2) AS DOUBLE) AS expense,
           CAST(ROUND(SUM(income) OVER w, 2) AS DOUBLE) AS income_to_date,
           CAST(ROUND(SUM(expense) OVER w, 2) AS DOUBLE) AS expense_to_date,
           CAST(ROUND(SUM(income - expense) OVER w, 2) AS DOUBLE) AS net_to_date
    FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY month_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def monthly_pnl_running(t):
    kind = F.when(F.col("l_returnflag") == "R", "expense").otherwise("income").alias("kind")
    lines = t("lineitem").select("l_partkey", "l_shipdate", net().alias("value"), kind)
    brand = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # Part and month first: brands are few, so joining before summing would only move more rows.
    return monthly_profit(lines, "l_partkey", brand, "p_brand", "l_shipdate", "value")
