"""Aggregates, set operations, sorts and top-k."""

from pyspark.sql import functions as F

from rentroll.functions.money import amount, mean, money
from rentroll.operators import distinct_sets, measures, rollup
from rentroll.plans.base import NET, customer_place, net, order_owner
from rentroll.plans.registry import query
from rentroll.sources.tables import materialise


@query(
    "charge_rollup",
    "D01 A01 A07 V005 V006 V013",
    f"""
    WITH o AS (SELECT l_orderkey, SUM({NET}) AS charge FROM lineitem GROUP BY l_orderkey),
    c AS (SELECT o_custkey, SUM(charge) AS charge FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT c_nationkey, CAST(ROUND(SUM(charge), 2) AS DOUBLE) AS charge, COUNT(*) AS n_customers
    FROM c JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
    """,
)
def charge_rollup(t):
    """Line -> order -> customer -> nation, each level from the one before."""
    lines = t("lineitem").select("l_orderkey", net().alias("charge"))
    per_order = rollup.roll_up(lines, [["l_orderkey"]], "charge")[-1]
    per_customer = rollup.roll_up(per_order.join(order_owner(t), "l_orderkey"), [["c_custkey"]], "charge")[-1]
    return per_customer.join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(
        amount(F.sum("charge")).alias("charge"), F.count(F.lit(1)).alias("n_customers")
    )


@query(
    "charge_levels",
    "D01 A07",
    f"""
    SELECT l_suppkey, CAST(ROUND(SUM(charge), 2) AS DOUBLE) AS charge, COUNT(*) AS n_groups FROM (
        SELECT l_suppkey, l_returnflag, l_linestatus, SUM({NET}) AS charge FROM lineitem GROUP BY ALL) GROUP BY l_suppkey
    """,
)
def charge_levels(t):
    lines = t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", net().alias("charge"))
    fine, = rollup.roll_up(lines, [["l_suppkey", "l_returnflag", "l_linestatus"]], "charge")
    return fine.groupBy("l_suppkey").agg(amount(F.sum("charge")).alias("charge"), F.count(F.lit(1)).alias("n_groups"))


@query(
    "charges_pivot",
    "A08 V052",
    f"""
    SELECT l_orderkey, {", ".join(f"CAST(ROUND(COALESCE(SUM({NET}) FILTER (WHERE l_returnflag = '{f}'), 0), 2) AS DOUBLE) AS charge_{f.lower()}" for f in "ANR")}
    FROM lineitem GROUP BY l_orderkey
    """,
)
def charges_pivot(t):
    lines = t("lineitem").select("l_orderkey", "l_returnflag", net().alias("net"))
    return rollup.pivot_sum(
        lines, ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "net", ["charge_a", "charge_n", "charge_r"]
    )


@query(
    "count_kinds",
    "A02 A03 A10",
    """
    SELECT o_custkey, COUNT(*) AS n_orders, COUNT(NULLIF(o_orderstatus, 'P')) AS n_known,
           COUNT(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_custkey
    """,
)
def count_kinds(t):
    return t("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count(F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("n_known"),
        F.countDistinct("o_orderpriority").alias("n_priorities"),
    )


@query(
    "min_max_avg",
    "A04 A05 X02",
    """
    SELECT l_suppkey, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship, MIN(l_quantity) AS least,
           MAX(l_quantity) AS most, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / COUNT(l_quantity) AS avg_quantity
    FROM lineitem GROUP BY l_suppkey
    """,
)
def min_max_avg(t):
    return t("lineitem").groupBy("l_suppkey").agg(
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.min("l_quantity").alias("least"),
        F.max("l_quantity").alias("most"),
        mean(money(F.col("l_quantity"))).alias("avg_quantity"),
    )


@query(
    "conditional_sums",
    "A06 C01",
    f"""
    SELECT l_partkey, CAST(ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'R' THEN {NET} END), 0), 2) AS DOUBLE) AS returned,
           CAST(ROUND(COALESCE(SUM(CASE WHEN l_linestatus = 'O' THEN {NET} END), 0), 2) AS DOUBLE) AS still_open
    FROM lineitem GROUP BY l_partkey
    """,
)
def conditional_sums(t):
    def of(cond):
        return amount(F.coalesce(F.sum(F.when(cond, net())), F.lit(0)))

    return t("lineitem").groupBy("l_partkey").agg(
        of(F.col("l_returnflag") == "R").alias("returned"), of(F.col("l_linestatus") == "O").alias("still_open")
    )


@query("distinct_rows", "A09", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(t):
    return t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()


@query(
    "global_totals",
    "A11 X01 X04",
    f"SELECT COUNT(*) AS n_lines, CAST(ROUND(SUM({NET}), 2) AS DOUBLE) AS total_net, MAX(l_shipdate) AS last_ship FROM lineitem",
)
def global_totals(t):
    return t("lineitem").agg(
        F.count(F.lit(1)).alias("n_lines"), amount(F.sum(net())).alias("total_net"), F.max("l_shipdate").alias("last_ship")
    )


@query(
    "union_tagged",
    "U01 P06",
    """
    SELECT kind, strftime("at", '%Y-%m') AS month_key, COUNT(*) AS n FROM (
        SELECT 'order' AS kind, o_orderdate AS "at" FROM orders UNION ALL SELECT 'shipment', l_shipdate FROM lineitem)
    GROUP BY ALL
    """,
)
def union_tagged(t):
    placed = t("orders").select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"))
    shipped = t("lineitem").select(F.lit("shipment").alias("kind"), F.col("l_shipdate").alias("at"))
    both = placed.unionByName(shipped)
    return both.groupBy("kind", F.date_format("at", "yyyy-MM").alias("month_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_distinct",
    "U02 V018 V111",
    """
    SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day FROM orders
    UNION SELECT l_orderkey, CAST(l_shipdate AS DATE) FROM lineitem
    """,
)
def union_distinct(t):
    placed = t("orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("day"))
    shipped = t("lineitem").select(F.col("l_orderkey").alias("order_id"), F.to_date("l_shipdate").alias("day"))
    return placed.unionByName(shipped).distinct()


@query(
    "multi_key_sort",
    "O01",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey",
)
def multi_key_sort(t):
    """Sort with a unique last key, so that range partitions stay even."""
    return t("orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@query(
    "segments_by_balance",
    "O02 A01",
    """
    SELECT c_mktsegment, CAST(ROUND(SUM(CAST(c_acctbal AS DECIMAL(18,4))), 2) AS DOUBLE) AS balance
    FROM customer GROUP BY c_mktsegment ORDER BY balance DESC
    """,
)
def segments_by_balance(t):
    per_segment = t("customer").groupBy("c_mktsegment").agg(amount(F.sum(money(F.col("c_acctbal")))).alias("balance"))
    return per_segment.orderBy(F.col("balance").desc())


@query(
    "top100_ties",
    "O03",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_discount AS score FROM lineitem
    WHERE l_quantity * l_discount >= (SELECT MIN(v) FROM (SELECT l_quantity * l_discount AS v FROM lineitem ORDER BY v DESC LIMIT 100))
    """,
)
def top100_ties(t):
    """The 100 highest and every row equal to the hundredth."""
    lines = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * F.col("l_discount")).alias("score")
    )
    return measures.top_with_ties(lines, 100, "score")


@query(
    "capped_rows",
    "O04 S12",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def capped_rows(t, cap=25):
    """Row cap given as a parameter; ordered, so that the same rows come back each time."""
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(cap)


@query(
    "months_in_order",
    "O06 X11",
    """
    SELECT monthname(o_orderdate) AS month_name, month(o_orderdate)::INTEGER AS month_no, COUNT(*) AS n_orders
    FROM orders GROUP BY 1, 2 ORDER BY month_no
    """,
)
def months_in_order(t):
    """Month names sorted by their number."""
    return (
        t("orders")
        .groupBy(F.date_format("o_orderdate", "MMMM").alias("month_name"), F.month("o_orderdate").alias("month_no"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
        .orderBy("month_no")
    )


@query(
    "table_with_totals",
    "X18",
    f"""
    SELECT r_name, c_mktsegment, CAST(GROUPING(r_name) * 2 + GROUPING(c_mktsegment) AS BIGINT) AS level,
           COUNT(*) AS n_orders, CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)
    """,
)
def table_with_totals(t):
    """Group rows, subtotals and the grand total. Rows are summed once, then rolled up."""
    place = customer_place(t).select(F.col("c_custkey").alias("o_custkey"), "r_name", "c_mktsegment")
    per_customer = t("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(F.col("o_totalprice"))).alias("price")
    )
    return rollup.with_totals(
        per_customer.join(place, "o_custkey"),
        ["r_name", "c_mktsegment"],
        F.sum("n").alias("n_orders"),
        amount(F.sum("price")).alias("total_price"),
    )


@query(
    "totals_of_states",
    "X18 A07 A03",
    """
    SELECT r_name, c_mktsegment, CAST(GROUPING(r_name) * 2 + GROUPING(c_mktsegment) AS BIGINT) AS level,
           COUNT(*) AS n_orders, COUNT(DISTINCT o_custkey) AS n_customers,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS mean_price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)
    """,
)
def totals_of_states(t):
    """Averages and distinct customers in groups, subtotals and the total: measures that don't add up."""
    place = customer_place(t).select(F.col("c_custkey").alias("o_custkey"), "r_name", "c_mktsegment")
    orders = t("orders").select("o_custkey", money(F.col("o_totalprice")).alias("price"))
    told = rollup.totals_of_states(orders.join(place, "o_custkey"), ["r_name", "c_mktsegment"], "o_custkey", "n_customers", price="price")
    mean_price = F.col("price").cast("double") / F.col("n_rows")
    return told.select("r_name", "c_mktsegment", "level", F.col("n_rows").alias("n_orders"), "n_customers", mean_price.alias("mean_price"))


@query(
    "distinct_by_period",
    "A03 W10 U01",
    """
    WITH seen AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'day' AS period, day AS start, COUNT(DISTINCT c_name) AS n_customers, COUNT(*) AS n_orders FROM seen GROUP BY day
    UNION ALL
    SELECT 'month', CAST(date_trunc('month', day) AS DATE) AS start, COUNT(DISTINCT c_name), COUNT(*) FROM seen GROUP BY start
    UNION ALL
    SELECT 'year', CAST(date_trunc('year', day) AS DATE) AS start, COUNT(DISTINCT c_name), COUNT(*) FROM seen GROUP BY start
    """,
)
def distinct_by_period(t):
    """Customers by day, month and year from one stored set per day; names get dense ids first."""
    names = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    ids = distinct_sets.dense_ids(names, "c_name", "member")
    seen = t("orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).join(names, "o_custkey").join(ids, "c_name")
    days = materialise(distinct_sets.member_sets(seen, ["day"], "member"), "customers_of_day")
    out = None
    for period in ("day", "month", "year"):
        start = F.col("day") if period == "day" else F.trunc("day", period)
        sets = distinct_sets.merged(days, [start.alias("start")])
        told = distinct_sets.counted(sets, ["start"], "n_customers")
        told = told.select(F.lit(period).alias("period"), "start", "n_customers", F.col("n_rows").alias("n_orders"))
        out = told if out is None else out.unionByName(told)
    return out
