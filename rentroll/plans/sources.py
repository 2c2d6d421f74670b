"""Scans, sinks, snapshots, parameters and small lookups."""

from pyspark.sql import functions as F

from rentroll.functions.money import amount, money
from rentroll.operators import sales
from rentroll.plans.base import NET, net
from rentroll.plans.registry import query
from rentroll.plans.sales import RAW_SQL, raw_sales
from rentroll.sources import published
from rentroll.sources.tables import materialise, overwrite, read_csv, read_csv_checked, scratch_path


@query("table_scan", "S01 S06", "SELECT * FROM orders")
def table_scan(t):
    return t("orders")


@query("column_projection", "S05 S01", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def column_projection(t):
    return t("lineitem").select("l_orderkey", "l_quantity").filter(F.col("l_quantity") > 40)


@query(
    "external_path",
    "S08",
    "SELECT l_returnflag, COUNT(*) AS n_lines FROM lineitem GROUP BY l_returnflag",
)
def external_path(t):
    """A table outside the catalog, read by its location."""
    located = t.spark.read.parquet(t.path("lineitem"))
    return located.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "csv_scan",
    "S02 N01 T11",
    f"""
    SELECT region, CAST(ROUND(SUM(CAST(amount AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_sales, COUNT(*) AS n_rows
    FROM ({RAW_SQL}) WHERE amount > 0 AND quantity > 0 GROUP BY region
    """,
)
def csv_scan(t):
    """Raw sales written as CSV with a header, then read back under a declared schema."""
    path = scratch_path(t.spark, "sales_csv")
    raw_sales(t).select("date", "amount", "quantity", "region", "category").write.option("header", True).csv(path)
    cleaned = sales.clean(read_csv(t.spark, path, sales.RAW_SCHEMA))
    return cleaned.groupBy("region").agg(
        amount(F.sum(money(F.col("amount")))).alias("total_sales"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "overwrite_sink",
    "S03 N02",
    "SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders GROUP BY o_orderpriority",
)
def overwrite_sink(t):
    """Summary written over its earlier version, then read back."""
    path = scratch_path(t.spark, "priority_summary")
    summary = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    overwrite(summary.withColumn("n_orders", F.lit(0).cast("bigint")), path)
    return overwrite(summary, path)


@query(
    "snapshot_of_wide_view",
    "S10 S09 J11 V002",
    f"""
    SELECT p_brand, COUNT(*) AS n_lines, CAST(ROUND(SUM({NET}), 2) AS DOUBLE) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand
    """,
)
def snapshot_of_wide_view(t):
    """A wide join written once to the shared folder and read by later queries."""
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = t("lineitem").select("l_partkey", "l_suppkey", net().alias("net"))
    wide = materialise(lines.join(part, "l_partkey").join(supplier, "l_suppkey"), "wide_lines")
    return wide.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"), amount(F.sum("net")).alias("revenue"))


@query(
    "refreshed_wide_view",
    "S10 S09 V002",
    f"""
    SELECT p_brand, COUNT(*) AS n_lines, CAST(ROUND(SUM({NET}), 2) AS DOUBLE) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
    """,
)
def refreshed_wide_view(t):
    """The wide join kept up to date by months: first an older state of the lines, then all; only later months are built."""
    root = scratch_path(t.spark, "wide_by_month")
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = t("lineitem").select("l_partkey", "l_shipdate", net().alias("net"))
    month = F.date_format("l_shipdate", "yyyy-MM")

    def build(rows):
        return rows.join(part, "l_partkey")

    published.refresh(lines.filter(F.col("l_shipdate") < F.lit("2001-01-01")), month, build, root, others=[part])
    published.refresh(lines, month, build, root, others=[part])
    wide = published.read_refreshed(t.spark, root)
    return wide.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"), amount(F.sum("net")).alias("revenue"))


@query(
    "published_sink",
    "S03 N02 N04",
    f"""
    SELECT region, CAST(ROUND(SUM(CAST(amount AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_sales,
           (SELECT COUNT(*) FROM ({RAW_SQL})) AS checked_rows, (SELECT COUNT(*) FROM ({RAW_SQL}) WHERE amount IS NULL) AS null_rows
    FROM ({RAW_SQL}) GROUP BY region
    """,
)
def published_sink(t):
    """Raw sales published with numbers observed by the write; a second version, out of bounds, is refused and never read."""
    root = scratch_path(t.spark, "raw_sales")
    numbers = {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col("amount").isNull()), "sold": F.count("amount")}
    published.publish(raw_sales(t).select("region", "amount"), root, numbers, {"rows": (1, None), "sold": (1, None)})
    try:
        emptied = published.read(t.spark, root).withColumn("amount", F.lit(None).cast("double"))
        published.publish(emptied, root, numbers, {"sold": (1, None)})
    except published.Rejected:
        pass  # as it should be
    numbers = published.log(t.spark, root).select(
        F.col("metrics")["rows"].cast("bigint").alias("checked_rows"), F.col("metrics")["nulls"].cast("bigint").alias("null_rows")
    )
    per_region = published.read(t.spark, root).groupBy("region").agg(amount(F.sum(money(F.col("amount")))).alias("total_sales"))
    return per_region.withColumns({c: numbers.select(c).scalar() for c in numbers.columns})


@query(
    "csv_rejects",
    "S02 N01 N04",
    """
    SELECT CASE WHEN l_linenumber = 1 THEN 'amount: no double' WHEN l_linenumber = 2 THEN 'number of fields'
                WHEN l_linenumber = 3 THEN 'sold: no date' ELSE 'good' END AS reason,
           COUNT(*) AS n_lines, COUNT(DISTINCT l_orderkey) AS n_orders
    FROM lineitem GROUP BY reason
    """,
)
def csv_rejects(t):
    """Order lines as text, some of them broken, split into good rows and rejects with their reason."""
    path = scratch_path(t.spark, "lines_csv")
    kind = F.col("l_linenumber")
    amount_ = F.when(kind == 1, F.concat(F.lit("x"), "l_extendedprice")).otherwise(F.col("l_extendedprice").cast("string"))
    day = F.when(kind == 3, F.lit("yesterday")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    line = F.concat_ws(",", "l_orderkey", amount_, day, F.when(kind == 2, F.lit("one too many")))
    t("lineitem").select(line.alias("value")).write.text(path)
    good, rejects = read_csv_checked(t.spark, path, "id bigint, amount double, sold date", header=False)
    both = good.select(F.lit("good").alias("reason"), "id").unionByName(
        rejects.select("reason", F.substring_index("line", ",", 1).cast("bigint").alias("id"))
    )
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("id").alias("n_orders"))


@query(
    "lookup_rows",
    "S04 J02",
    """
    SELECT o_orderpriority, COALESCE(CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' END, 'other') AS team,
           COUNT(*) AS n_orders FROM orders GROUP BY o_orderpriority
    """,
)
def lookup_rows(t):
    """A small lookup given in memory, joined to the table's groups."""
    team = t.spark.createDataFrame([("1-URGENT", "A"), ("2-HIGH", "B")], "o_orderpriority string, team string")
    counted = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    return counted.join(team, "o_orderpriority", "left").withColumn("team", F.coalesce("team", F.lit("other")))


@query(
    "view_over_view",
    "S09",
    """
    SELECT c_mktsegment, COUNT(*) AS n_customers FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0)
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY c_mktsegment
    """,
)
def view_over_view(t):
    """Views stack as plain functions; the optimizer sees one plan."""

    def in_credit():
        return t("customer").filter(F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment")

    def with_open_orders():
        opened = t("orders").filter(F.col("o_orderstatus") == "O")
        return in_credit().join(opened, F.col("c_custkey") == F.col("o_custkey"), "left_semi")

    return with_open_orders().groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"))


@query(
    "named_parameters",
    "S11 X23",
    "SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '2-HIGH' GROUP BY o_orderstatus",
)
def named_parameters(t):
    return t.sql(
        "SELECT o_orderstatus, COUNT(*) AS n_orders FROM {orders} "
        "WHERE o_totalprice > :floor AND o_orderpriority = :priority GROUP BY o_orderstatus",
        tables=["orders"],
        floor=100000,
        priority="2-HIGH",
    )


@query(
    "constant_row",
    "S07 A11",
    "SELECT 1 AS one, (SELECT COUNT(*) FROM orders) AS n_orders, (SELECT MAX(o_orderdate) FROM orders) AS last_order",
)
def constant_row(t):
    """A one-row table that carries measures as scalar subqueries."""
    orders = t("orders")
    return t.spark.range(1).select(
        F.lit(1).alias("one"),
        orders.agg(F.count(F.lit(1))).scalar().alias("n_orders"),
        orders.agg(F.max("o_orderdate")).scalar().alias("last_order"),
    )
