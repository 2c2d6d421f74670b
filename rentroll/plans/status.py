"""Business states: pipeline stage, utilisation, funding, arrears, due dates, duplicates, reconciliation."""

from pyspark.sql import functions as F

from rentroll.functions.money import amount, gain, loss, money
from rentroll.operators import reconcile, status
from rentroll.operators.rules import longest_prefix
from rentroll.plans.base import AS_OF, DAY, GROSS, NET, net, open_items
from rentroll.plans.registry import query


@query(
    "pipeline_stage",
    "D13 C01 C02",
    """
    SELECT o_orderkey, CASE WHEN n_returned > 0 THEN 'returned' WHEN n_shipped > 0 THEN 'shipped'
        WHEN n_lines > 0 THEN 'picked' WHEN o_orderstatus = 'O' THEN 'ordered' ELSE 'none' END AS stage
    FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS n_shipped,
        COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    """,
)
def pipeline_stage(t):
    """Furthest step an order has reached."""
    steps = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_linestatus") == "F").alias("shipped"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    stage = status.furthest_stage(
        (F.col("returned") > 0, "returned"),
        (F.col("shipped") > 0, "shipped"),
        (F.col("lines") > 0, "picked"),
        (F.col("o_orderstatus") == "O", "ordered"),
        otherwise="none",
    )
    return t("orders").join(steps, "o_orderkey", "left").select("o_orderkey", stage.alias("stage"))


@query(
    "utilisation_flag",
    "D14 C02 V019 V116",
    f"""
    SELECT p_partkey, COALESCE(CASE WHEN charge = 0.01 THEN 'Yes (FoC)' END, CASE WHEN n_open > 0 THEN 'Yes' END,
        CASE WHEN n_any > 0 THEN 'In Application' END, 'No') AS utilised
    FROM part LEFT JOIN (SELECT l_partkey, COUNT(*) AS n_any, COUNT(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 45) AS n_open,
        CASE WHEN MIN(l_quantity) > 2 THEN CAST(0.01 AS DECIMAL(4,2)) ELSE CAST(1 AS DECIMAL(4,2)) END AS charge
        FROM lineitem WHERE l_shipdate >= DATE '2001-01-01' GROUP BY l_partkey) ON l_partkey = p_partkey
    """,
)
def utilisation_flag(t):
    recent = t("lineitem").filter(F.col("l_shipdate") >= F.lit(AS_OF.replace(month=1, day=1)))
    use = recent.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n_any"),
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).alias("n_open"),
        F.when(F.min("l_quantity") > 2, F.lit("0.01")).otherwise("1").cast("decimal(4,2)").alias("charge"),
    )
    flag = status.utilisation(status.is_free(F.col("charge")), F.col("n_open") > 0, F.col("n_any") > 0)
    return t("part").select("p_partkey").join(use, "p_partkey", "left").select("p_partkey", flag.alias("utilised"))


@query(
    "funding_status",
    "D15 A01 A04 V112",
    f"""
    SELECT o_orderkey, CASE WHEN COALESCE(funded, 0) = 0 THEN 'Not Funded' WHEN funded >= CAST(o_totalprice AS DECIMAL(18,4)) THEN 'Fully Funded'
        ELSE 'Partially Funded' END AS funding, CAST(ROUND(COALESCE(funded, 0), 2) AS DOUBLE) AS funded
    FROM orders LEFT JOIN (SELECT l_orderkey, SUM({NET}) AS funded FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    """,
)
def funding_status(t):
    paid = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net()).alias("funded"))
    both = t("orders").select("o_orderkey", money(F.col("o_totalprice")).alias("price")).join(paid, "o_orderkey", "left")
    return both.select(
        "o_orderkey",
        status.funding_status(F.col("funded"), F.col("price")).alias("funding"),
        amount(F.coalesce("funded", F.lit(0))).alias("funded"),
    )


@query(
    "arrears_per_order",
    "D16 M03 A04 V066",
    f"""
    WITH i AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS due, {GROSS} AS open FROM lineitem WHERE l_returnflag = 'N')
    SELECT l_orderkey, CAST(ROUND(SUM(open), 2) AS DOUBLE) AS arrears, MIN(due) AS oldest_due,
           CAST(GREATEST(date_diff('day', MIN(due), {DAY}) - 14, 0) AS INTEGER) AS days_past_due
    FROM i WHERE due <= {DAY} AND open > 0 GROUP BY l_orderkey
    """,
)
def arrears_per_order(t):
    items = open_items(t, F.col("l_returnflag") == "N")
    late = status.arrears(items, ["l_orderkey"], F.col("due"), F.col("open"), AS_OF, 14)
    return late.withColumn("arrears", amount(F.col("arrears")))


@query(
    "next_due_date",
    "D17 T01 A04 V027",
    f"""
    SELECT o_orderkey, next_due FROM orders LEFT JOIN (SELECT l_orderkey, MIN(CAST(l_shipdate AS DATE)) AS next_due FROM lineitem
        WHERE CAST(l_shipdate AS DATE) > {DAY} GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    """,
)
def next_due_date(t):
    later = open_items(t, F.col("l_shipdate") > F.lit(AS_OF))
    coming = status.next_due(later, ["l_orderkey"], F.col("due"), AS_OF).withColumnRenamed("l_orderkey", "o_orderkey")
    return t("orders").select("o_orderkey").join(coming, "o_orderkey", "left")


@query(
    "product_family",
    "D19 F04 V108",
    """
    SELECT CASE WHEN p_type LIKE 'ECO%' THEN 'Economy' WHEN p_type LIKE 'STAND%' THEN 'Standard' WHEN p_type LIKE 'PROM%' THEN 'Promotion'
        ELSE p_type END AS family, COUNT(*) AS n_parts FROM part GROUP BY family
    """,
)
def product_family(t):
    families = [("ECO", "Economy"), ("STAND", "Standard"), ("PROM", "Promotion")]
    family = status.prefix_family(F.col("p_type"), families, F.col("p_type"))
    return t("part").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n_parts"))


@query(
    "profit_loss_split",
    "D21 C01 V077 V078",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ROUND(CASE WHEN r > 0 THEN r ELSE 0 END, 2) AS DOUBLE) AS profit,
           CAST(ROUND(CASE WHEN r < 0 THEN r ELSE 0 END, 2) AS DOUBLE) AS loss
    FROM (SELECT *, {NET} - CAST(p_retailprice * l_quantity AS DECIMAL(18,4)) AS r FROM lineitem JOIN part ON l_partkey = p_partkey)
    """,
)
def profit_loss_split(t):
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    result = net() - money(F.col("p_retailprice") * F.col("l_quantity"))
    return t("lineitem").join(part, "l_partkey").withColumn("result", result).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        amount(gain(F.col("result"))).alias("profit"),
        amount(loss(F.col("result"))).alias("loss"),
    )


@query(
    "dup_keep_remove",
    "D12 W09 V105",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, copies,
           CASE WHEN copies > 1 OR l_linestatus = 'O' THEN 'keep' ELSE 'remove' END AS verdict
    FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem)
    """,
)
def dup_keep_remove(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    return reconcile.keep_or_remove(lines, ["l_orderkey", "l_linenumber"], "l_linestatus", "O").drop("l_linestatus")


@query(
    "recon_diff",
    "X08 D12 J02",
    f"""
    SELECT COALESCE(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END AS missing,
           CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END AS missing_in_ours,
           CASE WHEN o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL AND ours - theirs <> 0 THEN 1 ELSE 0 END AS mismatch,
           CAST(ROUND(COALESCE(ours, 0) - COALESCE(theirs, 0), 2) AS DOUBLE) AS difference
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,4)) AS ours FROM orders WHERE o_orderstatus <> 'P')
    FULL JOIN (SELECT l_orderkey, SUM({GROSS}) AS theirs FROM lineitem WHERE l_tax > 0 GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    """,
)
def recon_diff(t):
    """Settled order totals of one system against totals of taxed lines of the other: each lacks some orders."""
    ours = t("orders").filter("o_orderstatus <> 'P'").select("o_orderkey", money(F.col("o_totalprice")).alias("ours"))
    theirs = open_items(t, F.col("l_tax") > 0).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("open").alias("theirs"))
    both = reconcile.compare_feeds(ours, theirs, "o_orderkey", "ours", "theirs")
    return both.select("o_orderkey", "missing", "missing_in_ours", "mismatch", amount(F.col("difference")).alias("difference"))


@query(
    "recon_by_ranges",
    "D12 X08",
    f"""
    WITH a AS (SELECT l_orderkey AS k, SUM({NET}) AS ours FROM lineitem GROUP BY l_orderkey),
    b AS (SELECT k, CASE WHEN k BETWEEN 3000 AND 3050 THEN ours + 1 ELSE ours END AS theirs FROM a WHERE k NOT BETWEEN 1000 AND 1200
          UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT k FROM a))
    SELECT COALESCE(a.k, b.k) AS l_orderkey, CASE WHEN b.k IS NULL THEN 1 ELSE 0 END AS missing, CASE WHEN a.k IS NULL THEN 1 ELSE 0 END AS missing_in_ours,
           CAST(ROUND(COALESCE(ours, 0) - COALESCE(theirs, 0), 2) AS DOUBLE) AS difference
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR ours <> COALESCE(theirs, 0)
    """,
)
def recon_by_ranges(t):
    """Order totals against a copy of them that lacks some orders, has others of its own and other amounts: only key ranges
    whose digests differ are joined."""
    ours = t("lineitem").select("l_orderkey", net().alias("ours")).groupBy("l_orderkey").agg(F.sum("ours").alias("ours"))
    key = F.col("l_orderkey")
    theirs = ours.filter(~key.between(1000, 1200)).select("l_orderkey", F.when(key.between(3000, 3050), F.col("ours") + 1).otherwise(F.col("ours")).alias("theirs"))
    unknown = t("orders").select(F.col("o_orderkey").alias("l_orderkey")).join(t("lineitem"), "l_orderkey", "left_anti")
    theirs = theirs.unionByName(unknown.withColumn("theirs", F.lit(None).cast("decimal(28,4)")))
    found = reconcile.differences(ours, theirs, "l_orderkey", "ours", "theirs", leaf=1000)
    return found.select("l_orderkey", "missing", "missing_in_ours", amount(F.col("difference")).alias("difference"))


@query(
    "prefix_rules",
    "D19 C04",
    """
    WITH rules AS (
        SELECT DISTINCT p_name AS prefix, 'name of ' || p_type AS label, 2 AS priority FROM part WHERE p_size < 4
        UNION ALL SELECT DISTINCT substr(p_name, 1, 3), 'three of ' || p_type, 1 FROM part WHERE p_type IN ('PROMO', 'SMALL')
        UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1), 'word', 3 FROM part
        UNION ALL SELECT '', 'any', 9),
    best AS (SELECT prefix, label FROM rules QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY priority, label) = 1),
    names AS (SELECT DISTINCT p_name FROM part),
    told AS (SELECT p_name, label FROM names JOIN best ON starts_with(p_name, prefix)
             QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(prefix) DESC) = 1)
    SELECT label, COUNT(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey JOIN told USING (p_name) GROUP BY label
    """,
)
def prefix_rules(t):
    """Families of part names from a table of nested prefixes."""
    part = t("part")
    kind, name = F.col("p_type"), F.col("p_name")

    def rule(rows, prefix, label, priority):
        return rows.select(prefix.alias("prefix"), label.alias("label"), F.lit(priority).alias("priority")).distinct()

    rules = (
        rule(part.filter("p_size < 4"), name, F.concat(F.lit("name of "), kind), 2)
        .unionByName(rule(part.filter(kind.isin("PROMO", "SMALL")), F.substring(name, 1, 3), F.concat(F.lit("three of "), kind), 1))
        .unionByName(rule(part, F.substring_index(name, " ", 1), F.lit("word"), 3))
        .unionByName(rule(part, F.lit(""), F.lit("any"), 9))
    )
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "p_name"), "p_partkey")
    return longest_prefix(lines, rules, "p_name").groupBy("label").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "recon_three_way",
    "X08 C03",
    f"""
    SELECT l_orderkey, CAST(ROUND(line_total - credit - payable, 2) AS DOUBLE) AS diff FROM (
        SELECT l_orderkey, COALESCE(SUM({NET}), 0) AS line_total, COALESCE(SUM({NET}) FILTER (WHERE l_returnflag = 'R'), 0) AS credit,
               COALESCE(SUM({NET}) FILTER (WHERE l_linestatus = 'F'), 0) AS payable FROM lineitem GROUP BY l_orderkey)
    """,
)
def recon_three_way(t):
    """Line total less credit less payable; a missing amount counts as zero."""
    sums = t("lineitem").groupBy("l_orderkey").agg(
        F.sum(net()).alias("line_total"),
        F.sum(F.when(F.col("l_returnflag") == "R", net())).alias("credit"),
        F.sum(F.when(F.col("l_linestatus") == "F", net())).alias("payable"),
    )
    diff = reconcile.difference(F.col("line_total"), F.col("credit"), F.col("payable"))
    return sums.select("l_orderkey", amount(diff).alias("diff"))
