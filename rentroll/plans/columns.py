"""Predicates and scalar functions, one query per family."""

from datetime import date

from pyspark.sql import functions as F

from rentroll.functions import dates, money, nulls, text
from rentroll.plans.base import AS_OF, DAY, net
from rentroll.plans.registry import query


@query(
    "comparison_filters",
    "P02 S01",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus <> 'P' AND o_totalprice > 200000 AND o_orderpriority = '1-URGENT'
    """,
)
def comparison_filters(t):
    return t("orders").filter(
        (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 200000) & (F.col("o_orderpriority") == "1-URGENT")
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "nested_and_or",
    "P03 F03 V059",
    """
    SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE lower(c_mktsegment) = 'building' AND o_orderstatus = 'O' OR lower(c_mktsegment) = 'machinery' AND o_totalprice > 300000
    """,
)
def nested_and_or(t):
    """AND binds before OR, over columns of two tables."""
    both = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    segment = F.lower("c_mktsegment")
    keep = ((segment == "building") & (F.col("o_orderstatus") == "O")) | (
        (segment == "machinery") & (F.col("o_totalprice") > 300000)
    )
    return both.filter(keep).select("o_orderkey", "c_mktsegment", "o_orderstatus")


@query(
    "in_and_not_in",
    "P04 X16",
    """
    SELECT o_orderkey, status, o_orderpriority FROM (SELECT *, NULLIF(o_orderstatus, 'P') AS status FROM orders)
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND status NOT IN ('F', 'X')
    """,
)
def in_and_not_in(t):
    """A null status fails NOT IN, as in SQL."""
    known = t("orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return known.filter(
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & ~F.col("status").isin("F", "X")
    ).select("o_orderkey", "status", "o_orderpriority")


@query(
    "null_checks",
    "P05",
    """
    SELECT o_orderkey, status IS NULL AS unknown_status FROM
        (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, NULLIF(o_orderpriority, '5-LOW') AS pr FROM orders)
    WHERE pr IS NOT NULL
    """,
)
def null_checks(t):
    known = t("orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("pr"),
    )
    return known.filter(F.col("pr").isNotNull()).select("o_orderkey", F.col("status").isNull().alias("unknown_status"))


@query(
    "placeholder_columns",
    "P06 P09 V058",
    """
    SELECT *, '' AS reserved, CAST(NULL AS VARCHAR) AS note, 0 AS flag, CAST(NULL AS DATE) AS review_day FROM supplier
    """,
)
def placeholder_columns(t):
    return t("supplier").select(
        "*",
        F.lit("").alias("reserved"),
        F.lit(None).cast("string").alias("note"),
        F.lit(0).alias("flag"),
        F.lit(None).cast("date").alias("review_day"),
    )


@query(
    "star_plus_extras",
    "P09 P01",
    "SELECT s.*, n_name AS \"Country\", s_acctbal > 0 AS in_credit FROM supplier s JOIN nation ON s_nationkey = n_nationkey",
)
def star_plus_extras(t):
    supplier, nation = t("supplier").alias("s"), t("nation")
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s.*", F.col("n_name").alias("Country"), (F.col("s_acctbal") > 0).alias("in_credit"))


@query(
    "between_bands",
    "P08 C01",
    """
    SELECT p_size_band, COUNT(*) AS n_parts FROM (SELECT CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small'
        WHEN p_size BETWEEN 11 AND 30 THEN 'medium' ELSE 'large' END AS p_size_band FROM part) GROUP BY p_size_band
    """,
)
def between_bands(t):
    size = F.col("p_size")
    band = nulls.first_match(
        (size.between(1, 10), F.lit("small")), (size.between(11, 30), F.lit("medium")), otherwise=F.lit("large")
    )
    return t("part").groupBy(band.alias("p_size_band")).agg(F.count(F.lit(1)).alias("n_parts"))


@query(
    "quality_filter",
    "P10 N01",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS sale_date,
           l_extendedprice / l_quantity AS unit_price FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0
    """,
)
def quality_filter(t):
    good = t("lineitem").filter((F.col("l_extendedprice") > 0) & (F.col("l_quantity") > 0))
    return good.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("sale_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )


@query(
    "nested_case",
    "C01",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice > 250000 THEN 'open large' ELSE 'open' END
        WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'pending' END AS state FROM orders
    """,
)
def nested_case(t):
    opened = F.when(F.col("o_totalprice") > 250000, "open large").otherwise("open")
    status = F.col("o_orderstatus")
    state = nulls.first_match((status == "O", opened), (status == "F", F.lit("closed")), otherwise=F.lit("pending"))
    return t("orders").select("o_orderkey", state.alias("state"))


@query(
    "null_defaults",
    "C02 C03 W03",
    """
    SELECT o_orderkey, COALESCE(a, b, 'none') AS either, COALESCE(price, CAST(0 AS DECIMAL(10,2)))::DOUBLE AS price FROM (
        SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS a, NULLIF(o_orderpriority, '5-LOW') AS b,
               CASE WHEN o_totalprice > 100000 THEN CAST(o_totalprice AS DECIMAL(10,2)) END AS price FROM orders)
    """,
)
def null_defaults(t):
    a = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    b = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    price = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice").cast("decimal(10,2)"))
    return t("orders").select(
        "o_orderkey",
        F.coalesce(a, b, F.lit("none")).alias("either"),
        nulls.default_to(price, 0, "decimal(10,2)").cast("double").alias("price"),
    )


@query(
    "first_match_ladder",
    "C04 V085",
    """
    SELECT c_custkey, COALESCE(CASE WHEN c_acctbal < 0 THEN 'overdrawn' END, CASE WHEN c_acctbal < 1000 THEN 'low' END,
        CASE WHEN c_acctbal < 5000 THEN 'fair' END, 'good') AS standing FROM customer
    """,
)
def first_match_ladder(t):
    bal = F.col("c_acctbal")
    standing = nulls.first_match(
        (bal < 0, F.lit("overdrawn")), (bal < 1000, F.lit("low")), (bal < 5000, F.lit("fair")), otherwise=F.lit("good")
    )
    return t("customer").select("c_custkey", standing.alias("standing"))


@query(
    "concat_kinds",
    "F01 F02",
    """
    SELECT p_partkey, p_brand || ' ' || t AS strict_label, concat(p_brand, ' ', t) AS blank_label
    FROM (SELECT p_partkey, p_brand, NULLIF(p_type, 'SMALL') AS t FROM part)
    """,
)
def concat_kinds(t):
    """Null makes one form null and counts as empty in the other."""
    kind = F.nullif(F.col("p_type"), F.lit("SMALL"))
    return t("part").select(
        "p_partkey",
        text.concat_strict(F.col("p_brand"), F.lit(" "), kind).alias("strict_label"),
        text.concat_blank(F.col("p_brand"), F.lit(" "), kind).alias("blank_label"),
    )


@query(
    "text_matching",
    "F03 F04 F07 V095",
    """
    SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE 'red%')
        AND p_name NOT LIKE '%blue%' AND substr(p_type, 1, 1) BETWEEN 'A' AND 'P'
    """,
)
def text_matching(t):
    name = F.lower("p_name")
    keep = text.like_any(name, ["%ring%", "red%"]) & ~F.col("p_name").like("%blue%")
    return t("part").filter(keep & text.initial_in(F.col("p_type"), "A", "P")).select("p_partkey", "p_name")


@query(
    "description_build",
    "F05 F02 D22 V007",
    """
    SELECT p_partkey, array_to_string(list_filter([p_brand, CASE WHEN p_type = 'STANDARD' THEN '' ELSE p_type END,
        CASE WHEN p_size > 40 THEN NULL ELSE 'size ' || p_size END, p_name], lambda x: x <> ''), ' ') AS description FROM part
    """,
)
def description_build(t):
    """Only the parts that say something, separated by one space."""
    size = F.when(~(F.col("p_size") > 40), text.concat_strict(F.lit("size "), F.col("p_size").cast("string")))
    return t("part").select(
        "p_partkey",
        text.join_parts(
            F.col("p_brand"), text.blank_if(F.col("p_type"), "STANDARD"), size, F.col("p_name")
        ).alias("description"),
    )


@query(
    "trim_and_cut",
    "F06 K02 V104",
    """
    SELECT c_custkey, NULLIF(trim(pad), '') AS tag, substr(c_name, 1, 8) AS short_name
    FROM (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN '  ' || c_mktsegment || ' ' ELSE '   ' END AS pad FROM customer)
    """,
)
def trim_and_cut(t):
    pad = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).otherwise("   ")
    return t("customer").select(
        "c_custkey", text.trimmed_or_null(pad).alias("tag"), text.varchar(F.col("c_name"), 8).alias("short_name")
    )


@query(
    "casts",
    "K01 K03 K04",
    """
    SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_no, CAST(o_orderdate AS DATE) AS day,
           CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS price_1dp, CAST(o_custkey AS VARCHAR) AS customer_text,
           CAST(o_custkey AS DOUBLE) AS customer_float FROM orders
    """,
)
def casts(t):
    return t("orders").select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority_no"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").cast("decimal(12,1)").cast("double").alias("price_1dp"),
        F.col("o_custkey").cast("string").alias("customer_text"),
        F.col("o_custkey").cast("double").alias("customer_float"),
    )


@query(
    "money_arithmetic",
    "M01 M02 M03",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ROUND(n * 1.2 - q, 2) AS DOUBLE) AS worth,
           CAST(CASE WHEN d IS NOT NULL THEN GREATEST(n - d, 0) END AS DOUBLE) AS above_cost FROM (
        SELECT *, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS n, CAST(l_quantity AS DECIMAL(18,4)) AS q,
               CASE WHEN l_tax > 0 THEN CAST(30000 AS DECIMAL(18,4)) END AS d FROM lineitem)
    """,
)
def money_arithmetic(t):
    cost = F.when(F.col("l_tax") > 0, money.money(F.lit(30000)))
    worth = net() * F.lit("1.2").cast("decimal(2,1)") - money.money(F.col("l_quantity"))
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        money.amount(worth).alias("worth"),
        money.floor_zero(net() - cost).cast("double").alias("above_cost"),
    )


@query(
    "greatest_and_least",
    "M04 T04",
    """
    SELECT o_orderkey, GREATEST(a, b) AS later, LEAST(a, b) AS earlier,
           CASE WHEN lo = DATE '1900-01-01' THEN a ELSE lo END AS known_from FROM (
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus = 'F' THEN DATE '1999-06-01' END AS b,
               CASE WHEN o_orderstatus = 'O' THEN DATE '1900-01-01' ELSE DATE '1996-01-01' END AS lo FROM orders)
    """,
)
def greatest_and_least(t):
    """Both skip nulls; an unknown start is replaced."""
    a = F.to_date("o_orderdate")
    b = F.when(F.col("o_orderstatus") == "F", F.lit(date(1999, 6, 1)))
    low = F.when(F.col("o_orderstatus") == "O", F.lit(dates.UNKNOWN_START)).otherwise(F.lit(date(1996, 1, 1)))
    return t("orders").select(
        "o_orderkey",
        F.greatest(a, b).alias("later"),
        F.least(a, b).alias("earlier"),
        dates.known_start(low, a).alias("known_from"),
    )


@query(
    "division_kinds",
    "M05 X07",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS unit_price,
           CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS safe_ratio, l_orderkey // 1000 AS thousand,
           CAST(floor(l_quantity / 30) AS BIGINT) AS floored FROM lineitem
    """,
)
def division_kinds(t):
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        money.ratio(F.col("l_discount"), F.col("l_tax")).alias("safe_ratio"),
        money.whole_ratio(F.col("l_orderkey"), F.lit(1000)).alias("thousand"),
        F.floor(F.col("l_quantity") / 30).alias("floored"),
    )


@query(
    "as_of_filters",
    "T01 P02",
    f"""
    SELECT COUNT(*) FILTER (WHERE l_shipdate < {DAY} + 1) AS due_by_now, COUNT(*) FILTER (WHERE l_shipdate > {DAY}) AS after_now,
           COUNT(*) FILTER (WHERE CAST(l_shipdate AS DATE) >= {DAY}) AS today_or_later FROM lineitem
    """,
)
def as_of_filters(t):
    """Every reading of "now" is the as-of day that the caller passes."""
    ship = F.col("l_shipdate")
    return t("lineitem").agg(
        F.count_if(dates.on_or_before(ship, AS_OF)).alias("due_by_now"),
        F.count_if(ship > F.lit(AS_OF)).alias("after_now"),
        F.count_if(dates.on_or_after(ship, AS_OF)).alias("today_or_later"),
    )


@query(
    "day_and_month_diff",
    "T02 T03",
    f"""
    SELECT o_orderkey, date_diff('day', o_orderdate, {DAY}) AS days_since, date_diff('month', o_orderdate, {DAY}) AS months_since
    FROM orders
    """,
)
def day_and_month_diff(t):
    at = F.col("o_orderdate")
    return t("orders").select(
        "o_orderkey",
        dates.days_between(at, F.lit(AS_OF)).cast("bigint").alias("days_since"),
        dates.month_steps(at, F.lit(AS_OF)).cast("bigint").alias("months_since"),
    )


@query(
    "shifted_dates",
    "T05 T09 T04",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS plus_30, CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INTEGER) AS plus_terms,
           CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) AS next_year,
           CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE DATE '9999-01-01' END AS ended FROM orders
    """,
)
def shifted_dates(t):
    at = F.col("o_orderdate")
    return t("orders").select(
        "o_orderkey",
        dates.plus_days(at, 30).alias("plus_30"),
        dates.plus_days(at, (F.col("o_custkey") % 60).cast("int")).alias("plus_terms"),
        dates.plus_years(at, 1).alias("next_year"),
        F.when(F.col("o_orderstatus") == "F", F.to_date(at)).otherwise(F.lit(dates.NOT_TERMINATED)).alias("ended"),
    )


@query(
    "month_filters_and_keys",
    "T06 T07 T08",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_key, strftime(o_orderdate, '%d/%m/%Y') AS uk_day
    FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2001-06-01'
    """,
)
def month_filters_and_keys(t):
    at = F.col("o_orderdate")
    return t("orders").filter(dates.same_month(at, AS_OF)).select(
        "o_orderkey", dates.month_key(at).alias("month_key"), dates.uk_date(at).alias("uk_day")
    )


@query(
    "sunday_week",
    "T10",
    """
    SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n_orders,
           CAST((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) + 6) // 7 AS INTEGER) AS week_no
    FROM orders GROUP BY day, week_no
    """,
)
def sunday_week(t):
    return t("orders").groupBy(F.to_date("o_orderdate").alias("day"), dates.sunday_week(F.col("o_orderdate")).alias("week_no")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )


@query(
    "parsed_dates",
    "T11",
    """
    SELECT o_orderkey, CAST(strptime(txt, '%Y-%m-%d') AS DATE) AS parsed FROM
        (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS txt FROM orders)
    """,
)
def parsed_dates(t):
    texts = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("txt"))
    return texts.select("o_orderkey", F.to_date("txt", "yyyy-MM-dd").alias("parsed"))
