"""Frames that several plans start from, and the as-of days of the fixture data."""

from datetime import date

from pyspark.sql import functions as F

from rentroll.functions.money import money

AS_OF = date(2001, 6, 30)
EVENTS_AS_OF = date(2024, 1, 31)


def net():
    """Line value after discount."""
    return money(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def gross():
    """Line value after discount with tax."""
    return money(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6)


# The same values for the SQL checks.
NET = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
GROSS = "CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6))"
DAY = "DATE '2001-06-30'"
EVENT_DAY = "DATE '2024-01-31'"


def open_items(t, where=None):
    """Order lines as receivables: due on the ship day, open with tax."""
    lines = t("lineitem") if where is None else t("lineitem").filter(where)
    return lines.select(
        "l_orderkey", F.to_date("l_shipdate").alias("due"), gross().alias("open"), "l_returnflag"
    )


def order_owner(t):
    return t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))


def customer_place(t):
    """Customer with nation and region names."""
    nation = t("nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"), "n_name"
    )
    return t("customer").join(nation, "c_nationkey").join(t("region"), "r_regionkey")
