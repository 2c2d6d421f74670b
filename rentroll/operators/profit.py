"""Monthly income and expense with running totals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.functions.dates import month_key
from rentroll.functions.money import amount


def monthly_profit(moves, item, owners, owner, at, value):
    """Income, expense, running totals and net per owner and month.

    ``moves`` tags each row ``income`` or ``expense`` in ``kind``. Rows are summed per item and month,
    joined to their owner and summed again, so the window holds one row per owner and month.
    """

    def of(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0))

    per_item = moves.groupBy(item, month_key(F.col(at)).alias("month_key")).agg(
        of("income").alias("income"), of("expense").alias("expense")
    )
    per_owner = per_item.join(owners, item).groupBy(owner, "month_key").agg(
        F.sum("income").alias("income"), F.sum("expense").alias("expense")
    )
    so_far = (
        Window.partitionBy(owner).orderBy("month_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return per_owner.select(
        owner,
        "month_key",
        amount(F.col("income")).alias("income"),
        amount(F.col("expense")).alias("expense"),
        amount(F.sum("income").over(so_far)).alias("income_to_date"),
        amount(F.sum("expense").over(so_far)).alias("expense_to_date"),
        amount(F.sum(F.col("income") - F.col("expense")).over(so_far)).alias("net_to_date"),
    )
