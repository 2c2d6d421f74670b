"""Business state labels for contracts and assets."""

from pyspark.sql import functions as F

from rentroll.functions.money import floor_zero
from rentroll.functions.nulls import first_match

FREE_OF_CHARGE = "0.01"  # fixed value: a charge of exactly one penny means free of charge


def furthest_stage(*stages, otherwise="None"):
    """Label of the furthest step reached; list ``(reached, label)`` from the last step back."""
    return first_match(*[(c, F.lit(label)) for c, label in stages], otherwise=F.lit(otherwise))


def is_free(charge):
    return charge == F.lit(FREE_OF_CHARGE).cast("decimal(4,2)")


def utilisation(free, leased, in_application):
    """Free of charge > leased > in application > no."""
    return F.coalesce(
        F.when(free, F.lit("Yes (FoC)")),
        F.when(leased, F.lit("Yes")),
        F.when(in_application, F.lit("In Application")),
        F.lit("No"),
    )


def funding_status(funded, book_value):
    return first_match(
        (F.coalesce(funded, F.lit(0)) == 0, F.lit("Not Funded")),
        (funded >= book_value, F.lit("Fully Funded")),
        otherwise=F.lit("Partially Funded"),
    )


def arrears(open_items, keys, due, value, as_of, grace):
    """Open items already due per contract: sum, oldest due day and days past due less grace."""
    late = open_items.filter((due <= F.lit(as_of)) & (value > 0))
    return late.groupBy(*keys).agg(F.sum(value).alias("arrears"), F.min(due).alias("oldest_due")).withColumn(
        "days_past_due", floor_zero(F.datediff(F.lit(as_of), F.col("oldest_due")) - F.lit(grace))
    )


def next_due(open_items, keys, due, as_of):
    """Earliest due day after the as-of day."""
    return open_items.filter(due > F.lit(as_of)).groupBy(*keys).agg(F.min(due).alias("next_due"))


def prefix_family(col, families, otherwise):
    """Family by name prefix: ``(prefix, family)`` in order."""
    return first_match(*[(col.startswith(p), F.lit(f)) for p, f in families], otherwise=otherwise)
