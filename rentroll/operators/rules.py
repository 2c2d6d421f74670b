"""Rules kept as rows instead of branches in code."""

from pyspark.sql import functions as F

from rentroll.operators.hot import split_join


def longest_prefix(rows, rules, text, label="label", priority="priority"):
    """``rows`` with the label of the longest rule prefix that ``text`` begins with; null where none fits or ``text`` is null.

    ``rules`` has prefix, label and priority; an empty prefix fits every text. Of rules with equal prefix the least priority
    wins, of equal ones the smallest label. Each distinct text is cut to the lengths that prefixes have and the cuts are
    joined to the rules by equality, so the plan is the same for ten rules or ten thousand, and nested prefixes need no order
    in code. A text makes at most one row per length in use, rows themselves are joined once.
    """
    best = rules.groupBy("prefix").agg(F.min(F.struct(priority, label)).alias("_best"))
    best = best.select(F.col("prefix").alias("_prefix"), F.col("_best")[label].alias("_label"))
    lengths = rules.agg(F.collect_set(F.length("prefix"))).scalar()  # as many numbers as prefixes have lengths
    texts = rows.select(F.col(text).alias("_text")).filter(F.col(text).isNotNull()).distinct()
    cuts = texts.withColumn("_length", F.explode(lengths)).filter(F.col("_length") <= F.length("_text"))
    cuts = cuts.withColumn("_prefix", F.expr("left(_text, _length)"))
    found = cuts.join(best, "_prefix").groupBy("_text").agg(F.max_by("_label", "_length").alias(label))
    told = split_join(rows.withColumn("_text", F.col(text)), found, ["_text"], "left")
    return told.select(*rows.columns, label)
