"""Connected components of a link table by alternating stars (Kiveris et al., 2014).

Each round every node hands its larger neighbours, then its smaller ones, to the smallest node it knows. The table stays
about as large as the links, a hub is a partial minimum and a join that adaptive execution can split, and the number of
rounds grows with the logarithm of the longest chain. Rounds end when the links are stars around their smallest nodes, so
links that come as stars, or none at all, take no round.
"""

from pyspark.sql import functions as F

from rentroll.llm.shared import save


def smallest(pairs):
    """(u, m): the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))


def large_star(links):
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    handed = both.join(smallest(both), "u").filter(F.col("v") > F.col("u"))
    return handed.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def small_star(links):
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = smallest(down)
    handed = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def apart(links):
    """Whether ``links`` (larger end first) are anything but stars around their smallest nodes."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
    return seen.agg(F.max(F.when(F.col("leaf") + F.col("hub") > 1, 1))).first()[0] is not None


def components(links):
    """(node, label) for every node with a link; the label is the smallest node of its component.

    ``links`` has a and b, in any order, any number of times; loops and links with a null are ignored.
    """
    turned = links.select("a", "b").na.drop().filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = save(turned.distinct(), "links")
    while apart(now):
        now = save(small_star(large_star(now)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
