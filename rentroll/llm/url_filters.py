"""URL filter: a sort-merge range join of urls with nested prefix rules.

A url is looked up once per suffix of its host that has rules (``m.example.org`` -> ``org``, ``org.example``,
``org.example.m``: labels reversed, so that a rule and all it covers are neighbours in sort order). Within one suffix a
rule is the interval of all paths that start with its path. Urls, interval starts and interval ends are sorted
together; walking along that order, entering an interval makes its rule the top of the stack and leaving it gives the
top back to the rule around it, so each url meets the innermost open rule. A suffix with many urls is cut into slices,
each of which gets the rules of that suffix; the slices hold about ``rows_per_slice`` urls at any size.

Of the rules that fit at different suffixes the longest (host and path together) wins; of equal length the one with the
longer host; of the same host and path ``block``. Only column functions: no Python runs on the executors.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.llm.shared import ascii_lower

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
START, END, POINT = 1, 0, 2


def with_parts(pages):
    """Add ``host`` (lower-cased) and ``path``; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumns({
        "host": ascii_lower(F.regexp_extract(url, URL, 1)),
        "path": F.regexp_extract(url, URL, 2),
    })


def rule_table(spark, rules):
    """Rules given as (verdict, host, path) tuples as a table."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path")])
    one = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*one)))


def reversed_host(host):
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def with_parent(rules):
    """One row per (host, path), with the innermost other rule of that host whose path this path starts with."""
    own = (
        rules.select(ascii_lower("host").alias("host"), "path", "verdict")
        .na.drop()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("rule", F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("name"),
            "verdict",
        ))
    )
    shorter = own.select(
        "host",
        F.col("path").alias("inner_path"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"),
    ).filter(F.col("path") != F.col("inner_path"))
    outer = (
        shorter.join(own.select("host", "path", "rule"), ["host", "path"])
        .groupBy("host", F.col("inner_path").alias("path"))
        .agg(F.max("rule").alias("parent"))
    )
    return own.join(outer, ["host", "path"], "left")


def suffixes(urls, hosts):
    """(suffix, host, path) for each suffix of a url's host that has rules."""
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return urls.select("host", "path", F.explode(ends).alias("suffix")).join(hosts, "suffix", "left_semi")


def innermost(urls, rules, rows_per_slice):
    """(host, path, rule) for every distinct url that some rule fits."""
    nested = with_parent(rules)
    hosts = nested.select(F.col("host").alias("suffix")).distinct()
    looked_up = suffixes(urls.select("host", "path").distinct(), hosts)
    points = looked_up.select("suffix", "path").distinct()
    slices = points.groupBy("suffix").agg(F.ceil(F.count(F.lit(1)) / rows_per_slice).cast("int").alias("slices"))
    sliced = points.join(slices, "suffix").withColumn(
        "slice", F.pmod(F.xxhash64("suffix", "path"), F.col("slices")).cast("int")
    )
    no_rule = F.lit(None).cast(nested.schema["rule"].dataType)
    key = F.concat(F.encode(F.concat(reversed_host(F.col("suffix")), F.lit("\u0000"), F.col("path")), "UTF-8"))
    bound = (
        nested.withColumnRenamed("host", "suffix")
        .join(slices, "suffix")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    )
    past = F.concat(key, F.unhex(F.lit("FF")))  # no UTF-8 text holds this byte: after all that starts with the key
    columns = ("suffix", "slice", "path")
    events = (
        sliced.select(*columns, key.alias("key"), F.lit(POINT).alias("kind"), F.lit(None).cast("struct<top:%s>" % nested.schema["rule"].dataType.simpleString()).alias("state"))
        .unionByName(bound.select(*columns, key.alias("key"), F.lit(START).alias("kind"), F.struct(F.col("rule").alias("top")).alias("state")))
        .unionByName(bound.select(*columns, past.alias("key"), F.lit(END).alias("kind"), F.struct(F.coalesce("parent", no_rule).alias("top")).alias("state")))
    )
    sweep = Window.partitionBy("suffix", "slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        events.withColumn("open", F.last("state", ignorenulls=True).over(sweep))
        .filter((F.col("kind") == POINT) & F.col("open.top").isNotNull())
        .select("suffix", "path", F.col("open.top").alias("rule"))
    )
    return (
        looked_up.join(met, ["suffix", "path"])
        .groupBy("host", "path")
        .agg(F.max("rule").alias("rule"))
    )


def judge(pages, rules, default="allow", rows_per_slice=1_000_000):
    """Verdict for every row of ``pages`` (needs ``url``); ``rules`` has verdict, host, path.

    Adds host, path, rule (host and path of the winning rule, null if none fits) and verdict (the rule's, else
    ``default``). Rows are never dropped or merged: a repeated row is judged as often as it occurs, a null or malformed
    url has an empty host and path and gets ``default`` (unless a rule for the empty host exists), an empty table gives
    an empty result. Rules with a null field are no rules. Columns of ``pages`` that clash are replaced.
    """
    urls = with_parts(pages.drop("host", "path", "rule", "verdict"))
    verdicts = innermost(urls, rules, rows_per_slice).select(
        "host", "path", F.col("rule.name").alias("rule"), F.col("rule.verdict").alias("verdict")
    )
    return urls.join(verdicts, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
