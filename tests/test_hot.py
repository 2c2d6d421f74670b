"""Hot-key operators against plain windows, with a key that holds a third of the rows and a null key."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.operators import hot, timeline

CUT = {"per_piece": 3}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(600):
        key = rnd.choice([0, 0, 0, 0, None, None, *range(1, 60)]) if i % 3 else 7
        day = datetime(2024, 1, 1) + timedelta(days=rnd.randrange(40), hours=rnd.choice([0, 6]))
        data.append((key, day, i, rnd.choice(["a", "b", None]), rnd.randrange(100)))
    return spark.createDataFrame(data, "k int, at timestamp_ntz, id int, s string, v int")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_pieces_are_bounded_whatever_a_key_holds(spark, rows):
    for frame in (rows, rows.withColumn("at", F.lit(0))):  # also when all rows fall on one day
        pieces, by = hot.in_groups(frame, ["k"], ["at", "id"], 8)
        sizes = pieces.groupBy("_group").count().collect()
        assert by == ["_group"]
        assert max(r["count"] for r in sizes) <= 12
        assert {r._group.k for r in sizes if r._group._slot is not None} >= {0, 7, None}
        ends = pieces.filter("_group._slot is not null").groupBy("_group").agg(F.min(F.struct("at", "id")), F.max(F.struct("at", "id")))
        ordered = sorted(ends.collect(), key=lambda r: (repr(r._group.k), r._group._slot))
        assert all(a[2] < b[1] for a, b in zip(ordered, ordered[1:]) if a._group.k == b._group.k)


def test_hot_keys_cost_no_more_per_row(spark, rows):
    """No list of cut points reaches the rows: they are dealt by range, and the pieces are stored."""
    dealt = hot.dealt_by_range(rows, ["k"], ["at", "id"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(k" in dealt and "Broadcast" not in dealt and "transform" not in dealt
    small = hot.ordered_columns(rows, ["k"], ["at", "id"], ordinal="n", per_piece=5)
    large = hot.ordered_columns(rows, ["k"], ["at", "id"], ordinal="n", per_piece=90)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (small, large)]
    assert [p.count("Join") for p in plans][0] == [p.count("Join") for p in plans][1]
    assert all("lambda" not in p and "array" not in p for p in plans)
    plain = hot.ordered_columns(rows, ["k"], ["at", "id"], ordinal="n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plain and plain.count("Window") == 1


def test_equal_rows_get_many_salts(spark):
    rows = spark.createDataFrame([(1, "same")] * 300, "k int, s string")
    plan = hot.spread_join(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], per_piece=30)
    assert plan.count() == 300 and "monotonically_increasing_id" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_ordered_columns_equal_plain_windows(rows):
    w = Window.partitionBy("k").orderBy("at", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    desc = Window.partitionBy("k").orderBy(F.col("at").desc(), F.col("id").desc())
    plain = rows.withColumns(
        {
            "n": F.row_number().over(w).cast("bigint"),
            "back": F.row_number().over(desc).cast("bigint"),
            "run": F.sum("v").over(so_far),
            "before": F.lag("s").over(w),
            "after": F.lead("at").over(w),
            "opening": F.first("s").over(whole),
            "closing": F.last("s").over(whole),
        }
    )
    for cut in (CUT, {}):
        ours = hot.ordered_columns(
            rows,
            ["k"],
            ["at", "id"],
            ordinal="n",
            reverse_ordinal="back",
            running={"run": "v"},
            previous={"before": "s"},
            following={"after": "at"},
            first={"opening": "s"},
            last={"closing": "s"},
            **cut,
        )
        same(ours, plain)


def test_counts_over_a_key(rows):
    w = Window.partitionBy("k")
    plain = rows.select("k", "id", F.count("*").over(w).alias("n"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    same(hot.spread_join(rows, counts, ["k"], **CUT).select("k", "id", "n"), plain)
    same(hot.count_per_key(rows, ["k"], "n").select("k", "id", "n"), plain)
    per_value = F.size(F.collect_set("s").over(w)).cast("bigint")
    same(hot.distinct_per_key(rows, ["k"], "s").select("k", "id", "n_distinct"),
         rows.select("k", "id", per_value.alias("n_distinct")))


def brute_intervals(data):
    out = []
    for key in {r.k for r in data}:
        mine = sorted((r for r in data if r.k == key), key=lambda r: (r.at, r.id))
        points = [r for i, r in enumerate(mine) if i == 0 or r.s != mine[i - 1].s]
        for i, r in enumerate(points):
            until = points[i + 1].at.date() if i + 1 < len(points) else date(9999, 12, 31)
            out.append((key, r.s, r.at, min(until, mine[-1].ends)))
    return sorted(map(repr, out))


def test_state_intervals_with_and_without_hot_keys(rows):
    ended = rows.withColumn("ends", F.date_add(F.to_date("at"), F.col("v")))
    want = brute_intervals(ended.collect())
    for cut in (CUT, {}):
        got = timeline.state_intervals(ended, ["k"], ["at", "id"], "s", "at", "ends", **({"rows": 3} if cut else {}))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_split_and_attach_joins(rows):
    per_key = rows.groupBy("k").agg(F.max("v").alias("top"))
    known = rows.filter("k is not null")
    same(hot.split_join(known, per_key, ["k"]).select("k", "id", "top"), known.join(per_key, "k").select("k", "id", "top"))
    base = rows.sparkSession.range(0, 70).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("twice"))
    want = base.join(known, "k", "left").select("k", "twice", "id")
    same(hot.attach_many(base, known, ["k"]).select("k", "twice", "id"), want)
