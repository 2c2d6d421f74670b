"""Published tables, refresh by increments, CSV rejects, day blocks and mergeable sets."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rentroll.operators import distinct_sets, joins, reconcile, rollup
from rentroll.operators.rules import longest_prefix
from rentroll.sources import published
from rentroll.sources.tables import read_csv_checked


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def test_a_write_that_fails_half_way_leaves_the_old_version(spark, root):
    frame = spark.range(100).repartition(4)
    assert published.publish(frame, root) == 1
    broken = frame.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, root)
    assert published.read(spark, root).count() == 100
    # A frame may read the table it replaces.
    assert published.publish(published.read(spark, root).filter("id < 10"), root) == 2
    assert published.read(spark, root).count() == 10 and published.read(spark, root, version=1).count() == 100
    with pytest.raises(ValueError, match="no such version"):
        published.read(spark, root, version=9)


def test_numbers_out_of_bounds_are_never_read(spark, root):
    numbers = {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col("v").isNull()), "most": F.max("v")}
    good = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    published.publish(good, root, numbers, {"rows": (1, 10), "nulls": (None, 1), "most": (5, 5)})
    bad = [good.unionByName(good), good.filter("false"), good.withColumn("v", F.lit(None).cast("int"))]
    for frame, said in zip(bad, ("nulls is 2.0", "rows is 0", "most is None")):
        with pytest.raises(published.Rejected, match=said) as refused:
            published.publish(frame, root, numbers, {"rows": (1, 10), "nulls": (None, 1), "most": (5, None)})
        assert refused.value.metrics["rows"] == frame.count()
    assert rows_of(published.read(spark, root)) == rows_of(good)
    assert [tuple(r) for r in published.log(spark, root).select("version", F.col("metrics")["nulls"]).collect()] == [(1, 1.0)]


def test_numbers_come_from_the_job_that_writes(spark, root):
    sc = spark.sparkContext
    sc.setJobGroup("one write", "")
    found = published.write_observed(spark.range(1000), f"{root}/x", {"rows": F.count(F.lit(1)), "sum": F.sum("id")})
    jobs = sc.statusTracker().getJobIdsForGroup("one write")
    sc.setJobGroup("others", "")
    assert found == {"rows": 1000.0, "sum": 499500.0} and len(jobs) == 1


def test_refresh_builds_changed_buckets_only(spark, root):
    def files():
        return {f: f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet") if "_log" not in str(f)}

    def build(rows):
        return rows.join(names, "k")

    def full(source):
        return build(source).select("k", "v", "name")

    names = spark.createDataFrame([(i, f"n{i % 3}") for i in range(20)], "k int, name string")
    rows = [(i % 20, i) for i in range(200)] + [(3, None), (None, 1)]
    first = spark.createDataFrame(rows, "k int, v int")
    bucket = F.col("k") % 5
    assert published.refresh(first, bucket, build, root, [names]) == ["0", "1", "2", "3", "4", "null"]
    before = files()
    assert published.refresh(first.repartition(7), bucket, build, root, [names]) == []
    assert files() == before and published.latest(spark, root).version == 1
    second = spark.createDataFrame([(k, v) for k, v in rows if k != 4 and k is not None] + [(7, 999), (2, None), (4, None)], "k int, v int")
    assert published.refresh(second, bucket, build, root, [names]) == ["2", "4"]
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)  # nothing is rewritten in place
    read = published.read_refreshed(spark, root).select("k", "v", "name")
    assert rows_of(read) == rows_of(full(second))
    kept = {f for f in read.inputFiles() if any(f.endswith(str(b.relative_to(root))) for b in before)}
    assert {f.split("_bucket=")[1][0] for f in kept} == {"0", "1", "3"}
    names = names.withColumn("name", F.upper("name"))
    assert published.refresh(second, bucket, build, root, [names]) == ["0", "1", "2", "3", "4"]
    assert rows_of(published.read_refreshed(spark, root).select("k", "v", "name")) == rows_of(full(second))


def test_digests_tell_nulls_and_repeats_apart(spark):
    def digest(rows):
        return published.digests_of(spark.createDataFrame(rows, "a string, b string"), F.lit("x")).first().digest

    assert digest([("p", None)]) != digest([(None, "p")])
    assert digest([("p", "q")] * 3) != digest([("p", "q")])
    assert digest([("p", "q"), ("r", "s")]) == digest([("r", "s"), ("p", "q")]) != digest([("p", "s"), ("r", "q")])


def test_csv_rejects_keep_line_and_reason(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,amount,day\n1,2.5,2024-01-01\n2,two,2024-01-01\n3,3.5\n4,,\n5,1.0,2024-01-01,more\n6,"1",nineteen\n"7","7.5","2024-02-01"\n')
    good, rejects = read_csv_checked(spark, str(path), "id int, amount double, day date")
    assert good.columns == ["id", "amount", "day"]
    assert rows_of(good) == sorted([repr((1, 2.5, date(2024, 1, 1))), repr((4, None, None)), repr((7, 7.5, date(2024, 2, 1)))])
    assert sorted((r.line[0], r.reason) for r in rejects.collect()) == [
        ("2", "amount: no double"), ("3", "number of fields"), ("5", "number of fields"), ("6", "day: no date")
    ]
    assert all(r.file.endswith("in.csv") for r in rejects.collect())


def test_blocks_of_an_interval_do_not_grow_with_it(spark):
    rng = random.Random(2)
    start = date(1950, 1, 1)
    spans = [(i, start + timedelta(days=rng.randrange(30_000)), n) for i, n in enumerate([0, 1, 2, 3, 8, 9, 31, 365, 366, 4000, 11_000, 36_500] * 9)]
    spans = [(i, a, a + timedelta(days=n)) for i, a, n in spans] + [(900, date(2000, 1, 2), date(2000, 1, 1)), (901, None, start)]
    frame = spark.createDataFrame(spans, "i int, lo date, hi date")
    cover = joins.block_cover(frame, F.col("lo"), F.col("hi"))
    sizes = cover.groupBy("i").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in sizes) <= 9 and {r.i for r in sizes} == set(range(len(spans) - 2))
    outside = cover.withColumn("_a", F.expr("_block * shiftleft(1, _level)")).selectExpr(
        "i", "greatest(unix_date(lo) - _a, 0) + greatest(_a + shiftleft(1, _level) - 1 - unix_date(hi), 0) as more", "datediff(hi, lo) + 1 as days"
    )
    assert outside.filter("more > days / 4 + 2").count() == 0
    points = spark.createDataFrame([(start + timedelta(days=rng.randrange(60_000)),) for _ in range(300)], "at date")
    got = joins.interval_join(points.withColumn("k", F.lit(1)), frame.withColumn("k", F.lit(1)), ["k"], "at", F.col("lo"), F.col("hi"), F.col("hi"), closed=True)
    want = [(p.at, s[0]) for p in points.collect() for s in spans if s[1] and s[1] <= p.at <= s[2]]
    assert sorted(map(tuple, got.select("at", "i").collect())) == sorted(want)


def test_sets_merge_to_any_level(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([None, *range(90)]) if i % 2 else rng.randrange(200_000), i) for i in range(3000)]
    frame = spark.createDataFrame(data, "g string, h string, m int, v int")
    ids = distinct_sets.dense_ids(frame.withColumn("name", F.concat(F.lit("n"), "m")), "name", "id", parts=5)
    got = [tuple(r) for r in ids.orderBy("name").collect()]
    assert got == [(name, i) for i, name in enumerate(sorted({f"n{m}" for _, _, m, _ in data if m is not None}))]
    told = rollup.totals_of_states(frame, ["g", "h"], "m", "members", total="v")
    want = []
    for keys in (2, 1, 0):
        for group in {r[:keys] for r in data}:
            mine = [r for r in data if r[:keys] == group]
            members = len({r[2] for r in mine} - {None})
            want.append((*group, *[None] * (2 - keys), (1 << 2 - keys) - 1, members, len(mine), sum(r[3] for r in mine)))
    assert rows_of(told) == sorted(map(repr, want))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert rollup.totals_of_states(frame.limit(0), ["g"], "m", "members").filter("level = 0").count() == 0


def test_a_checksum_tree_finds_the_rows_that_differ(spark):
    rng = random.Random(4)
    ours = [(rng.randrange(-5000, 200_000), rng.choice([None, rng.randrange(50)])) for _ in range(4000)]
    ours = list(dict(ours).items())
    theirs = [(k, 0 if v is None else v) for k, v in ours if not 1000 <= k < 1100] + [(300_000, 5)]
    theirs = [(k, v + (150_000 <= k < 150_400)) for k, v in theirs]
    a, b = spark.createDataFrame(ours, "k bigint, ours int"), spark.createDataFrame(theirs, "k bigint, theirs int")
    for leaf in (1, 50, 10**9):
        got = reconcile.differences(a, b, "k", "ours", "theirs", fanout=16, leaf=leaf)
        want = reconcile.compare_feeds(a, b, "k", "ours", "theirs").filter("missing + missing_in_ours + mismatch > 0")
        assert rows_of(got) == rows_of(want) and want.count() > 3
    ranges = reconcile.differing_ranges(a, b, "k", "ours", "theirs", fanout=16, leaf=50)
    joined = sum(reconcile.within(s, "k", ranges).count() for s in (a, b))
    assert joined < 300  # of 8,000 rows
    assert reconcile.differences(a, a.withColumnRenamed("ours", "theirs"), "k", "ours", "theirs").count() == 0
    assert reconcile.differences(a.limit(0), b, "k", "ours", "theirs").count() == b.count()
    assert reconcile.differing_ranges(a.limit(0), b.limit(0), "k", "ours", "theirs") == []


def test_ten_thousand_nested_rules_in_one_plan(spark):
    rng = random.Random(6)
    pool = [("".join(rng.choices("abc", k=rng.randint(0, 9))), rng.randrange(3), f"r{i}") for i in range(10_000)]
    texts = ["".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def plain(text, rules):
        fits = [(len(p), -q, l) for p, q, l in rules if text is not None and text.startswith(p)]
        longest = max((n for n, _, _ in fits), default=None)
        return min(((-q, l) for n, q, l in fits if n == longest), default=(0, None))[1]

    sizes = []
    for rules in (pool, [r for r in pool if r[0]][:20]):
        got = longest_prefix(rows, spark.createDataFrame(rules, "prefix string, priority int, label string"), "t")
        assert sorted(map(tuple, got.select("i", "label").collect())) == [(i, plain(t, rules)) for i, t in enumerate(texts)]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        sizes.append((plan.count("Join"), plan.count("Aggregate")))
    assert sizes[0] == sizes[1]
