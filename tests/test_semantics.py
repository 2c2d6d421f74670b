"""Edge rows of every rule whose result depends on a day, a tie, a null or a bound."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rentroll.functions import dates, money, nulls, text
from rentroll.operators import ageing, calendars, joins, measures, reconcile, rollup, sales, status, timeline, versions
from rentroll.operators.profit import monthly_profit

AS_OF = date(2001, 6, 30)


def values(df, *cols):
    return sorted([tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()], key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def days(spark, *offsets):
    return spark.createDataFrame([(i, AS_OF + timedelta(days=o) if o is not None else None) for i, o in enumerate(offsets)], "i int, due date")


def test_age_bands_at_every_edge(spark):
    rows = days(spark, 1, 0, -1, -30, -31, -60, -61, -90, -91, -120, -121, None)
    got = [r.b for r in rows.select("i", ageing.age_band(F.col("due"), AS_OF).alias("b")).orderBy("i").collect()]
    assert got == ["Current"] * 2 + ["1-30 Days"] * 2 + ["31-60 Days"] * 2 + ["61-90 Days"] * 2 + ["91-120 Days"] * 2 + ["120+ Days"] * 2


def test_item_due_today_has_no_chase_band(spark):
    rows = days(spark, 0, -1, -30, -31, -90, -91)
    got = [r.b for r in rows.select("i", ageing.chase_band(F.col("due"), AS_OF).alias("b")).orderBy("i").collect()]
    assert got == [None, "1-30 Days", "1-30 Days", "31-60 Days", "61-90 Days", "91+ Days"]
    zeros = rows.filter("i = 0").select(*[c.alias(n) for n, c in ageing.chase_columns(F.col("due"), F.lit(5), AS_OF).items()]).first()
    assert set(zeros) == {0}


def test_ageing_sums_zero_balances_credits_and_empty_bands(spark):
    rows = spark.createDataFrame(
        [(1, AS_OF, Decimal("10")), (1, AS_OF - timedelta(days=5), Decimal("-4")), (1, AS_OF, Decimal("0")), (2, None, Decimal("3"))],
        "k int, due date, v decimal(18,4)",
    )
    aged = ageing.ageing_report(ageing.ageing(rows, ["k"], F.col("due"), F.col("v"), AS_OF)).orderBy("k").collect()
    assert (aged[0].current_due, aged[0].days_1_30, aged[0].days_31_60, aged[0].overdue, aged[0].outstanding) == (10.0, -4.0, None, -4.0, 6.0)
    assert (aged[1].days_120_plus, aged[1].overdue) == (3.0, 3.0)


def test_terms_only_move_items_that_earn_them(spark):
    rows = spark.createDataFrame([(True, 30), (False, 30), (None, 30)], "t boolean, n int")
    got = [r.d for r in rows.select(ageing.terms_due(F.lit(AS_OF), F.col("n"), F.col("t")).alias("d")).collect()]
    assert got == [date(2001, 7, 30), AS_OF, None]


@pytest.mark.parametrize(
    "days_left,label",
    [(-1, "Already Matured"), (0, "Already Matured"), (1, "1 Month or Less"), (30, "1 Month or Less"), (31, "1-2 Months"), (90, "2-3 Months"), (180, "3-6 Months"), (365, "6-12 Months"), (366, "More than 1 Year"), (None, None)],
)
def test_maturity_ladder(spark, days_left, label):
    assert one(spark, ageing.days_ladder(F.lit(days_left).cast("int"))) == label


def test_month_steps_count_boundaries_not_days(spark):
    assert one(spark, dates.month_steps(F.lit(date(2001, 1, 31)), F.lit(date(2001, 2, 1)))) == 1
    assert one(spark, dates.month_steps(F.lit(date(2000, 12, 31)), F.lit(date(2001, 1, 1)))) == 1
    assert one(spark, dates.month_steps(F.lit(date(2001, 3, 1)), F.lit(date(2001, 3, 31)))) == 0


def test_sunday_week_holds_new_year(spark):
    # 2021-01-01 is a Friday, 2021-01-03 the first Sunday.
    for day, week in [(date(2021, 1, 1), 1), (date(2021, 1, 2), 1), (date(2021, 1, 3), 2), (date(2020, 12, 31), 53), (date(2023, 1, 1), 1), (date(2023, 1, 8), 2)]:
        assert one(spark, dates.sunday_week(F.lit(day))) == week


def test_fridays(spark):
    friday = date(2024, 1, 5)
    for d in range(-6, 1):
        assert one(spark, dates.friday_on_or_after(F.lit(friday + timedelta(days=d)))) == friday


def test_same_month_at_the_year_end(spark):
    rows = spark.createDataFrame([(date(2000, 12, 1),), (date(2000, 12, 31),), (date(2001, 1, 1),), (date(2000, 11, 30),)], "d date")
    assert rows.filter(dates.same_month(F.col("d"), date(2000, 12, 15))).count() == 2


def test_day_differences_and_bounds_on_timestamps(spark):
    rows = spark.createDataFrame([(datetime(2001, 6, 30, 23, 59),), (datetime(2001, 7, 1),), (datetime(2001, 6, 30),)], "t timestamp_ntz")
    assert rows.filter(dates.on_or_before(F.col("t"), AS_OF)).count() == 2
    assert one(spark, dates.days_between(F.lit("2001-06-29 23:59:00").cast("timestamp_ntz"), F.lit("2001-06-30 00:01:00").cast("timestamp_ntz"))) == 1


def test_unknown_start_is_replaced(spark):
    known = dates.known_start(F.col("s"), F.col("c"))
    rows = spark.createDataFrame([(date(1900, 1, 1), date(2000, 5, 5)), (date(1999, 1, 1), date(2000, 5, 5)), (None, date(2000, 5, 5))], "s date, c date")
    assert values(rows.select(known.alias("x")), "x") == sorted([date(2000, 5, 5), date(1999, 1, 1), None], key=repr)


def test_null_change_rules(spark):
    rows = spark.createDataFrame([(None, None), ("a", None), (None, "a"), ("a", "a"), ("a", "b")], "n string, b string")
    assert [r.x for r in rows.select(nulls.changed(F.col("n"), F.col("b")).alias("x")).collect()] == [False, True, True, False, True]


def test_text_rules(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.concat_strict(F.lit("a"), null)) is None
    assert one(spark, text.concat_blank(F.lit("a"), null, F.lit("b"))) == "ab"
    assert one(spark, text.join_parts(F.lit("a"), null, F.lit(""), F.lit("b"))) == "a b"
    assert one(spark, text.trimmed_or_null(F.lit("   "))) is None
    assert one(spark, text.varchar(F.lit("abcdefghij"), 8)) == "abcdefgh"
    assert [one(spark, text.initial_in(F.lit(w), "A", "E")) for w in ("Apple", "Eel", "Fig", "apple")] == [True, True, False, False]


def test_money_rules(spark):
    assert one(spark, money.whole_ratio(F.lit(7), F.lit(2))) == 3
    assert one(spark, money.whole_ratio(F.lit(-7), F.lit(2))) == -3
    assert one(spark, money.ratio(F.lit(7.0), F.lit(0.0))) is None
    assert one(spark, money.floor_zero(F.lit(-3))) == 0
    assert one(spark, money.floor_zero(F.lit(None).cast("int"))) is None
    assert one(spark, F.greatest(F.lit(None).cast("int"), F.lit(1))) == 1
    assert one(spark, nulls.default_to(F.lit(None).cast("decimal(10,2)"), 0, "decimal(10,2)")) == Decimal("0.00")


def test_free_of_charge_is_exactly_a_penny(spark):
    rows = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),), (None,)], "c decimal(18,4)")
    flag = status.utilisation(status.is_free(F.col("c")), F.col("c").isNotNull(), F.lit(True))
    assert [r.x for r in rows.select(flag.alias("x")).collect()] == ["Yes (FoC)", "Yes", "In Application"]


def test_funding_status(spark):
    rows = spark.createDataFrame([(None, 10), (0, 10), (5, 10), (10, 10), (11, 10)], "f int, b int")
    got = [r.x for r in rows.select(status.funding_status(F.col("f"), F.col("b")).alias("x")).collect()]
    assert got == ["Not Funded", "Not Funded", "Partially Funded", "Fully Funded", "Fully Funded"]


def test_arrears_less_grace_never_below_zero(spark):
    rows = spark.createDataFrame([(1, AS_OF, 5), (1, AS_OF - timedelta(days=20), 5), (2, AS_OF - timedelta(days=3), 5), (3, AS_OF + timedelta(days=1), 5)], "k int, due date, v int")
    got = {r.k: (r.arrears, r.days_past_due) for r in status.arrears(rows, ["k"], F.col("due"), F.col("v"), AS_OF, 14).collect()}
    assert got == {1: (10, 6), 2: (5, 0)}
    assert values(status.next_due(rows, ["k"], F.col("due"), AS_OF), "k") == [3]


def test_interval_join_bounds_gaps_and_open_ends(spark):
    spans = spark.createDataFrame(
        [("k", "a", date(2001, 1, 10), date(2001, 1, 31)), ("k", "b", date(2001, 1, 31), date(2001, 3, 2)), ("k", "c", date(2001, 4, 1), date(9999, 12, 31)), ("k", "none", date(2001, 5, 2), date(2001, 5, 1))],
        "k string, name string, lo date, hi date",
    )
    events = spark.createDataFrame([("k", d) for d in (date(2001, 1, 9), date(2001, 1, 10), date(2001, 1, 31), date(2001, 3, 2), date(2001, 3, 15), date(2001, 6, 30))], "k string, at date")
    half = joins.interval_join(events, spans, ["k"], "at", F.col("lo"), F.col("hi"), F.lit(AS_OF))
    assert values(half, "at", "name") == sorted([(date(2001, 1, 10), "a"), (date(2001, 1, 31), "b"), (date(2001, 6, 30), "c")], key=repr)
    closed = joins.interval_join(events, spans, ["k"], "at", F.col("lo"), F.col("hi"), F.lit(AS_OF), closed=True)
    assert values(closed, "at", "name") == sorted(
        [(date(2001, 1, 10), "a"), (date(2001, 1, 31), "a"), (date(2001, 1, 31), "b"), (date(2001, 3, 2), "b"), (date(2001, 6, 30), "c")], key=repr
    )


def test_either_key_join_lists_a_pair_once(spark):
    left = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "a int, n string")
    right = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "b int, m string")
    got = joins.either_key_join(left, right, F.col("a") == F.col("b"), F.col("n") == F.col("m"))
    assert values(got, "a", "n", "b", "m") == sorted([(1, "x", 1, "x"), (1, "x", 2, "x"), (2, None, 2, "x"), (None, "y", 3, "y")], key=repr)


def test_first_per_key_and_ends(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (2, 7, "d")], "k int, o int, v string")
    assert values(versions.first_per_key(rows, ["k"], F.col("o").desc(), F.col("v")), "v") == ["a", "d"]
    assert values(versions.first_per_key(rows, ["k"], F.col("o"), F.col("v")), "v") == ["c", "d"]
    assert values(versions.opening_and_closing(rows, ["k"], "v", "o", "v"), "opening_value", "closing_value") == [("c", "b"), ("d", "d")]


def test_change_points_keep_unset_and_set_again(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, None, "a", "a", None, "a"])], "k int, i int, s string")
    assert values(timeline.change_points(rows, ["k"], ["i"], "s"), "i") == [0, 2, 4, 5]


def test_state_after_an_unset_state_is_a_new_interval(spark):
    rows = spark.createDataFrame([(1, date(2001, 1, d), s, date(9999, 12, 31)) for d, s in [(1, None), (2, None), (3, "a"), (4, "a")]], "k int, at date, s string, e date")
    for cut in ({}, {"rows": 1}):
        got = timeline.state_intervals(rows, ["k"], ["at"], "s", "at", "e", unset=lambda s: s.isNull(), **cut)
        assert [r.valid_from.day for r in got.orderBy("valid_from").collect()] == [1, 2, 3]


def test_friday_on_a_boundary_counts_in_both_intervals(spark):
    friday = date(2024, 1, 12)
    spans = spark.createDataFrame([("a", date(2024, 1, 3), friday), ("b", friday, date(9999, 12, 31)), ("c", date(2024, 1, 6), date(2024, 1, 11))], "s string, lo date, hi date")
    got = timeline.friday_snapshots(spans, F.col("lo"), F.col("hi"), date(2024, 1, 20))
    assert values(got, "s", "snapshot") == sorted([("a", date(2024, 1, 5)), ("a", friday), ("b", friday), ("b", date(2024, 1, 19))], key=repr)


def test_weekly_balance_carries_over_quiet_weeks(spark):
    moves = spark.createDataFrame([(1, datetime(2024, 1, 1), Decimal("5")), (1, datetime(2024, 1, 5, 8), Decimal("2")), (1, datetime(2024, 1, 20), Decimal("1")), (1, datetime(2024, 3, 1), Decimal("9"))], "k int, t timestamp_ntz, v decimal(18,4)")
    got = timeline.weekly_balance(moves, ["k"], "t", "v", date(2024, 1, 26)).orderBy("week_end").collect()
    assert [(r.week_end.day, float(r.balance)) for r in got] == [(5, 7.0), (12, 7.0), (19, 7.0), (26, 8.0)]


def test_balance_before_a_snapshot_and_facts_carried(spark):
    snaps = spark.createDataFrame([(1, date(2024, 1, 5)), (1, date(2024, 1, 12)), (2, date(2024, 1, 5))], "k int, s date")
    moves = spark.createDataFrame([(1, date(2024, 1, 4), 3), (1, date(2024, 1, 4), 4), (1, date(2024, 1, 5), 10)], "k int, d date, v int")
    facts = spark.createDataFrame([(1, date(2024, 1, 1), 50)], "k int, d date, b int")
    got = timeline.balance_at(snaps, moves, ["k"], "s", "d", "v", "bal", facts=(facts, "d", {"book": "b"}))
    assert values(got, "k", "s", "bal", "book") == [(1, date(2024, 1, 12), 17, 50), (1, date(2024, 1, 5), 7, 50), (2, date(2024, 1, 5), 0, None)]


def test_top_with_ties_keeps_the_tie_at_the_cut(spark):
    rows = spark.createDataFrame([(v,) for v in (9, 8, 7, 7, 7, 1)], "v int")
    assert values(measures.top_with_ties(rows, 3, "v"), "v") == [7, 7, 7, 8, 9]


def test_year_to_date_starts_over_each_year(spark):
    rows = spark.createDataFrame([("a", date(2000, 12, 31), 5), ("a", date(2001, 1, 1), 2), ("a", date(2001, 1, 1), 1), ("a", date(2001, 3, 1), 4)], "k string, d date, v int")
    got = measures.year_to_date(rows, ["k"], "d", "v").orderBy("day").collect()
    assert [r.ytd for r in got] == [5.0, 3.0, 7.0]


def test_duplicates_and_differences(spark):
    rows = spark.createDataFrame([("e1", "new"), ("e1", "old"), ("e2", "new"), ("e3", "old"), (None, "old")], "e string, s string")
    got = reconcile.keep_or_remove(rows, ["e"], "s", "new")
    assert values(got, "e", "s", "verdict") == sorted([("e1", "new", "keep"), ("e1", "old", "keep"), ("e2", "new", "keep"), ("e3", "old", "remove"), (None, "old", "remove")], key=repr)
    assert one(spark, reconcile.difference(F.lit(5), F.lit(None).cast("int"), F.lit(2))) == 3


def test_quality_report_counts_raw_nulls(spark):
    raw = spark.createDataFrame([("2001-01-01", 5.0, 1, "r", "c"), ("2001-01-01", None, 1, "r", "c"), ("2001-01-01", -1.0, 0, "r", "c")], sales.RAW_SCHEMA)
    report = sales.quality(raw).first()
    assert (report.total_records, report.null_records, report.quality_score, report.no_nulls, report.has_rows) == (3, 1, 66.67, False, True)
    empty = sales.quality(raw.filter("amount > 100")).first()
    assert (empty.total_records, empty.quality_score, empty.has_rows) == (0, None, False)
    assert sales.clean(raw).count() == 1


def test_calendar_spans_whole_years(spark):
    rows = spark.createDataFrame([(date(2000, 5, 1), date(2001, 2, 1))], "a date, b date")
    got = calendars.with_parts(calendars.calendar_of(rows, "a", "b"))
    assert got.count() == 366 + 365
    first = got.orderBy("day").first()
    assert (first.day, first.quarter_label, first.month_name, first.month_serial) == (date(2000, 1, 1), "Q1", "January", 200001)


def test_pivot_and_totals(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (2, "z", 9)], "k int, c string, v int")
    assert values(rollup.pivot_sum(rows, ["k"], "c", ["a", "b"], "v"), "k", "a", "b") == [(1, 5.0, 0.0), (2, 0.0, 0.0)]
    totals = rollup.with_totals(rows, ["k"], F.sum("v").alias("s"))
    assert values(totals, "k", "level", "s") == sorted([(1, 0, 5), (2, 0, 9), (None, 1, 14)], key=repr)


def test_running_profit_along_months(spark):
    moves = spark.createDataFrame([(1, date(2001, 1, 3), "income", 5), (1, date(2001, 2, 3), "expense", 2), (2, date(2001, 2, 9), "income", 1)], "i int, d date, kind string, v int")
    owner = spark.createDataFrame([(1, "x"), (2, "x")], "i int, o string")
    got = monthly_profit(moves, "i", owner, "o", "d", "v").orderBy("month_key").collect()
    assert [(r.month_key, r.income, r.expense, r.income_to_date, r.net_to_date) for r in got] == [("2001-01", 5.0, 0.0, 5.0, 5.0), ("2001-02", 1.0, 2.0, 6.0, 4.0)]


def test_not_in_drops_null(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert rows.filter(~F.col("s").isin("a")).count() == 1
