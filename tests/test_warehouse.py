"""The lease reports on a user's own tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from check import duck
from rentroll.lease import debt
from rentroll.lease.parts import registrations
from rentroll.lease.warehouse import Settings, Warehouse
from rentroll.plans.lease.star import STAR
from rentroll.session import shared_folder
from rentroll.sources.tables import materialise

AS_OF = date(2001, 6, 30)


def test_tables_by_prefix_with_renamed_columns(spark, tmp_path):
    rows = [(1, 7, "OLD", date(1999, 1, 1), 1, 1), (2, 7, "NEW", date(2000, 1, 1), 1, 1), (3, 7, "GONE", date(2001, 1, 1), 1, 0), (4, 8, "ONE", date(1999, 1, 1), 0, 1)]
    frame = spark.createDataFrame(rows, "reg_key int, asset_id int, registration_number string, effective_date date, is_active int, current_flag int")
    frame.write.parquet(str(tmp_path / "house_dim_registration.parquet"))
    w = Warehouse.of_lake(spark, tmp_path, Settings(as_of=AS_OF), prefix="house_", renamed={"reg_key": "bk_registration_id"})
    got = {r.asset_id: (r.registration_number, r.is_active) for r in registrations(w).collect()}
    assert got == {7: ("NEW", 1), 8: ("ONE", 0)}
    assert registrations(w) is registrations(w)


def test_controllers_are_settings(spark):
    rules = {"prefix": {"Box": "p"}, "initial": {("A", "C"): "q"}, "other": "r"}
    names = spark.createDataFrame([("Boxes",), ("Bob",), ("Zed",), (None,)], "n string")
    w = Warehouse(spark, None, Settings(as_of=AS_OF, controllers=rules))
    assert [r.x for r in names.select(debt.controller(w, F.col("n")).alias("x")).collect()] == ["p", "q", "r", "r"]
    none = Warehouse(spark, None, Settings(as_of=AS_OF))
    assert names.select(debt.controller(none, F.col("n")).alias("x")).distinct().collect()[0].x is None


def test_snapshots_go_to_the_named_folder(spark):
    folder = shared_folder(spark)
    kept = materialise(spark.range(5), "five")
    assert kept.count() == 5
    assert all(f.split("file:")[-1].lstrip("/").startswith(folder.lstrip("/")) for f in kept.inputFiles())


WHOLE = {
    "dim_receivable_tax": "events", "flat_expenses": "events", "dim_asset_sale": "orders", "dim_asset_sale_employee": "orders",
    "dim_asset_sale_detail": "lineitem", "dim_book_depreciation": "lineitem", "flat_budgets": "lineitem",
    "dim_application_structure_asset": "lineitem WHERE l_orderkey % 8 = 7",  # the orders that have a structure
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_derived_tables_have_a_row_for_every_source_row(name):
    con = duck("/root/testdata/sf0.001")
    rows = con.sql(f"SELECT count(*) FROM ({STAR[name]})").fetchall()
    assert rows == con.sql(f"SELECT count(*) FROM {WHOLE[name]}").fetchall() and rows[0][0] > 0
