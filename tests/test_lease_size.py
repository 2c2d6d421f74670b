"""What the lease reports shuffle: plans that keep it in proportion to the tables."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from rentroll.lease import assets, contracts, debt, finance, fleet, history, procurement, receivables
from rentroll.lease.warehouse import Settings, Warehouse, of_assets
from rentroll.operators import hot
from rentroll.plans.lease.fixture import STORED, warehouse
from rentroll.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def w(spark):
    """A warehouse without broadcasts, as tables of any size are joined."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield warehouse(Tables(spark, SF))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def test_moves_meet_leases_by_asset_alone(w, monkeypatch):
    """One shuffle of the moves, none for every length of lease, and the months are built once."""
    stored = []
    monkeypatch.setattr(finance, "materialise", lambda df, name: stored.append(df) or df)
    finance.hire_maintenance_provision(w)
    assert len(stored) == 1
    assert "_level" not in plan_of(stored[0])
    top = plan_of(stored[0]).split("SortMergeJoin")[0]
    assert "Exchange" not in top  # months are summed where the asset's moves are


def test_pairs_of_documents_and_contracts_stay_where_they_are(w):
    plan = plan_of(history.application_documents(w))
    assert "Exchange" not in plan.split("SortMergeJoin")[0]
    assert "Aggregate" not in plan.split("SortMergeJoin")[0]


def test_rows_of_documents_come_once(spark):
    """Repeated rows of any part, as the distinct over all pairs told them apart."""
    frames = {
        "flat_contracts": spark.createDataFrame([("1", "L1", "n", "s", "p", "2001-01-01", "APP")] * 2, "id string, sequence_number string, customer_name string, status string, product string, commencement_date string, application_name string"),
        "flat_equipment": spark.createDataFrame([("1", "7", None, 3)] * 3 + [("1", "7", "2001-01-01", 3)], "contract_id string, asset_id string, terminated_on string, contract_mileage int"),
        "flat_assets": spark.createDataFrame([("7", "R7")] * 2, "id string, registration_number string"),
        "flat_application_documents": spark.createDataFrame([(5, "APP", "doc")] * 2 + [(6, "APP", "doc")], "document_id long, application_name string, title string"),
    }
    assert history.application_documents(frames.__getitem__).count() == 4


def test_assets_are_never_broadcast(w, spark):
    """Spark takes a million dense keys for small by their files; the driver would build them as broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    plan = plan_of(procurement.asset_funding(w))
    sides = re.findall(r"BroadcastExchange[^\n]*\n(.*?)FileScan parquet \[(\w+)", plan, re.S)
    assert {first for _, first in sides} <= {"sk_asset_status", "bk_detail_config_id", "sk_date"}


def test_leases_are_numbered_once_and_stored(w):
    assert "Window" not in plan_of(history.fleet_with_leases(w))


def test_sums_and_next_day_come_from_one_pass(w):
    plan = plan_of(receivables.customer_receivables(w))
    assert len(re.findall(r"FileScan parquet [^\n]*sk_invoice_run_date", plan)) == 1


def test_an_invoice_version_sends_its_latest_row_before_it_meets_its_invoice(w):
    """The facts are read at their source, and texts of the invoice are in no shuffle of all facts."""
    plan = plan_of(receivables.invoices(w))
    assert "WindowGroupLimit [sk_receivable_invoice" in plan
    assert "FileScan parquet [sk_invoice_detail" not in plan
    sent = [s for s in re.findall(r"Exchange hashpartitioning\((?:sk_invoice_detail|sk_receivable)#[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan) if "invoice_amount" in s]
    assert sent and not any("invoice_number" in s for s in sent)


def test_the_latest_row_of_an_invoice_counts_over_its_versions(w):
    """The latest row of all versions, also where it is a row of the old one or where the very latest has no receivable."""
    plain = {(r.bk_receivable_invoice_id, r.balance_amount) for r in receivables.invoice_details(w).select("bk_receivable_invoice_id", "balance_amount").collect()}
    facts = w("fact_receivable_invoice_detail")
    lost = facts.withColumns({"sk_date_record": F.lit(99991231).cast("long"), "sk_receivable": F.lit(-5).cast("long"), "balance_amount": F.lit(-1).cast("decimal(18,4)")})
    late = facts.filter("sk_receivable_invoice % 20 = 0").withColumns({"sk_date_record": F.lit(99991230).cast("long"), "balance_amount": F.lit(-2).cast("decimal(18,4)")})
    made = Warehouse(w.spark, lambda name: facts.unionByName(lost).unionByName(late) if name == "fact_receivable_invoice_detail" else w(name), w.settings)
    got = {(r.bk_receivable_invoice_id, r.balance_amount) for r in receivables.invoice_details(made).select("bk_receivable_invoice_id", "balance_amount").collect()}
    assert plain and {b for b, _ in got} == {b for b, _ in plain}
    assert all((b, a) in plain or (a == -2 and b % 10 == 0) for b, a in got) and any(a == -2 for _, a in got)


def test_next_day_counts_over_all_rows_of_a_contract(spark, monkeypatch):
    """Two customers on one contract: both rows show its soonest day; a contract without a coming day is left out."""
    sums = ", ".join(f"cast(1 as decimal(18,4)) {c}" for c in receivables.SUMS)
    rows = spark.sql(f"""SELECT *, {sums}, 1 days_late_count, 1 days_since_due FROM VALUES
        (1L, 's', 1L, 'a', 'p', DATE '2001-08-01'), (1L, 's', 2L, 'b', 'p', DATE '2001-07-01'), (1L, 's', 2L, 'b', 'p', DATE '2001-01-01'),
        (2L, 't', 1L, 'a', 'p', DATE '2001-06-30'), (NULL, 'u', 1L, 'a', 'p', DATE '2001-09-01')
        AS v(contract_id, sequence_number, customer_id, customer_name, product_name, due_date)""")
    monkeypatch.setattr(receivables, "invoice_details", lambda w: rows)
    got = receivables.lease_receivables(Warehouse(spark, None, Settings(as_of=date(2001, 6, 30)))).collect()
    assert {(r.contract_id, r.customer_id, str(r.next_due), int(r.invoice_amount)) for r in got} == {(1, 1, "2001-07-01", 1), (1, 2, "2001-07-01", 2)}
    assert len(got) == 2


def test_parts_of_one_key_take_one_shuffle(w):
    mixed = contracts.contracts_with(w, "migrated", "sales_rep", "balloon")
    grouped = contracts.contracts_with(w, "sales_rep", "migrated", "balloon")
    assert len(shuffles(mixed)) == len(shuffles(grouped))


def test_facts_of_leased_assets_are_shuffled_for_asset_marks_and_heads_alone(w):
    """Not once for each of contract, finance and customer."""
    wide = [line for line in plan_of(contracts.leased_now(w)).splitlines() if "SortMergeJoin" in line and "sk_customer" in line]
    assert any("sk_contract" in line and "sk_lease_finance" in line for line in wide)


def test_bills_due_read_the_invoice_facts_at_their_source(w):
    assert "FileScan parquet [sk_invoice_detail" not in plan_of(finance.bills_due(w))


def test_charge_lines_meet_the_charges_due_before_they_are_summed(w):
    assert plan_of(finance.month_charges(w)).count("HashAggregate") == 6


def test_facts_of_other_contracts_leave_first(w):
    joins = [line for line in plan_of(finance.leased_assets_open(w)).splitlines() if "SortMergeJoin" in line]
    place = {key: max(i for i, line in enumerate(joins) if key in line) for key in ("sk_contract", "sk_lease_finance", "sk_lease_asset", "sk_customer")}
    assert place["sk_contract"] == max(place.values())


def test_finance_of_some_contracts_is_that_of_all(w):
    """Also where a contract has two current versions and only the one without the latest record has the status."""
    def commenced(status):
        return status == "Commenced"

    both = w("dim_contract").filter("bk_contract_id % 3 = 0 AND status = 'InstallingAssets'").withColumn("current_flag", F.lit(1))
    odd = w("dim_contract").filter("NOT (bk_contract_id % 3 = 0 AND status = 'InstallingAssets')").unionByName(both)
    facts = w("fact_lease_finance_detail")
    late = facts.filter("sk_contract % 12 = 3").withColumn("sk_contract", F.col("sk_contract") - 1)
    made = Warehouse(w.spark, lambda name: {"dim_contract": odd, "fact_lease_finance_detail": facts.unionByName(late)}.get(name) or w(name), w.settings)
    names = "contract_id", "sk_contract", "status", "total_yield", "maturity_date"
    whole = contracts.finance_latest(made).filter(commenced(F.col("status"))).select(*names)
    assert not whole.isEmpty() and same(contracts.finance_latest_of(made, commenced).select(*names), whole)


def test_pivoted_charges_are_shuffled_once(w):
    plan = plan_of(finance.accruals_pivot(w))
    assert "pivotfirst" not in plan and "sk_branch" not in plan
    assert len(re.findall(r"HashAggregate\(keys=\[contract_id#\d+L, asset_id#\d+L", plan)) == 2


def test_originations_read_leases_of_their_contracts_alone(w):
    chosen = w("dim_contract").filter("bk_contract_id % 3 = 1").select(F.col("bk_contract_id").alias("contract_id"))
    names = "contract_id", "asset_id", "nbv_amount"
    whole = contracts.leased_now(w, inactive=False).join(chosen, "contract_id", "left_semi").select(*names)
    assert not whole.isEmpty() and same(contracts.leased_now(w, inactive=False, chosen=chosen).select(*names), whole)
    assert "_split" not in plan_of(history.originations(w))


def test_items_leave_with_their_invoice_and_are_read_at_their_source(w):
    plan = plan_of(debt.open_items(w))
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    place = {key: max(i for i, line in enumerate(joins) if key in line) for key in ("sk_receivable_invoice", "[sk_receivable#", "sk_invoice_detail", "sk_customer")}
    assert place["sk_receivable_invoice"] == max(place.values())
    assert "FileScan parquet [sk_invoice_detail" not in plan


def test_finance_of_chosen_contracts_is_that_of_all(w):
    chosen = w("dim_contract").filter("bk_contract_id % 5 = 0").select(F.col("bk_contract_id").alias("contract_id"))
    names = "contract_id", "customer_id", "sk_lease_finance", "total_yield"
    whole = contracts.finance_detail(w).join(chosen, "contract_id", "left_semi").select(*names)
    assert not whole.isEmpty() and same(contracts.finance_detail_of(w, chosen).select(*names), whole)


def test_invoices_meet_their_contract_once_the_latest_row_is_known(w):
    plan = plan_of(debt.outstanding_invoices(w))
    assert "FileScan parquet [sk_invoice_detail" not in plan
    sent = [s for s in re.findall(r"Exchange hashpartitioning\(contract_id[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan) if "invoice_amount" in s]
    assert sent and all("_split" in s for s in sent)


def test_charges_are_summed_once(w):
    assert plan_of(contracts.charges_by_asset(w)).count("HashAggregate") == 2


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_part_of_the_fleet_has_the_rows_of_the_whole(w):
    chosen = contracts.rental_fleet(w).filter("asset_id % 3 = 0").select("asset_id")
    own = of_assets(w, chosen)
    columns = "contract_id", "asset_id", "total_charge", "termination_date"
    for view, names in ((contracts.lease_assets_all, columns), (assets.in_application, ("asset_id", "stage", "opp_number")), (finance.latest_leases, columns[:2])):
        whole = view(w).select(*names).join(chosen, "asset_id", "left_semi")
        assert not whole.isEmpty() and same(view(own).select(*names), whole.select(*names))


def test_rental_reports_copy_no_star_table(w, monkeypatch):
    """Facts meet the assets of the report before anything else, and no more columns than it shows are stored."""
    stored = {}
    monkeypatch.setattr(hot, "materialise", lambda df, name: stored.setdefault(name, df))
    fleet.rental_availability(w)
    assert not {name for app, root, name in STORED} & {"fact_lease_asset", "dim_lease_asset", "dim_contract", "dim_asset", "asset_sheet"}
    assert len(stored["base"].columns) == 6
    first = [line for line in plan_of(stored["many"]).splitlines() if "sk_asset" in line and "Join" in line][-1]
    assert "LeftSemi" in first


def test_old_contract_versions_leave_first(w):
    joins = [line for line in plan_of(contracts.finance_rows(w)).splitlines() if "SortMergeJoin" in line]
    place = {key: max(i for i, line in enumerate(joins) if key in line) for key in ("sk_contract", "sk_lease_finance", "sk_customer")}
    assert place["sk_contract"] > max(place["sk_lease_finance"], place["sk_customer"])


def test_leased_assets_go_on_with_their_contract_alone(w):
    """The asset and its mark are looked up after version, finance and customer have become one contract."""
    rows = contracts.leased_now(w).select("contract_id", "asset_id", "rent_amount")
    marks = [s for s in re.findall(r"Exchange hashpartitioning\(sk_lease_asset[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan_of(rows)) if "rent_amount" in s]
    assert marks and not any("sk_customer" in s or "sk_lease_finance" in s for s in marks)


def test_moves_are_summed_where_their_asset_is(w):
    assert "Exchange" not in plan_of(finance.maintenance_moves(w)).split("SortMergeJoin")[0]


def test_months_of_maintenance_are_built_once(w, monkeypatch):
    stored = []
    monkeypatch.setattr(finance, "materialise", lambda df, name: stored.append(name) or df)
    finance.maintenance_costs(w)
    assert len(stored) == 1


def test_leases_of_chosen_contracts_are_those_of_all(w):
    """Waiting contracts alone, as the report on contracts not yet active reads them."""
    chosen = w("dim_contract").filter("current_flag = 1 AND status IN ('Pending', 'InstallingAssets')").select(F.col("bk_contract_id").alias("contract_id"))
    parts = (
        (contracts.lease_assets_live, contracts.lease_assets_live_of, ("contract_id", "asset_id", "total_charge", "rent_amount")),
        (contracts.charges_detail, contracts.charges_detail_of, ("contract_id", "asset_id", "charge_name", "charges")),
        (finance.latest_fact_of_asset, finance.latest_fact_of, ("contract_id", "asset_id", "lease_finance_id", "terminated_on")),
    )
    for view, of, names in parts:
        whole = view(w).join(chosen, "contract_id", "left_semi").select(*names)
        assert not whole.isEmpty() and same(of(w, chosen).select(*names), whole)
    many = contracts.lease_assets_live_of(w, chosen, few=False).select("contract_id", "asset_id")
    assert same(many, contracts.lease_assets_live(w).join(chosen, "contract_id", "left_semi").select("contract_id", "asset_id"))


def test_reports_on_some_contracts_read_leases_of_these_alone(w):
    for report in (fleet.contracts_not_activated, fleet.open_lease_file, finance.hire_maintenance_provision):
        monthless = plan_of(report(w)) if report is not finance.hire_maintenance_provision else plan_of(finance.latest_fact_of(w, contracts.contracts_to_keep(w, lambda s: s != "Inactive", "Contract Hire")))
        joins = [line for line in monthless.splitlines() if "SortMergeJoin" in line]
        place = {key: max((i for i, line in enumerate(joins) if key in line), default=-1) for key in ("sk_contract", "[sk_asset")}
        assert place["sk_contract"] > place["[sk_asset"]


def test_finance_of_one_product_is_that_of_all(w):
    def started(status):
        return ~status.isin("Inactive", "Pending")

    names = "contract_id", "status", "product_name", "maturity_date"
    whole = contracts.finance_latest(w).filter(started(F.col("status")) & (F.col("product_name") == "Contract Hire")).select(*names)
    assert not whole.isEmpty() and same(contracts.finance_latest_of(w, started, "Contract Hire").select(*names), whole)


def test_first_payments_need_no_second_finance_detail(w):
    plan = plan_of(contracts.contract_origination(w))
    assert len(re.findall(r"WindowGroupLimit \[contract_id#\d+L\], \[sk_contract#\d+L DESC NULLS LAST, sk_customer[^\n]*Partial", plan)) == 1


def test_charges_meet_leases_of_reported_assets(w):
    plan = plan_of(fleet.accruals_by_charge(w))
    first = [line for line in plan.splitlines() if "Join" in line and "sk_asset" in line][-1]
    assert "LeftSemi" in first


def test_structures_meet_their_profile_before_their_assets(w):
    sent = re.findall(r"Exchange hashpartitioning\((?:credit_profile_id|customer_id)#[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan_of(assets.credit_lines(w)))
    assert sent and not any("asset_id" in s for s in sent)


def test_tracked_tests_are_told_apart_before_leases_join(w, monkeypatch):
    monkeypatch.setattr(hot, "materialise", lambda df, name: df)
    plan = plan_of(history.test_tracker(w))
    assert "Aggregate" not in plan.split("Join")[0]


def test_distinct_counts_are_built_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(hot, "materialise", lambda df, name: stored.append(name) or df)
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (2, None)], "k int, v int")
    got = sorted((str(r.k), str(r.v), r.n_distinct) for r in hot.distinct_per_key(rows, ["k"], "v").collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("1", "2", 2), ("2", "None", 0), ("None", "3", 1)]
    assert stored == ["counts"]
