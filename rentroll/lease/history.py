"""Reports over both systems' history and the current fleet with its leases."""

from pyspark.sql import functions as F

from rentroll.functions.dates import NOT_TERMINATED, UNKNOWN_START
from rentroll.functions.nulls import first_match
from rentroll.lease.assets import asset_details, asset_sheet, asset_value, in_application, in_application_once
from rentroll.lease.contracts import charges_by_asset, finance_latest, finance_records, leased_now
from rentroll.lease.finance import (
    contract_sheet,
    latest_approved_leases,
    latest_fact_of_asset,
    latest_leases,
    leased_assets_open,
)
from rentroll.lease.parts import as_amounts, config, current_assets, current_contracts, current_customers, lookup, products, registrations, serials, with_day
from rentroll.lease.pipeline import contract_events
from rentroll.lease.receivables import sundry_details
from rentroll.lease.warehouse import of_assets, view
from rentroll.operators import versions
from rentroll.operators.hot import attach_many, ordered_columns, split_join
from rentroll.operators.joins import either_key_join, text_key_join
from rentroll.operators.reconcile import keep_or_remove
from rentroll.operators.status import is_free
from rentroll.sources.tables import materialise

# Fees that are no fleet spend.
NO_FLEET_SPEND = [
    "Arrears Letter",
    "Asset Sales Cost Charge",
    "Asset Sales Cost Recharge",
    "Backed off Other Charge",
    "Balloon Payment (FL)",
    "Balloon Payment (HP)",
    "Billing Expense (FL)",
    "Billing Expense (HP)",
    "Brokerage Income",
    "Brokerage Income - Credit",
    "Brokerage Income - Credit NO VAT",
    "Brokerage Income NO VAT",
    "Collection and Delivery Rental Charge",
    "Collection and Delivery Rental Recharge",
    "Contract Hire Income - Credit V2",
    "Contract Hire Income - V2",
    "Deposit - HP",
    "Document Fee",
    "Document Fee (No VAT)",
    "Documentation Fee",
    "Documentation Fee (Expense)",
    "Funder Deposit (FL)",
    "Funder Deposit (HP)",
    "Insufficient Funds to meet a Direct Debit",
    "Hire Purchase Income - Credit",
    "Late Payment Interest",
    "Operating Lease  Income - Credit",
    "Option to Purchase",
    "Overdue Payment",
    "Refurb Cost Charge",
    "Refurb Cost Recharge",
    "Rent Receivable",
    "Rent Receivable - Credit",
    "Rental Income",
    "Rental Income - Credit",
    "Rental_Lease_Mid-Period_Payoff",
    "Repossession Charges",
    "Utilities",
    "Waiver",
]
# Fees that are no maintenance.
NO_MAINTENANCE = [
    "Arrears Letter",
    "Asset Sales Cost Charge",
    "Asset Sales Cost Recharge",
    "Backed off Other Charge",
    "Balloon Payment (FL)",
    "Balloon Payment (HP)",
    "Billing Expense (FL)",
    "Billing Expense (HP)",
    "Brokerage Income",
    "Brokerage Income - Credit NO VAT",
    "Brokerage Income NO VAT",
    "Collection & Delivery (Not Budgeted) Charge",
    "Collection & Delivery (Not Budgeted) Recharge",
    "Collection and Delivery Rental Charge",
    "Collection and Delivery Rental Recharge",
    "Contract Hire Income - Credit V2",
    "Contract Hire Income - V2",
    "Deposit - HP",
    "Document Fee",
    "Document Fee (No VAT)",
    "Documentation Fee",
    "Documentation Fee (Expense)",
    "End of Life Charge",
    "End of life Recharge ",
    "Excess Mileage Cost Charge",
    "Excess Mileage Cost Recharge",
    "Funder Deposit (FL)",
    "Funder Deposit (HP)",
    "Insufficient Funds to meet a Direct Debit",
    "Late Payment Interest",
    "Maintenance Cost Budget - Overhead",
    "Option to Purchase",
    "Overdue Payment",
    "Penalty Charge Admin Fee Charge",
    "Penalty Charge Admin Fee Recharge",
    "Penalty Charge Notice Cost Charge",
    "Penalty Charge Notice Cost Recharge",
    "Refurb Cost Charge",
    "Refurb Cost Recharge",
    "Rent Receivable",
    "Rent Receivable - Credit",
    "Rental Income",
    "Rental Income - Credit",
    "Rental_Lease_Mid-Period_Payoff",
    "Repossession Charges",
    "Utilities",
    "VOR Recharge",
    "Waiver",
]
PENALTY_RECHARGES = ["Penalty Charge Notice Cost Recharge", "Penalty Charge Admin Fee Recharge"]
PENALTY_CHARGE = "Penalty Charge Notice Cost Charge"


@view
def charge_history(w):
    """Budgets, recharges and expenses of both systems as one tagged list, each row once."""
    columns = "id", "asset_id", "contract_id", "amount", "invoice_date", "fee_name", "description", "account_name", "source_system", "category"
    none = F.lit(None).cast("string")

    def of(table, tag, **extra):
        return w(table).withColumns(extra).select(*columns, F.lit(tag).alias("type"))

    budgets = of("flat_budgets", "budgets", description=none, account_name=F.col("customer_name"))
    recharges = of("flat_recharges", "recharges", account_name=F.col("customer_name"))
    expenses = of("flat_expenses", "expenses", description=none, contract_id=none)
    return budgets.unionByName(recharges).unionByName(expenses).distinct()


def _history_assets(w):
    return w("flat_assets").select(
        F.col("id").alias("asset_id"), "registration_number", F.col("status").alias("asset_status"), "vehicle_category", "asset_sub_type", "equipment_id", "parent_asset_id"
    )


def spend_with_history(w):
    """Fleet spend of both systems; a missing fee name fails the exclusion, as NOT IN does."""
    rows = charge_history(w).filter(~F.col("fee_name").isin(*NO_FLEET_SPEND)).join(_history_assets(w), "asset_id", "left")
    return as_amounts(
        rows.select("id", "asset_id", "amount", "invoice_date", "fee_name", "account_name", "type", "source_system", "registration_number", "vehicle_category"), "amount"
    )


def maintenance_provision(w):
    """Maintenance charges with the day they are reported on; end-of-life work and other fees left out."""
    one_off = w.active("dim_sundry").select("bk_sundry_id", "created_time")
    fee = F.trim("fee_name")  # trailing blanks never tell two fees apart, so the list is read without them too
    rows = charge_history(w).filter(
        (F.col("fee_name").isNull() | ~fee.isin(*[n.rstrip() for n in NO_MAINTENANCE]))
        & (F.col("description").isNull() | ~F.lower("description").like("%eol%"))
        & F.col("asset_id").isNotNull()
    )
    joined = text_key_join(rows, one_off, "id", "bk_sundry_id", "left")
    return as_amounts(
        joined.select(
            "id", "asset_id", "amount", "invoice_date", "fee_name", "type", "category", "created_time",
            F.when(F.col("category") == "Sundry", F.to_date("created_time")).otherwise(F.col("invoice_date")).alias("report_date"),
        ),
        "amount",
    )


def tyre_spend(w):
    """Tyre charges with asset and contract."""
    contract = w("flat_contracts").select(F.col("id").alias("contract_id"), "sequence_number", "commencement_date", "maturity_date", F.col("status").alias("contract_status"))
    rows = charge_history(w).filter(F.lower("fee_name").like("%tyre%")).join(_history_assets(w), "asset_id", "left").join(contract, "contract_id", "left")
    return as_amounts(
        rows.select("id", "asset_id", "amount", "invoice_date", "fee_name", "type", "registration_number", "equipment_id", "parent_asset_id", "sequence_number", "commencement_date", "contract_status"), "amount"
    )


def penalty_charges(w):
    rows = charge_history(w).filter(
        ((F.col("type") == "recharges") & F.col("fee_name").isin(*PENALTY_RECHARGES)) | ((F.col("type") == "expenses") & (F.col("fee_name") == PENALTY_CHARGE))
    )
    return as_amounts(rows.select("id", "asset_id", "amount", "invoice_date", "fee_name", "type", "source_system"), "amount")


def fleet_overheads(w):
    contract = w("flat_contracts").select(F.col("id").alias("contract_id"), "sequence_number", F.col("customer_name").alias("customer"))
    asset = w("flat_assets").select(F.col("id").alias("asset_id"), "equipment_id", "registration_number")
    rows = w("flat_budgets").filter(F.col("fee_name").like("%Overhead%")).join(contract, "contract_id").join(asset, "asset_id")
    return as_amounts(rows.select("id", "equipment_id", "registration_number", "customer", "sequence_number", "fee_name", "amount", "invoice_date", "source_system"), "amount")


def _documents(w, documents, key, contract_key):
    """Documents with the contracts of their key and those contracts' assets, each row once.

    Every column of both sides is in the result, so rows are told apart before documents and contracts meet: their pairs are
    many times the contracts, and are neither shuffled nor sorted again. What a join has put together by the asset or the
    contract needs no shuffle to be told apart.
    """
    contract = w("flat_contracts").select(
        F.col(contract_key).alias("_key"), F.col("id").alias("contract_id"), "sequence_number", "customer_name", F.col("status").alias("contract_status"), "product", "commencement_date"
    )
    link = w("flat_equipment").select("contract_id", "asset_id", "terminated_on", "contract_mileage")
    asset = w("flat_assets").select(F.col("id").alias("asset_id"), "registration_number")
    held = contract.join(link.join(asset, "asset_id").distinct(), "contract_id").distinct()
    documents = documents.distinct()
    return documents.join(held, documents[key] == F.col("_key")).drop("_key")


def application_documents(w):
    """Documents of an application by contract and asset."""
    return _documents(w, w("flat_application_documents"), "application_name", "application_name")


def lease_documents(w):
    return _documents(w, w("flat_lease_documents"), "lease_name", "schedule_number")


# Product families by name prefix, and business lines under their report name.
FAMILIES = ["Contract Hire", "Finance Lease", "Hire Purchase", "Operating Lease", "Rental"]
LINES = {"Bus and Coach": "Bus & Coach", "Contract Hire Leasing and Rental": "Contract Hire Lease Rental"}


def retention_and_growth(w):
    """First start, last end and assets per customer, business line and product.

    A contract belongs to the customer with its account number or its organization. Each distinct
    pair of the two is resolved once, with two hash joins.
    """
    line, product = F.col("line_of_business"), F.col("product")
    contract = w("flat_contracts").filter(~F.col("status").isin("Inactive", "Pending", "PARTIAL APPLICATION")).select(
        F.col("id").alias("contract_id"), "source_system", "bdm", "customer_name", "account_number", F.col("organization_id").alias("org"), "commencement_date",
        first_match(*[(line == a, F.lit(b)) for a, b in LINES.items()], otherwise=line).alias("line_of_business"),
        first_match(*[(product.like(f"{f}%"), F.lit(f)) for f in FAMILIES], otherwise=product).alias("product"),
    )
    asset = w("flat_assets").filter(F.col("vehicle_category") != "Ancillary").select(F.col("id").alias("asset_id"), "equipment_id")
    link = w("flat_equipment").select("contract_id", "asset_id", "terminated_on")
    open_legacy = (F.col("source_system") == w.settings.old_system) & F.col("terminated_on").isNull()
    rows = contract.join(link, "contract_id").join(asset, "asset_id").withColumn(
        "ended", F.coalesce(F.when(open_legacy, F.lit(w.settings.migration_day)).otherwise(F.col("terminated_on")), F.lit(NOT_TERMINATED))
    )
    pairs = contract.select("account_number", "org").distinct()
    customer = w.current("dim_customer").select("external_reference_id", "organization_id", "party_name")
    named = either_key_join(
        pairs, customer, F.col("account_number") == F.col("external_reference_id"), F.col("org") == F.col("organization_id")
    ).select("account_number", "org", "party_name").distinct()
    # Contracts are summed per pair first; a pair may stand for several customers.
    per_pair = rows.groupBy("account_number", "org", "customer_name", "line_of_business", "bdm", "product", "equipment_id").agg(
        F.min("commencement_date").alias("first_start"), F.max("ended").alias("last_end")
    )
    named = named.withColumnsRenamed({"account_number": "_account", "org": "_org"})  # either key may be null
    same = F.col("account_number").eqNullSafe(F.col("_account")) & F.col("org").eqNullSafe(F.col("_org"))
    wide = per_pair.join(named, same, "left").withColumn("customer", F.coalesce("party_name", "customer_name"))
    return wide.groupBy("customer", "line_of_business", "bdm", "product").agg(
        F.min("first_start").alias("first_start"), F.max("last_end").alias("last_end"), F.countDistinct("equipment_id").alias("assets")
    )


def fleet_spend(w):
    """Recurring charges due and one-off charges with their asset."""
    sheet = asset_sheet(w).select("asset_id", "registration_number", "product_name", "asset_status")
    code = lookup(w, "dim_receivable_code", "bk_receivable_code_id", "receivable_code_id", recurring_name="name")
    customer = current_customers(w).select("customer_id", F.col("company_name").alias("company"))
    head = (
        w.current("dim_sundry_recurring")
        .join(code, "receivable_code_id")
        .join(customer, "customer_id")
        .join(current_contracts(w).select("contract_id"), "contract_id", "left_semi")
        .select(F.col("bk_sundry_recurring_id").alias("sundry_recurring_id"), "sundry_type", "recurring_name", "company")
    )
    due = w.current("dim_recurring_schedule").filter(F.col("due_date") <= F.lit(w.as_of)).select("sundry_recurring_id", "due_date").distinct()
    detail = w.current("dim_recurring_detail").select("sundry_recurring_id", "asset_id", "amount").distinct()
    recurring = detail.join(head, "sundry_recurring_id").join(due, "sundry_recurring_id").join(sheet, "asset_id").select(
        "registration_number", "product_name", "asset_status", F.col("sundry_recurring_id").alias("id"), F.col("sundry_type").alias("type"), "amount", "recurring_name",
        F.lit(None).cast("string").alias("recharge_fee_name"), F.col("due_date").alias("schedule_due_date"), F.lit(None).cast("date").alias("receivable_due_date"), "company",
    )
    one_off = sundry_details(w).join(sheet, "asset_id", "left").select(
        "registration_number", "product_name", "asset_status", F.col("bk_sundry_id").alias("id"), F.col("sundry_type").alias("type"), "amount", F.lit(None).cast("string").alias("recurring_name"),
        "recharge_fee_name", F.lit(None).cast("date").alias("schedule_due_date"), "receivable_due_date", F.col("company_name").alias("company"),
    )
    return as_amounts(recurring.distinct().unionByName(one_off), "amount")


@view
def leases_of_assets(w):
    """Every lease of an asset with contract terms, numbered from the latest start.

    Leases are numbered on their keys alone; terms are joined to the numbered rows.
    """
    started = finance_records(w).filter(F.col("customer_is_current") == 1).select("contract_id", "lease_finance_id", "sk_date_commencement_date")
    keys = materialise(latest_fact_of_asset(w).join(started, ["contract_id", "lease_finance_id"]), "leases")  # counted, then numbered
    numbered = ordered_columns(
        keys, ["asset_id"], ["sk_date_commencement_date", "contract_id"], reverse_ordinal="current_lease"
    )
    terms = finance_records(w).select(
        "contract_id", "company_name", "contract_number", "sequence_number", "status", "sk_date_maturity_date", "customer_term_in_months", "payment_frequency"
    )
    rows = with_day(w, split_join(numbered, terms, ["contract_id"]), "sk_date_maturity_date", "maturity_date")
    return with_day(w, rows, "sk_date_commencement_date", "commencement_date")


def _located(w, rows):
    place = w.current("dim_asset_location").filter(F.col("is_current") == 1).select("asset_id", "location_id")
    return rows.join(place, "asset_id", "left").join(lookup(w, "dim_location", "bk_location_id", "location_id", city="city", depot_code="depot_code"), "location_id", "left")


def _registered(w, rows):
    return rows.join(registrations(w).filter(F.col("is_active") == 1).select("asset_id", "registration_number"), "asset_id", "left")


def fleet_with_leases(w):
    """Current asset sheet with every lease of the asset."""
    body = w.active("dim_body_type_config").select(F.col("bk_body_type_config_id").alias("body_type_config_id"), F.col("body_type_code").alias("body_type"))
    builder = lookup(w, "dim_body_builder_config", "bk_body_builder_config_id", "body_builder_config_id", body_builder="name")
    assets = asset_details(w).join(body, "body_type_config_id", "left").join(builder, "body_builder_config_id", "left").join(config(w, "asset_sub_type_id", "asset_sub_type"), "asset_sub_type_id", "left")
    assets = _registered(w, _located(w, assets)).join(serials(w), "asset_id", "left")
    flag = in_application_once(w).select("asset_id", F.lit(1).alias("applied"))
    lease = leases_of_assets(w).select(
        "asset_id", "contract_id", "sequence_number", F.col("status").alias("contract_status"), "commencement_date", "maturity_date", "terminated_on", "current_lease", "rent_amount"
    )
    rows = attach_many(assets.join(flag, "asset_id", "left"), lease, ["asset_id"])
    return as_amounts(
        rows.select(
            "asset_id", "registration_number", "alias", "product_name", "gvw", "body_type", "body_builder", "serial_number", "asset_status", "asset_sub_type", "city", "contract_id", "sequence_number",
            "contract_status", "commencement_date", "maturity_date", "terminated_on", "current_lease", F.coalesce("applied", F.lit(0)).alias("in_application"), "rent_amount",
        ),
        "rent_amount",
    )


def fleet_in_application(w):
    """Assets in application with registration and status."""
    status = lookup(w, "dim_asset_status", "sk_asset_status", "sk_asset_status", asset_status="asset_status")
    assets = current_assets(w).select("asset_id", "sk_asset", "fleet_number").join(w("fact_asset_status").select("sk_asset", "sk_asset_status"), "sk_asset", "left").join(status, "sk_asset_status", "left")
    return split_join(in_application(w), _registered(w, assets), ["asset_id"]).select(
        "asset_id", "registration_number", "fleet_number", "asset_status", "stage", "opp_number", "credit_number", "company", "product"
    )


def fleet_in_inventory(w):
    """Inventory with the last contract of each asset and its application."""
    contract = w.current("dim_contract").filter(~F.col("status").isin("Inactive", "Pending", "Installing Assets")).select(
        "sk_contract", F.col("bk_contract_id").alias("contract_id"), "sequence_number", F.col("status").alias("contract_status")
    )
    customer = w("dim_customer").select("sk_customer", F.col("company_name").alias("last_customer"))
    asset = w("dim_asset").select("sk_asset", F.col("bk_asset_id").alias("asset_id"))
    leases = w("fact_lease_asset").join(contract, "sk_contract").join(customer, "sk_customer").join(asset, "sk_asset").join(
        w.current("dim_branch").select("sk_branch"), "sk_branch", "left_semi"
    )
    order = F.col("contract_id").desc(), F.col("sk_date_record").desc(), F.col("sk_time_record").desc(), F.col("sk_lease_asset").desc()
    last = with_day(w, versions.first_per_key(leases, ["asset_id"], *order), "sk_date_termination_date", "termination_date").select(
        "asset_id", "sequence_number", "contract_status", "last_customer", "termination_date"
    )
    rows = asset_details(w).filter(F.col("asset_status") == "Inventory").join(config(w, "asset_sub_type_id", "asset_sub_type"), "asset_sub_type_id", "left")
    app = in_application(w).select("asset_id", "stage", "opp_number", "credit_number", "company")
    base = _registered(w, _located(w, rows)).join(last, "asset_id", "left")
    return attach_many(base, app, ["asset_id"]).select(
        "asset_id", "registration_number", "fleet_number", "asset_contract_type", "asset_sub_type", "city", "sequence_number", "contract_status", "last_customer", "termination_date",
        "stage", "opp_number", "credit_number", "company",
    ).distinct()


def service_schedule(w):
    """Assets with their latest contract; assets whose contract follows an earlier schedule are left out."""
    sheet = asset_sheet(w).filter(F.col("asset_status").isin("Leased", "Inventory")).select("asset_id", "alias", "asset_status", "service_intervals_vehicle")
    heads = contract_sheet(w).select(
        "contract_id", "status", "sequence_number", "commencement_date", "party_name", "product_name", "cost_center", "payment_frequency", "customer_term_in_months", "line_of_business", "sales_rep",
        "previous_schedule_number",
    )
    started = w("dim_contract").filter(F.col("status") == "Commenced")
    day = F.when(F.col("start_date") == F.lit(UNKNOWN_START), F.col("dp_process_datetime")).otherwise(F.col("start_date"))
    origin = versions.first_per_key(started, ["bk_contract_id"], F.col("dp_process_datetime"), F.col("sk_contract")).select(
        F.col("bk_contract_id").alias("contract_id"), day.alias("origination_date")
    )
    lease = latest_approved_leases(w).select("asset_id", "contract_id")
    rows = split_join(sheet.join(lease, "asset_id", "left"), heads.join(origin, "contract_id", "left"), ["contract_id"], "left")
    return rows.filter(F.col("previous_schedule_number").isNull()).drop("previous_schedule_number").distinct()


def fleet_with_history(w):
    """Contracts and assets of both systems; ids are text there and numbers here."""
    contract = w("flat_contracts").filter(~F.col("status").isin("Inactive", "Pending", "InstallingAssets")).select(
        F.col("id").alias("contract_key"), "sequence_number", "customer_name", F.col("status").alias("contract_status"), "product", "commencement_date"
    )
    link = w("flat_equipment").select(F.col("contract_id").alias("contract_key"), F.col("asset_id").alias("asset_key"), "terminated_on", "contract_mileage", F.col("status").alias("equipment_status"))
    asset = w("flat_assets").select(F.col("id").alias("asset_key"), "registration_number", "source_system", "vehicle_category")
    own = current_assets(w).select("asset_id", "fleet_number", "service_intervals_vehicle")
    novated = contract_events(w).filter(F.col("event") == "novated").select("contract_id", F.col("event_day").alias("novated_on"))
    flag = in_application_once(w).select("asset_id", F.lit(1).alias("applied"))
    rows = contract.join(link, "contract_key").join(asset, "asset_key")
    rows = text_key_join(rows, own.join(flag, "asset_id", "left"), "asset_key", "asset_id", "left")
    rows = text_key_join(rows, novated, "contract_key", "contract_id", "left")
    return rows.select(
        "contract_key", "asset_key", "sequence_number", "customer_name", "contract_status", "product", "commencement_date", "terminated_on", "contract_mileage", "equipment_status", "registration_number", "source_system",
        "fleet_number", F.coalesce("applied", F.lit(0)).alias("in_application"), "novated_on",
    ).distinct()


def provision_assets(w):
    """Assets to keep across both systems with their parent and the day they were sold."""
    system = w.settings.new_system
    assets = keep_or_remove(w("flat_assets"), ["equipment_id"], "source_system", system).filter(F.col("verdict") == "keep")
    parent = w("flat_assets").select(F.col("id").alias("parent_asset_id"), F.col("equipment_id").alias("parent_equipment_id"))
    rows = assets.join(parent, "parent_asset_id", "left").withColumn("combined_equipment_id", F.coalesce("parent_equipment_id", "equipment_id"))
    latest = w("flat_assets").filter(F.col("source_system") == system).select(
        F.col("equipment_id").alias("combined_equipment_id"), F.col("id").alias("latest_asset_id"), F.col("status").alias("latest_status")
    )
    status = lookup(w, "dim_asset_status", "sk_asset_status", "sk_asset_status", asset_status="asset_status").filter(F.col("asset_status") == "Sold")
    sold = w("fact_asset_status").join(status, "sk_asset_status", "left_semi").join(w("dim_asset").select("sk_asset", "bk_asset_id"), "sk_asset")
    sold = with_day(w, sold, "sk_date_record", "day").groupBy("bk_asset_id").agg(F.min("day").alias("sold_date"))
    joined = text_key_join(rows.join(latest, "combined_equipment_id", "left"), sold, "latest_asset_id", "bk_asset_id", "left")
    return joined.select(
        "id", "alias", "source_system", "equipment_id", F.col("verdict").alias("keep_or_remove"), "parent_equipment_id", "combined_equipment_id", "latest_asset_id", "latest_status", "sold_date"
    )


def test_tracker(w):
    """Roadworthiness tests due per asset with contract and application stage, each row once.

    Every column of both sides is in the result, so rows are told apart before assets and leases meet: the pairs are many times
    the assets, and are not shuffled again.
    """
    contract = w.current("dim_contract").filter(F.col("status") == "Commenced").select("sk_contract", "sequence_number", "deal_product_type_id").join(products(w), "deal_product_type_id", "left")
    finance = w("dim_lease_finance").filter(F.col("is_current") == 1).select("sk_lease_finance")
    customer = w("dim_customer").select("sk_customer", F.col("company_name").alias("company_name"))
    asset = w("dim_asset").select("sk_asset", F.col("bk_asset_id").alias("asset_id"))
    held = w("fact_lease_asset").join(finance, "sk_lease_finance", "left_semi").join(contract, "sk_contract").join(customer, "sk_customer").join(asset, "sk_asset")
    held = held.select("asset_id", "sequence_number", "company_name", F.col("product_name").alias("deal_type")).distinct()
    app = in_application_once(w).select("asset_id", "stage", "app_company", "structure_company", "line_company", "structure_product", "line_product")
    rows = asset_details(w).join(config(w, "mot_booking_status_id", "booking_status"), "mot_booking_status_id", "left")
    stage = F.col("stage")
    company = first_match((stage == "app", F.col("app_company")), (stage == "app structure", F.col("structure_company")), (stage == "line of credit", F.col("line_company")))
    product = first_match((stage == "app structure", F.col("structure_product")), (stage == "line of credit", F.col("line_product")))
    base = _registered(w, _located(w, rows)).join(app, "asset_id", "left").select(
        "asset_id", "registration_number", "mot_expiry_date", "mot_passed_date", "booking_status", "asset_status", "city", "stage",
        company.alias("company_in_application"), product.alias("product_in_application"),
    )
    return attach_many(base.distinct(), held, ["asset_id"]).select(
        "asset_id", "registration_number", "mot_expiry_date", "mot_passed_date", "booking_status", "asset_status", "city", "sequence_number", "company_name", "deal_type", "stage",
        "company_in_application", "product_in_application",
    )


def originations(w):
    """Origination amount and day by the rules of each system, one row per sequence number.

    Leased assets count for contracts of the new system only, so those of other contracts are left where they are.
    """
    new, old = w.settings.new_system, w.settings.old_system
    rows = w("flat_contracts").filter(
        ~F.col("status").isin("Inactive", "Pending", "InstallingAssets")
        & ~F.coalesce("schedule_number", F.lit("")).like("8%")
        & ~F.coalesce("sequence_number", F.lit("")).like("%novated%")
    )
    first = versions.first_per_key(rows, ["sequence_number"], F.col("created_date"), F.col("id"))
    key_type = w("dim_contract").schema["bk_contract_id"].dataType
    chosen = rows.filter(F.col("source_system") == new).select(F.col("id").try_cast(key_type).alias("contract_id"))
    totals = leased_now(w, inactive=False, chosen=chosen).groupBy("contract_id").agg(F.sum("nbv_amount").alias("total_nbv"))
    started = contract_events(w).filter(F.col("event") == "commenced").select("contract_id", "event_day")
    own = totals.join(started, "contract_id", "full")
    asset = w("flat_assets").filter(
        (F.coalesce("vehicle_category", F.lit("")) != "Ancillary") & (F.coalesce("asset_sub_type", F.lit("")) != "Fleet Managed Asset")
    ).select(F.col("id").alias("asset_id"))
    counts = w("flat_equipment").join(asset, "asset_id").groupBy(F.col("contract_id").alias("id")).agg(F.count("asset_id").alias("number_of_assets"))
    key = w("flat_equipment").filter(F.col("customer_id").isin(*w.settings.key_account_ids)).select(
        F.col("contract_id").alias("id"), F.lit(w.settings.key_account_label).alias("key_account")
    ).distinct()
    joined = text_key_join(first, own, "id", "contract_id", "left").join(counts, "id", "left").join(key, "id", "left")
    zero, system, product = F.lit(0), F.col("source_system"), F.col("product")
    legacy = F.when(product.like("%Hire Purchase%"), F.coalesce("financed_amount", zero) - F.coalesce("vat_on_asset", zero)).otherwise(F.col("financed_amount"))
    current = F.coalesce("total_nbv", zero) - F.coalesce("down_payment_amount", zero) - F.coalesce("tax_deferral_amount", zero)
    day = F.when(F.col("was_migrated") == 1, F.col("created_date")).otherwise(F.col("commencement_date"))
    families = ["Contract Hire", "Operating Lease", "Hire Purchase", "Rental", "Finance Lease"]
    return as_amounts(
        joined.select(
            "id", "sequence_number", "source_system", F.when(system == old, legacy).when(system == new, current).alias("origination_amount"),
            F.when(system == old, F.to_date(day)).when(system == new, F.to_date("event_day")).alias("origination_day"),
            first_match(*[(product.like(f"%{f}%"), F.lit(f)) for f in families], otherwise=product).alias("product_name"), "number_of_assets",
            F.coalesce("key_account", "line_of_business").alias("line_of_business"),
        ),
        "origination_amount",
    )


def rental_utilisation(w):
    """Rental fleet with utilisation, latest lease, charges and closing value."""
    sheet = asset_sheet(w).filter(F.col("asset_status").isin("Leased", "Inventory") & (F.col("asset_contract_type") == "Rental")).select(
        "asset_id", "registration_number", "asset_status", "asset_sub_type", "depreciation_value", "rv_maturity_date"
    )
    heads = contract_sheet(w).select("contract_id", "sequence_number", F.col("status").alias("booking_status"), "commencement_date", "maturity_date", "party_name", "product_name", "payment_method", "sales_rep")
    # All but the contract is read for these assets alone.
    own = of_assets(w, sheet)
    app = in_application_once(own).select("asset_id", F.col("stage").alias("application_stage"), "opp_number")
    charges = charges_by_asset(own).select("contract_id", "asset_id", "charges")
    value = asset_value(own).select("asset_id", F.col("last_book_value").alias("equipment_nbv"))
    rows = sheet.join(latest_leases(own), "asset_id", "left").join(app, "asset_id", "left").join(value, "asset_id", "left")
    rows = split_join(rows, heads, ["contract_id"], "left").join(charges, ["contract_id", "asset_id"], "left")
    charge = F.coalesce("charges", F.lit(0)) + F.coalesce("rent_amount", F.lit(0))
    status = F.col("asset_status")
    used = first_match(
        ((status == "Leased") & is_free(charge), F.lit("Yes (FoC)")),
        (status == "Leased", F.lit("Yes")),
        (F.col("application_stage").isNotNull(), F.lit("In Application")),
        otherwise=F.lit("No"),
    )
    return as_amounts(
        rows.select(
            "asset_id", used.alias("utilised"), "registration_number", "asset_status", "terminated_on", "branch_name", "sequence_number", "booking_status", "commencement_date", "product_name", "sales_rep",
            "opp_number", "application_stage", charge.alias("total_charge"), "equipment_nbv",
        ),
        "total_charge", "equipment_nbv",
    )


def tyre_contracts(w):
    """Live contracts with the axle set-up of their assets; one list of values under five roles."""
    heads = finance_latest(w).filter((F.col("status") == "Commenced") & (F.col("customer_is_current") == 1)).join(
        lookup(w, "dim_business_type", "bk_business_type_id", "business_type_id", account_legal_entity="name"), "business_type_id", "left"
    ).select("contract_id", "sequence_number", "commencement_date", "maturity_date", "party_name", "account_legal_entity", "payment_frequency", "product_name")
    roles = {"axle_config_id": "axle_config", "steer_axle_id": "steer_axle", "drive_axle_id": "drive_axle", "lift_axle_id": "lift_axle", "axles_id": "axles"}
    details = w.current("dim_additional_details").select(F.col("bk_additional_details_id").alias("asset_id"), "tyre_configuration", *roles)
    for key, out in roles.items():
        details = details.join(config(w, key, out), key, "left")
    axle = lookup(w, "dim_vehicle_detail", "bk_vehicle_detail_id", "asset_id", axle_index="axle_index")
    assets = leased_assets_open(w).select("contract_id", "asset_id", "sk_lease_asset", "sk_time_record", "registration_number", "asset_status", "model_year", "tyres_fair_wear_tear")
    rows = split_join(assets, _located(w, details.join(axle, "asset_id", "left")), ["asset_id"], "left")
    return split_join(rows, heads, ["contract_id"]).select(
        "contract_id", "asset_id", "sk_lease_asset", "sk_time_record", "sequence_number", "party_name", "account_legal_entity", "commencement_date", "product_name", "registration_number", "asset_status", "model_year", "tyres_fair_wear_tear",
        "tyre_configuration", "axle_index", *roles.values(), "depot_code", "city",
    )
