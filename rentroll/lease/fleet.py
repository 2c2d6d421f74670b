"""Fleet reports over the asset sheet, leased assets and contracts."""

from pyspark.sql import functions as F

from rentroll.functions.dates import days_between, plus_years, real_date_key, uk_date
from rentroll.functions.nulls import default_to
from rentroll.functions.text import concat_strict, varchar
from rentroll.lease.assets import asset_features, asset_sheet
from rentroll.lease.contracts import (
    assets_in_application_latest,
    charges_detail,
    charges_detail_of,
    contracts_with,
    credit_applications,
    lease_assets_all,
    lease_assets_live,
    lease_assets_live_of,
    rental_fleet,
    rentals_of,
)
from rentroll.lease.parts import as_amounts, current_contracts
from rentroll.lease.receivables import customers
from rentroll.lease.warehouse import of_assets
from rentroll.operators.ageing import days_ladder, days_to_go
from rentroll.operators.hot import attach_many, split_join


def dash(column):
    return F.coalesce(column, F.lit("-"))


def zero(column):
    return default_to(F.col(column), 0, "decimal(18,4)").cast("double").alias(column)


def all_asset(w):
    """Unsold assets with defaults for what is missing."""
    return asset_sheet(w).filter(F.col("asset_status") != "Sold").select(
        "asset_id",
        "registration_number",
        dash("serial_number").alias("serial_number"),
        F.lit("-").alias("collateral_category"),
        "asset_status",
        "asset_contract_type",
        zero("residual_value_amount"),
        zero("book_value_amount"),
        zero("equipment_nbv"),
        zero("depreciation_value"),
        F.lit(0).alias("fair_value_adjustment"),
    )


def _delivery_list(w, statuses):
    dates = "acquisition_date", "delivered_on", "planned_delivery", "reserve_date", "rv_maturity_date", "available_from"
    rows = asset_sheet(w).filter(
        F.col("asset_status").isin(*statuses)
        & (F.col("asset_type") != "Ancillary")
        & (F.col("asset_contract_type") != "BackedOffAsset")
        & (F.col("current_flag") == 1)
    )
    return rows.select(
        "asset_id",
        "registration_number",
        dash("serial_number").alias("chassis_number"),
        "project_number",
        F.col("gvw").cast("int").alias("gvw"),
        "allocated_status",
        "asset_status",
        *[uk_date(F.col(d)).alias(d) for d in dates],
    )


def available_assets(w):
    """Assets in stock or awaiting delivery, days as dd/mm/yyyy."""
    return _delivery_list(w, ["Inventory", "AwaitingDelivery"])


def awaiting_delivery(w):
    return _delivery_list(w, ["AwaitingDelivery"])


def stock_assets(w):
    return asset_sheet(w).filter(F.col("asset_contract_type") == "Stock").select(
        "asset_id",
        varchar(F.col("alias"), 8).alias("registration_number"),
        dash("asset_funding_status").alias("funding_status"),
        dash("asset_sub_type").alias("asset_sub_type"),
        zero("book_value_amount"),
        dash("serial_number").alias("chassis_number"),
    )


def rental_availability(w):
    """Commercial rental vehicles not on hire; the next test is due a year after the last one passed."""
    sheet = rental_fleet(w).filter(
        (F.col("category_name") == "Commercial Vehicles") & F.col("asset_status").isin("Inventory", "Leased")
    ).select("asset_id", "registration_number", "mot_passed_date", "asset_status")
    contract = contracts_with(w, "product").select("contract_id", "product_name", "status")
    free = rentals_of(w, sheet, contract).filter(F.col("utilised").isin("In Application", "No"))
    return free.select(
        "asset_id",
        "registration_number",
        plus_years(F.col("mot_passed_date"), 1).alias("mot_expiry_date"),
        F.when(F.col("application_stage").isNotNull(), 1).otherwise(0).alias("in_application"),
        "asset_status",
        "utilised",
    )


def assets_not_on_hire(w):
    rows = asset_sheet(w).filter(F.col("asset_status").isin("Inventory", "AwaitingDelivery"))
    return rows.select(
        "asset_sub_type", "rv_maturity_date", "asset_status", F.col("book_value_amount").cast("double").alias("book_value_amount"),
        zero("depreciation_value"), F.lit(0).alias("in_application"), "registration_number",
    ).distinct()


def asset_funding_analysis(w):
    """Lease and rental assets in stock, awaited or on hold."""
    rows = asset_sheet(w).filter(
        (F.col("current_flag") == 1)
        & (F.col("asset_type") != "Ancillary")
        & F.col("asset_status").isin("Inventory", "AwaitingDelivery", "OnHold")
        & F.col("asset_contract_type").isin("Lease", "Rental")
    )
    return rows.select(
        varchar(F.col("alias"), 8).alias("registration_number"), "asset_contract_type", "is_migrated", "asset_status",
        dash("asset_funding_status").alias("funding_status"), dash("serial_number").alias("chassis_number"),
        dash("allocated_status").alias("allocated_status"), dash("reserved_by").alias("reserved_by"),
    ).distinct()


def asset_nbv(w):
    return asset_sheet(w).select(
        "asset_id", "registration_number", "equipment_id", "acquisition_date", dash("serial_number").alias("serial_number"),
        zero("book_value_amount"), zero("equipment_nbv"), zero("residual_value_amount"), zero("depreciation_value"),
    ).distinct()


def sale_stock(w):
    """Stock with the days since termination; open-ended leases give a negative count."""
    lease = lease_assets_live(w).select("asset_id", "termination_date")
    rows = attach_many(asset_sheet(w), lease, ["asset_id"])
    return rows.select(
        "asset_id", "registration_number", F.col("equipment_nbv").cast("double").alias("stock_nbv"), "asset_status",
        F.col("gvw").cast("int").alias("gvw"), "termination_date",
        days_between(F.col("termination_date"), F.lit(w.as_of)).alias("days_standing"),
    )


def warehouse_assets(w):
    """Inventory with a flag for assets in a current application."""
    applied = assets_in_application_latest(w).select("asset_id", F.lit("TRUE").alias("in_application"))
    rows = asset_sheet(w).filter(F.col("asset_status") == "Inventory").join(applied, "asset_id", "left")
    return rows.select(
        "asset_id", "alias", F.col("gvw").cast("int").alias("gvw"), "asset_sub_type",
        F.coalesce("in_application", F.lit("FALSE")).alias("in_application"),
    )


def _leases(w, assets, *parts, chosen=None):
    """Leased assets with the asset sheet and the contract parts of a report; ``chosen`` as in ``contracts_with``."""
    sheet = asset_sheet(w).drop("current_flag").withColumnsRenamed({"product_name": "vehicle_category", "is_migrated": "asset_is_migrated"})
    contract = contracts_with(w, *parts, chosen=chosen).drop("sequence_number", "customer_id", "rent_amount", "asset_budget_value", "total_charge")
    return split_join(assets.join(sheet, "asset_id"), contract, ["contract_id"])


def terminated_assets(w):
    rows = _leases(w, lease_assets_all(w), "customer", "terms", "product", "branch", "cost_center", "sales_rep", "commencement")
    ended = rows.filter(real_date_key(F.col("sk_date_termination_date")))
    return as_amounts(
        ended.select(
            "contract_id", "asset_id", "sequence_number", "company_name", dash("serial_number").alias("serial_number"), "payment_frequency",
            "product_name", "branch_name", "commencement_date", "termination_date", "payment_method", "cost_center", "sales_rep",
            "rent_amount", "total_charge",
        ),
        "rent_amount", "total_charge",
    )


def contracts_created(w):
    """Live leased assets with the contract's creation day, else its first start."""
    rows = _leases(w, lease_assets_live(w), "customer", "start", "migrated", "terms", "product", "branch", "cost_center", "sales_rep", "creator", "maturity", "created")
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", "sequence_number", "company_name", "product_name", "status", dash("sales_rep").alias("sales_rep"),
            "contract_created_by", F.coalesce("created_date", "lease_start_date").alias("created_on"), "maturity_date", "is_migrated",
            "termination_date", "rent_amount",
        ),
        "rent_amount",
    )


def terminations_on_live_contracts(w):
    """Terminated assets whose contract is still live, ids with the house prefix."""
    ended = lease_assets_all(w).filter(
        real_date_key(F.col("sk_date_termination_date")) & (F.col("contract_status") != "Inactive")
    )
    rows = _leases(w, ended, "customer", "product", "terms", "maturity")
    money = F.lit(w.settings.currency)
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", concat_strict(F.lit(w.settings.contract_prefix), F.col("sequence_number")).alias("account_id"),
            "product_name", "company_name", "payment_method", "termination_date", "maturity_date", money.alias("rent_currency"),
            "rent_amount", "total_charge",
        ),
        "rent_amount", "total_charge",
    )


def _evergreen(w, kind):
    rows = _leases(w, lease_assets_live(w), "customer", "terms", "branch", "commencement", "maturity")
    past = rows.filter((F.col("asset_contract_type") == kind) & (F.col("is_over_term_lease") == 1))
    return past.select(
        "contract_id", "asset_id", "sequence_number", "company_name", "branch_name", uk_date(F.col("commencement_date")).alias("commencement_date"),
        uk_date(F.col("maturity_date")).alias("maturity_date"), uk_date(F.col("acquisition_date")).alias("acquisition_date"),
    )


def evergreen_leased(w):
    """Lease assets past their term."""
    return _evergreen(w, "Lease")


def evergreen_rental(w):
    return _evergreen(w, "Rental")


def _open_leases(w, *parts):
    """Leased assets on commenced contracts; leases and finance of others leave before they meet anything else."""
    chosen = current_contracts(w).filter(F.lower("status") == "commenced").select("contract_id")
    rows = _leases(w, lease_assets_live_of(w, chosen, few=False), "customer", "terms", "product", "commencement", "maturity", *parts, chosen=chosen)
    return rows.filter((F.col("asset_status") == "Leased") & (F.lower("status") == "commenced"))


def individual_customers(w):
    """Assets on hire to customers, stock and backed-off assets left out."""
    rows = _open_leases(w, "branch", "cost_center", "sales_rep").filter(~F.col("asset_contract_type").isin("Stock", "BackedOffAsset"))
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", "sequence_number", "company_name", "product_name", "commencement_date", "maturity_date",
            "branch_name", "cost_center", "sales_rep", "rent_amount", "equipment_nbv",
        ),
        "rent_amount", "equipment_nbv",
    )


def open_lease_customers(w):
    rows = _open_leases(w, "branch", "cost_center", "sales_rep")
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", "company_name", dash("serial_number").alias("serial_number"), "service_intervals_vehicle",
            "payment_method", "commencement_date", "maturity_date", "term", "total_charge",
        ),
        "total_charge",
    )


def open_lease_file(w):
    """Open leases with the customer's account manager and columns kept free."""
    manager = customers(w).select("customer_id", F.col("account_manager").alias("sales_person"))
    rows = _open_leases(w, "branch", "cost_center", "sales_rep").join(manager, "customer_id", "left")
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", "company_name", "sales_person", "rv_maturity_date", F.lit("xxx").alias("renewal_action"),
            F.lit("xxx").alias("opt_out"), dash("sales_rep").alias("sales_rep"), "maturity_date", "total_charge",
        ),
        "total_charge",
    )


def funding_migration(w):
    """Leased assets that were not migrated."""
    rows = _leases(w, lease_assets_live(w), "customer").filter(
        (F.col("asset_status") == "Leased") & ~F.col("asset_contract_type").isin("Stock", "BackedOffAsset") & (F.col("asset_is_migrated") == 0)
    )
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", "registration_number", dash("asset_funding_status").alias("funding_status"), "acquisition_date",
            F.col("company_name").alias("reserved_for"), zero("depreciation_value"), "equipment_nbv",
        ),
        "equipment_nbv",
    )


def contracts_not_activated(w):
    """Leased assets on contracts not yet active, one row per charge.

    Few contracts are on their way: leases, finance and charges of others leave before they meet anything else.
    """
    def waiting(status):
        return F.lower(status).isin("installingassets", "pending")

    chosen = current_contracts(w).filter(waiting(F.col("status"))).select("contract_id")
    charges = charges_detail_of(w, chosen).select("contract_id", "asset_id", "charge_name")
    applied = credit_applications(w).filter(F.col("opportunity_number").isNotNull()).select("opportunity_number", "approved_amount")
    rows = _leases(w, lease_assets_live_of(w, chosen), "customer", "terms", "product", "branch", "cost_center", "sales_rep", "maturity", chosen=chosen).filter(
        (F.col("asset_status") == "Leased") & waiting(F.col("status"))
    )
    rows = rows.join(applied, "opportunity_number", "left").join(charges, ["contract_id", "asset_id"], "left")
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", concat_strict(F.lit(w.settings.contract_prefix), F.col("sequence_number")).alias("account_id"), "status",
            "company_name", "product_name", "charge_name", "branch_name", "cost_center", "sales_rep", "maturity_date", "approved_amount",
        ),
        "approved_amount",
    )


def accruals_by_charge(w):
    """One row per leased asset and charge; leases of assets that are not in the report leave at the first join."""
    def reported(sheet):
        return sheet.filter((F.lower("asset_contract_type") != "stock") & F.lower("asset_status").isin("inventory", "leased"))

    own = of_assets(w, reported(asset_sheet(w)))
    charges = charges_detail(w).select("contract_id", "asset_id", "charge_name", "charges")
    rows = reported(
        _leases(w, lease_assets_live(own).withColumnRenamed("booked_residual_amount", "asset_residual"), "customer", "start", "terms", "product", "branch", "cost_center", "commencement", "maturity")
    )
    return rows.join(charges, ["contract_id", "asset_id"], "left").select(
        "contract_id", "asset_id", "sequence_number", "product_name", "company_name", "status",
        F.coalesce("lease_start_date", "commencement_date").alias("created_on"), "maturity_date",
        dash("charge_name").alias("charge_name"), zero("charges"), zero("rent_amount"), zero("asset_residual"), zero("nbv_amount"),
    )


def maturity_timeframes(w):
    """Leased assets by time left to maturity."""
    contract = contracts_with(w, "product", "terms", "sales_rep", "maturity", "commencement").select(
        "contract_id", "sequence_number", "product_name", "sales_rep", "maturity_date"
    )
    rows = split_join(lease_assets_live(w).select("contract_id", "asset_id", "total_charge"), contract, ["contract_id"], "left").join(asset_sheet(w).select("asset_id", "registration_number", "term"), "asset_id", "left")
    left = days_to_go(F.col("maturity_date"), w.as_of)
    return as_amounts(
        rows.select(
            "contract_id", "asset_id", "sequence_number", "registration_number", "product_name", "maturity_date", left.alias("days_left"),
            days_ladder(left).alias("timeframe"), "sales_rep", "total_charge",
        ),
        "total_charge",
    )


def origination_assets(w):
    return lease_assets_live(w).select("contract_id", "asset_id").join(
        asset_sheet(w).select("asset_id", "alias", "service_intervals_vehicle", "term"), "asset_id", "left"
    )


def sync_status(w):
    """Which assets the workshop system has taken over."""
    rows = asset_sheet(w).select("asset_id", "fleet_number").join(asset_features(w), "asset_id")
    return rows.select(
        "equipment_id", "fleet_number", F.col("registration_number").alias("vehicle_registration"),
        F.when(F.col("is_synced") == 1, "Success").otherwise("Error").alias("sent"), dash("sync_status").alias("last_status"),
    ).distinct()
