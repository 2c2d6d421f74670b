"""Procurement: order book over time, funding per asset, first contracts, supplying dealers."""

from pyspark.sql import functions as F

from rentroll.functions.dates import UNKNOWN_START, on_or_before
from rentroll.functions.nulls import first_match
from rentroll.lease.assets import asset_description, asset_sheet, credit_lines
from rentroll.lease.contracts import finance_latest, leased_now
from rentroll.lease.parts import as_amounts, config, current_assets, current_customers, lookup, registrations, serials, with_day
from rentroll.lease.warehouse import view
from rentroll.operators import timeline, versions
from rentroll.operators.hot import split_join
from rentroll.operators.joins import large
from rentroll.operators.status import funding_status

# Allocation texts that decide the kind of an order.
ALLOCATED = ("VOF Signed", "Yes", "TTS Allocation")
NOT_FIRM = ("Firm - No VOF", "Soft", "No")


def order_type(allocated, available, day):
    """Physical asset > order > incoming stock."""
    return first_match(
        (~F.coalesce(allocated, F.lit("")).isin(*ALLOCATED) & (available <= day), F.lit("Physical Assets")),
        (allocated.isNotNull() & ~allocated.isin(*NOT_FIRM), F.lit("Orders")),
        otherwise=F.lit("Incoming Stock"),
    )


@view
def procured(w):
    """Assets of the procurement program that belong to a project."""
    return asset_sheet(w).filter((F.col("procurement_program") == 1) & F.col("project_number").isNotNull())


@view
def order_versions(w):
    """Awaited versions of procured assets, each joined to the details of its status fact."""
    status = lookup(w, "dim_asset_status", "sk_asset_status", "sk_asset_status", asset_status="asset_status").filter(F.col("asset_status") == "AwaitingDelivery")
    details = w("dim_additional_details").select(
        "sk_additional_details", "allocated_status_id", "available_from", F.col("start_date").alias("details_start"), F.col("end_date").alias("details_end"), F.col("created_time").alias("details_created")
    )
    asset = w("dim_asset").withColumnRenamed("bk_asset_id", "asset_id").join(large(procured(w).select("asset_id")), "asset_id", "left_semi")
    rows = (
        w("fact_asset_status").select("sk_asset", "sk_asset_status", "sk_additional_details")
        .join(status, "sk_asset_status", "left_semi")
        .join(large(asset), "sk_asset")
        .join(large(details), "sk_additional_details")
        .join(config(w, "allocated_status_id", "allocated_status"), "allocated_status_id", "left")
    )
    unset = F.lit(UNKNOWN_START)
    asset_start = F.when(F.col("start_date") == unset, F.coalesce("created_time", "updated_time")).otherwise(F.col("start_date"))
    details_start = F.when(F.col("details_start") == unset, F.col("details_created")).otherwise(F.col("details_start"))
    return rows.select(
        "asset_id", "sk_asset", "product_name", "book_value_amount", "equipment_id", F.col("start_date").alias("recorded_from"), "available_from",
        F.struct("allocated_status", "asset_funding_status").alias("state"),
        F.greatest(asset_start, details_start).alias("changed_on"), F.least("end_date", "details_end").alias("ended_on"),
    )


@view
def orders_over_time(w):
    """Order status at every Friday, rebuilt from the change points of the versions."""
    spans = timeline.state_intervals(
        order_versions(w), ["asset_id"], ["changed_on", "sk_asset"], "state", "changed_on", "ended_on",
        last={"last_available": "available_from", "vehicle_category": "product_name"},
        unset=lambda s: s["allocated_status"].isNull() & s["asset_funding_status"].isNull(),
    )
    weeks = timeline.friday_snapshots(spans, F.col("valid_from"), F.col("valid_to"), w.as_of)
    allocated = F.col("state.allocated_status")
    return weeks.select(
        "asset_id", "snapshot", "vehicle_category", allocated.alias("allocated_status"), F.col("state.asset_funding_status").alias("funding_status"),
        order_type(allocated, F.col("last_available"), F.col("snapshot")).alias("order_type"), "valid_from", "valid_to", "last_available",
    )


@view
def funded(w):
    """What has been invoiced for each asset, less tax, per invoice row."""
    zero = F.lit(0)
    paid = F.coalesce("acquisition_cost_amount", zero) + F.coalesce("other_cost_amount", zero) - F.coalesce("vat_amount", zero)
    rows = w("fact_payable_invoice_asset").join(large(current_assets(w).select("asset_id", "sk_asset")), "sk_asset").withColumn("funded", paid)
    return with_day(w, rows, "sk_date_record", "invoice_date").select("asset_id", "invoice_date", "funded")


@view
def migrated_assets(w):
    """Assets that were fully funded at their first snapshot and exist in both systems: their first book value."""
    first = versions.first_per_key(orders_over_time(w), ["asset_id"], F.col("snapshot"), F.col("valid_from"))
    full = first.filter(F.col("funding_status") == "FullyFunded").select("asset_id")
    own = w("flat_assets").filter(F.col("source_system") == w.settings.new_system).select("id", "equipment_id")
    old = w("flat_assets").filter(F.col("source_system") == w.settings.old_system).select("equipment_id")
    both = own.join(large(old), "equipment_id", "left_semi").select("id")
    value = versions.first_per_key(order_versions(w), ["asset_id"], F.col("recorded_from"), F.col("sk_asset")).select(
        "asset_id", F.col("book_value_amount").alias("migrated_amount")
    )
    named = full.withColumn("id", F.col("asset_id").cast("string")).join(large(both), "id", "left_semi").select("asset_id")
    return named.join(large(value), "asset_id")


def asset_funding(w):
    """Funded amount against adjusted book value per procured asset."""
    totals = funded(w).groupBy("asset_id").agg(F.sum("funded").alias("funded"), F.max("invoice_date").alias("last_invoice"))
    zero = F.lit(0)
    rows = (
        order_versions(w).select("asset_id").distinct()
        .join(large(asset_sheet(w).select("asset_id", "adjusted_book_value")), "asset_id")
        .join(large(totals), "asset_id", "left")
        .join(large(migrated_assets(w)), "asset_id", "left")
        .withColumn("total_funded", F.coalesce("funded", zero) + F.coalesce("migrated_amount", zero))
    )
    migrated_on = F.when(F.col("migrated_amount").isNotNull(), F.lit(w.settings.migration_day))
    return as_amounts(
        rows.select(
            "asset_id", "adjusted_book_value", F.coalesce("last_invoice", migrated_on).alias("last_invoice"), "total_funded",
            funding_status(F.col("total_funded"), F.col("adjusted_book_value")).alias("funding_status"),
        ),
        "adjusted_book_value", "total_funded",
    )


@view
def first_credit_line(w):
    """First credit line of each asset."""
    order = F.col("profile_created"), F.col("credit_number")
    return versions.first_per_key(credit_lines(w), ["asset_id"], *order).select(
        "asset_id", F.col("party_name").alias("line_customer"), F.col("profile_created").alias("line_created"), "expected_commencement_date", F.col("opp_number").alias("line_opp")
    )


def funding_over_time(w):
    """Funding at every snapshot: what was invoiced before it, the book value last set before it."""
    snapshots = orders_over_time(w).select("asset_id", "snapshot", "vehicle_category", "allocated_status", "funding_status", "order_type")
    adjusted = w.current("dim_asset_value_history").filter(
        (F.col("source_module") == "AssetValueAdjustment")
        & (F.col("is_lessor_owned") == 1)
        & (F.col("is_schedule") == 1)
        & (F.col("is_accounted") == 1)
        & F.col("gl_journal_id").isNotNull()
        & on_or_before(F.col("income_date"), w.as_of)
    )
    daily = adjusted.groupBy("asset_id", "income_date").agg(F.max_by("net_value_amount", "bk_asset_value_history_id").alias("net_value"))
    moves = funded(w).join(procured(w).select("asset_id"), "asset_id", "left_semi")
    at = timeline.balance_at(
        snapshots, moves, ["asset_id"], "snapshot", "invoice_date", "funded", "invoiced", facts=(daily, "income_date", {"adjusted_book_value": "net_value"})
    )
    rows = at.join(migrated_assets(w).join(first_credit_line(w), "asset_id", "full"), "asset_id", "left")
    known = F.col("line_created") <= F.col("snapshot")
    return as_amounts(
        rows.select(
            "asset_id", "snapshot", "vehicle_category", "allocated_status", "funding_status", "order_type",
            (F.col("invoiced") + F.coalesce("migrated_amount", F.lit(0))).alias("cumulative_funded"), "adjusted_book_value",
            F.when(known, F.col("line_customer")).alias("line_customer"), F.when(known, F.col("line_created")).alias("line_created"),
        ),
        "cumulative_funded", "adjusted_book_value",
    )


def first_contracts(w):
    """First contract of each procured asset that has been in the order book."""
    sheet = procured(w).select("asset_id", "alias", "description", "manufacturer_name", "model_name", "asset_contract_type", "equipment_id", F.floor(F.col("gvw") / 1000).alias("gvw_tonnes"))
    contract = finance_latest(w).filter(F.coalesce("status", F.lit("")) != "Inactive").select("contract_id", "sequence_number", "commencement_date")
    lease = leased_now(w).select("asset_id", "contract_id", "contract_status")
    rows = split_join(lease.join(sheet, "asset_id"), contract, ["contract_id"]).join(orders_over_time(w).select("asset_id"), "asset_id", "left_semi")
    first = versions.first_per_key(rows, ["asset_id"], F.col("commencement_date"), F.col("contract_id"))
    return (
        first.join(registrations(w).select("asset_id", "registration_number"), "asset_id", "left")
        .join(serials(w), "asset_id", "left")
        .join(asset_description(w), "asset_id", "left")
        .select("asset_id", "sequence_number", "commencement_date", "alias", "registration_number", "manufacturer_name", "model_name", "gvw_tonnes", "serial_number", "equipment_id", "asset_description")
    )


def order_book(w):
    """Awaited assets with the dealer of the dearest invoice and the first credit line."""
    vendor = w("dim_vendor").select(F.col("bk_vendor_id").alias("vendor_id"), F.col("company_name").alias("supplying_dealer"))
    invoice = w("fact_payable_invoice_asset").join(current_assets(w).select("asset_id", "sk_asset"), "sk_asset")
    dearest = versions.first_per_key(invoice, ["asset_id"], F.col("acquisition_cost_amount").desc(), F.col("sk_time_record").desc(), F.col("vendor_id").desc()).join(vendor, "vendor_id", "left")
    owner = current_assets(w).select("asset_id", "customer_id").join(current_customers(w).select("customer_id", F.col("party_name").alias("customer")), "customer_id", "left")
    rows = procured(w).filter((F.col("asset_status") == "AwaitingDelivery") & (F.col("current_flag") == 1))
    rows = (
        rows.join(dearest.select("asset_id", "supplying_dealer"), "asset_id", "left")
        .join(owner.select("asset_id", "customer"), "asset_id", "left")
        .join(first_credit_line(w), "asset_id", "left")
        .join(asset_description(w), "asset_id", "left")
    )
    return as_amounts(
        rows.select(
            "asset_id", "customer", "supplying_dealer", order_type(F.col("allocated_status"), F.col("available_from"), F.lit(w.as_of)).alias("order_type"), "project_number", "registration_number",
            F.coalesce("delivered_on", "planned_delivery").alias("origination_date"), "allocated_status", "asset_funding_status", F.col("adjusted_book_value").alias("book_value"), "asset_description",
            "line_opp", "line_customer", "expected_commencement_date",
        ),
        "book_value",
    )
