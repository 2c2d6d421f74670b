"""Asset views: status, value, depreciation, description, features, in-application stage."""

from pyspark.sql import functions as F

from rentroll.functions.dates import on_or_before
from rentroll.functions.text import blank_if, join_parts
from rentroll.lease.parts import current_assets, current_contracts, lookup, products
from rentroll.lease.warehouse import view
from rentroll.operators import versions
from rentroll.operators.hot import ordered_columns, split_join
from rentroll.operators.status import furthest_stage


@view
def asset_status_latest(w):
    """Latest status fact per asset, over all versions of the asset."""
    return versions.latest_by_business_key(
        w("fact_asset_status"), w("dim_asset"), "sk_asset", "bk_asset_id", F.col("sk_asset").desc(), F.col("sk_asset_status").desc()
    ).withColumnRenamed("bk_asset_id", "asset_id")


@view
def asset_sheet(w):
    """The wide asset table, materialised upstream and read as it is."""
    return w("asset_sheet")


@view
def asset_value(w):
    """Opening value of the first cleared row and closing value of the last posted row, in one pass."""
    rows = w("dim_asset_value_history").filter(
        (F.col("is_lessor_owned") == 1)
        & (F.col("is_schedule") == 1)
        & (F.col("is_accounted") == 1)
        & on_or_before(F.col("income_date"), w.as_of)
    )
    rank = F.struct("income_date", "bk_asset_value_history_id")
    cleared = F.when(F.col("is_cleared") == 1, rank)
    posted = F.when(F.col("gl_journal_id").isNotNull() & (F.col("current_flag") == 1), rank)
    ends = rows.groupBy("asset_id").agg(
        F.min_by("begin_book_value_amount", cleared).alias("begin_book_value"),
        F.min_by("cost_amount", cleared).alias("cost"),
        F.max_by("end_book_value_amount", posted).alias("end_book_value"),
        F.max_by("end_book_value_amount", rank).alias("last_book_value"),
    )
    return current_assets(w).select("asset_id").join(ends, "asset_id", "left")


@view
def book_depreciation(w):
    """Active depreciation rows with their place from the last and from the first, by asset and by contract."""
    rows = w.active("dim_book_depreciation").withColumns(
        {
            "_ends": F.coalesce("terminated_date", "end_date"),
            "_contract": F.coalesce("contract_id", F.lit(-1)),
        }
    )
    by_asset, by_contract, sk = ["asset_id"], ["asset_id", "contract_id"], "sk_book_depreciation"
    places = [
        (by_asset, ["_ends", "begin_date", sk], {"reverse_ordinal": "current_asset_value"}),
        (by_asset, ["_contract", "begin_date", sk], {"reverse_ordinal": "current_contract_value"}),
        (by_asset, ["begin_date", sk], {"ordinal": "initial_asset_value"}),
        (by_contract, ["begin_date", sk], {"ordinal": "initial_contract_value"}),
    ]
    plain = rows
    for keys, order, named in places:
        rows = ordered_columns(rows, keys, order, source=plain, **named)
    return rows.drop("_ends", "_contract")


@view
def latest_depreciation(w):
    """The depreciation row of an asset's latest contract; a top-1, so no full ordering is needed."""
    rows = w.active("dim_book_depreciation")
    order = F.coalesce("contract_id", F.lit(-1)).desc(), F.col("begin_date").desc(), F.col("sk_book_depreciation").desc()
    return versions.first_per_key(rows, ["asset_id"], *order).select(
        "asset_id", (F.col("per_day_factor") * 30).alias("depreciation_value"), F.col("begin_date").alias("depreciation_start")
    )


@view
def asset_details(w):
    """Current asset with status and the details of its status fact."""
    status = lookup(w, "dim_asset_status", "sk_asset_status", "sk_asset_status", asset_status="asset_status")
    details = w.current("dim_additional_details").drop("bk_additional_details_id", "start_date", "end_date", "created_time")
    vehicle = w.current("dim_vehicle_detail").drop("bk_vehicle_detail_id")
    return (
        current_assets(w)
        .join(w("fact_asset_status").drop("sk_date_record", "sk_time_record"), "sk_asset")
        .join(details, "sk_additional_details")
        .join(vehicle, "sk_vehicle_detail")
        .join(status, "sk_asset_status", "left")
    )


@view
def asset_description(w):
    """Maker, make, model, body and category in one line, without fillers and repeats."""
    body = lookup(w, "dim_body_type_config", "bk_body_type_config_id", "body_type_config_id", body_type="body_type_code")
    rows = asset_details(w).join(body, "body_type_config_id", "left")
    make = blank_if(F.col("make_name"), "Other")
    both_bus = F.coalesce(F.col("body_type"), F.lit("")).like("%Bus%") & F.col("product_name").like("%Bus%")
    category = F.when(both_bus, "").otherwise(F.col("product_name"))
    text = join_parts(
        F.col("manufacturer_name"),
        F.when(F.col("manufacturer_name") != make, make),
        blank_if(F.col("model_name"), "Other"),
        F.col("body_type"),
        category,
    )
    return rows.select("asset_id", F.when(F.col("manufacturer_name").isNotNull(), text).alias("asset_description")).distinct()


@view
def asset_features(w):
    """Features with the latest registration of each piece of equipment."""
    category = lookup(w, "dim_asset_category", "bk_asset_category_id", "asset_category_id", feature_category="name")
    reg = w.current("dim_registration").select("asset_id", "registration_number", "effective_date", "bk_registration_id")
    rows = w.current("dim_asset_features").join(category, "asset_category_id", "left").join(reg, "asset_id", "left")
    order = F.col("effective_date").desc(), F.col("bk_registration_id").desc(), F.col("bk_asset_feature_id").desc()
    return versions.first_per_key(rows, ["equipment_id"], *order).select(
        "asset_id", "equipment_id", "registration_number", "effective_date", "feature_category", "is_synced", "sync_status"
    )


OPEN_APPLICATION = ("Pending", "SubmittedToCredit")
DEAD_PROFILE = ("Inactivate", "Declined", "OpportunityWithdrawn", "Cancelled")


@view
def opportunities(w):
    return w.current("dim_opportunity").withColumnRenamed("bk_opportunity_id", "opportunity_id")


@view
def open_applications(w):
    """Applications still open that have no credit profile yet, with customer and cost center."""
    profiles = w.current("dim_credit_profile").select("opportunity_id")
    customer = lookup(w, "dim_customer", "bk_customer_id", "customer_id", party_name="party_name")
    center = lookup(w, "dim_cost_center", "bk_cost_center_id", "cost_center_id", cost_center="description")
    user = lookup(w, "dim_user", "bk_user_id", "created_by_id", created_by="full_name")
    opportunity = opportunities(w).select("opportunity_id", F.col("number").alias("opp_number"), "customer_id", "cost_center_id")
    return (
        w.current("dim_credit_application")
        .filter(F.col("status").isin(*OPEN_APPLICATION))
        .withColumnRenamed("bk_credit_application_id", "opportunity_id")
        .join(profiles, "opportunity_id", "left_anti")
        .join(opportunity, "opportunity_id")
        .join(customer, "customer_id")
        .join(center, "cost_center_id")
        .join(user, "created_by_id", "left")
    )


@view
def credit_lines(w):
    """Assets on live credit profiles, latest structure per asset and profile, with the contract made from it."""
    customer = lookup(w, "dim_customer", "bk_customer_id", "customer_id", party_name="party_name")
    user = lookup(w, "dim_user", "bk_user_id", "created_by_id", created_by="full_name")
    opportunity = opportunities(w).select("opportunity_id", F.col("number").alias("opp_number"), F.col("customer_id"), "created_by_id")
    center = lookup(w, "dim_cost_center", "bk_cost_center_id", "cost_center_id", cost_center="description")
    structure = w.active("dim_approved_structure").select(
        F.col("bk_approved_structure_id").alias("approved_structure_id"),
        F.col("credit_profile_id"),
        F.col("number").alias("structure_number"),
        "deal_product_type_id",
        "expected_commencement_date",
    )
    held = w.active("dim_approved_structure_asset").select("approved_structure_id", "asset_id", "bk_approved_structure_asset_id")
    profile = w.current("dim_credit_profile").filter(~F.col("status").isin(*DEAD_PROFILE)).select(
        F.col("bk_credit_profile_id").alias("credit_profile_id"),
        "opportunity_id",
        F.col("number").alias("credit_number"),
        F.col("status").alias("profile_status"),
        F.col("created_time").alias("profile_created"),
        "cost_center_id",
        "assigned_to_user_id",
    )
    # Structures meet their profile, and opportunities their customer, before the assets: these are many to each.
    rows = held.join(structure.join(profile, "credit_profile_id"), "approved_structure_id")
    latest = versions.first_per_key(
        rows,
        ["asset_id", "credit_number"],
        F.col("structure_number").desc(),
        F.col("bk_approved_structure_asset_id").desc(),
    )
    contract = current_contracts(w).filter(F.col("status") != "Inactive").select(
        F.col("credit_approved_structure_id").alias("approved_structure_id"),
        "contract_id",
        "sequence_number",
        F.col("status").alias("booking_status"),
    )
    return (
        latest.join(opportunity.join(customer, "customer_id"), "opportunity_id")
        .join(products(w).drop("product_code"), "deal_product_type_id")
        .join(center, "cost_center_id")
        .join(contract, "approved_structure_id", "left")
        .join(user, "created_by_id", "left")
    )


@view
def in_application(w):
    """Assets on their way to a contract: contract > line of credit > structure > application.

    One row for each application of an asset, with its structure there, and one for each of its credit lines: an open
    application has no credit line yet, so the two never describe the same opportunity and no pairs are made of them.
    """
    pair = ["asset_id", "opportunity_id"]
    app = versions.first_per_key(
        w.current("dim_application_asset").join(
            open_applications(w), F.col("credit_application_id") == F.col("opportunity_id")
        ),
        pair,
        F.col("bk_application_asset_id").desc(),
    ).select(
        *pair,
        F.col("opp_number").alias("app_opp"),
        F.col("party_name").alias("app_company"),
        F.col("status").alias("app_status"),
        F.col("created_by").alias("app_created_by"),
    )
    structure = (
        w.active("dim_application_structure")
        .withColumnRenamed("bk_application_structure_id", "application_structure_id")
        .join(w.active("dim_application_structure_asset"), "application_structure_id")
        .join(open_applications(w), F.col("credit_application_id") == F.col("opportunity_id"))
        .join(products(w), F.col("transaction_type_id") == F.col("deal_product_type_id"))
    )
    structure = versions.first_per_key(structure, pair, F.col("bk_application_structure_asset_id").desc()).select(
        *pair,
        F.col("opp_number").alias("structure_opp"),
        F.col("party_name").alias("structure_company"),
        F.col("product_name").alias("structure_product"),
        F.col("status").alias("structure_status"),
    )
    line = credit_lines(w).select(
        "asset_id",
        "credit_number",
        "profile_status",
        F.col("opp_number").alias("line_opp"),
        F.col("party_name").alias("line_company"),
        F.col("product_name").alias("line_product"),
        F.col("created_by").alias("line_created_by"),
        "sequence_number",
        "booking_status",
    )
    opportunities_ = app.join(structure, pair, "full").drop("opportunity_id").unionByName(line, allowMissingColumns=True)
    rows = split_join(opportunities_, current_assets(w).select("asset_id", "alias"), ["asset_id"])
    booked = F.col("sequence_number").isNotNull()
    stage = furthest_stage(
        (booked & (F.col("booking_status") == "InstallingAssets"), "contract installing assets"),
        (booked & (F.col("booking_status") == "Pending"), "contract pending"),
        (booked, "converted to contract"),
        (F.col("credit_number").isNotNull(), "line of credit"),
        (F.col("structure_status").isNotNull(), "app structure"),
        (F.col("app_status").isNotNull(), "app"),
        otherwise="not in application",
    )
    named = rows.withColumns(
        {
            "stage": stage,
            "product": F.coalesce("line_product", "structure_product"),
            "company": F.coalesce("line_company", "app_company"),
            "opp_number": F.coalesce("line_opp", "structure_opp", "app_opp"),
            "created_by": F.coalesce("app_created_by", "line_created_by"),
        }
    )
    return named.filter(~F.col("stage").isin("converted to contract", "not in application"))


@view
def in_application_once(w):
    """One row per asset in application, its latest opportunity, for joins that need a flag or a stage."""
    order = F.col("opp_number").desc(), F.col("credit_number").desc()
    return versions.first_per_key(in_application(w), ["asset_id"], *order)
