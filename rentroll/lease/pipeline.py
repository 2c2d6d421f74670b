"""Sales pipeline and customer reports: applications, credit lines, contracts created, customers, vehicle sales."""

from pyspark.sql import functions as F

from rentroll.functions.dates import UNKNOWN_START, days_between, month_steps
from rentroll.functions.money import gain, loss
from rentroll.functions.nulls import first_match
from rentroll.functions.text import concat_blank, trimmed_or_null
from rentroll.lease.assets import credit_lines, opportunities
from rentroll.lease.contracts import contract_core, contracts_with, credit_applications, finance_latest, leased_now
from rentroll.lease.parts import as_amounts, cost_centers, current_assets, current_contracts, current_customers, lookup, products, registrations, with_people
from rentroll.lease.receivables import customers, invoices, latest_exposure
from rentroll.lease.warehouse import view
from rentroll.operators import versions


def annual_reviews(w):
    """Active customers whose latest proposed exposure is above zero."""
    exposure = latest_exposure(w).select("customer_id", "exposure_date", "total_proposed_exposure", "primary_customer_amount", "group_exposure", "proposed_exposure")
    customer = current_customers(w).filter(F.col("status") == "Active").select(
        "customer_id", F.coalesce(trimmed_or_null(F.col("company_name")), F.col("party_name")).alias("company_name"), "creation_date", "credit_score",
        F.col("annual_credit_review_date").alias("last_review_date"), "next_review_date",
    )
    policy = w.active("dim_insurance_policy").select("customer_id", "expiration_date")
    rows = customer.join(exposure.filter(F.col("proposed_exposure") > 0), "customer_id").join(policy, "customer_id", "left")
    return as_amounts(with_people(w, rows).distinct(), "total_proposed_exposure", "primary_customer_amount", "group_exposure", "proposed_exposure")


def application_contracts(w):
    """Contracts made from applications with both creation days."""
    apps = credit_applications(w).select("opportunity_number", "opportunity_id", "application_created")
    rows = contracts_with(w, "customer", "commencement").filter(F.col("opportunity_number").isNotNull()).join(apps, "opportunity_number")
    return rows.select("opportunity_id", "application_created", "company_name", "sequence_number", "created_time", "status", "commencement_date")


def application_progress(w):
    """Approved or amended applications that are no pre-approvals and not taken down."""
    rows = credit_applications(w).filter(
        F.lower("loc_status").isin("approved", "amendment") & (F.col("is_pre_approval") == 0) & (F.col("all_assets_taken_down") == 0)
    )
    return as_amounts(
        rows.select(
            "opportunity_number", "credit_profile_number", "company_name", "expected_commencement_date", "product_name", "equipment_count",
            F.coalesce("approved_amount", F.lit(0)).alias("approved_amount"), "loc_status", "application_status", "branch_name", "customer_term", "sales_rep", "assigned_user",
        ),
        "approved_amount",
    )


def qa_queue(w):
    """Applications waiting for a check: submitted with the line approved or pending, or a contract not yet active."""
    lease = contract_core(w).filter(F.col("opportunity_number").isNotNull()).select("opportunity_number", F.col("status").alias("lease_status"))
    rows = credit_applications(w).join(lease, "opportunity_number", "left")
    submitted = (F.lower("application_status") == "submittedtocredit") & F.lower("loc_status").isin("approved", "pending")
    return as_amounts(
        rows.filter(submitted | F.lower("lease_status").isin("pending", "installingassets")).select(
            "opportunity_number", "company_name", "product_name", "equipment_count", F.coalesce("approved_amount", F.lit(0)).alias("approved_amount"),
            "cost_center", "application_owner", "report_status", "application_status", "loc_status",
        ),
        "approved_amount",
    )


def credit_ratings(w):
    """Customer credit sheet: exposure, arrears flag, insurance, address, people."""
    late = invoices(w).filter((F.col("effective_balance_amount") > 0) & (F.col("due_date") <= F.lit(w.as_of))).select("customer_id").distinct()
    insurer = w.active("dim_insurance_company").select(F.col("bk_insurance_company_id").alias("insurance_company_id"), F.col("name").alias("insurer"))
    policy = w.active("dim_insurance_policy").join(insurer, "insurance_company_id", "left").select(
        "customer_id", "insurer", "is_self_insured", "expiration_date", "policy_number"
    )
    address = lookup(w, "dim_party_address", "bk_party_address_id", "customer_id", street="address_line1", postal_code="postal_code")
    exposure = latest_exposure(w).select("customer_id", F.col("primary_customer_amount").alias("current_exposure"), "proposed_exposure")
    rows = (
        current_customers(w).filter(F.col("primary_role") == "Customer")
        .join(policy, "customer_id", "left")
        .join(address, "customer_id", "left")
        .join(exposure, "customer_id", "left")
        .join(late.withColumn("in_arrears", F.lit("TRUE")), "customer_id", "left")
    )
    rows = with_people(w, rows)
    return as_amounts(
        rows.select(
            "customer_id", "party_name", "status", "street", "postal_code", "current_exposure", "proposed_exposure", F.coalesce("in_arrears", F.lit("FALSE")).alias("in_arrears"), "insurer",
            F.when(F.col("is_self_insured") == 1, "TRUE").otherwise("FALSE").alias("self_insured"), "expiration_date", "next_review_date", "sales_rep", "account_manager",
        ).distinct(),
        "current_exposure", "proposed_exposure",
    )


def customer_reviews(w):
    """Review-due and policy labels per customer."""
    months, expiry = F.col("months_to_review"), F.col("policy_expiration_date")
    review = first_match((months < 0, F.lit("Overdue")), (months == 1, F.lit("1 Month")), (months > 1, F.lit("More than 2 Months")))
    policy = first_match((expiry.isNull(), F.lit("None Held")), (expiry <= F.lit(w.as_of), F.lit("Overdue")), otherwise=F.lit("Up to Date"))
    return customers(w).select(
        "customer_id", "party_name", "next_review_date", days_between(F.lit(w.as_of), F.col("next_review_date")).alias("days_to_review"),
        month_steps(F.lit(w.as_of), F.col("next_review_date")).alias("months_to_review"), review.alias("review_due"), policy.alias("policy_status"), "account_manager",
        F.when(F.col("effective_balance_amount") > 0, 1).otherwise(0).alias("in_arrears"),
    )


# Report product by cost center and deal product; an empty product stands for any.
PRODUCT_MATRIX = [
    ("Lease Sales", "Contract Hire", "Contract Hire Origination"),
    ("Lease Sales", "Hire Purchase", "Hire Purchase Origination"),
    ("Lease Sales", "Operating Lease", "Operating Lease Origination"),
    ("Lease Sales", "Finance Lease", "Finance Lease Origination"),
    ("Lease Sales", "Rental", "Rental - Origination"),
    ("Extension -Lease", "Contract Hire", "Contract Hire Extension"),
    ("Extension -Lease", "Operating Lease", "Operating Lease Extension"),
    ("Extension -Lease", "Hire Purchase", "Hire Purchase Extension"),
    ("Lease (Used Asset)", "Contract Hire", "Contract Hire Lease - Used Asset"),
    ("Lease (Used Asset)", "Hire Purchase", "Hire Purchase (Used Asset)"),
    ("Lease (Used Asset)", "Operating Lease", "Operating Lease (Used Asset)"),
    ("Lease (Used Asset)", "Finance Lease", "Finance Lease (Used Asset)"),
    ("Lease (Used Asset)", "Rental", "Rental (Used Asset)"),
    ("Rental (New Asset)", "Rental", "Rental - Origination"),
    ("Rental", "Rental", "Rental - Churn"),
    ("Extension - Rental Std", "Rental", "Rental - Extension (Existing Customer)"),
    ("Lease (Re-Profile)", None, "Lease (Re-Profile)"),
    ("Vendor Finance", None, "Vendor Finance"),
    ("Traffic Managment", None, "Traffic Management"),
    ("Fleet Management", None, "Fleet Management"),
]


def report_product(novated, center, product):
    """Product of a contract event from the matrix; a novation is its own product."""
    rules = [((center == c) if p is None else (center == c) & (product == p), F.lit(label)) for c, p, label in PRODUCT_MATRIX]
    return first_match((novated, F.lit("Novated")), *rules)


@view
def contract_events(w):
    """First commenced and first novated version of each contract."""
    found = w("dim_contract").filter(F.col("status").isin("Commenced", "FullyPaidOff"))
    day = F.when(F.col("start_date") == F.lit(UNKNOWN_START), F.coalesce("created_time", "dp_process_datetime")).otherwise(F.col("start_date"))
    novated_day = F.when(F.col("start_date") == F.lit(UNKNOWN_START), F.col("dp_process_datetime")).otherwise(F.col("start_date"))
    order = F.col("dp_process_datetime"), F.col("sk_contract")
    columns = "bk_contract_id", "sequence_number", "deal_product_type_id", "cost_center_id"
    commenced = versions.first_per_key(found, ["bk_contract_id"], *order).select(*columns, day.alias("event_day"), F.lit("commenced").alias("event"))
    moved = found.filter((F.col("status") == "Commenced") & (F.col("report_status") == "Assumed"))
    novated = versions.first_per_key(moved, ["bk_contract_id"], *order).select(*columns, novated_day.alias("event_day"), F.lit("novated").alias("event"))
    return commenced.unionByName(novated).withColumnRenamed("bk_contract_id", "contract_id")


def contracts_created_events(w):
    """Commencements and novations with product, assets and origination amount."""
    finance = finance_by_record_day(w)
    totals = leased_now(w).groupBy("contract_id").agg(
        F.count("asset_id").alias("assets"), F.sum("nbv_amount").alias("nbv_amount"), F.sum("true_down_payment_amount").alias("down_payment")
    )
    rows = (
        contract_events(w)
        .join(finance, "contract_id", "left")
        .join(totals, "contract_id", "left")
        .join(products(w), "deal_product_type_id", "left")
        .join(cost_centers(w), "cost_center_id", "left")
        .filter(F.coalesce("finance_status", F.lit(" ")) != "Inactive")
    )
    zero = F.lit(0)
    value = F.when(
        F.col("product_name") == "Hire Purchase",
        F.coalesce("nbv_amount", zero) - F.coalesce("tax_deferral_amount", zero) - F.coalesce("down_payment", zero),
    ).otherwise(F.col("nbv_amount"))
    return as_amounts(
        rows.select(
            "contract_id", "sequence_number", "event", "event_day", "party_name", "finance_status", "line_of_business", "assets", "cost_center", "product_name",
            report_product(F.col("event") == "novated", F.col("cost_center"), F.col("product_name")).alias("report_product"), value.alias("origination_amount"),
        ),
        "origination_amount",
    )


@view
def finance_by_record_day(w):
    """Latest finance record of each contract over all its versions, by record day."""
    finance = w.current("dim_lease_finance").filter(F.col("is_current") == 1).select("sk_lease_finance")
    contract = w("dim_contract").select("sk_contract", F.col("bk_contract_id").alias("contract_id"), F.col("status").alias("finance_status"))
    customer = w.current("dim_customer").select("sk_customer", "party_name")
    lob = lookup(w, "dim_line_of_business", "sk_line_of_business", "sk_line_of_business", line_of_business="description")
    rows = w("fact_lease_finance_detail").join(finance, "sk_lease_finance", "left_semi").join(contract, "sk_contract").join(customer, "sk_customer")
    order = F.col("sk_date_record").desc(), F.col("sk_time_record").desc(), F.col("sk_contract").desc()
    return versions.first_per_key(rows, ["contract_id"], *order).join(lob, "sk_line_of_business").select(
        "contract_id", "finance_status", "party_name", "tax_deferral_amount", "line_of_business"
    )


def installing_contracts(w):
    """Contracts installing assets with an approved finance: first seen, assets, cost."""
    first = w("dim_contract").groupBy(F.col("bk_contract_id").alias("contract_id")).agg(F.min("dp_process_date").alias("created_date"))
    link = w.current("dim_contract").select("sk_contract", F.col("bk_contract_id").alias("contract_id"))
    totals = w("fact_lease_asset").join(link, "sk_contract").groupBy("contract_id").agg(
        F.count("sk_asset").alias("assets"), F.sum("customer_cost_amount").alias("customer_cost")
    )
    branch = lookup(w, "dim_branch", "sk_branch", "sk_branch", branch_name="branch_name")
    rows = finance_latest(w).filter((F.col("status") == "InstallingAssets") & (F.col("approval_status") != "Pending"))
    rows = rows.join(totals, "contract_id", "left").join(first, "contract_id", "left").join(branch, "sk_branch")
    return as_amounts(
        rows.select(
            "contract_id", "sequence_number", "contract_number", "company_name", "cost_center", "branch_name", "product_name", "commencement_date", "customer_term_in_months",
            "assets", "customer_cost", "created_date", "approval_status",
        ),
        "customer_cost",
    )


def live_credit_lines(w):
    """Assets on live lines without an active contract, with the department and person to act."""
    line = credit_lines(w).filter(F.col("booking_status").isNull() | F.col("booking_status").isin("Pending", "InstallingAssets"))
    user = lookup(w, "dim_user", "bk_user_id", "owner_user_id", owner="full_name")
    # The latest task of an entity is the one that counts.
    tasks = (
        w.current("dim_transaction_instance").filter(F.col("status") == "Active")
        .withColumnRenamed("bk_transaction_instance_id", "transaction_instance_id").drop("status")
        .join(w.current("dim_work_item").filter(F.col("status") == "Assigned").drop("status"), "transaction_instance_id")
        .join(user, "owner_user_id")
    )
    latest = versions.first_per_key(tasks, ["entity_name", "entity_id"], F.col("transaction_instance_id").desc())
    line_owner = latest.filter(F.col("entity_name") == "CreditProfile").select(F.col("entity_id").alias("credit_profile_id"), F.col("owner").alias("line_owner"))
    finance = finance_latest(w).select("contract_id", "lease_finance_id", "approval_status")
    lease_owner = latest.filter(F.col("entity_name") == "LeaseFinance").select(F.col("entity_id").alias("lease_finance_id"), F.col("owner").alias("lease_owner"))
    assigned = lookup(w, "dim_user", "bk_user_id", "assigned_to_user_id", assigned_user="full_name")
    rows = (
        line.join(line_owner, "credit_profile_id", "left")
        .join(finance, "contract_id", "left")
        .join(lease_owner, "lease_finance_id", "left")
        .join(assigned, "assigned_to_user_id", "left")
        .join(registrations(w).select("asset_id", "registration_number"), "asset_id", "left")
    )
    booked, state = F.col("booking_status"), F.col("profile_status")
    department = first_match(
        (booked.isNull() & state.isin("Amendment", "Approved"), F.lit("Contract Management")),
        (booked.isNull(), F.lit("Credit")),
        (booked == "Pending", F.lit("Contract Management")),
        ((booked == "InstallingAssets") & (F.col("approval_status") == "Pending"), F.lit("Contract Management")),
        otherwise=F.lit("Finance"),
    )
    return rows.select(
        "asset_id", "credit_number", "opp_number", concat_blank(F.col("opp_number"), F.lit("-"), F.col("structure_number").cast("string")).alias("opp_structure"), "cost_center", "profile_status",
        "product_name", "registration_number", "sequence_number", "booking_status", "assigned_user", "line_owner", "lease_owner", "approval_status", department.alias("department"),
    ).distinct()


def rental_days_to_contract(w):
    """Days from a line's first approval to the contract's first commencement, rentals only."""
    approved = w("dim_credit_profile").filter(F.col("status") == "Approved")
    first = versions.first_per_key(approved, ["bk_credit_profile_id"], F.col("dp_process_date"), F.col("sk_credit_profile")).select(
        F.col("bk_credit_profile_id").alias("credit_profile_id"), F.col("number").alias("credit_number"), "cost_center_id", "customer_id", "opportunity_id", F.col("dp_process_date").alias("approved_on")
    )
    opportunity = opportunities(w).select("opportunity_id", F.col("number").alias("opp_number"))
    structure = w.current("dim_approved_structure").select(F.col("bk_approved_structure_id").alias("credit_approved_structure_id"), "credit_profile_id")
    contract = current_contracts(w).select("credit_approved_structure_id", "contract_id", "sequence_number")
    started = w("dim_contract").filter(F.col("status") == "Commenced").withColumnRenamed("bk_contract_id", "contract_id")
    commenced = versions.first_per_key(started, ["contract_id"], F.col("dp_process_datetime"), F.col("sk_contract")).join(products(w), "deal_product_type_id").select(
        "contract_id", F.col("dp_process_date").alias("commenced_on"), "product_name"
    )
    customer = current_customers(w).select("customer_id", "company_name")
    rows = (
        first.join(opportunity, "opportunity_id").join(structure, "credit_profile_id").join(contract, "credit_approved_structure_id")
        .join(cost_centers(w), "cost_center_id").join(customer, "customer_id")
        .join(commenced.filter(F.col("product_name").like("%Rental%")), "contract_id")
    )
    return rows.select(
        "credit_number", "opp_number", "sequence_number", "cost_center", "company_name", "approved_on", "commenced_on", "product_name",
        days_between(F.col("approved_on"), F.col("commenced_on")).alias("days"),
    )


@view
def asset_sales(w):
    """Vehicle sales with asset, buyer, branch, seller and route to market; sales to the own company are left out."""
    detail = w.active("dim_asset_sale_detail").withColumnRenamed("asset_sale_id", "bk_asset_sale_id")
    asset = current_assets(w).select("asset_id", "sk_asset", "fleet_number", "product_name", "manufacturer_name")
    buyer = current_customers(w).select(F.col("customer_id").alias("buyer_id"), F.col("party_name").alias("buyer"))
    seller = w.active("dim_asset_sale_employee").filter(F.col("is_primary") == 1).select(F.col("asset_sale_id").alias("bk_asset_sale_id"), "employee_id").join(
        lookup(w, "dim_user", "bk_user_id", "employee_id", salesperson="full_name"), "employee_id"
    )
    return (
        w.current("dim_asset_sale")
        .join(detail, "bk_asset_sale_id")
        .join(asset, "asset_id")
        .join(buyer, "buyer_id", "left")
        .join(lookup(w, "dim_branch", "bk_branch_id", "branch_id", depot="branch_name"), "branch_id", "left")
        .join(seller.select("bk_asset_sale_id", "salesperson"), "bk_asset_sale_id", "left")
        .join(lookup(w, "dim_receivable_code", "bk_receivable_code_id", "receivable_code_id", route_to_market="name"), "receivable_code_id", "left")
        .join(registrations(w).select("asset_id", "registration_number"), "asset_id", "left")
        .filter(F.col("buyer") != w.settings.own_company)
        .withColumn("result", F.col("fair_market_value_amount") - F.col("net_value_amount"))
        .withColumn("financed", F.when(F.col("finance_company_funded") == 1, "Financed").otherwise("Not Financed"))
    )


SALE = "bk_asset_sale_id", "bk_asset_sale_detail_id", "asset_id", "transaction_date", "buyer", "transaction_number", "status", "registration_number", "depot", "salesperson", "route_to_market", "financed"


def _split(rows):
    return as_amounts(
        rows.select(*SALE, gain(F.col("result")).alias("profit"), loss(F.col("result")).alias("loss")), "profit", "loss"
    )


def completed_sales_split(w):
    """Completed sales of sold vehicles with profit and loss in two columns."""
    status = w("fact_asset_status").join(lookup(w, "dim_asset_status", "sk_asset_status", "sk_asset_status", asset_status="asset_status"), "sk_asset_status")
    sold = status.filter(F.col("asset_status") == "Sold").select("sk_asset")
    return _split(asset_sales(w).filter(F.col("status") == "Completed").join(sold, "sk_asset", "left_semi"))


def open_sales_split(w):
    """Pending and submitted sales."""
    return _split(asset_sales(w).filter((F.col("status") == "Pending") | (F.col("status") == "Submitted")))


def completed_sales(w):
    """Completed sales with the result and the buyer's postal code."""
    address = lookup(w, "dim_party_address", "bk_party_address_id", "buyer_id", postal_code="postal_code")
    rows = asset_sales(w).filter(F.col("status") == "Completed").join(address, "buyer_id", "left")
    return as_amounts(
        rows.select("bk_asset_sale_detail_id", "net_value_amount", F.col("result").alias("profit"), "salesperson", "fair_market_value_amount", "buyer", "transaction_date", "manufacturer_name", "postal_code"),
        "net_value_amount", "profit", "fair_market_value_amount",
    )


def unpaid_sales(w):
    """Completed sales whose first invoice still has a balance."""
    invoice = w.current("dim_receivable_invoice").select(F.col("bk_receivable_invoice_id").alias("first_receivable_invoice_id"), "sk_receivable_invoice", "number").join(
        w("fact_receivable_invoice"), "sk_receivable_invoice"
    )
    owed = invoice.filter(F.col("balance_amount") + F.col("tax_balance_amount") > 0)
    rows = asset_sales(w).filter(F.col("status") == "Completed").join(owed, "first_receivable_invoice_id")
    return as_amounts(
        rows.select(*SALE, "number", "fair_market_value_amount", (F.col("fair_market_value_amount") + F.col("projected_vat_amount")).alias("amount_with_vat")),
        "fair_market_value_amount", "amount_with_vat",
    )
