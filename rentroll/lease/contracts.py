"""Contract views: charges, leased assets, finance detail, contracts, credit applications, payments."""

from pyspark.sql import functions as F

from rentroll.functions.dates import NOT_TERMINATED, UNKNOWN_START, on_or_before
from rentroll.functions.nulls import default_to
from rentroll.lease.assets import asset_sheet, in_application_once
from rentroll.lease.parts import (
    cost_centers,
    current_contracts,
    current_customers,
    lookup,
    party_people,
    products,
    with_day,
)
from rentroll.lease.warehouse import of_assets, view
from rentroll.operators import versions
from rentroll.operators.hot import attach_many, ordered_columns, split_join
from rentroll.operators.status import is_free, utilisation


def _charge_lines(w, contract):
    """Lines of recurring asset charges of these contracts with their charge name."""
    code = lookup(w, "dim_receivable_code", "bk_receivable_code_id", "receivable_code_id", charge_name="name")
    recurring = w.current("dim_sundry_recurring").filter(F.col("is_asset_based") == 1)
    lines = w.current("dim_recurring_detail").select("sundry_recurring_id", "asset_id", F.col("amount").alias("charges"), "vat_amount")
    head = recurring.select(F.col("bk_sundry_recurring_id").alias("sundry_recurring_id"), "contract_id", "receivable_code_id")
    return split_join(lines, head.join(code, "receivable_code_id").join(contract, "contract_id"), ["sundry_recurring_id"])


@view
def charge_lines(w):
    """Lines of recurring asset charges with their contract and charge name."""
    return _charge_lines(w, current_contracts(w).select("contract_id", "sequence_number"))


def _numbers_of(w, chosen):
    return current_contracts(w).select("contract_id", "sequence_number").join(chosen, "contract_id", "left_semi")


def _charges_detail(lines):
    return lines.groupBy("contract_id", "sequence_number", "asset_id", "charge_name").agg(
        F.sum("charges").alias("charges"), F.sum("vat_amount").alias("vat_amount")
    )


@view
def charges_detail(w):
    """Recurring asset charges with tax per contract, asset and charge name."""
    return _charges_detail(charge_lines(w))


def charges_detail_of(w, chosen):
    """The same for the contracts in ``chosen``, a frame of ``contract_id``."""
    return _charges_detail(_charge_lines(w, _numbers_of(w, chosen)))


def _charges_by_asset(lines):
    return lines.groupBy("contract_id", "sequence_number", "asset_id").agg(
        F.sum("charges").alias("charges"), F.sum("vat_amount").alias("vat_amount")
    )


@view
def charges_by_asset(w):
    return _charges_by_asset(charge_lines(w))


@view
def charges_by_contract(w):
    return charge_lines(w).groupBy("contract_id", "sequence_number").agg(
        F.sum("charges").alias("charges"), F.sum("vat_amount").alias("vat_amount")
    )


def leased_now(w, approved=True, inactive=True, chosen=None, few=True):
    """Latest leased-asset fact per contract and asset, on the current contract version.

    The assets of a contract share its version, finance and customer: these are resolved once for each distinct set, and the
    facts join the sets that are left, first of all: one contract goes on with them and not three keys. The facts of a part
    of the fleet are few and join the three directly, so they are found once and not once more for their sets.

    ``chosen``, a frame of ``contract_id``: leases of these contracts alone. Their facts are few once they have met them; where
    they are half of all facts (not ``few``), their sets are resolved first as well.
    """
    contract = w.current("dim_contract").select(
        "sk_contract", F.col("bk_contract_id").alias("contract_id"), "sequence_number", F.col("status").alias("contract_status")
    )
    if not inactive:
        contract = contract.filter(F.col("contract_status") != "Inactive")
    if chosen is not None:
        contract = contract.join(chosen, "contract_id", "left_semi")
    marks = w.current("dim_lease_asset")
    if approved:
        marks = marks.filter(F.col("is_approved") == 1)
    finance = w("dim_lease_finance").filter(F.col("is_current") == 1).select("sk_lease_finance")
    asset = w("dim_asset").select("sk_asset", F.col("bk_asset_id").alias("asset_id"))
    customer = w("dim_customer").select("sk_customer", F.col("bk_customer_id").alias("customer_id"))
    shared = ["sk_contract", "sk_lease_finance", "sk_customer"]

    def resolved(rows):
        return rows.join(contract, "sk_contract").join(finance, "sk_lease_finance", "left_semi").join(customer, "sk_customer")

    facts = w("fact_lease_asset")
    if w.is_part:
        rows = resolved(facts.join(asset, "sk_asset").join(marks, "sk_lease_asset"))
    elif chosen is not None and few:
        # No semi-join: Spark would move it in front of the contracts.
        rows = facts.join(contract, "sk_contract").join(marks, "sk_lease_asset").join(finance, "sk_lease_finance").join(customer, "sk_customer").join(asset, "sk_asset")
    else:
        rows = split_join(facts, resolved(facts.select(*shared).distinct()), shared).join(marks, "sk_lease_asset").join(asset, "sk_asset")
    order = F.col("sk_date_record").desc(), F.col("sk_time_record").desc(), F.col("sk_lease_asset").desc()
    return versions.first_per_key(rows, ["contract_id", "asset_id"], *order)


def _lease_assets(w, leased, charges):
    """Leased assets with termination day, budget and total charge."""
    charges = charges.select("contract_id", "asset_id", "charges")
    rows = with_day(w, leased, "sk_date_termination_date", "termination_date")
    budget = F.coalesce("charges", F.lit(0))
    return (
        rows.join(charges, ["contract_id", "asset_id"], "left")
        .withColumns(
            {
                "asset_budget_value": budget,
                "total_charge": budget + F.coalesce("rent_amount", F.lit(0)),
            }
        )
        .drop("charges")
    )


@view
def lease_assets_all(w):
    """Approved leased assets with termination day, budget and total charge."""
    return _lease_assets(w, leased_now(w), charges_by_asset(w))


def _live(rows):
    return rows.filter((F.col("termination_date") == F.lit(NOT_TERMINATED)) & (F.col("contract_status") != "Inactive"))


@view
def lease_assets_live(w):
    """Not terminated, and not on an inactive contract."""
    return _live(lease_assets_all(w))


def lease_assets_of(w, chosen, few=True):
    """``lease_assets_all`` of the contracts in ``chosen``, a frame of ``contract_id``: facts of others leave at the first join."""
    charges = _charges_by_asset(_charge_lines(w, _numbers_of(w, chosen)))
    return _lease_assets(w, leased_now(w, chosen=chosen, few=few), charges)


def lease_assets_live_of(w, chosen, few=True):
    return _live(lease_assets_of(w, chosen, few))


@view
def contract_assignments(w):
    """Primary employee of each contract."""
    role = lookup(w, "dim_role_function", "bk_role_function_id", "role_function_id", role_function="name", system_name="system_defined_name")
    user = lookup(w, "dim_user", "bk_user_id", "employee_id", employee_name="full_name")
    staff = w.current("dim_party_employee").select(
        F.col("bk_party_employee_id").alias("party_employee_id"), "role_function_id", "employee_id"
    )
    rows = w.current("dim_contract_employee").join(staff, "party_employee_id").join(role, "role_function_id").join(user, "employee_id")
    order = F.col("is_primary").desc(), F.col("bk_contract_employee_id")
    return versions.first_per_key(rows, ["contract_id"], *order).select(
        "contract_id", "employee_name", "role_function", "system_name"
    )


@view
def contract_sales_reps(w):
    """Sales rep of each contract, the rep's primary link first."""
    roles = lookup(w, "dim_role_function", "bk_role_function_id", "role_function_id", role="name").filter(F.col("role") == "Sales Rep")
    user = lookup(w, "dim_user", "bk_user_id", "employee_id", sales_rep="full_name")
    staff = w.active("dim_party_employee").select(
        F.col("bk_party_employee_id").alias("party_employee_id"), "role_function_id", "employee_id", F.col("is_primary").alias("rank")
    )
    rows = w.active("dim_contract_employee").join(staff, "party_employee_id").join(roles, "role_function_id", "left_semi").join(user, "employee_id")
    return versions.first_per_key(rows, ["contract_id"], F.col("rank").desc(), F.col("bk_contract_employee_id")).select(
        "contract_id", "sales_rep"
    )


@view
def customer_assignments(w):
    """Sales rep, else account manager, of each active customer."""
    customer = current_customers(w).filter(F.col("status") == "Active").select("customer_id", "party_name")
    people = party_people(w)

    def of(role, tag):
        return people.filter(F.col("role_function") == role).select(
            "customer_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("employee_name", "role_function", "system_name")]
        )

    both = customer.join(of("Sales Rep", "a"), "customer_id", "left").join(of("Account Manager", "b"), "customer_id", "left")
    return both.select(
        "customer_id",
        "party_name",
        *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in ("employee_name", "role_function", "system_name")],
    )


def _finance_rows(w, contract, rated=True):
    """Finance records of these contract versions, with the customer's version and the rate.

    Rates are joined to the finance versions, which are fewer and narrower than the records.
    """
    finance = w.current("dim_lease_finance").filter(F.col("is_current") == 1).select(
        "sk_lease_finance", F.col("bk_lease_finance_id").alias("lease_finance_id"), "is_over_term_lease"
    )
    rate = w.active("dim_interest_rate_detail").select(
        F.col("bk_interest_rate_detail_id").alias("interest_rate_detail_id"), "base_rate", "spread"
    )
    link = w.current("dim_lease_interest_rate").select(
        F.col("lease_finance_detail_id").alias("lease_finance_id"), "interest_rate_detail_id", "sk_lease_interest_rate"
    )
    if rated:
        finance = finance.join(link.join(rate, "interest_rate_detail_id", "left"), "lease_finance_id", "left")
    old = w("dim_customer").select("sk_customer", F.col("bk_customer_id").alias("customer_id"))
    # The small dimensions and the contract first: facts of old contract versions, half of them, go no further.
    return (
        w("fact_lease_finance_detail")
        .join(w.current("dim_branch").select("sk_branch"), "sk_branch", "left_semi")
        .join(w.current("dim_line_of_business").select("sk_line_of_business"), "sk_line_of_business", "left_semi")
        .join(w.current("dim_cost_center").select("sk_cost_center"), "sk_cost_center", "left_semi")
        .join(contract, "sk_contract")
        .join(finance, "sk_lease_finance")
        .join(old, "sk_customer")
    )


def _finance_versions(w):
    return w.current("dim_contract").select("sk_contract", F.col("bk_contract_id").alias("contract_id"), "sequence_number")


@view
def finance_rows(w):
    """Finance records of the current contract versions."""
    return _finance_rows(w, _finance_versions(w))


def _current_finance(rows):
    keys = "sk_contract", "sk_customer", "sk_lease_interest_rate", "sk_date_record", "sk_time_record", "sk_lease_finance"
    return versions.first_per_key(rows, ["contract_id"], *[F.col(k).desc() for k in keys])


@view
def finance_detail(w):
    """Current finance version of each contract, with the customer's current version and its rate."""
    return _current_finance(finance_rows(w))


def finance_detail_of(w, chosen):
    """The same for the contracts in ``chosen``, a frame of ``contract_id``; records of others leave at the first join."""
    return _current_finance(_finance_rows(w, _finance_versions(w).join(chosen, "contract_id", "left_semi")))


@view
def first_records(w):
    """Day of the first finance record of each contract."""
    return _finance_rows(w, _finance_versions(w), rated=False).groupBy("contract_id").agg(F.min("sk_date_record").alias("sk_created_date"))


def _finance_contracts(w):
    return current_contracts(w).select(
        "sk_contract", "contract_id", "sequence_number", "contract_number", "status", "report_status", "deal_product_type_id",
        "created_time", "previous_schedule_number", "grace_delinquency_days",
    )


def _records_of(w, contract):
    """Latest finance record of each of these contracts by record day, with terms and customer."""
    finance = w.current("dim_lease_finance").filter(F.col("is_current") == 1).select(
        "sk_lease_finance", F.col("bk_lease_finance_id").alias("lease_finance_id"), "is_advance", "payment_frequency",
        "customer_term_in_months", "lease_contract_type", "approval_status",
    )
    customer = w("dim_customer").select(
        "sk_customer", F.col("bk_customer_id").alias("customer_id"), "party_name", "company_name", "party_number",
        "external_reference_id", "organization_id", "creation_date", "sic_code_id", "business_type_id",
        F.col("current_flag").alias("customer_is_current"),
    )
    rows = w("fact_lease_finance_detail").join(contract, "sk_contract").join(finance, "sk_lease_finance").join(customer, "sk_customer")
    order = [F.col(c).desc() for c in ("sk_contract", "sk_date_record", "sk_time_record", "sk_lease_finance", "sk_customer")]
    return versions.first_per_key(rows, ["contract_id"], *order)


@view
def finance_records(w):
    """Latest finance record of each current contract."""
    return _records_of(w, _finance_contracts(w))


def _with_names(w, records):
    """Finance records with product, cost center, business line and days."""
    center = lookup(w, "dim_cost_center", "sk_cost_center", "sk_cost_center", cost_center="description")
    lob = lookup(w, "dim_line_of_business", "sk_line_of_business", "sk_line_of_business", line_of_business="name")
    wide = records.join(products(w), "deal_product_type_id", "left").join(center, "sk_cost_center", "left").join(lob, "sk_line_of_business", "left")
    wide = with_day(w, wide, "sk_date_commencement_date", "commencement_date")
    wide = with_day(w, wide, "sk_date_maturity_date", "maturity_date")
    return wide.withColumn("payment_method", F.when(F.col("is_advance") == 1, "ADVANCE").otherwise("ARREARS"))


@view
def finance_latest(w):
    """The finance records with product, cost center, business line and days."""
    return _with_names(w, finance_records(w))


def contracts_to_keep(w, keep, product=None):
    """Ids of the contracts with a current version whose status meets ``keep(status)``, of one product if it is named."""
    chosen = _finance_contracts(w).filter(keep(F.col("status")))
    if product:
        chosen = chosen.join(products(w).filter(F.col("product_name") == product), "deal_product_type_id", "left_semi")
    return chosen.select("contract_id")


def finance_latest_of(w, keep, product=None):
    """``finance_latest`` where its status meets ``keep(status)``, of one product if it is named.

    A contract without any current version of such a status leaves before it meets the facts. One with several versions goes on
    with all of them, as the latest record decides which one counts.
    """
    records = _records_of(w, _finance_contracts(w).join(contracts_to_keep(w, keep, product), "contract_id", "left_semi"))
    rows = _with_names(w, records).filter(keep(F.col("status")))
    return rows.filter(F.col("product_name") == product) if product else rows


@view
def credit_applications(w):
    """Wide credit application: opportunity, profile, first structure, people, equipment count."""
    profile = w.current("dim_credit_profile").select(
        "opportunity_id",
        F.col("bk_credit_profile_id").alias("credit_profile_id"),
        F.col("number").alias("credit_profile_number"),
        F.col("status").alias("loc_status"),
        "approved_amount",
        "is_pre_approval",
        "all_assets_taken_down",
        F.col("created_time").alias("loc_created_time"),
        "assigned_to_user_id",
    )
    structure = w.current("dim_approved_structure").filter(F.col("number") == 1).select(
        "credit_profile_id", "deal_product_type_id", "expected_commencement_date", "customer_term", "balloon_amount"
    )
    application = w.current("dim_credit_application").select(
        F.col("bk_credit_application_id").alias("opportunity_id"),
        F.col("status").alias("application_status"),
        F.col("created_time").alias("application_created"),
        "submitted_to_credit_date",
        F.col("created_by_id").alias("application_user_id"),
    )
    equipment = w.current("dim_application_asset").groupBy(F.col("credit_application_id").alias("opportunity_id")).agg(
        F.count("asset_id").alias("equipment_count")
    )
    user = lookup(w, "dim_user", "bk_user_id", "user_id", full_name="full_name")

    def named(key, out):
        return user.select(F.col("user_id").alias(key), F.col("full_name").alias(out))

    rep = customer_assignments(w).filter(F.col("system_name") == "SalesRep").select(
        "customer_id", F.col("employee_name").alias("sales_rep")
    )
    opportunity = w.current("dim_opportunity").withColumnsRenamed(
        {"bk_opportunity_id": "opportunity_id", "number": "opportunity_number"}
    )
    return (
        opportunity.join(profile, "opportunity_id", "left")
        .join(current_customers(w).select("customer_id", "party_name", "company_name"), "customer_id", "left")
        .join(structure, "credit_profile_id", "left")
        .join(application, "opportunity_id", "left")
        .join(equipment, "opportunity_id", "left")
        .join(products(w).drop("product_code"), "deal_product_type_id", "left")
        .join(cost_centers(w), "cost_center_id", "left")
        .join(lookup(w, "dim_branch", "bk_branch_id", "branch_id", branch_name="branch_name"), "branch_id", "left")
        .join(lookup(w, "dim_legal_entity", "bk_legal_entity_id", "legal_entity_id", legal_entity="name", legal_entity_number="legal_entity_number"), "legal_entity_id", "left")
        .join(lookup(w, "dim_line_of_business", "bk_line_of_business_id", "line_of_business_id", line_of_business="name"), "line_of_business_id", "left")
        .join(named("created_by_id", "application_owner"), "created_by_id", "left")
        .join(named("assigned_to_user_id", "assigned_user"), "assigned_to_user_id", "left")
        .join(named("application_user_id", "application_created_by"), "application_user_id", "left")
        .join(rep, "customer_id", "left")
        .withColumn("equipment_count", default_to(F.col("equipment_count"), 0, "bigint"))
    )


@view
def origin_dates(w):
    """First commenced start among the contracts of a sequence number, on each of them.

    An unknown start is replaced by the contract's own first processed day.
    """
    started = w("dim_contract").filter(F.col("status") == "Commenced")
    per_sequence = started.groupBy(F.col("sequence_number").alias("_sequence")).agg(F.min("start_date").alias("start"))
    per_contract = started.groupBy(F.col("bk_contract_id").alias("contract_id"), "sequence_number").agg(
        F.min("dp_process_date").alias("processed")
    )
    both = per_contract.join(per_sequence, F.col("sequence_number").eqNullSafe(F.col("_sequence")))
    first = both.groupBy("contract_id").agg(F.min("start").alias("start"), F.min("processed").alias("processed"))
    return first.select(
        "contract_id", F.when(F.col("start") == F.lit(UNKNOWN_START), F.col("processed")).otherwise(F.col("start")).alias("lease_start_date")
    )


@view
def contract_totals(w):
    """Sums over the approved assets of each contract."""
    return _totals(lease_assets_all(w))


def _totals(leases):
    return leases.groupBy("contract_id").agg(
        F.sum("nbv_amount").alias("total_nbv_amount"),
        F.sum("customer_cost_amount").alias("customer_cost_amount"),
        F.sum("rent_amount").alias("rent_amount"),
        F.sum("asset_budget_value").alias("asset_budget_value"),
        F.sum("total_charge").alias("total_charge"),
        F.count(F.lit(1)).alias("number_of_assets"),
    )


@view
def balloons(w):
    """Balloon payment of each opportunity's latest credit profile."""
    opportunity = w.current("dim_opportunity").select("bk_opportunity_id", F.col("number").alias("opportunity_number"))
    profile = w.current("dim_credit_profile").select(F.col("opportunity_id").alias("bk_opportunity_id"), F.col("bk_credit_profile_id").alias("credit_profile_id"))
    structure = w.current("dim_approved_structure").filter(F.col("number") == 1).select("credit_profile_id", "balloon_amount")
    rows = opportunity.join(profile, "bk_opportunity_id").join(structure, "credit_profile_id")
    return versions.first_per_key(rows, ["opportunity_number"], F.col("credit_profile_id").desc()).select("opportunity_number", "balloon_amount")


@view
def contract_core(w):
    """Current contract with its current finance version."""
    return _core(w, finance_detail(w))


def _core(w, detail):
    contract = current_contracts(w).select(
        "contract_id", "contract_number", "contract_type", "status", "report_status", "opportunity_number", "deal_product_type_id",
        "cost_center_id", "created_by_id", "created_time", "grace_delinquency_days", "previous_schedule_number",
    )
    detail = detail.drop("is_over_term_lease", "interest_rate_detail_id", "sk_lease_interest_rate", "sk_customer", "sk_cost_center")
    return detail.withColumnRenamed("rent_amount", "lease_rent_amount").join(contract, "contract_id")


def _assigned(w, system_name, out):
    return contract_assignments(w).filter(F.col("system_name") == system_name).select("contract_id", F.col("employee_name").alias(out))


def _terms(w):
    names = ["is_advance", "is_over_term_lease", "payment_frequency", "customer_term_in_months", "term_in_months", "approval_status", "lease_contract_type"]
    method = F.when(F.col("is_advance") == 1, "Advance").otherwise("Arrears").alias("payment_method")
    return w("dim_lease_finance").select("sk_lease_finance", *names, method)


def _opportunity(w):
    return w.current("dim_opportunity").select(F.col("number").alias("opportunity_number"), F.lit("No").alias("is_migrated"))


# What a report can add to a contract: the frame to join and its key.
PARTS = {
    "start": (origin_dates, "contract_id"),
    "totals": (contract_totals, "contract_id"),
    "customer": (
        lambda w: current_customers(w).select("customer_id", "party_name", "company_name", "external_reference_id", "business_type_id", "sic_code_id"),
        "customer_id",
    ),
    "migrated": (_opportunity, "opportunity_number"),
    "creator": (lambda w: lookup(w, "dim_user", "bk_user_id", "created_by_id", contract_created_by="full_name"), "created_by_id"),
    "sales_rep": (lambda w: _assigned(w, "SalesRep", "sales_rep"), "contract_id"),
    "account_manager": (lambda w: _assigned(w, "AccountManager", "account_manager"), "contract_id"),
    "product": (products, "deal_product_type_id"),
    "cost_center": (cost_centers, "cost_center_id"),
    "legal_entity": (lambda w: lookup(w, "dim_legal_entity", "sk_legal_entity", "sk_legal_entity", legal_entity_number="legal_entity_number"), "sk_legal_entity"),
    "line_of_business": (lambda w: lookup(w, "dim_line_of_business", "sk_line_of_business", "sk_line_of_business", line_of_business="name"), "sk_line_of_business"),
    "branch": (lambda w: lookup(w, "dim_branch", "sk_branch", "sk_branch", branch_name="branch_name"), "sk_branch"),
    "business_type": (lambda w: lookup(w, "dim_business_type", "bk_business_type_id", "business_type_id", business_type="name"), "business_type_id"),
    "sic": (lambda w: lookup(w, "dim_classification_code", "bk_classification_code_id", "sic_code_id", sic_code="code", sic_description="description"), "sic_code_id"),
    "terms": (_terms, "sk_lease_finance"),
    "balloon": (balloons, "opportunity_number"),
}
DAYS = {
    "commencement": ("sk_date_commencement_date", "commencement_date"),
    "maturity": ("sk_date_maturity_date", "maturity_date"),
    "created": ("sk_created_date", "created_date"),
}


def contracts_with(w, *parts, chosen=None):
    """Contracts with the parts a report needs; parts it does not name cost no join.

    Parts of one key follow each other, those of the contract first, so contracts are shuffled once for each key and not for
    each part. ``chosen``, a frame of ``contract_id``: these contracts alone, the finance records of others leave at the first join.
    """
    rows = contract_core(w) if chosen is None else _core(w, finance_detail_of(w, chosen))

    def key_of(part):
        return "contract_id" if part == "created" else DAYS[part][0] if part in DAYS else PARTS[part][1]

    keys = list(dict.fromkeys(["contract_id", *map(key_of, parts)]))
    for part in sorted(parts, key=lambda p: keys.index(key_of(p))):
        if part == "created":
            rows = rows.join(first_records(w), "contract_id", "left")
        if part in DAYS:
            rows = with_day(w, rows, *DAYS[part])
        else:
            frame, key = PARTS[part]
            made = frame(w) if part != "totals" or chosen is None else _totals(lease_assets_of(w, chosen, few=False))
            rows = rows.join(made, key, "left")
    if "migrated" in parts:
        rows = rows.withColumn("is_migrated", F.coalesce("is_migrated", F.lit("Yes")))
    return rows


@view
def lease_contracts(w):
    """Wide contract row: finance, people, first start, asset totals, migrated flag, days."""
    return contracts_with(w, *PARTS, *DAYS)


APPLIED = ("pending", "datagathering", "creditanalysis", "amendment", "approved")


@view
def application_states(w):
    """Applications that are still on their way, with what decides it: three statuses, a stage and a day."""
    profile = w.current("dim_credit_profile").select(
        "opportunity_id", F.col("bk_credit_profile_id").alias("credit_profile_id"), F.col("status").alias("loc_status")
    )
    application = w.current("dim_credit_application").select(
        F.col("bk_credit_application_id").alias("opportunity_id"), F.col("status").alias("application_status"), F.col("created_time").alias("application_created")
    )
    opportunity = w.current("dim_opportunity").select(F.col("bk_opportunity_id").alias("opportunity_id"), F.col("number").alias("opportunity_number"))
    lease = contract_core(w).filter(F.col("opportunity_number").isNotNull()).select("opportunity_number", F.col("status").alias("lease_status"))
    rows = opportunity.join(profile, "opportunity_id", "left").join(application, "opportunity_id", "left").join(lease, "opportunity_number", "left")
    app, loc, booked = F.lower("application_status"), F.lower("loc_status"), F.lower("lease_status")
    keep = (
        (app == "pending")
        | ((app == "submittedtocredit") & loc.isin(*APPLIED[:-1]))
        | ((loc == "approved") & (booked.isin("installingassets", "pending") | F.col("lease_status").isNull()))
    )
    stage = F.coalesce(
        F.when(F.col("lease_status").isNotNull(), F.lit("Pre-Contract")),
        F.when(F.col("loc_status").isNotNull(), F.lit("Line of Credit")),
        F.when(F.col("application_status").isNotNull(), F.lit("Credit App")),
        F.lit("Unknown"),
    )
    return rows.filter(keep).withColumn("application_stage", stage)


@view
def applied_assets(w):
    """Assets of those applications, each pair once, from the credit profile or from the application."""
    states = application_states(w)
    by_profile = states.filter(F.lower("loc_status").isin(*APPLIED)).join(
        w.current("dim_profile_asset").select("credit_profile_id", "asset_id"), "credit_profile_id"
    )
    by_application = states.filter(F.lower("application_status") == "pending").join(
        w.current("dim_application_asset").select(F.col("credit_application_id").alias("opportunity_id"), "asset_id"), "opportunity_id"
    )
    return by_profile.unionByName(by_application).distinct()


@view
def assets_in_application(w):
    """Assets of open applications with their stage, numbered from the latest application.

    The pairs are numbered first, the wide columns are joined afterwards.
    """
    numbered = ordered_columns(
        applied_assets(w), ["asset_id"], ["application_created", "opportunity_id"], reverse_ordinal="latest_application"
    )
    wide = credit_applications(w).select(
        "opportunity_id", "credit_profile_number", "product_name", "company_name", "legal_entity", "application_created_by"
    )
    sheet = asset_sheet(w).select("asset_id", "alias", "asset_status", "make_name", "model_name", "asset_sub_type")
    return numbered.join(wide, "opportunity_id", "left").join(sheet, "asset_id", "left")


@view
def assets_in_application_latest(w):
    """Only the latest application of each asset."""
    order = F.col("application_created").desc(), F.col("opportunity_id").desc()
    return versions.first_per_key(applied_assets(w), ["asset_id"], *order)


def rental_fleet(w):
    """Assets for rental that have not been sold."""
    return asset_sheet(w).filter(
        (F.col("asset_contract_type") == "Rental") & F.col("asset_status").isin("Leased", "Inventory", "AwaitingDelivery")
    )


def rentals_of(w, sheet, contract):
    """Assets of a rental sheet with lease, application and utilisation; ``contract`` has their contracts.

    Leases and applications are read for these assets alone.
    """
    own = of_assets(w, sheet)
    lease = lease_assets_live(own).filter(F.col("contract_status").isin("Pending", "Commenced", "InstallingAssets")).select(
        "asset_id", "contract_id", "rent_amount", "total_charge"
    )
    contract = contract.withColumnsRenamed({"product_name": "lease_product", "status": "lease_status"})
    app = in_application_once(own).select("asset_id", F.col("stage").alias("application_stage"), F.col("opp_number").alias("application_id"))
    rows = attach_many(sheet.join(app, "asset_id", "left"), lease, ["asset_id"])
    rows = split_join(rows, contract, ["contract_id"], "left")
    leased = (F.col("asset_status") == "Leased") & (F.lower("lease_status") == "commenced")
    free = leased & (F.col("lease_product") == "Rental") & is_free(F.col("total_charge"))
    return rows.withColumn("utilised", utilisation(free, leased, F.col("application_stage").isNotNull()))


@view
def asset_rentals(w):
    """Rental fleet with its utilisation."""
    contract = contracts_with(w, "customer", "branch", "product", "migrated", "terms", "cost_center", "commencement", "maturity").select(
        "contract_id", "company_name", "branch_name", "sequence_number", "product_name", "is_migrated", "status", "commencement_date",
        "maturity_date", "customer_term_in_months", "cost_center",
    )
    return rentals_of(w, rental_fleet(w), contract)


@view
def payment_schedule(w):
    return w.active("dim_payment_schedule").withColumnRenamed("lease_finance_detail_id", "lease_finance_id")


@view
def payment_heads(w):
    """Contract data that every payment of a schedule carries; contracts without all three days have none."""
    finance = w("dim_lease_finance").select("sk_lease_finance", "is_advance", "payment_frequency", "approval_status", "term_in_months")
    detail = finance_detail(w).select(
        "contract_id", "sk_lease_finance", "lease_finance_id", "sk_date_post_date", "sk_date_maturity_date", "sk_date_commencement_date", "customer_id"
    )
    detail = with_day(w, detail, "sk_date_post_date", "post_date", "inner")
    detail = with_day(w, detail, "sk_date_maturity_date", "maturity_date", "inner")
    detail = with_day(w, detail, "sk_date_commencement_date", "commencement_date", "inner")
    contract = current_contracts(w).select("contract_id", "sequence_number", "status", "report_status", "deal_product_type_id")
    return (
        detail.join(finance, "sk_lease_finance")
        .join(contract, "contract_id")
        .join(current_customers(w).select("customer_id", "company_name"), "customer_id")
        .join(products(w), "deal_product_type_id")
    )


@view
def lease_payments(w):
    """Payment schedule of each contract, numbered from the first.

    A contract has one current finance version, so rows are numbered per finance version before the join.
    """
    numbered = ordered_columns(
        payment_schedule(w), ["lease_finance_id"], ["sk_payment_schedule"], ordinal="schedule_number"
    )
    return numbered.join(payment_heads(w), "lease_finance_id")


@view
def first_payments(w):
    """Balance at the first payment of each finance version."""
    return payment_schedule(w).groupBy("lease_finance_id").agg(
        F.min_by("begin_balance_amount", "sk_payment_schedule").alias("begin_balance_amount")
    )


def origination_of(w, *parts):
    """Commenced contracts with first payment, yield = base rate + spread, and these parts.

    Leases, charges and finance of other contracts leave before they meet anything else.
    """
    kept = ~F.col("sequence_number").like("00%") & (F.lower("status") == "commenced")
    chosen = current_contracts(w).filter(F.lower("status") == "commenced").select("contract_id")
    rows = contracts_with(w, *parts, chosen=chosen).filter(kept)
    return rows.join(first_payments(w), "lease_finance_id", "left").withColumn("yield", F.col("base_rate") + F.col("spread"))


@view
def contract_origination(w):
    return origination_of(w, *PARTS, *DAYS)


@view
def payment_vat_deferrals(w):
    """Deferred-tax payments after the first due day, numbered from the latest."""
    payments = payment_schedule(w).select("lease_finance_id", "due_date", "deferred_tax_amount", "sk_payment_schedule")
    first = payments.groupBy("lease_finance_id").agg(F.min("due_date").alias("first_due"))
    taxed = payments.filter(F.col("deferred_tax_amount") != 0)
    later = taxed.join(first, "lease_finance_id").filter(F.col("due_date") != F.col("first_due")).drop("first_due")
    numbered = ordered_columns(
        later, ["lease_finance_id"], ["due_date", "sk_payment_schedule"], reverse_ordinal="latest_due_date"
    )
    return numbered.join(payment_heads(w).select("lease_finance_id", "contract_id"), "lease_finance_id")


@view
def payments_to_date(w):
    """Payments due by the as-of day, numbered from both ends."""
    due = payment_schedule(w).filter(on_or_before(F.col("due_date"), w.as_of))
    numbered = ordered_columns(
        due, ["lease_finance_id"], ["sk_payment_schedule"], ordinal="initial_schedule", reverse_ordinal="latest_schedule"
    )
    return numbered.join(payment_heads(w), "lease_finance_id")
