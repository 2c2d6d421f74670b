"""Receipts, invoices, receivables, customers and one-off charges."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.functions.dates import month_steps
from rentroll.lease.contracts import contract_totals, customer_assignments, finance_detail
from rentroll.lease.parts import current_contracts, current_customers, lookup, products, with_day
from rentroll.lease.warehouse import view
from rentroll.operators import versions
from rentroll.operators.hot import split_join


@view
def receipts(w):
    """Receipts with users, legal entity and type; creator and updater are two roles of one dimension."""
    user = lookup(w, "dim_user", "bk_user_id", "user_id", full_name="full_name")

    def named(key, out):
        return user.select(F.col("user_id").alias(key), F.col("full_name").alias(out))

    return (
        w.current("dim_receipt")
        .join(named("created_by_id", "created_by"), "created_by_id", "left")
        .join(named("updated_by_id", "updated_by"), "updated_by_id", "left")
        .join(lookup(w, "dim_legal_entity", "bk_legal_entity_id", "legal_entity_id", legal_entity="name"), "legal_entity_id", "left")
        .join(lookup(w, "dim_receipt_type", "bk_receipt_type_id", "type_id", receipt_type="receipt_type_name"), "type_id", "left")
    )


def _invoice_details(w, facts):
    """Latest detail row of each invoice with days since due.

    Details of unknown contracts are dropped before they meet the facts; what a contract shows joins the latest rows alone. So
    do the versions of an invoice: each of them sends its latest row only, and their texts are in no other shuffle of the facts.
    """
    old = w("dim_receivable_invoice").select("sk_receivable_invoice", "bk_receivable_invoice_id", F.col("number").alias("invoice_number"))
    now = w.current("dim_receivable_invoice").select("bk_receivable_invoice_id", "days_late_count")
    detail = w.current("dim_invoice_detail").select(
        "sk_invoice_detail", "entity_type", F.col("entity_id").alias("contract_id"), F.col("sequence_number").alias("invoice_sequence")
    )
    contract = current_contracts(w).select("sk_contract", "contract_id", "sequence_number", F.col("status").alias("contract_status"), "deal_product_type_id")
    contract = versions.first_per_key(contract.join(products(w), "deal_product_type_id"), ["contract_id"], F.col("sk_contract").desc()).drop("sk_contract")
    lease = finance_detail(w).select("contract_id", "sk_branch", "customer_id")
    receivable = w("dim_receivable").select("sk_receivable", F.col("bk_receivable_id").alias("receivable_id"))
    kind = lookup(w, "dim_receivable_type", "sk_receivable_type", "sk_receivable_type", receivable_type="name")
    rows = with_day(w, facts, "sk_due_date", "due_date", "inner")
    rows = (
        with_day(w, rows, "sk_invoice_run_date", "invoice_date", "inner")
        .join(kind, "sk_receivable_type", "left_semi")
        .join(detail.join(contract.select("contract_id"), "contract_id"), "sk_invoice_detail")
        .join(receivable, "sk_receivable")
    )
    order = F.col("sk_date_record").desc(), F.col("sk_time_record").desc()
    rows = versions.first_per_key(rows, ["sk_receivable_invoice"], *order).join(old, "sk_receivable_invoice").join(kind, "sk_receivable_type")
    latest = versions.first_per_key(rows, ["bk_receivable_invoice_id"], *order).drop("sk_customer")
    customer = current_customers(w).select("customer_id", F.col("company_name").alias("customer_name"), F.col("external_reference_id").alias("customer_number"))
    return (
        split_join(latest.join(now, "bk_receivable_invoice_id"), contract.join(lease, "contract_id", "left"), ["contract_id"])
        .join(lookup(w, "dim_branch", "sk_branch", "sk_branch", branch_name="branch_name"), "sk_branch", "left")
        .join(customer, "customer_id", "left")
        .withColumn("days_since_due", F.datediff(F.lit(w.as_of), F.col("due_date")))
    )


@view
def invoice_details(w):
    return _invoice_details(w, w("fact_receivable_invoice_detail"))


@view
def invoice_details_once(w):
    """The same for a report that reads the facts nowhere else: no copy of them is made."""
    return _invoice_details(w, w.scan("fact_receivable_invoice_detail"))


SUMS = ["balance_amount", "tax_balance_amount", "effective_balance_amount", "invoice_amount", "tax_amount"]


def _summed(df, keys, *more):
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.max("days_late_count").alias("days_late_count"),
        F.max("days_since_due").alias("days_since_due"),
        *more,
    )


@view
def invoices(w):
    """Sums and worst lateness per invoice."""
    keys = [
        "bk_receivable_invoice_id", "invoice_number", "customer_id", "customer_name", "customer_number", "contract_id", "sequence_number",
        "contract_status", "branch_name", "entity_type", "due_date", "product_name", "receivable_type", "invoice_date",
    ]
    return _summed(invoice_details_once(w), keys)


@view
def receivables(w):
    """Sums per receivable."""
    keys = [
        "receivable_id", "bk_receivable_invoice_id", "invoice_number", "customer_id", "contract_id", "sequence_number", "due_date",
        "product_name", "receivable_type", "invoice_date",
    ]
    return _summed(invoice_details_once(w), keys)


@view
def lease_receivables(w):
    """Contract sums with the next due day; contracts without a coming due day are left out.

    Sums and next day come from one pass over the invoices; the window holds the few rows of one contract.
    """
    keys = ["contract_id", "sequence_number", "customer_id", "customer_name", "product_name"]
    coming = F.when(F.col("due_date") > F.lit(w.as_of), F.col("due_date"))
    summed = _summed(invoice_details(w).filter(F.col("contract_id").isNotNull()), keys, F.min(coming).alias("_coming"))
    late = F.when(F.col("effective_balance_amount") > 0, F.col("days_late_count")).otherwise(0)
    soonest = F.min("_coming").over(Window.partitionBy("contract_id"))
    rows = summed.withColumn("next_due", soonest).filter(F.col("next_due").isNotNull())
    return rows.drop("_coming").withColumn("days_past_due", late)


@view
def customer_receivables(w):
    return lease_receivables(w).groupBy("customer_id").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum("days_late_count").alias("days_late_count")
    )


@view
def latest_exposure(w):
    """Latest proposed exposure per customer next to the summary exposure."""
    summary = w.current("dim_credit_summary_exposure").filter(F.col("exposure_type") == "EF").select(
        "customer_id", "primary_customer_amount", "direct_amount", "indirect_amount"
    )
    proposed = versions.first_per_key(
        w.active("dim_customer_exposure"), ["exposure_customer_id"], F.col("exposure_date").desc(), F.col("bk_customer_exposure_id").desc()
    ).select(
        F.col("exposure_customer_id").alias("customer_id"), F.col("bk_customer_exposure_id").alias("exposure_id"), "exposure_date", "total_proposed_exposure"
    )
    joined = proposed.join(summary, "customer_id")
    return joined.withColumns(
        {
            "group_exposure": F.col("direct_amount") + F.col("indirect_amount") + F.col("primary_customer_amount"),
            "proposed_exposure": F.col("total_proposed_exposure") + F.col("primary_customer_amount"),
        }
    )


@view
def latest_policy(w):
    """Insurance policy last activated per customer."""
    order = F.col("activation_date").desc(), F.col("bk_insurance_policy_id").desc()
    return versions.first_per_key(w.active("dim_insurance_policy"), ["customer_id"], *order)


@view
def customers(w):
    """Customer with exposure, policy, arrears and lease totals."""
    summary = w.current("dim_credit_summary_exposure").filter(F.col("exposure_type") == "EF").select("customer_id", "primary_customer_amount")
    exposure = latest_exposure(w).select("customer_id", "exposure_id", "total_proposed_exposure")
    policy = latest_policy(w).select(
        "customer_id", F.col("expiration_date").alias("policy_expiration_date"), F.col("type").alias("policy_type"), "policy_number"
    )
    code = lookup(w, "dim_classification_code", "bk_classification_code_id", "sic_code_id", sic_code="code", sic_description="description")
    rep = customer_assignments(w).filter(F.col("system_name") == "SalesRep").select("customer_id", F.col("employee_name").alias("account_manager"))
    owed = customer_receivables(w).select("customer_id", "effective_balance_amount")
    held = finance_detail(w).select("contract_id", "customer_id", "total_yield").join(contract_totals(w), "contract_id", "left")
    leases = held.groupBy("customer_id").agg(
        F.sum("total_nbv_amount").alias("total_nbv_amount"),
        F.sum("rent_amount").alias("rent_amount"),
        F.sum("total_charge").alias("total_charge"),
        F.sum("number_of_assets").alias("number_of_assets"),
        (F.sum("total_yield").cast("double") / F.count("total_yield")).alias("yield"),
    )
    return (
        current_customers(w)
        .join(summary, "customer_id")
        .join(exposure, "customer_id", "left")
        .join(policy, "customer_id", "left")
        .join(code, "sic_code_id", "left")
        .join(rep, "customer_id", "left")
        .join(owed, "customer_id", "left")
        .join(leases, "customer_id", "left")
        .withColumn("months_to_review", month_steps(F.lit(w.as_of), F.col("next_review_date")))
    )


@view
def sundry(w):
    """One-off charges with code, contract, customer, tax and the balance invoiced."""
    code = lookup(w, "dim_receivable_code", "bk_receivable_code_id", "receivable_code_id", charge_name="name")
    contract = current_contracts(w).select("contract_id", "sequence_number", "contract_number", "deal_product_type_id").join(
        products(w), "deal_product_type_id", "left"
    )
    customer = current_customers(w).select("customer_id", "company_name")
    tax = w.current("dim_receivable_tax").select("receivable_id", F.col("balance_amount").alias("tax_balance"))
    invoiced = receivables(w).select("receivable_id", "invoice_number", "receivable_type", "balance_amount", F.col("due_date").alias("invoice_due_date"))
    return (
        w.current("dim_sundry")
        .join(code, "receivable_code_id", "left")
        .join(contract, "contract_id", "left")
        .join(customer, "customer_id", "left")
        .join(tax, "receivable_id", "left")
        .join(invoiced, "receivable_id", "left")
        .withColumns(
            {
                "total_due": F.col("amount") + F.col("vat_amount"),
                "total_balance": F.col("tax_balance") + F.col("balance_amount"),
            }
        )
    )


@view
def sundry_details(w):
    """Active one-off charges with their asset, fee names, tax and total due."""
    recharge = w.active("dim_receivable_code").select(F.col("bk_receivable_code_id").alias("receivable_code_id"), F.col("name").alias("recharge_fee_name"))
    expense = lookup(w, "dim_payable_code", "bk_payable_code_id", "payable_code_id", expense_fee_name="name")
    tax = w.active("dim_receivable_tax").select("receivable_id", F.col("balance_amount").alias("tax_balance"))
    customer = current_customers(w).select("customer_id", "company_name")
    asset = w.active("dim_sundry_detail").select(F.col("sundry_id").alias("bk_sundry_id"), "asset_id")
    return (
        w.active("dim_sundry")
        .join(recharge, "receivable_code_id", "left")
        .join(expense, "payable_code_id", "left")
        .join(tax, "receivable_id", "left")
        .join(customer, "customer_id", "left")
        .join(asset, "bk_sundry_id", "left")
        .withColumn("total_due", F.col("amount") + F.col("vat_amount"))
        .distinct()
    )


@view
def recurring_charges(w):
    """Recurring charges with code and contract."""
    code = lookup(w, "dim_receivable_code", "bk_receivable_code_id", "receivable_code_id", charge_name="name")
    contract = current_contracts(w).select("contract_id", "sequence_number")
    return w.current("dim_sundry_recurring").join(code, "receivable_code_id", "left").join(contract, "contract_id", "left").distinct()


@view
def recurring_charge_details(w):
    """Payment details of recurring charges that stem from an additional charge of the lease."""
    head = recurring_charges(w).select(F.col("bk_sundry_recurring_id").alias("sundry_recurring_id"), "contract_id", "sequence_number", "charge_name")
    link = w.current("dim_lease_finance_charge").select(F.col("recurring_sundry_id").alias("sundry_recurring_id"), "additional_charge_id")
    extra = lookup(w, "dim_additional_charge", "bk_additional_charge_id", "additional_charge_id", additional_amount="amount")
    return w.current("dim_recurring_detail").join(head, "sundry_recurring_id").join(link.join(extra, "additional_charge_id"), "sundry_recurring_id")


@view
def recurring_schedule(w):
    return w.current("dim_recurring_schedule")
