"""Finance reports and their checks."""

from rentroll.lease import finance
from rentroll.plans.lease.base import DAY
from rentroll.plans.lease.fixture import VIEWS, lease_query


def dbl(*columns, source=""):
    return ", ".join(f"CAST({source}{c} AS DOUBLE) AS {c}" for c in columns)


MONTH = "date_trunc('month', due_date) = DATE '2001-06-01'"
VIEWS |= {
    "v_month_end": f"""SELECT lease_finance_detail_id AS lease_finance_id, end_balance_amount AS month_end_balance FROM dim_payment_schedule WHERE payment_type = 'FixedTerm' AND {MONTH}
        QUALIFY row_number() OVER (PARTITION BY lease_finance_detail_id ORDER BY due_date DESC, end_balance_amount DESC, sk_payment_schedule DESC) = 1""",
    "v_next_payment": f"SELECT lease_finance_detail_id AS lease_finance_id, MIN(due_date) AS next_due FROM dim_payment_schedule WHERE payment_type IN ('FixedTerm', 'OTP') AND due_date > {DAY} GROUP BY 1",
    "v_bills": f"""SELECT d.entity_id AS contract_id, SUM(f.invoice_amount) AS bills_due, CAST(GREATEST(date_diff('day', MIN(r.due_date), {DAY}), 0) AS INTEGER) AS days_late FROM fact_receivable_invoice_detail f
        JOIN dim_invoice_detail d USING (sk_invoice_detail) JOIN dim_receivable r USING (sk_receivable) JOIN dim_receivable_category g USING (sk_receivable_category)
        WHERE d.entity_type = 'CT' AND COALESCE(f.effective_balance_amount, f.tax_balance_amount) > 0 AND r.due_date <= {DAY} AND f.invoice_amount > 0 AND g.name = 'Rental' GROUP BY 1""",
    "v_month_charges": f"""SELECT s.contract_id, d.asset_id, SUM(d.amount) AS month_charge FROM dim_sundry_recurring s JOIN dim_recurring_detail d ON d.sundry_recurring_id = s.bk_sundry_recurring_id
        JOIN dim_receivable_code c ON c.bk_receivable_code_id = s.receivable_code_id
        JOIN (SELECT DISTINCT sundry_recurring_id, due_date FROM dim_recurring_schedule WHERE is_active = 1 AND {MONTH}) p ON p.sundry_recurring_id = s.bk_sundry_recurring_id GROUP BY ALL""",
    "v_loans": """SELECT x.contract_id, x.asset_id, f.party_number, f.company_name, f.sequence_number, f.commencement_date, f.maturity_date, b.name AS account_legal_entity, concat(s.code, ' - ', s.description) AS sic_description,
            f.customer_term_in_months, f.payment_frequency, f.product_name, CAST(CAST(ROUND(f.total_yield * 100, 2) AS DECIMAL(10,2)) AS DOUBLE) AS yield, x.rent_amount, x.nbv_amount, v.cost AS net_value, m.month_charge,
            COALESCE(x.rent_amount, 0) + COALESCE(m.month_charge, 0) AS charge_to_customer, e.month_end_balance, n.next_due, i.days_late, i.bills_due,
            CAST(CASE WHEN i.days_late IS NOT NULL THEN GREATEST(i.days_late - f.grace_delinquency_days, 0) END AS INTEGER) AS days_late_for_arrears
        FROM (SELECT k.bk_contract_id AS contract_id, a.bk_asset_id AS asset_id, l.* FROM fact_lease_asset l JOIN dim_contract k ON k.sk_contract = l.sk_contract AND k.current_flag = 1 AND k.status = 'Commenced'
            JOIN dim_lease_finance g ON g.sk_lease_finance = l.sk_lease_finance AND g.is_current = 1 AND g.current_flag = 1 JOIN dim_lease_asset q ON q.sk_lease_asset = l.sk_lease_asset AND q.is_approved = 1
            JOIN dim_asset a ON a.sk_asset = l.sk_asset AND a.current_flag = 1 JOIN dim_customer c ON c.sk_customer = l.sk_customer AND c.current_flag = 1
            LEFT JOIN v_status_latest t ON t.asset_id = a.bk_asset_id LEFT JOIN dim_asset_status y ON y.sk_asset_status = t.sk_asset_status
            LEFT JOIN dim_additional_details z ON z.bk_additional_details_id = a.bk_asset_id AND z.current_flag = 1 LEFT JOIN dim_detail_config w ON w.bk_detail_config_id = z.asset_sub_type_id
            WHERE l.sk_date_termination_date = -1 AND (y.asset_status IS NULL OR y.asset_status = 'Leased') AND (w.value IS NULL OR w.value NOT IN ('Company Car', 'Company Owned Asset', 'Fleet Managed Asset', 'No Liability Asset', 'Purchase for Resale'))) x
        JOIN v_finance_latest f ON f.contract_id = x.contract_id AND f.status = 'Commenced' AND f.customer_is_current = 1 LEFT JOIN dim_classification_code s ON s.bk_classification_code_id = f.sic_code_id
        LEFT JOIN dim_business_type b ON b.bk_business_type_id = f.business_type_id LEFT JOIN v_asset_value v ON v.asset_id = x.asset_id LEFT JOIN v_month_charges m ON m.contract_id = x.contract_id AND m.asset_id = x.asset_id
        LEFT JOIN v_month_end e ON e.lease_finance_id = f.lease_finance_id LEFT JOIN v_next_payment n ON n.lease_finance_id = f.lease_finance_id LEFT JOIN v_bills i ON i.contract_id = x.contract_id""",
    "v_latest_lease": """SELECT l.asset_id, l.contract_id, d.bk_date AS terminated_on, l.nbv_amount, l.customer_cost_amount, l.rent_amount, b.branch_name
        FROM (SELECT * FROM v_leased_all WHERE contract_status <> 'Inactive' QUALIFY row_number() OVER (PARTITION BY contract_id, asset_id ORDER BY sk_date_record DESC, sk_time_record DESC, sk_lease_asset DESC) = 1) l
        LEFT JOIN dim_date d ON d.sk_date = l.sk_date_termination_date LEFT JOIN dim_branch b ON b.sk_branch = l.sk_branch
        QUALIFY row_number() OVER (PARTITION BY l.asset_id ORDER BY d.bk_date DESC NULLS LAST, l.contract_id DESC) = 1""",
    "v_latest_live": """SELECT l.asset_id, l.contract_id, d.bk_date AS terminated_on, l.rent_amount
        FROM (SELECT * FROM v_leased_all WHERE contract_status <> 'Inactive' QUALIFY row_number() OVER (PARTITION BY contract_id, asset_id ORDER BY sk_date_record DESC, sk_time_record DESC, sk_lease_asset DESC) = 1) l
        JOIN dim_date d ON d.sk_date = l.sk_date_termination_date WHERE d.bk_date = DATE '9999-01-01' QUALIFY row_number() OVER (PARTITION BY l.asset_id ORDER BY l.contract_id DESC) = 1""",
    "v_asset_facts": """SELECT c.bk_contract_id AS contract_id, a.bk_asset_id AS asset_id, g.bk_lease_finance_id AS lease_finance_id, d.bk_date AS terminated_on, f.rent_amount, f.nbv_amount
        FROM fact_lease_asset f JOIN dim_contract c USING (sk_contract) JOIN dim_asset a USING (sk_asset) JOIN dim_lease_finance g USING (sk_lease_finance) LEFT JOIN dim_date d ON d.sk_date = f.sk_date_termination_date
        QUALIFY row_number() OVER (PARTITION BY c.bk_contract_id, a.bk_asset_id, g.bk_lease_finance_id ORDER BY f.sk_contract DESC, f.sk_lease_finance DESC, f.sk_asset DESC, f.sk_date_record DESC, f.sk_time_record DESC) = 1""",
    "v_moves": f"""SELECT d.asset_id, p.due_date AS day, 'budget' AS kind, d.amount FROM dim_sundry_recurring s JOIN dim_recurring_detail d ON d.sundry_recurring_id = s.bk_sundry_recurring_id
            JOIN dim_receivable_code c ON c.bk_receivable_code_id = s.receivable_code_id JOIN dim_asset a ON a.bk_asset_id = d.asset_id AND a.current_flag = 1
            JOIN (SELECT DISTINCT sundry_recurring_id, due_date FROM dim_recurring_schedule WHERE is_active = 1 AND due_date <= {DAY}) p ON p.sundry_recurring_id = s.bk_sundry_recurring_id
        UNION ALL SELECT x.asset_id, CASE x.sundry_type WHEN 'PayableOnly' THEN x.payable_due_date WHEN 'ReceivableOnly' THEN x.receivable_due_date END, CASE x.sundry_type WHEN 'PayableOnly' THEN 'expense' WHEN 'ReceivableOnly' THEN 'recharge' END, x.amount
            FROM v_sundry_details x JOIN dim_asset a ON a.bk_asset_id = x.asset_id AND a.current_flag = 1""",
}
ORIGIN = "total_nbv_amount - total_down_payment_amount - tax_deferral_amount"
lease_query("contracts_origination", "V072 M01 F04", finance.contracts_origination, f"""
    SELECT contract_id, sequence_number, opportunity_number, company_name, {dbl("yield", "total_yield")}, cost_center, sales_rep, product_name, commencement_date, maturity_date, CAST({ORIGIN} AS DOUBLE) AS origination_amount, {dbl("balloon_amount")}
    FROM v_origination""")
lease_query("earlier_origination", "V110 M01 C01 K03", finance.earlier_origination, f"""
    SELECT contract_id, sequence_number, product_name, lease_start_date, {dbl("begin_balance_amount")}, CAST(CASE WHEN product_name = 'Hire Purchase' THEN {ORIGIN} ELSE total_nbv_amount END AS DOUBLE) AS origination_amount,
        number_of_assets, is_migrated FROM v_origination""")
lease_query("income_streams", "V075 A09 J02 P04", finance.income_streams, f"""
    SELECT DISTINCT p.sequence_number, p.company_name, p.product_name, p.sk_payment_schedule, p.due_date, {dbl("amount", "interest_amount", "end_balance_amount", source="p.")}, d.due_date AS vat_date, CAST(d.tax AS DOUBLE) AS deferred_tax,
        CASE WHEN p.is_advance = 1 THEN 'ADVANCE' ELSE 'ARREARS' END AS payment_method FROM v_payments p LEFT JOIN (SELECT contract_id, due_date, MAX(deferred_tax_amount) AS tax FROM v_vat_deferrals GROUP BY ALL) d USING (contract_id, due_date)
    WHERE lower(p.status) = 'commenced' AND p.product_code IN ('HP', 'FL')""")
lease_query("funder_contracts", "V043 W01 W12 A04 M02 F01 J13", finance.funder_contracts, f"""
    SELECT f.contract_id, f.sequence_number, f.commencement_date, f.maturity_date, f.party_name, s.code || ' - ' || s.description AS sic_description, f.product_name, f.line_of_business, CAST(ROUND(f.total_yield * 100, 2) AS DOUBLE) AS total_yield,
        {dbl("net_investment_amount", source="f.")}, {dbl("remaining_amount", "financed_amount", source="r.")}, r.income_date, n.next_due
    FROM v_finance_latest f LEFT JOIN dim_classification_code s ON s.bk_classification_code_id = f.sic_code_id LEFT JOIN (SELECT * FROM dim_remaining_investment QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY income_date DESC) = 1) r ON r.contract_id = f.contract_id
    LEFT JOIN v_next_payment n ON n.lease_finance_id = f.lease_finance_id WHERE f.status = 'Commenced' AND f.customer_is_current = 1""")
lease_query("funder_customers", "V044 F01 P05", finance.funder_customers, f"""
    SELECT party_number, sic_code || ' - ' || sic_description AS sic_code, party_name, creation_date, next_review_date, credit_score, {dbl("primary_customer_amount", "total_nbv_amount")} FROM v_customers WHERE exposure_id IS NOT NULL""")
lease_query("regulatory_report", "V066 D16 D17 T06 M03 J13 K03", finance.regulatory_report, f"""
    SELECT contract_id, asset_id, sequence_number, commencement_date, maturity_date, account_legal_entity, sic_description, yield, next_due, days_late, days_late_for_arrears,
        {dbl("rent_amount", "nbv_amount", "net_value", "month_charge", "charge_to_customer", "month_end_balance", "bills_due")} FROM v_loans""")
lease_query("loan_agreements", "V067 S09 F01", finance.loan_agreements, f"""
    SELECT party_number, asset_id, 'LES-' || sequence_number AS account_id, company_name, product_name, yield, customer_term_in_months, {dbl("charge_to_customer")}, payment_frequency, {dbl("bills_due")}, next_due AS next_due_date,
        CAST(nbv_amount AS DOUBLE) AS equipment_nbv FROM v_loans""")
# Charges by report column. Written out here: the check must not share the list it checks.
PIVOTED = {
    "charge_maintenance_cost_budget_collection_delivery": "Maintenance Cost Budget - Collection & Delivery",
    "charge_third_party_fridge_charges": "Third Party Fridge Charges",
    "charge_maintenance_cost_budget_crane": "Maintenance Cost Budget - Crane",
    "charge_third_party_ancillary_charges": "Third Party Ancillary Charges",
    "charge_maintenance_cost_budget_rfl": "Maintenance Cost Budget - RFL",
    "charge_third_party_crane_charges": "Third Party Crane Charges",
    "charge_maintenance_cost_budget_overhead": "Maintenance Cost Budget - Overhead",
    "charge_third_party_maintenance": "Third Party Maintenance",
    "charge_maintenance_cost_budget_general": "Maintenance Cost Budget - General",
    "charge_maintenance_cost_budget_tyres": "Maintenance Cost Budget - Tyres",
    "charge_maintenance_cost_budget_tail_lift": "Maintenance Cost Budget - Tail Lift",
    "charge_maintenance_cost_budget_fridge": "Maintenance Cost Budget - Fridge",
    "charge_maintenance_cost_budget_relief_vehicle": "Maintenance Cost Budget - Relief Vehicle",
    "charge_maintenance_cost_budget_ancillary": "Maintenance Cost Budget - Ancillary",
}
LISTED = ", ".join(f"'{c}'" for c in PIVOTED.values())
SUMS = {col: f"SUM(charges) FILTER (WHERE charge_name = '{c}')" for col, c in PIVOTED.items()}
SUMS |= {"charge_other": f"SUM(charges) FILTER (WHERE charge_name IS NULL OR charge_name NOT IN ({LISTED}))"}
PIVOT = ", ".join(f"CAST(ROUND(COALESCE({x}, 0), 2) AS DOUBLE) AS {col}" for col, x in SUMS.items())
NAMES = ", ".join(f"COALESCE(x.{col}, 0) AS {col}" for col in SUMS)
lease_query("accruals_pivot", "V052 A08 W01 M02 J11", finance.accruals_pivot, f"""
    SELECT l.contract_id, l.asset_id, f.sequence_number, f.status, f.product_name, f.payment_method, r.sales_rep, CAST(ROUND(f.total_yield, 2) AS DOUBLE) AS interest_rate, l.terminated_on, {dbl("rent_amount", "nbv_amount", source="l.")}, {NAMES}
    FROM v_latest_lease l JOIN v_finance_latest f ON f.contract_id = l.contract_id LEFT JOIN v_sales_reps r ON r.contract_id = l.contract_id
    LEFT JOIN (SELECT contract_id, asset_id, {PIVOT} FROM v_charges_detail GROUP BY contract_id, asset_id) x ON x.contract_id = l.contract_id AND x.asset_id = l.asset_id
    WHERE COALESCE(f.status, '') NOT IN ('Inactive', 'Pending', 'InstallingAssets')""")
lease_query("residual_receivables", "V065 W01 W12 A09 T04 J13", finance.residual_receivables, f"""
    SELECT DISTINCT s.asset_id, s.alias, s.asset_status, s.rv_maturity_date, {dbl("residual_value_amount", source="s.")}, l.contract_id, l.terminated_on, CAST(l.rent_amount AS DOUBLE) AS rent, f.sequence_number, f.commencement_date, f.maturity_date,
        f.party_name, f.product_name, f.payment_method, r.sales_rep, f.lease_contract_type, CAST(COALESCE(c.charges, 0) AS DOUBLE) AS asset_budget_value, CAST(COALESCE(c.charges, 0) + COALESCE(l.rent_amount, 0) AS DOUBLE) AS total_charge
    FROM asset_sheet s JOIN v_latest_live l ON l.asset_id = s.asset_id JOIN v_finance_latest f ON f.contract_id = l.contract_id AND f.status = 'Commenced' LEFT JOIN v_sales_reps r ON r.contract_id = l.contract_id
    LEFT JOIN v_charges_asset c ON c.contract_id = l.contract_id AND c.asset_id = l.asset_id WHERE s.asset_status IN ('Leased', 'Inventory')""")
lease_query("maintenance_budgets", "V050 J12 W01 A09 K01 J11", finance.maintenance_budgets, f"""
    SELECT DISTINCT x.contract_id, x.asset_id, f.company_name, f.sequence_number, f.payment_method, f.commencement_date, f.maturity_date, f.product_name, x.terminated_on, a.alias, n.serial_number, v.gvw, {dbl("rent_amount", source="x.")},
        c.charge_name, CAST(c.amount AS DOUBLE) AS charge_amount
    FROM v_asset_facts x JOIN dim_asset a ON a.bk_asset_id = x.asset_id AND a.current_flag = 1 LEFT JOIN v_status_latest t ON t.asset_id = x.asset_id LEFT JOIN dim_asset_status y ON y.sk_asset_status = t.sk_asset_status
    JOIN v_finance_latest f ON f.contract_id = x.contract_id AND f.lease_finance_id = x.lease_finance_id LEFT JOIN dim_serial_number n ON n.asset_id = x.asset_id LEFT JOIN dim_vehicle_detail v ON v.bk_vehicle_detail_id = x.asset_id
    LEFT JOIN (SELECT DISTINCT l.lease_finance_id, d.asset_id, r.name AS charge_name, e.amount FROM dim_lease_finance_charge l JOIN dim_additional_charge e ON e.bk_additional_charge_id = l.additional_charge_id
        LEFT JOIN dim_receivable_code r ON r.bk_receivable_code_id = e.receivable_code_id JOIN dim_recurring_detail d ON d.sundry_recurring_id = l.recurring_sundry_id) c ON c.lease_finance_id = x.lease_finance_id AND c.asset_id = x.asset_id
    WHERE f.status = 'Commenced' AND (y.asset_status IS NULL OR y.asset_status = 'Leased')""")
SUMS = ", ".join(f"COALESCE(SUM(amount) FILTER (WHERE kind = '{k}'), 0) AS {k}" for k in ("budget", "recharge", "expense"))
PARTS = {"budget": "budget", "recharge": "recharge", "income": "(budget + recharge)", "expense": "expense", "net": "(budget + recharge - expense)"}
RUNNING = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in PARTS.items()) + ", " + ", ".join(f"CAST(SUM({e}) OVER w AS DOUBLE) AS cumulative_{n}" for n, e in PARTS.items())
OVER = "WINDOW w AS (PARTITION BY registration_number ORDER BY month_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
lease_query("maintenance_costs", "V039 D05 U01 W08 A06 T07", finance.maintenance_costs, f"""
    WITH m AS (SELECT asset_id, strftime(day, '%Y-%m') AS month_key, {SUMS} FROM v_moves GROUP BY ALL)
    SELECT registration_number, asset_id, month_key, {RUNNING} FROM m JOIN v_registration USING (asset_id) WHERE is_active = 1 {OVER}""")
lease_query("hire_maintenance_provision", "V099 J06 D05 W08 A06 T07", finance.hire_maintenance_provision, f"""
    WITH c AS (SELECT x.asset_id, f.sequence_number, f.status, f.company_name, f.cost_center, f.commencement_date, LEAST(x.terminated_on, f.maturity_date) AS contract_end FROM v_asset_facts x
        JOIN v_finance_latest f ON f.contract_id = x.contract_id AND f.lease_finance_id = x.lease_finance_id WHERE f.product_name = 'Contract Hire' AND f.status NOT IN ('Inactive', 'Pending', 'InstallingAssets')),
    m AS (SELECT v.asset_id, c.* EXCLUDE (asset_id), strftime(v.day, '%Y-%m') AS month_key, {SUMS} FROM v_moves v JOIN c ON c.asset_id = v.asset_id AND v.day BETWEEN c.commencement_date AND c.contract_end GROUP BY ALL)
    SELECT registration_number, m.asset_id, sequence_number, status, company_name, cost_center, commencement_date, contract_end, month_key, {RUNNING} FROM m JOIN v_registration USING (asset_id) WHERE is_active = 1 {OVER}""")
lease_query("residual_analysis", "V117 W10 W01 M01 C03 J11", finance.residual_analysis, """
    SELECT k.bk_contract_id AS contract_id, a.bk_asset_id AS asset_id, f.sk_lease_asset, f.sk_time_record, k.sequence_number, c.company_name, b.branch_name, p.transaction_type AS product_name,
        dense_rank() OVER (PARTITION BY k.bk_contract_id ORDER BY a.bk_asset_id) + dense_rank() OVER (PARTITION BY k.bk_contract_id ORDER BY a.bk_asset_id DESC) - 1 AS equipment_count,
        CASE WHEN f.sk_date_termination_date > 0 THEN f.sk_date_termination_date END AS termination_key, d.begin_date AS depreciation_start, CAST(d.per_day_factor * 30 AS DOUBLE) AS depreciation_value,
        CAST(COALESCE(x.charges, 0) AS DOUBLE) AS asset_budget_value, CAST(COALESCE(x.charges, 0) + COALESCE(f.rent_amount, 0) AS DOUBLE) AS total_charge
    FROM fact_lease_asset f JOIN dim_asset a USING (sk_asset) JOIN dim_customer c USING (sk_customer) JOIN dim_contract k ON k.sk_contract = f.sk_contract AND k.current_flag = 1 JOIN dim_branch b USING (sk_branch)
    LEFT JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = k.deal_product_type_id LEFT JOIN v_charges_asset x ON x.contract_id = k.bk_contract_id AND x.asset_id = a.bk_asset_id
    LEFT JOIN v_depreciation d ON d.asset_id = a.bk_asset_id AND d.current_contract_value = 1""")
