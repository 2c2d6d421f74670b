"""Pipeline, customer and vehicle-sale reports and their checks."""

from rentroll.lease import pipeline
from rentroll.plans.lease.base import DAY
from rentroll.plans.lease.finance import dbl
from rentroll.plans.lease.fixture import VIEWS, lease_query

# Report products by cost center and deal product. Written out here: the check must not share the list it checks.
MATRIX = """
    WHEN n.description = 'Lease Sales' AND p.transaction_type = 'Contract Hire' THEN 'Contract Hire Origination'
    WHEN n.description = 'Lease Sales' AND p.transaction_type = 'Hire Purchase' THEN 'Hire Purchase Origination'
    WHEN n.description = 'Lease Sales' AND p.transaction_type = 'Operating Lease' THEN 'Operating Lease Origination'
    WHEN n.description = 'Lease Sales' AND p.transaction_type = 'Finance Lease' THEN 'Finance Lease Origination'
    WHEN n.description = 'Lease Sales' AND p.transaction_type = 'Rental' THEN 'Rental - Origination'
    WHEN n.description = 'Extension -Lease' AND p.transaction_type = 'Contract Hire' THEN 'Contract Hire Extension'
    WHEN n.description = 'Extension -Lease' AND p.transaction_type = 'Operating Lease' THEN 'Operating Lease Extension'
    WHEN n.description = 'Extension -Lease' AND p.transaction_type = 'Hire Purchase' THEN 'Hire Purchase Extension'
    WHEN n.description = 'Lease (Used Asset)' AND p.transaction_type = 'Contract Hire' THEN 'Contract Hire Lease - Used Asset'
    WHEN n.description = 'Lease (Used Asset)' AND p.transaction_type = 'Hire Purchase' THEN 'Hire Purchase (Used Asset)'
    WHEN n.description = 'Lease (Used Asset)' AND p.transaction_type = 'Operating Lease' THEN 'Operating Lease (Used Asset)'
    WHEN n.description = 'Lease (Used Asset)' AND p.transaction_type = 'Finance Lease' THEN 'Finance Lease (Used Asset)'
    WHEN n.description = 'Lease (Used Asset)' AND p.transaction_type = 'Rental' THEN 'Rental (Used Asset)'
    WHEN n.description = 'Rental (New Asset)' AND p.transaction_type = 'Rental' THEN 'Rental - Origination'
    WHEN n.description = 'Rental' AND p.transaction_type = 'Rental' THEN 'Rental - Churn'
    WHEN n.description = 'Extension - Rental Std' AND p.transaction_type = 'Rental' THEN 'Rental - Extension (Existing Customer)'
    WHEN n.description = 'Lease (Re-Profile)' THEN 'Lease (Re-Profile)'
    WHEN n.description = 'Vendor Finance' THEN 'Vendor Finance'
    WHEN n.description = 'Traffic Managment' THEN 'Traffic Management'
    WHEN n.description = 'Fleet Management' THEN 'Fleet Management'
"""
BOTH = """LEFT JOIN v_people m ON m.customer_id = c.bk_customer_id AND m.role_function = 'Account Manager' LEFT JOIN v_people r ON r.customer_id = c.bk_customer_id AND r.role_function = 'Sales Rep'"""
VIEWS |= {
    "v_sales": """SELECT s.*, d.bk_asset_sale_detail_id, d.asset_id, d.fair_market_value_amount, d.net_value_amount, d.projected_vat_amount, a.sk_asset, a.manufacturer_name, c.party_name AS buyer, b.branch_name AS depot, u.full_name AS salesperson,
            q.name AS route_to_market, g.registration_number, d.fair_market_value_amount - d.net_value_amount AS result, CASE WHEN s.finance_company_funded = 1 THEN 'Financed' ELSE 'Not Financed' END AS financed
        FROM dim_asset_sale s JOIN dim_asset_sale_detail d ON d.asset_sale_id = s.bk_asset_sale_id JOIN dim_asset a ON a.bk_asset_id = d.asset_id AND a.current_flag = 1 LEFT JOIN dim_customer c ON c.bk_customer_id = s.buyer_id AND c.current_flag = 1
        LEFT JOIN dim_branch b ON b.bk_branch_id = s.branch_id LEFT JOIN dim_asset_sale_employee e ON e.asset_sale_id = s.bk_asset_sale_id LEFT JOIN dim_user u ON u.bk_user_id = e.employee_id
        LEFT JOIN dim_receivable_code q ON q.bk_receivable_code_id = s.receivable_code_id LEFT JOIN v_registration g ON g.asset_id = d.asset_id WHERE c.party_name <> 'Customer#000000003'""",
    "v_tasks": """SELECT t.entity_name, t.entity_id, u.full_name AS owner FROM dim_transaction_instance t JOIN dim_work_item i ON i.transaction_instance_id = t.bk_transaction_instance_id AND i.status = 'Assigned'
        JOIN dim_user u ON u.bk_user_id = i.owner_user_id WHERE t.status = 'Active' QUALIFY row_number() OVER (PARTITION BY t.entity_name, t.entity_id ORDER BY t.bk_transaction_instance_id DESC) = 1""",
    "v_events": """SELECT * FROM (
        SELECT bk_contract_id AS contract_id, sequence_number, deal_product_type_id, cost_center_id, CASE WHEN start_date = DATE '1900-01-01' THEN COALESCE(created_time, dp_process_datetime) ELSE start_date END AS event_day, 'commenced' AS event
          FROM dim_contract WHERE status IN ('Commenced', 'FullyPaidOff') QUALIFY row_number() OVER (PARTITION BY bk_contract_id ORDER BY dp_process_datetime, sk_contract) = 1)
        UNION ALL SELECT * FROM (SELECT bk_contract_id, sequence_number, deal_product_type_id, cost_center_id, CASE WHEN start_date = DATE '1900-01-01' THEN dp_process_datetime ELSE start_date END, 'novated'
          FROM dim_contract WHERE status = 'Commenced' AND report_status = 'Assumed' QUALIFY row_number() OVER (PARTITION BY bk_contract_id ORDER BY dp_process_datetime, sk_contract) = 1)""",
    "v_finance_by_day": """SELECT k.bk_contract_id AS contract_id, k.status AS finance_status, c.party_name, f.tax_deferral_amount, o.description AS line_of_business FROM fact_lease_finance_detail f
        JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance AND l.is_current = 1 AND l.current_flag = 1 JOIN dim_contract k ON k.sk_contract = f.sk_contract JOIN dim_customer c ON c.sk_customer = f.sk_customer AND c.current_flag = 1
        JOIN dim_line_of_business o ON o.sk_line_of_business = f.sk_line_of_business QUALIFY row_number() OVER (PARTITION BY k.bk_contract_id ORDER BY f.sk_date_record DESC, f.sk_time_record DESC, f.sk_contract DESC) = 1""",
}
lease_query("annual_reviews", "V040 W01 A09 F06 J13", pipeline.annual_reviews, f"""
    SELECT DISTINCT c.bk_customer_id AS customer_id, COALESCE(NULLIF(trim(c.company_name), ''), c.party_name) AS company_name, c.creation_date, c.credit_score, c.annual_credit_review_date AS last_review_date, c.next_review_date, e.exposure_date,
        {dbl("total_proposed_exposure", "primary_customer_amount", "group_exposure", "proposed_exposure", source="e.")}, p.expiration_date, m.employee_name AS account_manager, r.employee_name AS sales_rep
    FROM dim_customer c JOIN v_exposure e ON e.customer_id = c.bk_customer_id LEFT JOIN dim_insurance_policy p ON p.customer_id = c.bk_customer_id {BOTH} WHERE c.current_flag = 1 AND c.status = 'Active' AND e.proposed_exposure > 0""")
lease_query("application_contracts", "V041 J01 J02", pipeline.application_contracts, """
    SELECT a.opportunity_id, a.application_created, c.company_name, c.sequence_number, c.created_time, c.status, c.commencement_date FROM v_contracts c JOIN v_credit_apps a ON a.opportunity_number = c.opportunity_number""")
lease_query("application_progress", "V042 F03 C03 P04", pipeline.application_progress, """
    SELECT opportunity_number, credit_profile_number, company_name, expected_commencement_date, product_name, equipment_count, CAST(COALESCE(approved_amount, 0) AS DOUBLE) AS approved_amount, loc_status, application_status, branch_name, customer_term,
        sales_rep, assigned_user FROM v_credit_apps WHERE lower(loc_status) IN ('approved', 'amendment') AND is_pre_approval = 0 AND all_assets_taken_down = 0""")
lease_query("qa_queue", "V059 P03 F03", pipeline.qa_queue, """
    SELECT a.opportunity_number, a.company_name, a.product_name, a.equipment_count, CAST(COALESCE(a.approved_amount, 0) AS DOUBLE) AS approved_amount, a.cost_center, a.application_owner, a.report_status, a.application_status, a.loc_status
    FROM v_credit_apps a LEFT JOIN v_contracts c ON c.opportunity_number = a.opportunity_number
    WHERE lower(a.application_status) = 'submittedtocredit' AND lower(a.loc_status) IN ('approved', 'pending') OR lower(c.status) IN ('pending', 'installingassets')""")
lease_query("credit_ratings", "V051 W01 A09 C01 J13", pipeline.credit_ratings, f"""
    SELECT DISTINCT c.bk_customer_id AS customer_id, c.party_name, c.status, a.address_line1 AS street, a.postal_code, CAST(e.primary_customer_amount AS DOUBLE) AS current_exposure, CAST(e.proposed_exposure AS DOUBLE) AS proposed_exposure,
        CASE WHEN l.customer_id IS NULL THEN 'FALSE' ELSE 'TRUE' END AS in_arrears, i.name AS insurer, CASE WHEN p.is_self_insured = 1 THEN 'TRUE' ELSE 'FALSE' END AS self_insured, p.expiration_date, c.next_review_date,
        r.employee_name AS sales_rep, m.employee_name AS account_manager
    FROM dim_customer c LEFT JOIN dim_insurance_policy p ON p.customer_id = c.bk_customer_id LEFT JOIN dim_insurance_company i ON i.bk_insurance_company_id = p.insurance_company_id LEFT JOIN dim_party_address a ON a.bk_party_address_id = c.bk_customer_id
    LEFT JOIN v_exposure e ON e.customer_id = c.bk_customer_id LEFT JOIN (SELECT DISTINCT customer_id FROM v_invoices WHERE effective_balance_amount > 0 AND due_date <= {DAY}) l ON l.customer_id = c.bk_customer_id {BOTH}
    WHERE c.current_flag = 1 AND c.primary_role = 'Customer'""")
lease_query("customer_reviews", "V085 C04 T02 T03", pipeline.customer_reviews, f"""
    SELECT customer_id, party_name, next_review_date, CAST(date_diff('day', {DAY}, next_review_date) AS INTEGER) AS days_to_review, months_to_review,
        CASE WHEN months_to_review < 0 THEN 'Overdue' WHEN months_to_review = 1 THEN '1 Month' WHEN months_to_review > 1 THEN 'More than 2 Months' END AS review_due,
        CASE WHEN policy_expiration_date IS NULL THEN 'None Held' WHEN policy_expiration_date <= {DAY} THEN 'Overdue' ELSE 'Up to Date' END AS policy_status, account_manager,
        CASE WHEN effective_balance_amount > 0 THEN 1 ELSE 0 END AS in_arrears FROM v_customers""")
lease_query("contract_events", "V090 D06 D19 U01 W01 C01 T04", pipeline.contracts_created_events, f"""
    SELECT e.contract_id, e.sequence_number, e.event, e.event_day, f.party_name, f.finance_status, f.line_of_business, t.assets, n.description AS cost_center, p.transaction_type AS product_name,
        CASE WHEN e.event = 'novated' THEN 'Novated' {MATRIX} END AS report_product,
        CAST(CASE WHEN p.transaction_type = 'Hire Purchase' THEN COALESCE(t.nbv, 0) - COALESCE(f.tax_deferral_amount, 0) - COALESCE(t.down, 0) ELSE t.nbv END AS DOUBLE) AS origination_amount
    FROM v_events e LEFT JOIN v_finance_by_day f ON f.contract_id = e.contract_id LEFT JOIN (SELECT contract_id, COUNT(asset_id) AS assets, SUM(nbv_amount) AS nbv, SUM(true_down_payment_amount) AS down FROM v_leased GROUP BY contract_id) t ON t.contract_id = e.contract_id
    LEFT JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = e.deal_product_type_id LEFT JOIN dim_cost_center n ON n.bk_cost_center_id = e.cost_center_id WHERE COALESCE(f.finance_status, ' ') <> 'Inactive'""")
lease_query("installing_contracts", "V091 W01 A01 A02 J13", pipeline.installing_contracts, """
    SELECT f.contract_id, f.sequence_number, f.contract_number, f.company_name, f.cost_center, b.branch_name, f.product_name, f.commencement_date, f.customer_term_in_months, t.assets, CAST(t.cost AS DOUBLE) AS customer_cost, o.created_date, f.approval_status
    FROM v_finance_latest f JOIN dim_branch b ON b.sk_branch = f.sk_branch LEFT JOIN (SELECT bk_contract_id, MIN(dp_process_date) AS created_date FROM dim_contract GROUP BY 1) o ON o.bk_contract_id = f.contract_id
    LEFT JOIN (SELECT k.bk_contract_id, COUNT(l.sk_asset) AS assets, SUM(l.customer_cost_amount) AS cost FROM fact_lease_asset l JOIN dim_contract k ON k.sk_contract = l.sk_contract AND k.current_flag = 1 GROUP BY 1) t ON t.bk_contract_id = f.contract_id
    WHERE f.status = 'InstallingAssets' AND f.approval_status <> 'Pending'""")
lease_query("live_credit_lines", "V092 W01 A09 F02 C01 J11", pipeline.live_credit_lines, """
    SELECT DISTINCT l.asset_id, l.credit_number, l.opp_number, concat(l.opp_number, '-', l.number) AS opp_structure, l.cost_center, l.profile_status, l.product_name, g.registration_number, l.sequence_number, l.booking_status, u.full_name AS assigned_user,
        a.owner AS line_owner, b.owner AS lease_owner, f.approval_status,
        CASE WHEN l.booking_status IS NULL THEN CASE WHEN l.profile_status IN ('Amendment', 'Approved') THEN 'Contract Management' ELSE 'Credit' END WHEN l.booking_status = 'Pending' THEN 'Contract Management'
             WHEN l.booking_status = 'InstallingAssets' AND f.approval_status = 'Pending' THEN 'Contract Management' ELSE 'Finance' END AS department
    FROM v_credit_lines l LEFT JOIN v_tasks a ON a.entity_name = 'CreditProfile' AND a.entity_id = l.credit_profile_id LEFT JOIN v_finance_latest f ON f.contract_id = l.contract_id
    LEFT JOIN v_tasks b ON b.entity_name = 'LeaseFinance' AND b.entity_id = f.lease_finance_id LEFT JOIN dim_user u ON u.bk_user_id = l.assigned_to_user_id LEFT JOIN v_registration g ON g.asset_id = l.asset_id
    WHERE l.booking_status IS NULL OR l.booking_status IN ('Pending', 'InstallingAssets')""")
lease_query("rental_days_to_contract", "V093 D20 W01 T02 F04", pipeline.rental_days_to_contract, """
    WITH a AS (SELECT * FROM dim_credit_profile WHERE status = 'Approved' QUALIFY row_number() OVER (PARTITION BY bk_credit_profile_id ORDER BY dp_process_date, sk_credit_profile) = 1),
    s AS (SELECT c.bk_contract_id, c.dp_process_date, p.transaction_type FROM dim_contract c JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = c.deal_product_type_id WHERE c.status = 'Commenced'
        QUALIFY row_number() OVER (PARTITION BY c.bk_contract_id ORDER BY c.dp_process_datetime, c.sk_contract) = 1)
    SELECT a.number AS credit_number, o.number AS opp_number, k.sequence_number, n.description AS cost_center, c.company_name, a.dp_process_date AS approved_on, s.dp_process_date AS commenced_on, s.transaction_type AS product_name,
        CAST(date_diff('day', a.dp_process_date, s.dp_process_date) AS INTEGER) AS days
    FROM a JOIN dim_opportunity o ON o.bk_opportunity_id = a.opportunity_id JOIN dim_approved_structure t ON t.credit_profile_id = a.bk_credit_profile_id JOIN dim_contract k ON k.credit_approved_structure_id = t.bk_approved_structure_id AND k.current_flag = 1
    JOIN dim_cost_center n ON n.bk_cost_center_id = a.cost_center_id JOIN dim_customer c ON c.bk_customer_id = a.customer_id AND c.current_flag = 1 JOIN s ON s.bk_contract_id = k.bk_contract_id WHERE s.transaction_type LIKE '%Rental%'""")
SALE = ", ".join(pipeline.SALE)
SPLIT = f"SELECT {SALE}, CAST(CASE WHEN result >= 0 THEN result ELSE 0 END AS DOUBLE) AS profit, CAST(CASE WHEN result < 0 THEN result ELSE 0 END AS DOUBLE) AS loss FROM v_sales WHERE "
lease_query("completed_sales_split", "V077 D21 C01 M01 J11", pipeline.completed_sales_split, SPLIT + """status = 'Completed' AND sk_asset IN
    (SELECT f.sk_asset FROM fact_asset_status f JOIN dim_asset_status y USING (sk_asset_status) WHERE y.asset_status = 'Sold')""")
lease_query("open_sales_split", "V078 D21 C01 M01 P03", pipeline.open_sales_split, SPLIT + "(status = 'Pending' OR status = 'Submitted')")
lease_query("completed_sales", "V079 M01 J11", pipeline.completed_sales, f"""
    SELECT bk_asset_sale_detail_id, {dbl("net_value_amount")}, CAST(result AS DOUBLE) AS profit, salesperson, {dbl("fair_market_value_amount")}, buyer, transaction_date, manufacturer_name, a.postal_code
    FROM v_sales LEFT JOIN dim_party_address a ON a.bk_party_address_id = buyer_id WHERE status = 'Completed'""")
lease_query("unpaid_sales", "V081 M01 J11 P02", pipeline.unpaid_sales, f"""
    SELECT {", ".join("s." + c for c in pipeline.SALE)}, i.number, {dbl("fair_market_value_amount", source="s.")}, CAST(s.fair_market_value_amount + s.projected_vat_amount AS DOUBLE) AS amount_with_vat
    FROM v_sales s JOIN dim_receivable_invoice i ON i.bk_receivable_invoice_id = s.first_receivable_invoice_id AND i.current_flag = 1 JOIN fact_receivable_invoice f ON f.sk_receivable_invoice = i.sk_receivable_invoice
    WHERE s.status = 'Completed' AND f.balance_amount + f.tax_balance_amount > 0""")
