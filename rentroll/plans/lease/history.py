"""History, fleet and procurement reports and their checks."""

from rentroll.lease import history, procurement
from rentroll.plans.lease.base import DAY
from rentroll.plans.lease.finance import dbl
from rentroll.plans.lease.fixture import VIEWS, lease_query
from rentroll.plans.lease.pipeline import MATRIX  # noqa: F401  (its base views come first)

# Fees that are no spend, and fees that maintenance provisions leave out. Written out here: the check must not
# share the lists it checks.
NO_SPEND = [
    'Arrears Letter', 'Asset Sales Cost Charge', 'Asset Sales Cost Recharge', 'Backed off Other Charge', 'Balloon Payment (FL)',
    'Balloon Payment (HP)', 'Billing Expense (FL)', 'Billing Expense (HP)', 'Brokerage Income', 'Brokerage Income - Credit',
    'Brokerage Income - Credit NO VAT', 'Brokerage Income NO VAT', 'Collection and Delivery Rental Charge',
    'Collection and Delivery Rental Recharge', 'Contract Hire Income - Credit V2', 'Contract Hire Income - V2', 'Deposit - HP', 'Document Fee',
    'Document Fee (No VAT)', 'Documentation Fee', 'Documentation Fee (Expense)', 'Funder Deposit (FL)', 'Funder Deposit (HP)',
    'Insufficient Funds to meet a Direct Debit', 'Hire Purchase Income - Credit', 'Late Payment Interest', 'Operating Lease  Income - Credit',
    'Option to Purchase', 'Overdue Payment', 'Refurb Cost Charge', 'Refurb Cost Recharge', 'Rent Receivable', 'Rent Receivable - Credit',
    'Rental Income', 'Rental Income - Credit', 'Rental_Lease_Mid-Period_Payoff', 'Repossession Charges', 'Utilities', 'Waiver',
]
NO_PROVISION = [
    'Arrears Letter', 'Asset Sales Cost Charge', 'Asset Sales Cost Recharge', 'Backed off Other Charge', 'Balloon Payment (FL)',
    'Balloon Payment (HP)', 'Billing Expense (FL)', 'Billing Expense (HP)', 'Brokerage Income', 'Brokerage Income - Credit NO VAT',
    'Brokerage Income NO VAT', 'Collection & Delivery (Not Budgeted) Charge', 'Collection & Delivery (Not Budgeted) Recharge',
    'Collection and Delivery Rental Charge', 'Collection and Delivery Rental Recharge', 'Contract Hire Income - Credit V2',
    'Contract Hire Income - V2', 'Deposit - HP', 'Document Fee', 'Document Fee (No VAT)', 'Documentation Fee', 'Documentation Fee (Expense)',
    'End of Life Charge', 'End of life Recharge', 'Excess Mileage Cost Charge', 'Excess Mileage Cost Recharge', 'Funder Deposit (FL)',
    'Funder Deposit (HP)', 'Insufficient Funds to meet a Direct Debit', 'Late Payment Interest', 'Maintenance Cost Budget - Overhead',
    'Option to Purchase', 'Overdue Payment', 'Penalty Charge Admin Fee Charge', 'Penalty Charge Admin Fee Recharge',
    'Penalty Charge Notice Cost Charge', 'Penalty Charge Notice Cost Recharge', 'Refurb Cost Charge', 'Refurb Cost Recharge', 'Rent Receivable',
    'Rent Receivable - Credit', 'Rental Income', 'Rental Income - Credit', 'Rental_Lease_Mid-Period_Payoff', 'Repossession Charges', 'Utilities',
    'VOR Recharge', 'Waiver',
]


def listed(names):
    return ", ".join(f"'{n}'" for n in names)


def kind(allocated, available, day):
    return f"""CASE WHEN COALESCE({allocated}, '') NOT IN ('VOF Signed', 'Yes', 'TTS Allocation') AND {available} <= {day} THEN 'Physical Assets'
        WHEN {allocated} IS NOT NULL AND {allocated} NOT IN ('Firm - No VOF', 'Soft', 'No') THEN 'Orders' ELSE 'Incoming Stock' END"""


VIEWS |= {
    "v_history": """SELECT id, asset_id, contract_id, amount, invoice_date, fee_name, CAST(NULL AS VARCHAR) AS description, customer_name AS account_name, source_system, category, 'budgets' AS type FROM flat_budgets
        UNION SELECT id, asset_id, contract_id, amount, invoice_date, fee_name, description, customer_name, source_system, category, 'recharges' FROM flat_recharges
        UNION SELECT id, asset_id, NULL, amount, invoice_date, fee_name, NULL, account_name, source_system, category, 'expenses' FROM flat_expenses""",
    "v_asset_leases": """SELECT x.*, f.company_name, f.contract_number, f.sequence_number, f.status, f.commencement_date, f.maturity_date, row_number() OVER (PARTITION BY x.asset_id ORDER BY f.sk_date_commencement_date DESC, x.contract_id DESC) AS current_lease
        FROM v_asset_facts x JOIN v_finance_latest f ON f.contract_id = x.contract_id AND f.lease_finance_id = x.lease_finance_id WHERE f.customer_is_current = 1""",
    "v_procured": "SELECT * FROM asset_sheet WHERE procurement_program = 1 AND project_number IS NOT NULL",
    "v_order_versions": """SELECT a.bk_asset_id AS asset_id, a.sk_asset, a.product_name, a.book_value_amount, a.start_date AS recorded_from, a.asset_funding_status AS fs, g.value AS al, d.available_from,
            GREATEST(CASE WHEN a.start_date = DATE '1900-01-01' THEN COALESCE(a.created_time, a.updated_time) ELSE a.start_date END, CASE WHEN d.start_date = DATE '1900-01-01' THEN d.created_time ELSE d.start_date END) AS changed_on,
            LEAST(a.end_date, d.end_date) AS ended_on
        FROM dim_asset a JOIN fact_asset_status f USING (sk_asset) JOIN dim_asset_status y ON y.sk_asset_status = f.sk_asset_status AND y.asset_status = 'AwaitingDelivery' JOIN dim_additional_details d ON d.sk_additional_details = f.sk_additional_details
        LEFT JOIN dim_detail_config g ON g.bk_detail_config_id = d.allocated_status_id JOIN v_procured p ON p.asset_id = a.bk_asset_id""",
    "v_orders": f"""
        WITH p AS (SELECT *, lag(al) OVER w AS pal, lag(fs) OVER w AS pfs, row_number() OVER w AS rn, last_value(ended_on) OVER z AS last_end, last_value(available_from) OVER z AS last_available, last_value(product_name) OVER z AS cat FROM v_order_versions
            WINDOW w AS (PARTITION BY asset_id ORDER BY changed_on, sk_asset), z AS (PARTITION BY asset_id ORDER BY changed_on, sk_asset ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        c AS (SELECT *, LEAST(COALESCE(lead(changed_on) OVER (PARTITION BY asset_id ORDER BY changed_on, sk_asset), DATE '9999-12-31'), last_end) AS valid_to FROM p
            WHERE rn = 1 OR (pal IS NULL AND pfs IS NULL) OR al IS DISTINCT FROM pal OR fs IS DISTINCT FROM pfs),
        f AS (SELECT CAST(d AS DATE) AS snapshot FROM generate_series(DATE '2000-12-01', {DAY}, INTERVAL 7 DAY) g(d))
        SELECT c.asset_id, f.snapshot, c.cat AS vehicle_category, c.al AS allocated_status, c.fs AS funding_status, {kind("c.al", "c.last_available", "f.snapshot")} AS order_type, c.changed_on AS valid_from, c.valid_to, c.last_available
        FROM c JOIN f ON f.snapshot BETWEEN c.changed_on AND c.valid_to""",
    "v_funded": """SELECT a.bk_asset_id AS asset_id, d.bk_date AS invoice_date, COALESCE(f.acquisition_cost_amount, 0) + COALESCE(f.other_cost_amount, 0) - COALESCE(f.vat_amount, 0) AS funded
        FROM fact_payable_invoice_asset f JOIN dim_asset a ON a.sk_asset = f.sk_asset AND a.current_flag = 1 LEFT JOIN dim_date d ON d.sk_date = f.sk_date_record""",
    "v_migrated": """SELECT s.asset_id, v.book_value_amount AS migrated_amount FROM (SELECT * FROM v_orders QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY snapshot, valid_from) = 1) s
        JOIN (SELECT * FROM v_order_versions QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY recorded_from, sk_asset) = 1) v ON v.asset_id = s.asset_id
        WHERE s.funding_status = 'FullyFunded' AND CAST(s.asset_id AS VARCHAR) IN (SELECT o.id FROM flat_assets o JOIN flat_assets l ON l.equipment_id = o.equipment_id AND l.source_system = 'legacy' WHERE o.source_system = 'current')""",
    "v_first_line": """SELECT asset_id, party_name AS line_customer, profile_created AS line_created, expected_commencement_date, opp_number AS line_opp FROM v_credit_lines
        QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY profile_created, credit_number) = 1""",
}
lease_query("spend_with_history", "V097 U02 P04 J02", history.spend_with_history, f"""
    SELECT h.id, h.asset_id, {dbl("amount", source="h.")}, h.invoice_date, h.fee_name, h.account_name, h.type, h.source_system, a.registration_number, a.vehicle_category
    FROM v_history h LEFT JOIN flat_assets a ON a.id = h.asset_id WHERE h.fee_name NOT IN ({listed(NO_SPEND)})""")
lease_query("maintenance_provision", "V104 U02 P04 F06 J09 T04", history.maintenance_provision, f"""
    SELECT h.id, h.asset_id, {dbl("amount", source="h.")}, h.invoice_date, h.fee_name, h.type, h.category, s.created_time, CASE WHEN h.category = 'Sundry' THEN s.created_time ELSE h.invoice_date END AS report_date
    FROM v_history h LEFT JOIN dim_sundry s ON CAST(s.bk_sundry_id AS VARCHAR) = h.id AND s.is_active = 1
    WHERE (h.fee_name IS NULL OR trim(h.fee_name) NOT IN ({listed(NO_PROVISION)})) AND (h.description IS NULL OR lower(h.description) NOT LIKE '%eol%') AND h.asset_id IS NOT NULL""")
lease_query("tyre_spend", "V119 U02 F04 F03 J02", history.tyre_spend, f"""
    SELECT h.id, h.asset_id, {dbl("amount", source="h.")}, h.invoice_date, h.fee_name, h.type, a.registration_number, a.equipment_id, a.parent_asset_id, c.sequence_number, c.commencement_date, c.status AS contract_status
    FROM v_history h LEFT JOIN flat_assets a ON a.id = h.asset_id LEFT JOIN flat_contracts c ON c.id = h.contract_id WHERE lower(h.fee_name) LIKE '%tyre%'""")
lease_query("penalty_charges", "V111 U02 P04", history.penalty_charges, f"""
    SELECT id, asset_id, {dbl("amount")}, invoice_date, fee_name, type, source_system FROM v_history WHERE type = 'recharges' AND fee_name IN ('Penalty Charge Notice Cost Recharge', 'Penalty Charge Admin Fee Recharge')
        OR type = 'expenses' AND fee_name = 'Penalty Charge Notice Cost Charge'""")
lease_query("fleet_overheads", "V095 J01 F04", history.fleet_overheads, f"""
    SELECT b.id, a.equipment_id, a.registration_number, c.customer_name AS customer, c.sequence_number, b.fee_name, {dbl("amount", source="b.")}, b.invoice_date, b.source_system
    FROM flat_budgets b JOIN flat_contracts c ON c.id = b.contract_id JOIN flat_assets a ON a.id = b.asset_id WHERE b.fee_name LIKE '%Overhead%'""")
DOCUMENTS = """SELECT DISTINCT d.*, c.id AS contract_id, c.sequence_number, c.customer_name, c.status AS contract_status, c.product, c.commencement_date, e.asset_id, e.terminated_on, e.contract_mileage, a.registration_number
    FROM {} d JOIN flat_contracts c ON c.{} = d.{} JOIN flat_equipment e ON e.contract_id = c.id JOIN flat_assets a ON a.id = e.asset_id"""
lease_query("application_documents", "V088 A09 J02 J01", history.application_documents, DOCUMENTS.format("flat_application_documents", "application_name", "application_name"))
lease_query("lease_documents", "V089 A09 J02 J01", history.lease_documents, DOCUMENTS.format("flat_lease_documents", "schedule_number", "lease_name"))
lease_query("retention_and_growth", "V094 J08 A03 A04 A09 F04", history.retention_and_growth, """
    WITH c AS (SELECT DISTINCT CASE c.line_of_business WHEN 'Bus and Coach' THEN 'Bus & Coach' WHEN 'Contract Hire Leasing and Rental' THEN 'Contract Hire Lease Rental' ELSE c.line_of_business END AS line_of_business,
            CASE WHEN c.product LIKE 'Contract Hire%' THEN 'Contract Hire' WHEN c.product LIKE 'Finance Lease%' THEN 'Finance Lease' WHEN c.product LIKE 'Hire Purchase%' THEN 'Hire Purchase' WHEN c.product LIKE 'Operating Lease%' THEN 'Operating Lease'
                WHEN c.product LIKE 'Rental%' THEN 'Rental' ELSE c.product END AS product,
            CASE WHEN c.source_system = 'legacy' AND e.terminated_on IS NULL THEN DATE '2001-01-31' ELSE e.terminated_on END AS ended, c.bdm, c.customer_name, c.account_number, c.organization_id, c.commencement_date, a.equipment_id
        FROM flat_contracts c JOIN flat_equipment e ON e.contract_id = c.id JOIN flat_assets a ON a.id = e.asset_id WHERE a.vehicle_category <> 'Ancillary' AND c.status NOT IN ('Inactive', 'Pending', 'PARTIAL APPLICATION'))
    SELECT COALESCE(u.party_name, c.customer_name) AS customer, line_of_business, bdm, product, MIN(commencement_date) AS first_start, MAX(COALESCE(ended, DATE '9999-01-01')) AS last_end, COUNT(DISTINCT equipment_id) AS assets
    FROM c LEFT JOIN (SELECT external_reference_id, organization_id, party_name FROM dim_customer WHERE current_flag = 1) u ON c.account_number = u.external_reference_id OR c.organization_id = u.organization_id
    GROUP BY ALL""")
lease_query("fleet_spend", "V096 U01 A09 J11", history.fleet_spend, f"""
    SELECT DISTINCT a.registration_number, a.product_name, a.asset_status, s.bk_sundry_recurring_id AS id, s.sundry_type AS type, {dbl("amount", source="d.")}, c.name AS recurring_name, CAST(NULL AS VARCHAR) AS recharge_fee_name, p.due_date AS schedule_due_date,
        CAST(NULL AS DATE) AS receivable_due_date, u.company_name AS company
    FROM dim_sundry_recurring s JOIN dim_recurring_detail d ON d.sundry_recurring_id = s.bk_sundry_recurring_id JOIN dim_recurring_schedule p ON p.sundry_recurring_id = s.bk_sundry_recurring_id JOIN dim_receivable_code c ON c.bk_receivable_code_id = s.receivable_code_id
    JOIN dim_customer u ON u.bk_customer_id = s.customer_id AND u.current_flag = 1 JOIN asset_sheet a ON a.asset_id = d.asset_id JOIN dim_contract k ON k.bk_contract_id = s.contract_id AND k.current_flag = 1 WHERE p.due_date <= {DAY}
    UNION ALL SELECT a.registration_number, a.product_name, a.asset_status, x.bk_sundry_id, x.sundry_type, CAST(x.amount AS DOUBLE), NULL, x.recharge_fee_name, NULL, x.receivable_due_date, x.company_name
    FROM v_sundry_details x LEFT JOIN asset_sheet a ON a.asset_id = x.asset_id""")
ACTIVE = "LEFT JOIN v_registration g ON g.asset_id = {0}.asset_id AND g.is_active = 1"
PLACE = "LEFT JOIN dim_asset_location o ON o.asset_id = {0}.asset_id AND o.is_current = 1 LEFT JOIN dim_location q ON q.bk_location_id = o.location_id"
lease_query("fleet_with_leases", "V098 W01 J12 J11 C01", history.fleet_with_leases, f"""
    SELECT d.asset_id, g.registration_number, d.alias, d.product_name, d.gvw, b.body_type_code AS body_type, h.name AS body_builder, n.serial_number, d.asset_status, t.value AS asset_sub_type, q.city, l.contract_id, l.sequence_number,
        l.status AS contract_status, l.commencement_date, l.maturity_date, l.terminated_on, l.current_lease, CASE WHEN i.asset_id IS NULL THEN 0 ELSE 1 END AS in_application, {dbl("rent_amount", source="l.")}
    FROM v_details d LEFT JOIN dim_body_type_config b ON b.bk_body_type_config_id = d.body_type_config_id AND b.is_active = 1 LEFT JOIN dim_body_builder_config h ON h.bk_body_builder_config_id = d.body_builder_config_id
    LEFT JOIN dim_detail_config t ON t.bk_detail_config_id = d.asset_sub_type_id {ACTIVE.format("d")} {PLACE.format("d")} LEFT JOIN dim_serial_number n ON n.asset_id = d.asset_id
    LEFT JOIN v_asset_leases l ON l.asset_id = d.asset_id LEFT JOIN v_in_application_once i ON i.asset_id = d.asset_id""")
lease_query("fleet_in_application", "V100 J01 W01", history.fleet_in_application, f"""
    SELECT i.asset_id, g.registration_number, a.fleet_number, y.asset_status, i.stage, i.opp_number, i.credit_number, i.company, i.product FROM dim_asset a JOIN v_in_application i ON i.asset_id = a.bk_asset_id
    LEFT JOIN fact_asset_status f ON f.sk_asset = a.sk_asset LEFT JOIN dim_asset_status y ON y.sk_asset_status = f.sk_asset_status {ACTIVE.format("i")} WHERE a.current_flag = 1""")
lease_query("fleet_in_inventory", "V101 W01 A09 J11", history.fleet_in_inventory, f"""
    WITH l AS (SELECT a.bk_asset_id AS asset_id, k.sequence_number, k.status AS contract_status, c.company_name AS last_customer, d.bk_date AS termination_date FROM fact_lease_asset f
        JOIN dim_contract k ON k.sk_contract = f.sk_contract AND k.current_flag = 1 AND k.status NOT IN ('Inactive', 'Pending', 'Installing Assets') JOIN dim_customer c USING (sk_customer) JOIN dim_asset a USING (sk_asset) JOIN dim_branch b USING (sk_branch)
        LEFT JOIN dim_date d ON d.sk_date = f.sk_date_termination_date QUALIFY row_number() OVER (PARTITION BY a.bk_asset_id ORDER BY k.bk_contract_id DESC, f.sk_date_record DESC, f.sk_time_record DESC) = 1)
    SELECT DISTINCT d.asset_id, g.registration_number, d.fleet_number, d.asset_contract_type, t.value AS asset_sub_type, q.city, l.sequence_number, l.contract_status, l.last_customer, l.termination_date, i.stage, i.opp_number, i.credit_number, i.company
    FROM v_details d LEFT JOIN dim_detail_config t ON t.bk_detail_config_id = d.asset_sub_type_id {ACTIVE.format("d")} {PLACE.format("d")} LEFT JOIN l ON l.asset_id = d.asset_id LEFT JOIN v_in_application i ON i.asset_id = d.asset_id
    WHERE d.asset_status = 'Inventory'""")
lease_query("service_schedule", "V102 W01 W12 A09 J11", history.service_schedule, """
    WITH l AS (SELECT x.asset_id, x.contract_id FROM v_leased x LEFT JOIN dim_date d ON d.sk_date = x.sk_date_termination_date WHERE x.contract_status <> 'Inactive' QUALIFY row_number() OVER (PARTITION BY x.asset_id ORDER BY d.bk_date DESC NULLS LAST, x.contract_id DESC) = 1),
    o AS (SELECT bk_contract_id, CASE WHEN start_date = DATE '1900-01-01' THEN dp_process_datetime ELSE start_date END AS origination_date FROM dim_contract WHERE status = 'Commenced'
        QUALIFY row_number() OVER (PARTITION BY bk_contract_id ORDER BY dp_process_datetime, sk_contract) = 1)
    SELECT DISTINCT s.asset_id, s.alias, s.asset_status, s.service_intervals_vehicle, l.contract_id, f.status, f.sequence_number, f.commencement_date, f.party_name, f.product_name, f.cost_center, f.payment_frequency, f.customer_term_in_months,
        f.line_of_business, r.sales_rep, o.origination_date
    FROM asset_sheet s LEFT JOIN l ON l.asset_id = s.asset_id LEFT JOIN v_finance_latest f ON f.contract_id = l.contract_id LEFT JOIN v_sales_reps r ON r.contract_id = f.contract_id LEFT JOIN o ON o.bk_contract_id = l.contract_id
    WHERE s.asset_status IN ('Leased', 'Inventory') AND f.previous_schedule_number IS NULL""")
lease_query("fleet_with_history", "V103 J09 W01 A09 P04", history.fleet_with_history, """
    SELECT DISTINCT c.id AS contract_key, e.asset_id AS asset_key, c.sequence_number, c.customer_name, c.status AS contract_status, c.product, c.commencement_date, e.terminated_on, e.contract_mileage, e.status AS equipment_status,
        a.registration_number, a.source_system, d.fleet_number, CASE WHEN i.asset_id IS NULL THEN 0 ELSE 1 END AS in_application, n.event_day AS novated_on
    FROM flat_contracts c JOIN flat_equipment e ON e.contract_id = c.id JOIN flat_assets a ON a.id = e.asset_id LEFT JOIN dim_asset d ON CAST(d.bk_asset_id AS VARCHAR) = a.id AND d.current_flag = 1
    LEFT JOIN v_in_application_once i ON i.asset_id = d.bk_asset_id LEFT JOIN v_events n ON n.event = 'novated' AND CAST(n.contract_id AS VARCHAR) = c.id WHERE c.status NOT IN ('Inactive', 'Pending', 'InstallingAssets')""")
lease_query("provision_assets", "V105 D12 W09 J10 A04 C01", history.provision_assets, """
    WITH k AS (SELECT a.*, CASE WHEN COUNT(*) OVER (PARTITION BY a.equipment_id) > 1 OR a.source_system = 'current' THEN 'keep' ELSE 'remove' END AS verdict FROM flat_assets a),
    j AS (SELECT k.*, p.equipment_id AS parent_equipment_id, COALESCE(p.equipment_id, k.equipment_id) AS combined_equipment_id FROM k LEFT JOIN flat_assets p ON p.id = k.parent_asset_id WHERE verdict = 'keep')
    SELECT j.id, j.alias, j.source_system, j.equipment_id, j.verdict AS keep_or_remove, j.parent_equipment_id, j.combined_equipment_id, l.id AS latest_asset_id, l.status AS latest_status, s.sold_date
    FROM j LEFT JOIN flat_assets l ON l.equipment_id = j.combined_equipment_id AND l.source_system = 'current'
    LEFT JOIN (SELECT a.bk_asset_id, MIN(d.bk_date) AS sold_date FROM dim_asset a JOIN fact_asset_status f USING (sk_asset) JOIN dim_asset_status y USING (sk_asset_status) LEFT JOIN dim_date d ON d.sk_date = f.sk_date_record WHERE y.asset_status = 'Sold' GROUP BY 1) s
        ON CAST(s.bk_asset_id AS VARCHAR) = l.id""")
lease_query("test_tracker", "V106 A09 J11 C01", history.test_tracker, f"""
    WITH h AS (SELECT DISTINCT a.bk_asset_id AS asset_id, k.sequence_number, c.company_name, p.transaction_type AS deal_type FROM fact_lease_asset f JOIN dim_contract k ON k.sk_contract = f.sk_contract AND k.current_flag = 1 AND k.status = 'Commenced'
        JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance AND l.is_current = 1 JOIN dim_customer c USING (sk_customer) JOIN dim_asset a USING (sk_asset) LEFT JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = k.deal_product_type_id)
    SELECT DISTINCT d.asset_id, g.registration_number, d.mot_expiry_date, d.mot_passed_date, t.value AS booking_status, d.asset_status, q.city, h.sequence_number, h.company_name, h.deal_type, i.stage,
        CASE i.stage WHEN 'app' THEN i.app_company WHEN 'app structure' THEN i.structure_company WHEN 'line of credit' THEN i.line_company END AS company_in_application,
        CASE i.stage WHEN 'app structure' THEN i.structure_product WHEN 'line of credit' THEN i.line_product END AS product_in_application
    FROM v_details d LEFT JOIN dim_detail_config t ON t.bk_detail_config_id = d.mot_booking_status_id {ACTIVE.format("d")} {PLACE.format("d")} LEFT JOIN h ON h.asset_id = d.asset_id LEFT JOIN v_in_application_once i ON i.asset_id = d.asset_id""")
lease_query("originations", "V108 D19 W01 J09 A01 A02 F04 C01 T04", history.originations, f"""
    WITH c AS (SELECT * FROM flat_contracts WHERE status NOT IN ('Inactive', 'Pending', 'InstallingAssets') AND COALESCE(schedule_number, '') NOT LIKE '8%' AND COALESCE(sequence_number, '') NOT LIKE '%novated%'
        QUALIFY row_number() OVER (PARTITION BY sequence_number ORDER BY created_date, id) = 1),
    t AS (SELECT contract_id, SUM(nbv_amount) AS total_nbv FROM v_leased WHERE contract_status <> 'Inactive' GROUP BY 1)
    SELECT c.id, c.sequence_number, c.source_system, CAST(CASE c.source_system WHEN 'legacy' THEN CASE WHEN c.product LIKE '%Hire Purchase%' THEN COALESCE(c.financed_amount, 0) - COALESCE(c.vat_on_asset, 0) ELSE c.financed_amount END
            WHEN 'current' THEN COALESCE(t.total_nbv, 0) - COALESCE(c.down_payment_amount, 0) - COALESCE(c.tax_deferral_amount, 0) END AS DOUBLE) AS origination_amount,
        CASE c.source_system WHEN 'legacy' THEN CASE WHEN c.was_migrated = 1 THEN c.created_date ELSE c.commencement_date END WHEN 'current' THEN e.event_day END AS origination_day,
        CASE WHEN c.product LIKE '%Contract Hire%' THEN 'Contract Hire' WHEN c.product LIKE '%Operating Lease%' THEN 'Operating Lease' WHEN c.product LIKE '%Hire Purchase%' THEN 'Hire Purchase' WHEN c.product LIKE '%Rental%' THEN 'Rental'
            WHEN c.product LIKE '%Finance Lease%' THEN 'Finance Lease' ELSE c.product END AS product_name, n.number_of_assets, COALESCE(k.key_account, c.line_of_business) AS line_of_business
    FROM c LEFT JOIN t ON CAST(t.contract_id AS VARCHAR) = c.id LEFT JOIN v_events e ON e.event = 'commenced' AND CAST(e.contract_id AS VARCHAR) = c.id
    LEFT JOIN (SELECT e.contract_id, COUNT(a.id) AS number_of_assets FROM flat_equipment e JOIN flat_assets a ON a.id = e.asset_id WHERE COALESCE(a.vehicle_category, '') <> 'Ancillary' AND COALESCE(a.asset_sub_type, '') <> 'Fleet Managed Asset' GROUP BY 1) n ON n.contract_id = c.id
    LEFT JOIN (SELECT DISTINCT contract_id, 'Key Accounts' AS key_account FROM flat_equipment WHERE customer_id IN ('3', '5', '17')) k ON k.contract_id = c.id""")
lease_query("rental_utilisation", "V116 D14 W01 W12 A09 C01 J11", history.rental_utilisation, f"""
    SELECT s.asset_id, CASE WHEN s.asset_status = 'Leased' THEN CASE WHEN COALESCE(x.charges, 0) + COALESCE(l.rent_amount, 0) = 0.01 THEN 'Yes (FoC)' ELSE 'Yes' END WHEN i.asset_id IS NOT NULL THEN 'In Application' ELSE 'No' END AS utilised,
        s.registration_number, s.asset_status, l.terminated_on, l.branch_name, f.sequence_number, f.status AS booking_status, f.commencement_date, f.product_name, r.sales_rep, i.opp_number, i.stage AS application_stage,
        CAST(COALESCE(x.charges, 0) + COALESCE(l.rent_amount, 0) AS DOUBLE) AS total_charge, CAST(v.last_book_value AS DOUBLE) AS equipment_nbv
    FROM asset_sheet s LEFT JOIN v_latest_lease l ON l.asset_id = s.asset_id LEFT JOIN v_finance_latest f ON f.contract_id = l.contract_id LEFT JOIN v_sales_reps r ON r.contract_id = f.contract_id LEFT JOIN v_in_application_once i ON i.asset_id = s.asset_id
    LEFT JOIN v_charges_asset x ON x.contract_id = l.contract_id AND x.asset_id = s.asset_id LEFT JOIN v_asset_value v ON v.asset_id = s.asset_id WHERE s.asset_status IN ('Leased', 'Inventory') AND s.asset_contract_type = 'Rental'""")
lease_query("tyre_contracts", "V118 J10 W01 J11", history.tyre_contracts, f"""
    SELECT f.contract_id, a.bk_asset_id AS asset_id, l.sk_lease_asset, l.sk_time_record, f.sequence_number, f.party_name, b.name AS account_legal_entity, f.commencement_date, f.product_name, g.registration_number, y.asset_status, a.model_year, a.tyres_fair_wear_tear,
        z.tyre_configuration, v.axle_index, c1.value AS axle_config, c2.value AS steer_axle, c3.value AS drive_axle, c4.value AS lift_axle, c5.value AS axles, q.depot_code, q.city
    FROM fact_lease_asset l JOIN dim_contract k ON k.sk_contract = l.sk_contract AND k.current_flag = 1 AND k.status = 'Commenced' JOIN dim_lease_finance w ON w.sk_lease_finance = l.sk_lease_finance AND w.is_current = 1 AND w.current_flag = 1
    JOIN dim_lease_asset m ON m.sk_lease_asset = l.sk_lease_asset AND m.is_approved = 1 JOIN dim_asset a ON a.sk_asset = l.sk_asset AND a.current_flag = 1 JOIN dim_customer u ON u.sk_customer = l.sk_customer AND u.current_flag = 1
    JOIN v_finance_latest f ON f.contract_id = k.bk_contract_id AND f.status = 'Commenced' AND f.customer_is_current = 1 LEFT JOIN dim_business_type b ON b.bk_business_type_id = f.business_type_id LEFT JOIN v_registration g ON g.asset_id = a.bk_asset_id
    LEFT JOIN v_status_latest t ON t.asset_id = a.bk_asset_id LEFT JOIN dim_asset_status y ON y.sk_asset_status = t.sk_asset_status LEFT JOIN dim_additional_details z ON z.bk_additional_details_id = a.bk_asset_id AND z.current_flag = 1
    LEFT JOIN dim_detail_config c1 ON c1.bk_detail_config_id = z.axle_config_id LEFT JOIN dim_detail_config c2 ON c2.bk_detail_config_id = z.steer_axle_id LEFT JOIN dim_detail_config c3 ON c3.bk_detail_config_id = z.drive_axle_id
    LEFT JOIN dim_detail_config c4 ON c4.bk_detail_config_id = z.lift_axle_id LEFT JOIN dim_detail_config c5 ON c5.bk_detail_config_id = z.axles_id LEFT JOIN dim_vehicle_detail v ON v.bk_vehicle_detail_id = a.bk_asset_id
    LEFT JOIN dim_asset_location o ON o.asset_id = a.bk_asset_id AND o.is_current = 1 LEFT JOIN dim_location q ON q.bk_location_id = o.location_id
    WHERE l.sk_date_termination_date = -1 AND (y.asset_status IS NULL OR y.asset_status = 'Leased')""")
lease_query("orders_over_time", "V107 D07 W04 W05 J07 M04 T04 P07", procurement.orders_over_time, "SELECT * FROM v_orders")
lease_query("asset_funding", "V112 D15 A01 A04 W01 J05 J10 C01", procurement.asset_funding, f"""
    SELECT v.asset_id, {dbl("adjusted_book_value", source="s.")}, COALESCE(f.last_invoice, CASE WHEN m.asset_id IS NOT NULL THEN DATE '2001-01-31' END) AS last_invoice, CAST(COALESCE(f.t, 0) + COALESCE(m.migrated_amount, 0) AS DOUBLE) AS total_funded,
        CASE WHEN COALESCE(f.t, 0) + COALESCE(m.migrated_amount, 0) = 0 THEN 'Not Funded' WHEN COALESCE(f.t, 0) + COALESCE(m.migrated_amount, 0) >= s.adjusted_book_value THEN 'Fully Funded' ELSE 'Partially Funded' END AS funding_status
    FROM (SELECT DISTINCT asset_id FROM v_order_versions) v JOIN asset_sheet s ON s.asset_id = v.asset_id LEFT JOIN (SELECT asset_id, SUM(funded) AS t, MAX(invoice_date) AS last_invoice FROM v_funded GROUP BY 1) f ON f.asset_id = v.asset_id
    LEFT JOIN v_migrated m ON m.asset_id = v.asset_id""")
lease_query("funding_over_time", "V113 D08 W06 W07 W04 J06 J05 A01", procurement.funding_over_time, f"""
    WITH h AS (SELECT asset_id, income_date, net_value_amount, bk_asset_value_history_id FROM dim_asset_value_history WHERE source_module = 'AssetValueAdjustment' AND is_lessor_owned = 1 AND is_schedule = 1 AND is_accounted = 1
        AND gl_journal_id IS NOT NULL AND income_date <= {DAY})
    SELECT o.asset_id, o.snapshot, o.vehicle_category, o.allocated_status, o.funding_status, o.order_type,
        CAST(COALESCE((SELECT SUM(f.funded) FROM v_funded f WHERE f.asset_id = o.asset_id AND f.invoice_date < o.snapshot), 0) + COALESCE(m.migrated_amount, 0) AS DOUBLE) AS cumulative_funded,
        CAST((SELECT arg_max(h.net_value_amount, (h.income_date, h.bk_asset_value_history_id)) FROM h WHERE h.asset_id = o.asset_id AND h.income_date < o.snapshot) AS DOUBLE) AS adjusted_book_value,
        CASE WHEN l.line_created <= o.snapshot THEN l.line_customer END AS line_customer, CASE WHEN l.line_created <= o.snapshot THEN l.line_created END AS line_created
    FROM v_orders o LEFT JOIN v_migrated m ON m.asset_id = o.asset_id LEFT JOIN v_first_line l ON l.asset_id = o.asset_id""")
lease_query("first_contracts", "V114 W01 J05 A09 K03 M05", procurement.first_contracts, """
    SELECT s.asset_id, f.sequence_number, f.commencement_date, s.alias, g.registration_number, s.manufacturer_name, s.model_name, CAST(floor(s.gvw / 1000) AS BIGINT) AS gvw_tonnes, n.serial_number, s.equipment_id, d.asset_description
    FROM v_procured s JOIN v_leased l ON l.asset_id = s.asset_id JOIN v_finance_latest f ON f.contract_id = l.contract_id AND COALESCE(f.status, '') <> 'Inactive' LEFT JOIN v_registration g ON g.asset_id = s.asset_id
    LEFT JOIN dim_serial_number n ON n.asset_id = s.asset_id LEFT JOIN v_description d ON d.asset_id = s.asset_id WHERE s.asset_id IN (SELECT asset_id FROM v_orders)
    QUALIFY row_number() OVER (PARTITION BY s.asset_id ORDER BY f.commencement_date NULLS FIRST, l.contract_id) = 1""")
lease_query("order_book", "V115 W01 C01 J11", procurement.order_book, f"""
    SELECT s.asset_id, c.party_name AS customer, i.company_name AS supplying_dealer, {kind("s.allocated_status", "s.available_from", DAY)} AS order_type, s.project_number, s.registration_number, COALESCE(s.delivered_on, s.planned_delivery) AS origination_date,
        s.allocated_status, s.asset_funding_status, CAST(s.adjusted_book_value AS DOUBLE) AS book_value, d.asset_description, l.line_opp, l.line_customer, l.expected_commencement_date
    FROM v_procured s LEFT JOIN dim_asset a ON a.bk_asset_id = s.asset_id AND a.current_flag = 1 LEFT JOIN dim_customer c ON c.bk_customer_id = a.customer_id AND c.current_flag = 1
    LEFT JOIN (SELECT a.bk_asset_id, v.company_name FROM fact_payable_invoice_asset f JOIN dim_asset a ON a.sk_asset = f.sk_asset AND a.current_flag = 1 LEFT JOIN dim_vendor v ON v.bk_vendor_id = f.vendor_id
        QUALIFY row_number() OVER (PARTITION BY a.bk_asset_id ORDER BY f.acquisition_cost_amount DESC, f.sk_time_record DESC) = 1) i ON i.bk_asset_id = s.asset_id
    LEFT JOIN v_first_line l ON l.asset_id = s.asset_id LEFT JOIN v_description d ON d.asset_id = s.asset_id WHERE s.asset_status = 'AwaitingDelivery'""")
