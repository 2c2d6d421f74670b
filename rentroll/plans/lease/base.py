"""Base views of the lease warehouse and the SQL they are checked against."""

from pyspark.sql import functions as F

from rentroll.lease import assets, contracts, receivables
from rentroll.plans.lease.fixture import VIEWS, lease_query

DAY = "DATE '2001-06-30'"

VIEWS |= {
    "v_people": """SELECT DISTINCT e.party_id AS customer_id, e.employee_id, u.full_name AS employee_name, r.name AS role_function, r.system_defined_name AS system_name
        FROM dim_party_employee e JOIN dim_role_function r ON r.bk_role_function_id = e.role_function_id JOIN dim_user u ON u.bk_user_id = e.employee_id
        WHERE e.is_primary = 1 AND e.is_active = 1""",
    "v_registration": """SELECT asset_id, registration_number, effective_date, is_active FROM dim_registration WHERE current_flag = 1
        QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY effective_date DESC, bk_registration_id DESC) = 1""",
    "v_status_latest": """SELECT a.bk_asset_id AS asset_id, f.* FROM dim_asset a JOIN fact_asset_status f USING (sk_asset)
        QUALIFY row_number() OVER (PARTITION BY a.bk_asset_id ORDER BY f.sk_asset DESC) = 1""",
    "v_asset_value": f"""
        WITH h AS (SELECT * FROM dim_asset_value_history WHERE is_lessor_owned = 1 AND is_schedule = 1 AND is_accounted = 1 AND income_date <= {DAY}),
        o AS (SELECT * FROM h WHERE is_cleared = 1 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY income_date, bk_asset_value_history_id) = 1),
        c AS (SELECT * FROM h WHERE gl_journal_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY income_date DESC, bk_asset_value_history_id DESC) = 1),
        l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY income_date DESC, bk_asset_value_history_id DESC) = 1)
        SELECT a.bk_asset_id AS asset_id, o.begin_book_value_amount AS begin_book_value, o.cost_amount AS cost, c.end_book_value_amount AS end_book_value,
               l.end_book_value_amount AS last_book_value
        FROM dim_asset a LEFT JOIN o ON o.asset_id = a.bk_asset_id LEFT JOIN c ON c.asset_id = a.bk_asset_id LEFT JOIN l ON l.asset_id = a.bk_asset_id WHERE a.current_flag = 1""",
    "v_depreciation": """SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY COALESCE(terminated_date, end_date) DESC, begin_date DESC, sk_book_depreciation DESC) AS current_asset_value,
            row_number() OVER (PARTITION BY asset_id ORDER BY COALESCE(contract_id, -1) DESC, begin_date DESC, sk_book_depreciation DESC) AS current_contract_value,
            row_number() OVER (PARTITION BY asset_id ORDER BY begin_date, sk_book_depreciation) AS initial_asset_value,
            row_number() OVER (PARTITION BY asset_id, contract_id ORDER BY begin_date, sk_book_depreciation) AS initial_contract_value
        FROM dim_book_depreciation WHERE current_flag = 1 AND is_active = 1""",
    "v_details": """SELECT a.bk_asset_id AS asset_id, a.* EXCLUDE (bk_asset_id, sk_asset, start_date, end_date, created_time, current_flag), s.asset_status, d.* EXCLUDE (bk_additional_details_id, current_flag, start_date, end_date, created_time),
            v.gvw, v.body_type_config_id, v.body_builder_config_id, v.axle_index, v.contract_mileage, a.start_date, a.created_time
        FROM dim_asset a JOIN fact_asset_status f USING (sk_asset) JOIN dim_additional_details d ON d.sk_additional_details = f.sk_additional_details AND d.current_flag = 1
        JOIN dim_vehicle_detail v ON v.sk_vehicle_detail = f.sk_vehicle_detail LEFT JOIN dim_asset_status s ON s.sk_asset_status = f.sk_asset_status WHERE a.current_flag = 1""",
    "v_description": """
        WITH t AS (SELECT asset_id, manufacturer_name AS m, CASE WHEN make_name = 'Other' THEN '' ELSE make_name END AS k, CASE WHEN model_name = 'Other' THEN '' ELSE model_name END AS o,
                b.body_type_code AS b, CASE WHEN COALESCE(b.body_type_code, '') LIKE '%Bus%' AND product_name LIKE '%Bus%' THEN '' ELSE product_name END AS c
            FROM v_details LEFT JOIN dim_body_type_config b ON b.bk_body_type_config_id = body_type_config_id)
        SELECT DISTINCT asset_id, m || CASE WHEN k <> '' AND k <> m THEN ' ' || k ELSE '' END || CASE WHEN o <> '' THEN ' ' || o ELSE '' END
            || CASE WHEN b <> '' THEN ' ' || b ELSE '' END || CASE WHEN c <> '' THEN ' ' || c ELSE '' END AS asset_description FROM t""",
    "v_features": """SELECT f.asset_id, f.equipment_id, r.registration_number, r.effective_date, c.name AS feature_category, f.is_synced, f.sync_status
        FROM dim_asset_features f LEFT JOIN dim_asset_category c ON c.bk_asset_category_id = f.asset_category_id LEFT JOIN dim_registration r ON r.asset_id = f.asset_id AND r.current_flag = 1
        QUALIFY row_number() OVER (PARTITION BY f.equipment_id ORDER BY r.effective_date DESC NULLS LAST, r.bk_registration_id DESC, f.bk_asset_feature_id DESC) = 1""",
    "v_open_apps": """SELECT a.bk_credit_application_id AS opp_id, o.number AS opp, c.party_name AS company, a.status, u.full_name AS created_by
        FROM dim_credit_application a JOIN dim_opportunity o ON o.bk_opportunity_id = a.bk_credit_application_id
        JOIN dim_customer c ON c.bk_customer_id = o.customer_id AND c.current_flag = 1 JOIN dim_cost_center n ON n.bk_cost_center_id = o.cost_center_id
        LEFT JOIN dim_credit_profile p ON p.opportunity_id = a.bk_credit_application_id AND p.current_flag = 1 LEFT JOIN dim_user u ON u.bk_user_id = a.created_by_id
        WHERE a.status IN ('Pending', 'SubmittedToCredit') AND p.opportunity_id IS NULL""",
    "v_credit_lines": """
        WITH x AS (SELECT h.asset_id, h.bk_approved_structure_asset_id AS hid, s.*, p.number AS credit_number, p.status AS profile_status, p.created_time AS profile_created, p.opportunity_id, p.cost_center_id, p.assigned_to_user_id
            FROM dim_approved_structure_asset h JOIN dim_approved_structure s ON s.bk_approved_structure_id = h.approved_structure_id
            JOIN dim_credit_profile p ON p.bk_credit_profile_id = s.credit_profile_id AND p.current_flag = 1 WHERE p.status NOT IN ('Inactivate', 'Declined', 'OpportunityWithdrawn', 'Cancelled')
            QUALIFY row_number() OVER (PARTITION BY h.asset_id, p.number ORDER BY s.number DESC, h.bk_approved_structure_asset_id DESC) = 1)
        SELECT x.*, o.number AS opp_number, c.party_name, d.transaction_type AS product_name, n.description AS cost_center, k.bk_contract_id AS contract_id, k.sequence_number, k.status AS booking_status, u.full_name AS created_by
        FROM x JOIN dim_opportunity o ON o.bk_opportunity_id = x.opportunity_id JOIN dim_customer c ON c.bk_customer_id = o.customer_id AND c.current_flag = 1
        JOIN dim_deal_product_type d ON d.bk_deal_product_type_id = x.deal_product_type_id JOIN dim_cost_center n ON n.bk_cost_center_id = x.cost_center_id
        LEFT JOIN dim_contract k ON k.credit_approved_structure_id = x.bk_approved_structure_id AND k.current_flag = 1 AND k.status <> 'Inactive' LEFT JOIN dim_user u ON u.bk_user_id = o.created_by_id""",
    "v_in_application": """
        WITH a AS (SELECT h.asset_id, v.* FROM dim_application_asset h JOIN v_open_apps v ON v.opp_id = h.credit_application_id
            QUALIFY row_number() OVER (PARTITION BY h.asset_id, v.opp_id ORDER BY h.bk_application_asset_id DESC) = 1),
        s AS (SELECT h.asset_id, v.*, d.transaction_type AS product FROM dim_application_structure t JOIN dim_application_structure_asset h ON h.application_structure_id = t.bk_application_structure_id
            JOIN v_open_apps v ON v.opp_id = t.credit_application_id JOIN dim_deal_product_type d ON d.bk_deal_product_type_id = t.transaction_type_id
            QUALIFY row_number() OVER (PARTITION BY h.asset_id, v.opp_id ORDER BY h.bk_application_structure_asset_id DESC) = 1),
        u AS (SELECT COALESCE(a.asset_id, s.asset_id) AS asset_id, a.opp AS app_opp, a.company AS app_company, a.status AS app_status, a.created_by AS app_by, s.opp AS s_opp, s.company AS structure_company, s.product AS structure_product, s.status AS s_status
            FROM a FULL JOIN s ON s.asset_id = a.asset_id AND s.opp_id = a.opp_id
            UNION ALL BY NAME SELECT asset_id, credit_number, profile_status, sequence_number, booking_status, party_name AS line_company, product_name AS line_product, opp_number AS line_opp, created_by AS line_by FROM v_credit_lines),
        j AS (SELECT u.asset_id, x.alias, u.credit_number, u.profile_status, u.sequence_number, u.booking_status,
            CASE WHEN u.sequence_number IS NOT NULL AND u.booking_status = 'InstallingAssets' THEN 'contract installing assets'
                 WHEN u.sequence_number IS NOT NULL AND u.booking_status = 'Pending' THEN 'contract pending' WHEN u.sequence_number IS NOT NULL THEN 'converted to contract'
                 WHEN u.credit_number IS NOT NULL THEN 'line of credit' WHEN u.s_status IS NOT NULL THEN 'app structure' WHEN u.app_status IS NOT NULL THEN 'app' ELSE 'not in application' END AS stage,
            COALESCE(line_product, structure_product) AS product, COALESCE(line_company, app_company) AS company, COALESCE(line_opp, s_opp, app_opp) AS opp_number, COALESCE(app_by, line_by) AS created_by,
            app_company, app_status, structure_company, structure_product, line_company, line_product
            FROM u JOIN dim_asset x ON x.bk_asset_id = u.asset_id AND x.current_flag = 1)
        SELECT * FROM j WHERE stage NOT IN ('converted to contract', 'not in application')""",
    "v_in_application_once": "SELECT * FROM v_in_application QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY opp_number DESC, credit_number DESC NULLS LAST) = 1",
    "v_charges_detail": """SELECT c.bk_contract_id AS contract_id, c.sequence_number, d.asset_id, r.name AS charge_name, SUM(d.amount) AS charges, SUM(d.vat_amount) AS vat_amount
        FROM dim_sundry_recurring s JOIN dim_recurring_detail d ON d.sundry_recurring_id = s.bk_sundry_recurring_id JOIN dim_contract c ON c.bk_contract_id = s.contract_id AND c.current_flag = 1
        JOIN dim_receivable_code r ON r.bk_receivable_code_id = s.receivable_code_id WHERE s.is_asset_based = 1 GROUP BY ALL""",
    "v_charges_asset": "SELECT contract_id, sequence_number, asset_id, SUM(charges) AS charges, SUM(vat_amount) AS vat_amount FROM v_charges_detail GROUP BY ALL",
    "v_leased_all": """SELECT c.bk_contract_id AS contract_id, a.bk_asset_id AS asset_id, c.sequence_number, c.status AS contract_status, u.bk_customer_id AS customer_id, m.is_approved, f.*
        FROM fact_lease_asset f JOIN dim_contract c ON c.sk_contract = f.sk_contract AND c.current_flag = 1 JOIN dim_lease_asset m USING (sk_lease_asset)
        JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance AND l.is_current = 1 JOIN dim_asset a ON a.sk_asset = f.sk_asset JOIN dim_customer u ON u.sk_customer = f.sk_customer""",
    "v_leased": "SELECT * FROM v_leased_all WHERE is_approved = 1 QUALIFY row_number() OVER (PARTITION BY contract_id, asset_id ORDER BY sk_date_record DESC, sk_time_record DESC, sk_lease_asset DESC) = 1",
    "v_lease_assets": """SELECT l.*, d.bk_date AS termination_date, COALESCE(c.charges, 0) AS asset_budget_value, COALESCE(c.charges, 0) + COALESCE(l.rent_amount, 0) AS total_charge
        FROM v_leased l LEFT JOIN dim_date d ON d.sk_date = l.sk_date_termination_date LEFT JOIN v_charges_asset c ON c.contract_id = l.contract_id AND c.asset_id = l.asset_id""",
    "v_lease_assets_live": "SELECT * FROM v_lease_assets WHERE termination_date = DATE '9999-01-01' AND contract_status <> 'Inactive'",
    "v_assignments": """SELECT k.contract_id, u.full_name AS employee_name, r.name AS role_function, r.system_defined_name AS system_name FROM dim_contract_employee k
        JOIN dim_party_employee e ON e.bk_party_employee_id = k.party_employee_id JOIN dim_role_function r ON r.bk_role_function_id = e.role_function_id JOIN dim_user u ON u.bk_user_id = e.employee_id
        QUALIFY row_number() OVER (PARTITION BY k.contract_id ORDER BY k.is_primary DESC, k.bk_contract_employee_id) = 1""",
    "v_sales_reps": """SELECT k.contract_id, u.full_name AS sales_rep FROM dim_contract_employee k JOIN dim_party_employee e ON e.bk_party_employee_id = k.party_employee_id AND e.is_active = 1
        JOIN dim_role_function r ON r.bk_role_function_id = e.role_function_id AND r.name = 'Sales Rep' JOIN dim_user u ON u.bk_user_id = e.employee_id
        QUALIFY row_number() OVER (PARTITION BY k.contract_id ORDER BY e.is_primary DESC, k.bk_contract_employee_id) = 1""",
    "v_customer_people": """SELECT c.bk_customer_id AS customer_id, c.party_name, COALESCE(s.employee_name, m.employee_name) AS employee_name, COALESCE(s.role_function, m.role_function) AS role_function,
            COALESCE(s.system_name, m.system_name) AS system_name FROM dim_customer c LEFT JOIN v_people s ON s.customer_id = c.bk_customer_id AND s.role_function = 'Sales Rep'
        LEFT JOIN v_people m ON m.customer_id = c.bk_customer_id AND m.role_function = 'Account Manager' WHERE c.current_flag = 1 AND c.status = 'Active'""",
    "v_finance": """SELECT k.bk_contract_id AS contract_id, k.sequence_number, c.bk_customer_id AS customer_id, l.bk_lease_finance_id AS lease_finance_id, r.base_rate, r.spread, f.*
        FROM fact_lease_finance_detail f JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance AND l.is_current = 1 AND l.current_flag = 1
        LEFT JOIN dim_lease_interest_rate i ON i.lease_finance_detail_id = l.bk_lease_finance_id LEFT JOIN dim_interest_rate_detail r ON r.bk_interest_rate_detail_id = i.interest_rate_detail_id
        JOIN dim_contract k ON k.sk_contract = f.sk_contract AND k.current_flag = 1 JOIN dim_customer c ON c.sk_customer = f.sk_customer
        JOIN dim_branch b ON b.sk_branch = f.sk_branch JOIN dim_line_of_business o ON o.sk_line_of_business = f.sk_line_of_business JOIN dim_cost_center n ON n.sk_cost_center = f.sk_cost_center
        QUALIFY row_number() OVER (PARTITION BY k.bk_contract_id ORDER BY f.sk_contract DESC, f.sk_customer DESC, i.sk_lease_interest_rate DESC NULLS LAST, f.sk_date_record DESC, f.sk_time_record DESC) = 1""",
    "v_finance_latest": """SELECT x.*, p.transaction_type AS product_name, n.description AS cost_center, o.name AS line_of_business, d.bk_date AS commencement_date, m.bk_date AS maturity_date,
            CASE WHEN x.is_advance = 1 THEN 'ADVANCE' ELSE 'ARREARS' END AS payment_method FROM (
        SELECT f.*, k.bk_contract_id AS contract_id, k.sequence_number, k.contract_number, k.status, k.report_status, k.deal_product_type_id, k.created_time, k.previous_schedule_number, k.grace_delinquency_days,
            l.bk_lease_finance_id AS lease_finance_id, l.is_advance, l.payment_frequency, l.customer_term_in_months, l.lease_contract_type, l.approval_status,
            c.bk_customer_id AS customer_id, c.party_name, c.company_name, c.party_number, c.external_reference_id, c.organization_id, c.creation_date, c.sic_code_id, c.business_type_id, c.current_flag AS customer_is_current
        FROM fact_lease_finance_detail f JOIN dim_contract k ON k.sk_contract = f.sk_contract AND k.current_flag = 1 JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance AND l.is_current = 1 AND l.current_flag = 1
        JOIN dim_customer c ON c.sk_customer = f.sk_customer
        QUALIFY row_number() OVER (PARTITION BY k.bk_contract_id ORDER BY f.sk_contract DESC, f.sk_date_record DESC, f.sk_time_record DESC) = 1) x
        LEFT JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = x.deal_product_type_id LEFT JOIN dim_cost_center n ON n.sk_cost_center = x.sk_cost_center
        LEFT JOIN dim_line_of_business o ON o.sk_line_of_business = x.sk_line_of_business LEFT JOIN dim_date d ON d.sk_date = x.sk_date_commencement_date LEFT JOIN dim_date m ON m.sk_date = x.sk_date_maturity_date""",
    "v_credit_apps": """SELECT o.bk_opportunity_id AS opportunity_id, o.number AS opportunity_number, o.customer_id, o.report_status, p.bk_credit_profile_id AS credit_profile_id, p.number AS credit_profile_number, p.status AS loc_status,
            p.approved_amount, p.is_pre_approval, p.all_assets_taken_down, p.created_time AS loc_created_time, s.expected_commencement_date, s.customer_term, s.balloon_amount, a.status AS application_status,
            a.created_time AS application_created, a.submitted_to_credit_date, COALESCE(e.n, 0) AS equipment_count, d.transaction_type AS product_name, n.description AS cost_center, b.branch_name, g.name AS legal_entity,
            g.legal_entity_number, t.name AS line_of_business, c.party_name, c.company_name, u1.full_name AS application_owner, u2.full_name AS assigned_user, u3.full_name AS application_created_by, r.employee_name AS sales_rep
        FROM dim_opportunity o LEFT JOIN dim_credit_profile p ON p.opportunity_id = o.bk_opportunity_id AND p.current_flag = 1 LEFT JOIN dim_customer c ON c.bk_customer_id = o.customer_id AND c.current_flag = 1
        LEFT JOIN dim_approved_structure s ON s.credit_profile_id = p.bk_credit_profile_id AND s.number = 1 LEFT JOIN dim_credit_application a ON a.bk_credit_application_id = o.bk_opportunity_id
        LEFT JOIN (SELECT credit_application_id, COUNT(asset_id) AS n FROM dim_application_asset GROUP BY credit_application_id) e ON e.credit_application_id = o.bk_opportunity_id
        LEFT JOIN dim_deal_product_type d ON d.bk_deal_product_type_id = s.deal_product_type_id LEFT JOIN dim_cost_center n ON n.bk_cost_center_id = o.cost_center_id LEFT JOIN dim_branch b ON b.bk_branch_id = o.branch_id
        LEFT JOIN dim_legal_entity g ON g.bk_legal_entity_id = o.legal_entity_id LEFT JOIN dim_line_of_business t ON t.bk_line_of_business_id = o.line_of_business_id
        LEFT JOIN dim_user u1 ON u1.bk_user_id = o.created_by_id LEFT JOIN dim_user u2 ON u2.bk_user_id = p.assigned_to_user_id LEFT JOIN dim_user u3 ON u3.bk_user_id = a.created_by_id
        LEFT JOIN v_customer_people r ON r.customer_id = o.customer_id AND r.system_name = 'SalesRep'""",
    "v_contracts": """
        WITH started AS (SELECT bk_contract_id, dp_process_date, MIN(start_date) OVER (PARTITION BY sequence_number) AS first_start FROM dim_contract WHERE status = 'Commenced'),
        origin AS (SELECT bk_contract_id, MIN(CASE WHEN first_start = DATE '1900-01-01' THEN dp_process_date ELSE first_start END) AS lease_start_date FROM started GROUP BY bk_contract_id),
        record AS (SELECT k.bk_contract_id, MIN(f.sk_date_record) AS sk_created_date FROM fact_lease_finance_detail f JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance AND l.is_current = 1 AND l.current_flag = 1
            JOIN dim_contract k ON k.sk_contract = f.sk_contract AND k.current_flag = 1 JOIN dim_customer c ON c.sk_customer = f.sk_customer JOIN dim_branch b ON b.sk_branch = f.sk_branch
            JOIN dim_line_of_business o ON o.sk_line_of_business = f.sk_line_of_business JOIN dim_cost_center n ON n.sk_cost_center = f.sk_cost_center GROUP BY k.bk_contract_id),
        tot AS (SELECT contract_id, SUM(nbv_amount) AS total_nbv_amount, SUM(customer_cost_amount) AS customer_cost_amount, SUM(rent_amount) AS rent_amount, SUM(asset_budget_value) AS asset_budget_value, SUM(total_charge) AS total_charge,
            COUNT(*) AS number_of_assets FROM v_lease_assets GROUP BY contract_id)
        SELECT f.contract_id, f.sequence_number, k.contract_number, k.contract_type, k.status, k.report_status, k.opportunity_number, k.created_time, k.previous_schedule_number, k.grace_delinquency_days, origin.lease_start_date,
            tot.* EXCLUDE (contract_id), f.customer_id, c.party_name, c.company_name, c.external_reference_id, CASE WHEN o.number IS NULL THEN 'Yes' ELSE 'No' END AS is_migrated, u.full_name AS contract_created_by,
            CASE WHEN a.system_name = 'SalesRep' THEN a.employee_name END AS sales_rep, CASE WHEN a.system_name = 'AccountManager' THEN a.employee_name END AS account_manager,
            p.transaction_type AS product_name, p.code AS product_code, n.description AS cost_center, g.legal_entity_number, t.name AS line_of_business, b.branch_name, bt.name AS business_type, s.code AS sic_code, s.description AS sic_description,
            CASE WHEN l.is_advance = 1 THEN 'Advance' ELSE 'Arrears' END AS payment_method, l.is_over_term_lease, l.payment_frequency, l.customer_term_in_months, l.term_in_months, l.approval_status, l.lease_contract_type,
            f.base_rate, f.spread, f.total_yield, f.total_down_payment_amount, f.down_payment_amount, f.tax_deferral_amount, f.net_investment_amount, f.booked_residual_amount, f.rent_amount AS lease_rent_amount,
            f.sk_date_commencement_date, f.sk_date_maturity_date, f.sk_date_post_date, q.balloon_amount, dc.bk_date AS commencement_date, dm.bk_date AS maturity_date, dp.bk_date AS created_date
        FROM v_finance f JOIN dim_contract k ON k.bk_contract_id = f.contract_id AND k.current_flag = 1 LEFT JOIN origin ON origin.bk_contract_id = f.contract_id LEFT JOIN record ON record.bk_contract_id = f.contract_id LEFT JOIN tot ON tot.contract_id = f.contract_id
        LEFT JOIN dim_customer c ON c.bk_customer_id = f.customer_id AND c.current_flag = 1 LEFT JOIN dim_opportunity o ON o.number = k.opportunity_number LEFT JOIN dim_user u ON u.bk_user_id = k.created_by_id
        LEFT JOIN v_assignments a ON a.contract_id = f.contract_id LEFT JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = k.deal_product_type_id LEFT JOIN dim_cost_center n ON n.bk_cost_center_id = k.cost_center_id
        LEFT JOIN dim_legal_entity g ON g.sk_legal_entity = f.sk_legal_entity LEFT JOIN dim_line_of_business t ON t.sk_line_of_business = f.sk_line_of_business LEFT JOIN dim_branch b ON b.sk_branch = f.sk_branch
        LEFT JOIN dim_business_type bt ON bt.bk_business_type_id = c.business_type_id LEFT JOIN dim_classification_code s ON s.bk_classification_code_id = c.sic_code_id LEFT JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance
        LEFT JOIN (SELECT opportunity_number, balloon_amount FROM v_credit_apps) q ON q.opportunity_number = k.opportunity_number
        LEFT JOIN dim_date dc ON dc.sk_date = f.sk_date_commencement_date LEFT JOIN dim_date dm ON dm.sk_date = f.sk_date_maturity_date LEFT JOIN dim_date dp ON dp.sk_date = record.sk_created_date""",
    "v_assets_in_app": """
        WITH u AS (SELECT c.opportunity_id, c.opportunity_number, c.credit_profile_id, c.credit_profile_number, c.loc_status, c.application_status, c.application_created, c.product_name, c.company_name, c.legal_entity, c.application_created_by, h.asset_id
              FROM v_credit_apps c JOIN dim_profile_asset h USING (credit_profile_id) WHERE lower(c.loc_status) IN ('pending', 'datagathering', 'creditanalysis', 'amendment', 'approved')
            UNION SELECT c.opportunity_id, c.opportunity_number, c.credit_profile_id, c.credit_profile_number, c.loc_status, c.application_status, c.application_created, c.product_name, c.company_name, c.legal_entity, c.application_created_by, h.asset_id
              FROM v_credit_apps c JOIN dim_application_asset h ON h.credit_application_id = c.opportunity_id WHERE lower(c.application_status) = 'pending'),
        j AS (SELECT DISTINCT u.*, l.status AS lease_status, s.alias, s.asset_status, s.make_name, s.model_name, s.asset_sub_type FROM u LEFT JOIN v_contracts l ON l.opportunity_number = u.opportunity_number LEFT JOIN asset_sheet s ON s.asset_id = u.asset_id)
        SELECT *, CASE WHEN lease_status IS NOT NULL THEN 'Pre-Contract' WHEN loc_status IS NOT NULL THEN 'Line of Credit' WHEN application_status IS NOT NULL THEN 'Credit App' ELSE 'Unknown' END AS application_stage,
            row_number() OVER (PARTITION BY asset_id ORDER BY application_created DESC, opportunity_id DESC) AS latest_application
        FROM j WHERE lower(application_status) = 'pending' OR (lower(application_status) = 'submittedtocredit' AND lower(loc_status) IN ('pending', 'datagathering', 'creditanalysis', 'amendment'))
            OR lower(loc_status) = 'approved' AND lower(lease_status) IN ('installingassets', 'pending') OR lower(loc_status) = 'approved' AND lease_status IS NULL""",
    "v_rentals": """SELECT s.*, l.contract_id, l.rent_amount, l.total_charge, c.company_name, c.branch_name, c.sequence_number, c.product_name AS lease_product, c.status AS lease_status, c.commencement_date, c.maturity_date, c.customer_term_in_months,
            c.cost_center, i.stage AS application_stage, i.opp_number AS application_id,
            COALESCE(CASE WHEN s.asset_status = 'Leased' AND lower(c.status) = 'commenced' AND c.product_name = 'Rental' AND l.total_charge = 0.01 THEN 'Yes (FoC)' END,
                CASE WHEN s.asset_status = 'Leased' AND lower(c.status) = 'commenced' THEN 'Yes' END, CASE WHEN i.asset_id IS NOT NULL THEN 'In Application' END, 'No') AS utilised
        FROM asset_sheet s LEFT JOIN v_lease_assets_live l ON l.asset_id = s.asset_id AND l.contract_status IN ('Pending', 'Commenced', 'InstallingAssets') LEFT JOIN v_contracts c ON c.contract_id = l.contract_id
        LEFT JOIN v_in_application_once i ON i.asset_id = s.asset_id WHERE s.asset_contract_type = 'Rental' AND s.asset_status IN ('Leased', 'Inventory', 'AwaitingDelivery')""",
    "v_payments": """SELECT p.*, f.contract_id, k.sequence_number, k.status, k.report_status, l.is_advance, l.payment_frequency, c.company_name, d.transaction_type AS product_name, d.code AS product_code,
            dp.bk_date AS post_date, dm.bk_date AS maturity_date, dc.bk_date AS commencement_date, row_number() OVER (PARTITION BY f.contract_id ORDER BY p.sk_payment_schedule) AS schedule_number
        FROM v_finance f JOIN dim_lease_finance l ON l.sk_lease_finance = f.sk_lease_finance JOIN dim_payment_schedule p ON p.lease_finance_detail_id = f.lease_finance_id
        JOIN dim_date dp ON dp.sk_date = f.sk_date_post_date JOIN dim_date dm ON dm.sk_date = f.sk_date_maturity_date JOIN dim_date dc ON dc.sk_date = f.sk_date_commencement_date
        JOIN dim_contract k ON k.bk_contract_id = f.contract_id AND k.current_flag = 1 JOIN dim_customer c ON c.bk_customer_id = f.customer_id AND c.current_flag = 1 JOIN dim_deal_product_type d ON d.bk_deal_product_type_id = k.deal_product_type_id""",
    "v_origination": """SELECT c.*, c.base_rate + c.spread AS yield, p.begin_balance_amount FROM v_contracts c LEFT JOIN (
        SELECT f.contract_id, arg_min(p.begin_balance_amount, p.sk_payment_schedule) AS begin_balance_amount FROM v_finance f JOIN dim_payment_schedule p ON p.lease_finance_detail_id = f.lease_finance_id GROUP BY f.contract_id) p USING (contract_id)
        WHERE c.sequence_number NOT LIKE '00%' AND lower(c.status) = 'commenced'""",
    "v_vat_deferrals": """SELECT contract_id, due_date, deferred_tax_amount, sk_payment_schedule, row_number() OVER (PARTITION BY contract_id ORDER BY due_date DESC, sk_payment_schedule DESC) AS latest_due_date
        FROM (SELECT *, MIN(due_date) OVER (PARTITION BY contract_id) AS f FROM v_payments) WHERE deferred_tax_amount <> 0 AND due_date <> f""",
    "v_payments_to_date": f"""SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY sk_payment_schedule DESC) AS latest_schedule, row_number() OVER (PARTITION BY contract_id ORDER BY sk_payment_schedule) AS initial_schedule
        FROM v_payments WHERE due_date <= {DAY}""",
    "v_receipts": """SELECT r.*, a.full_name AS created_by, b.full_name AS updated_by, g.name AS legal_entity, t.receipt_type_name AS receipt_type FROM dim_receipt r LEFT JOIN dim_user a ON a.bk_user_id = r.created_by_id
        LEFT JOIN dim_user b ON b.bk_user_id = r.updated_by_id LEFT JOIN dim_legal_entity g ON g.bk_legal_entity_id = r.legal_entity_id LEFT JOIN dim_receipt_type t ON t.bk_receipt_type_id = r.type_id""",
    "v_invoice_details": f"""SELECT f.*, i.bk_receivable_invoice_id, i.number AS invoice_number, n.days_late_count, d.entity_type, r.bk_receivable_id AS receivable_id, k.bk_contract_id AS contract_id, k.sequence_number, k.status AS contract_status,
            p.transaction_type AS product_name, t.name AS receivable_type, dd.bk_date AS due_date, di.bk_date AS invoice_date, l.customer_id, c.company_name AS customer_name, c.external_reference_id AS customer_number, b.branch_name,
            CAST(date_diff('day', dd.bk_date, {DAY}) AS INTEGER) AS days_since_due
        FROM fact_receivable_invoice_detail f JOIN dim_receivable_invoice i USING (sk_receivable_invoice) JOIN dim_receivable_invoice n ON n.bk_receivable_invoice_id = i.bk_receivable_invoice_id AND n.current_flag = 1
        JOIN dim_invoice_detail d USING (sk_invoice_detail) JOIN dim_receivable r USING (sk_receivable) JOIN dim_contract k ON k.bk_contract_id = d.entity_id AND k.current_flag = 1
        JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = k.deal_product_type_id JOIN dim_receivable_type t USING (sk_receivable_type) JOIN dim_date dd ON dd.sk_date = f.sk_due_date JOIN dim_date di ON di.sk_date = f.sk_invoice_run_date
        LEFT JOIN v_finance l ON l.contract_id = k.bk_contract_id LEFT JOIN dim_branch b ON b.sk_branch = l.sk_branch LEFT JOIN dim_customer c ON c.bk_customer_id = l.customer_id AND c.current_flag = 1
        QUALIFY row_number() OVER (PARTITION BY i.bk_receivable_invoice_id ORDER BY f.sk_date_record DESC, f.sk_time_record DESC) = 1""",
}
SUMS = ", ".join(f"SUM({c}) AS {c}" for c in receivables.SUMS)
LATE = "MAX(days_late_count) AS days_late_count, MAX(days_since_due) AS days_since_due"
VIEWS |= {
    "v_invoices": f"""SELECT bk_receivable_invoice_id, invoice_number, customer_id, customer_name, customer_number, contract_id, sequence_number, contract_status, branch_name, entity_type, due_date, product_name, receivable_type, invoice_date, {SUMS}, {LATE}
        FROM v_invoice_details GROUP BY ALL""",
    "v_receivables": f"SELECT receivable_id, bk_receivable_invoice_id, invoice_number, customer_id, contract_id, sequence_number, due_date, product_name, receivable_type, invoice_date, {SUMS}, {LATE} FROM v_invoice_details GROUP BY ALL",
    "v_lease_receivables": f"""SELECT a.*, n.next_due, CASE WHEN a.effective_balance_amount > 0 THEN days_late_count ELSE 0 END AS days_past_due
        FROM (SELECT contract_id, sequence_number, customer_id, customer_name, product_name, {SUMS}, {LATE} FROM v_invoices GROUP BY ALL) a
        JOIN (SELECT contract_id, MIN(due_date) AS next_due FROM v_invoices WHERE due_date > {DAY} GROUP BY contract_id) n USING (contract_id)""",
    "v_customer_receivables": f"SELECT customer_id, {SUMS}, CAST(SUM(days_late_count) AS BIGINT) AS days_late_count FROM v_lease_receivables GROUP BY customer_id",
    "v_exposure": """SELECT e.exposure_customer_id AS customer_id, e.bk_customer_exposure_id AS exposure_id, e.exposure_date, e.total_proposed_exposure, s.primary_customer_amount, s.direct_amount, s.indirect_amount,
            s.direct_amount + s.indirect_amount + s.primary_customer_amount AS group_exposure, e.total_proposed_exposure + s.primary_customer_amount AS proposed_exposure
        FROM dim_customer_exposure e JOIN dim_credit_summary_exposure s ON s.customer_id = e.exposure_customer_id AND s.exposure_type = 'EF'
        QUALIFY row_number() OVER (PARTITION BY e.exposure_customer_id ORDER BY e.exposure_date DESC, e.bk_customer_exposure_id DESC) = 1""",
    "v_customers": f"""SELECT c.bk_customer_id AS customer_id, c.* EXCLUDE (bk_customer_id, current_flag), s.primary_customer_amount, e.exposure_id, e.total_proposed_exposure, p.expiration_date AS policy_expiration_date, p.type AS policy_type, p.policy_number,
            k.code AS sic_code, k.description AS sic_description, r.employee_name AS account_manager, w.effective_balance_amount, l.*  EXCLUDE (customer_id), CAST(date_diff('month', {DAY}, c.next_review_date) AS INTEGER) AS months_to_review
        FROM dim_customer c JOIN dim_credit_summary_exposure s ON s.customer_id = c.bk_customer_id AND s.exposure_type = 'EF' LEFT JOIN v_exposure e ON e.customer_id = c.bk_customer_id LEFT JOIN dim_insurance_policy p ON p.customer_id = c.bk_customer_id
        LEFT JOIN dim_classification_code k ON k.bk_classification_code_id = c.sic_code_id LEFT JOIN v_customer_people r ON r.customer_id = c.bk_customer_id AND r.system_name = 'SalesRep'
        LEFT JOIN v_customer_receivables w ON w.customer_id = c.bk_customer_id LEFT JOIN (SELECT customer_id, SUM(total_nbv_amount) AS total_nbv_amount, SUM(rent_amount) AS rent_amount, SUM(total_charge) AS total_charge,
            CAST(SUM(number_of_assets) AS BIGINT) AS number_of_assets, CAST(SUM(total_yield) AS DOUBLE) / COUNT(total_yield) AS yield FROM v_contracts GROUP BY customer_id) l ON l.customer_id = c.bk_customer_id
        WHERE c.current_flag = 1""",
    "v_sundry": """SELECT s.*, r.name AS charge_name, k.sequence_number, k.contract_number, p.transaction_type AS product_name, c.company_name, x.balance_amount AS tax_balance, v.invoice_number, v.receivable_type, v.balance_amount,
            v.due_date AS invoice_due_date, s.amount + s.vat_amount AS total_due, x.balance_amount + v.balance_amount AS total_balance
        FROM dim_sundry s LEFT JOIN dim_receivable_code r ON r.bk_receivable_code_id = s.receivable_code_id LEFT JOIN dim_contract k ON k.bk_contract_id = s.contract_id AND k.current_flag = 1
        LEFT JOIN dim_deal_product_type p ON p.bk_deal_product_type_id = k.deal_product_type_id LEFT JOIN dim_customer c ON c.bk_customer_id = s.customer_id AND c.current_flag = 1 LEFT JOIN dim_receivable_tax x ON x.receivable_id = s.receivable_id
        LEFT JOIN v_receivables v ON v.receivable_id = s.receivable_id""",
    "v_sundry_details": """SELECT DISTINCT s.*, r.name AS recharge_fee_name, e.name AS expense_fee_name, x.balance_amount AS tax_balance, c.company_name, d.asset_id, s.amount + s.vat_amount AS total_due
        FROM dim_sundry s LEFT JOIN dim_receivable_code r ON r.bk_receivable_code_id = s.receivable_code_id AND r.is_active = 1 LEFT JOIN dim_payable_code e ON e.bk_payable_code_id = s.payable_code_id
        LEFT JOIN dim_receivable_tax x ON x.receivable_id = s.receivable_id AND x.is_active = 1 LEFT JOIN dim_customer c ON c.bk_customer_id = s.customer_id AND c.current_flag = 1
        LEFT JOIN dim_sundry_detail d ON d.sundry_id = s.bk_sundry_id WHERE s.is_active = 1""",
    "v_recurring": """SELECT DISTINCT s.*, r.name AS charge_name, k.sequence_number FROM dim_sundry_recurring s LEFT JOIN dim_receivable_code r ON r.bk_receivable_code_id = s.receivable_code_id
        LEFT JOIN dim_contract k ON k.bk_contract_id = s.contract_id AND k.current_flag = 1""",
}


def base(name, covers, build, source, columns, amounts=()):
    """Check chosen columns of a view; exact amounts are compared as doubles."""
    names = columns.split()
    chosen = [f"CAST({c} AS DOUBLE) AS {c}" if c in amounts else c for c in names]

    def run(w):
        return build(w).select(*[F.col(c).cast("double").alias(c) if c in amounts else F.col(c) for c in names])

    lease_query(name, covers, run, f"SELECT {', '.join(chosen)} FROM {source}")


base("asset_status_latest", "V001 D10 J12 W01", assets.asset_status_latest, "v_status_latest", "asset_id sk_asset sk_asset_status sk_date_record sk_legal_entity")
base("asset_sheet", "V002 S09 S10", assets.asset_sheet, "asset_sheet", "asset_id registration_number alias serial_number asset_status asset_contract_type product_name gvw city equipment_nbv", {"equipment_nbv"})
base("asset_value", "V003 D18 W12", assets.asset_value, "v_asset_value", "asset_id begin_book_value cost end_book_value last_book_value", {"begin_book_value", "cost", "end_book_value", "last_book_value"})
base("book_depreciation", "V004 W02 W03 W12 C03", assets.book_depreciation, "v_depreciation",
     "sk_book_depreciation asset_id contract_id begin_date current_asset_value current_contract_value initial_asset_value initial_contract_value")
base("additional_charges_detail", "V005 D01 A01", contracts.charges_detail, "v_charges_detail", "contract_id sequence_number asset_id charge_name charges vat_amount", {"charges", "vat_amount"})
base("asset_additional_charges", "V006 D01 A07", contracts.charges_by_asset, "v_charges_asset", "contract_id sequence_number asset_id charges vat_amount", {"charges", "vat_amount"})
base("asset_description", "V007 F05 F02 A09", assets.asset_description, "v_description", "asset_id asset_description")
base("asset_features", "V008 W01", assets.asset_features, "v_features", "asset_id equipment_id registration_number effective_date feature_category is_synced sync_status")
base("contract_assignments", "V009 W01", contracts.contract_assignments, "v_assignments", "contract_id employee_name role_function system_name")
base("customer_assignments", "V010 A09 C02", contracts.customer_assignments, "v_customer_people", "customer_id party_name employee_name role_function system_name")
base("credit_application", "V011 J11 J13 A02", contracts.credit_applications, "v_credit_apps",
     "opportunity_id opportunity_number customer_id company_name credit_profile_number loc_status application_status expected_commencement_date customer_term product_name cost_center branch_name legal_entity line_of_business "
     "application_owner assigned_user application_created_by sales_rep equipment_count approved_amount", {"approved_amount"})
base("in_application", "V012 D13 J04 C02", assets.in_application, "v_in_application", "asset_id alias stage credit_number profile_status sequence_number booking_status product company opp_number created_by app_status structure_company")
lease_query("lease_additional_charges", "V013 D01 A07", lambda w: contracts.charges_by_contract(w).select("contract_id", "sequence_number", F.col("charges").cast("double"), F.col("vat_amount").cast("double")),
            "SELECT contract_id, sequence_number, CAST(SUM(charges) AS DOUBLE) AS charges, CAST(SUM(vat_amount) AS DOUBLE) AS vat_amount FROM v_charges_asset GROUP BY ALL")
ASSET_COLUMNS = "contract_id asset_id sequence_number contract_status customer_id termination_date nbv_amount rent_amount asset_budget_value total_charge"
ASSET_AMOUNTS = {"nbv_amount", "rent_amount", "asset_budget_value", "total_charge"}
base("lease_asset_all", "V014 W01 D10 M01", contracts.lease_assets_all, "v_lease_assets", ASSET_COLUMNS, ASSET_AMOUNTS)
base("lease_asset_current", "V015 T04 P02", contracts.lease_assets_live, "v_lease_assets_live", ASSET_COLUMNS, ASSET_AMOUNTS)
base("lease_finance_detail", "V016 W01 D11", contracts.finance_detail, "v_finance",
     "contract_id sequence_number customer_id lease_finance_id sk_contract sk_date_record sk_branch base_rate spread total_yield net_investment_amount", {"base_rate", "spread", "total_yield", "net_investment_amount"})
base("lease_contracts", "V017 W11 J11 J13 D06 T04", contracts.lease_contracts, "v_contracts",
     "contract_id sequence_number contract_number status report_status opportunity_number lease_start_date customer_id company_name is_migrated contract_created_by sales_rep account_manager product_name cost_center legal_entity_number "
     "line_of_business branch_name business_type sic_code sic_description payment_method is_over_term_lease payment_frequency customer_term_in_months commencement_date maturity_date created_date number_of_assets "
     "total_nbv_amount rent_amount asset_budget_value total_charge base_rate spread balloon_amount lease_rent_amount", {"total_nbv_amount", "rent_amount", "asset_budget_value", "total_charge", "base_rate", "spread", "balloon_amount", "lease_rent_amount"})
base("asset_in_application", "V018 U02 W02 C04 P03 F03", contracts.assets_in_application, "v_assets_in_app",
     "asset_id opportunity_number credit_profile_number loc_status application_status lease_status application_stage latest_application product_name company_name asset_status")
base("asset_rentals", "V019 D14 C02", contracts.asset_rentals, "v_rentals", "asset_id registration_number contract_id sequence_number lease_product lease_status utilised application_stage application_id commencement_date total_charge", {"total_charge"})
base("lease_payments", "V020 W02 J11", contracts.lease_payments, "v_payments",
     "contract_id sequence_number sk_payment_schedule schedule_number payment_number due_date payment_type product_name post_date maturity_date commencement_date company_name amount end_balance_amount", {"amount", "end_balance_amount"})
base("contract_origination", "V021 F04 M01", contracts.contract_origination, "v_origination", "contract_id sequence_number status commencement_date maturity_date yield begin_balance_amount total_nbv_amount", {"yield", "begin_balance_amount", "total_nbv_amount"})
base("payment_vat_deferrals", "V022 J13 W02 A04", contracts.payment_vat_deferrals, "v_vat_deferrals", "contract_id due_date sk_payment_schedule latest_due_date deferred_tax_amount", {"deferred_tax_amount"})
base("lease_payments_current", "V023 W02 W12 T01", contracts.payments_to_date, "v_payments_to_date", "contract_id sk_payment_schedule due_date latest_schedule initial_schedule")
base("receipts", "V024 J10 J11", receivables.receipts, "v_receipts", "bk_receipt_id number status received_date post_date receipt_type created_by updated_by legal_entity customer_id receipt_amount balance_amount", {"receipt_amount", "balance_amount"})
MONEY = set(receivables.SUMS)
base("receivable_invoice_detail", "V025 W01 T02", receivables.invoice_details_once, "v_invoice_details",
     "bk_receivable_invoice_id invoice_number contract_id sequence_number customer_id customer_name branch_name due_date invoice_date days_since_due days_late_count receivable_type entity_type balance_amount effective_balance_amount", MONEY)
base("receivable_invoices", "V026 A01 A04", receivables.invoices, "v_invoices",
     "bk_receivable_invoice_id invoice_number contract_id customer_id due_date receivable_type days_late_count days_since_due balance_amount tax_balance_amount effective_balance_amount invoice_amount", MONEY)
base("lease_receivables", "V027 D17 J13 C01", receivables.lease_receivables, "v_lease_receivables", "contract_id sequence_number customer_id product_name next_due days_past_due days_late_count effective_balance_amount invoice_amount", MONEY)
base("customer_receivables", "V028 A07", receivables.customer_receivables, "v_customer_receivables", "customer_id days_late_count balance_amount effective_balance_amount invoice_amount", MONEY)
base("customer_sheet", "V029 W01 A05 T03", receivables.customers, "v_customers",
     "customer_id party_name company_name exposure_id policy_number policy_expiration_date months_to_review sic_code account_manager number_of_assets yield primary_customer_amount total_proposed_exposure effective_balance_amount total_nbv_amount",
     {"primary_customer_amount", "total_proposed_exposure", "effective_balance_amount", "total_nbv_amount"})
base("receivables", "V030 A01 A04", receivables.receivables, "v_receivables", "receivable_id invoice_number contract_id due_date receivable_type days_late_count balance_amount effective_balance_amount", MONEY)
base("sundry", "V031 M01 J11", receivables.sundry, "v_sundry", "bk_sundry_id sundry_type charge_name sequence_number product_name company_name invoice_number amount total_due tax_balance total_balance", {"amount", "total_due", "tax_balance", "total_balance"})
base("sundry_details", "V032 A09 M01", receivables.sundry_details, "v_sundry_details", "bk_sundry_id sundry_type recharge_fee_name expense_fee_name company_name asset_id receivable_due_date payable_due_date amount total_due tax_balance", {"amount", "total_due", "tax_balance"})
base("sundry_recurring_charges", "V033 A09 J02", receivables.recurring_charges, "v_recurring", "bk_sundry_recurring_id contract_id sequence_number charge_name sundry_type status regular_amount", {"regular_amount"})
lease_query("sundry_recurring_charge_details", "V034 J01",
            lambda w: receivables.recurring_charge_details(w).select("bk_recurring_detail_id", "contract_id", "sequence_number", "charge_name", "asset_id", *[F.col(c).cast("double") for c in ("amount", "vat_amount", "additional_amount")]),
            """SELECT d.bk_recurring_detail_id, r.contract_id, r.sequence_number, r.charge_name, d.asset_id, CAST(d.amount AS DOUBLE) AS amount, CAST(d.vat_amount AS DOUBLE) AS vat_amount, CAST(a.amount AS DOUBLE) AS additional_amount
            FROM dim_recurring_detail d JOIN v_recurring r ON r.bk_sundry_recurring_id = d.sundry_recurring_id JOIN dim_lease_finance_charge f ON f.recurring_sundry_id = d.sundry_recurring_id
            JOIN dim_additional_charge a ON a.bk_additional_charge_id = f.additional_charge_id""")
base("sundry_recurring_schedule", "V035 P02", receivables.recurring_schedule, "dim_recurring_schedule", "bk_recurring_schedule_id sundry_recurring_id due_date is_active amount", {"amount"})
