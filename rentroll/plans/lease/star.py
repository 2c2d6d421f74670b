"""A lease warehouse derived from the fixture tables.

Orders stand for contracts, order lines for leased assets, charges, payments and invoices, parts for
assets, suppliers for staff, events for one-off charges and receipts. Every table is a plain SELECT
that both Spark and the SQL check understand, so both sides start from equal rows.
"""


def ymd(d):
    return f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS BIGINT)"


ORDERED = "CAST(o_orderdate AS DATE)"
SHIPPED = "CAST(l_shipdate AS DATE)"
HAPPENED = "(CAST(ts AS DATE) - 8250)"
UNSET = "DATE '1900-01-01'"
OPEN = "DATE '9999-12-31'"
NOW_SK = """CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN o_orderkey * 4 + 1
        WHEN o_orderstatus = 'P' THEN o_orderkey * 4 + 2
        WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN o_orderkey * 4 + 4 ELSE o_orderkey * 4 + 3 END"""
LINE = "(l_orderkey * 10 + l_linenumber)"
LINE_ID = "((((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT))"
NET = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"


def dec(x):
    return f"CAST({x} AS DECIMAL(18,4))"


def contract_version(n, status, lag, current, where):
    return f"""SELECT o_orderkey * 4 + {n} AS sk_contract, o_orderkey AS bk_contract_id, CAST({current} AS INT) AS current_flag,
        '{status}' AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'Assumed' ELSE 'Active' END AS report_status,
        CASE WHEN o_orderkey % 50 = 0 THEN '00' || CAST(o_orderkey AS STRING) ELSE 'L' || CAST(o_orderkey AS STRING) END AS sequence_number,
        'C' || CAST(o_orderkey AS STRING) AS contract_number, 'Lease' AS contract_type,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'OPP' || CAST(o_orderkey AS STRING) END AS opportunity_number,
        CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS deal_product_type_id, o_custkey % 11 AS cost_center_id,
        o_orderkey % 10 AS created_by_id, {ORDERED} AS created_time, {ORDERED} + {lag} AS updated_time,
        CASE WHEN o_orderkey % 5 = 0 THEN {UNSET} ELSE {ORDERED} + {lag} END AS start_date,
        CASE WHEN {current} = 1 THEN {OPEN} ELSE {ORDERED} + {lag} + 10 END AS end_date,
        {ORDERED} + {lag} AS dp_process_datetime, {ORDERED} + {lag} AS dp_process_date,
        CAST(o_orderkey % 20 AS INT) AS grace_delinquency_days,
        CASE WHEN o_orderkey % 7 = 0 THEN 'S' || CAST(o_orderkey AS STRING) END AS previous_schedule_number,
        o_orderkey AS credit_approved_structure_id, o_custkey AS customer_of_contract
    FROM orders WHERE {where}"""


def finance_record(sk_contract, lag, factor, where):
    return f"""SELECT {sk_contract} AS sk_contract, o_orderkey * 2 + 1 AS sk_lease_finance, o_custkey * 2 + 1 AS sk_customer,
        o_custkey % 25 AS sk_branch, o_custkey % 5 AS sk_line_of_business, o_orderkey % 3 AS sk_legal_entity, o_custkey % 11 AS sk_cost_center,
        CASE WHEN o_orderstatus = 'P' THEN -1 ELSE {ymd(ORDERED + " + 20")} END AS sk_date_commencement_date,
        {ymd(ORDERED + " + 730")} AS sk_date_maturity_date, {ymd(ORDERED)} AS sk_date_post_date,
        {ymd(f"{ORDERED} + {lag}")} AS sk_date_record, o_orderkey % 86400 AS sk_time_record,
        CAST(o_orderkey % 97 AS DECIMAL(18,4)) AS total_yield, {dec(f"o_totalprice * {factor}")} AS net_investment_amount,
        {dec("o_orderkey % 1000")} AS total_down_payment_amount, {dec("o_orderkey % 500")} AS down_payment_amount,
        {dec("o_orderkey % 300")} AS tax_deferral_amount, {dec("o_orderkey % 777")} AS rent_amount,
        {dec("o_orderkey % 444")} AS booked_residual_amount
    FROM orders WHERE {where}"""


def asset_version(n, current, where):
    return f"""SELECT p_partkey * 2 + {n} AS sk_asset, p_partkey AS bk_asset_id, {current} AS current_flag,
        'REG' || CAST(p_partkey AS STRING) AS alias, p_type AS product_name, p_brand AS manufacturer_name,
        CASE WHEN p_partkey % 5 = 0 THEN 'Other' WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS make_name,
        CASE WHEN p_partkey % 6 = 0 THEN 'Other' WHEN p_partkey % 11 = 0 THEN NULL ELSE 'M' || CAST(p_size AS STRING) END AS model_name,
        CAST(1990 + p_size % 10 AS INT) AS model_year, 'EQ' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS equipment_id,
        'F' || CAST(p_partkey AS STRING) AS fleet_number,
        CASE p_size % 4 WHEN 0 THEN 'Rental' WHEN 1 THEN 'Lease' WHEN 2 THEN 'Stock' ELSE 'BackedOffAsset' END AS asset_contract_type,
        CASE WHEN {n} = 0 THEN 'NotFunded' WHEN p_partkey % 3 = 0 THEN 'FullyFunded' WHEN p_partkey % 3 = 1 THEN 'PartiallyFunded' END AS asset_funding_status,
        {dec("p_retailprice * 100")} AS book_value_amount, CAST(p_partkey % 100 AS INT) AS service_intervals_vehicle,
        CASE WHEN {n} = 0 THEN {UNSET} ELSE DATE '2001-02-01' + CAST(p_partkey % 60 AS INT) END AS start_date,
        CASE WHEN {n} = 0 THEN DATE '2001-02-01' + CAST(p_partkey % 60 AS INT) ELSE {OPEN} END AS end_date,
        DATE '2001-01-01' + CAST(p_partkey % 20 AS INT) AS created_time, DATE '2001-01-05' AS updated_time,
        DATE '2001-06-30' + CAST(p_partkey % 90 AS INT) AS mot_expiry_date, p_partkey % 10 AS customer_id,
        'Tyres ' || CAST(p_size AS STRING) AS tyres_fair_wear_tear
    FROM part WHERE {where}"""


STATUS_OF_PART = """CASE WHEN p_partkey % 10 < 5 THEN 'Leased' WHEN p_partkey % 10 < 7 THEN 'Inventory' WHEN p_partkey % 10 < 9 THEN 'AwaitingDelivery' ELSE 'Sold' END"""

STAR = {
    "dim_customer": f"""SELECT c_custkey * 2 + 1 AS sk_customer, c_custkey AS bk_customer_id, 1 AS current_flag, c_name AS party_name,
        CASE WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 11 = 0 THEN NULL ELSE substr(c_mktsegment, 1, 4) || ' ' || c_name END AS company_name,
        CASE WHEN c_acctbal >= 0 THEN 'Active' ELSE 'Inactive' END AS status, 'ACC' || CAST(c_custkey AS STRING) AS external_reference_id,
        'ORG' || CAST(c_custkey % 40 AS STRING) AS organization_id, 'P' || CAST(c_custkey AS STRING) AS party_number,
        CAST(c_custkey % 4 * 15 AS INT) AS credit_term, CAST(c_custkey % 100 AS INT) AS credit_score,
        DATE '2001-06-30' + CAST(c_custkey % 200 - 60 AS INT) AS next_review_date, DATE '2000-06-30' AS annual_credit_review_date,
        DATE '1995-01-01' + CAST(c_custkey % 365 AS INT) AS creation_date, CASE WHEN c_custkey % 8 = 0 THEN 'Vendor' ELSE 'Customer' END AS primary_role,
        CAST(c_nationkey AS BIGINT) AS sic_code_id, c_custkey % 5 AS business_type_id
    FROM customer
    UNION ALL SELECT c_custkey * 2, c_custkey, 0, 'old ' || c_name, c_name, 'Active', 'ACC' || CAST(c_custkey AS STRING), 'ORG', 'P', 0, 0,
        DATE '2000-01-01', DATE '1999-01-01', DATE '1995-01-01', 'Customer', CAST(c_nationkey AS BIGINT), 0 FROM customer WHERE c_custkey % 3 = 0""",
    "dim_user": "SELECT s_suppkey AS bk_user_id, s_name AS full_name, 1 AS current_flag FROM supplier",
    "dim_role_function": """SELECT CAST(r_regionkey AS BIGINT) AS bk_role_function_id, 1 AS current_flag, 1 AS is_active,
        CASE r_regionkey WHEN 0 THEN 'Sales Rep' WHEN 1 THEN 'Account Manager' ELSE r_name END AS name,
        CASE r_regionkey WHEN 0 THEN 'SalesRep' WHEN 1 THEN 'AccountManager' ELSE r_name END AS system_defined_name FROM region""",
    "dim_party_employee": """SELECT c_custkey * 4 AS bk_party_employee_id, c_custkey AS party_id, c_custkey % 10 AS employee_id, CAST(0 AS BIGINT) AS role_function_id,
        1 AS is_primary, 1 AS is_active, 1 AS current_flag FROM customer WHERE c_custkey % 4 <> 0
    UNION ALL SELECT c_custkey * 4 + 1, c_custkey, (c_custkey + 3) % 10, CAST(1 AS BIGINT), 1, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 1 END, 1 FROM customer
    UNION ALL SELECT c_custkey * 4 + 2, c_custkey, (c_custkey + 5) % 10, CAST(0 AS BIGINT), 0, 1, 1 FROM customer WHERE c_custkey % 5 = 0""",
    "dim_contract_employee": """SELECT o_orderkey * 2 AS bk_contract_employee_id, o_orderkey AS contract_id, o_custkey * 4 + 1 AS party_employee_id, 0 AS is_primary, 1 AS is_active, 1 AS current_flag FROM orders
    UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, o_custkey * 4, 1, 1, 1 FROM orders WHERE o_orderkey % 2 = 0""",
    "dim_contract": "\n    UNION ALL ".join(
        [
            contract_version(1, "Pending", 0, "(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN 1 ELSE 0 END)", "1 = 1"),
            contract_version(2, "InstallingAssets", 10, "(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)", "o_orderstatus <> 'P' OR o_orderkey % 2 = 0"),
            contract_version(3, "Commenced", 20, "(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 0 ELSE 1 END)", "o_orderstatus <> 'P'"),
            contract_version(4, "Inactive", 400, "1", "o_orderstatus = 'F' AND o_orderkey % 4 = 0"),
        ]
    ),
    "dim_lease_finance": """SELECT o_orderkey * 2 + 1 AS sk_lease_finance, o_orderkey AS bk_lease_finance_id, 1 AS is_current, 1 AS current_flag,
        CAST(o_orderkey % 2 AS INT) AS is_advance, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS is_over_term_lease,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Quarterly' ELSE 'Monthly' END AS payment_frequency, CAST(12 + o_orderkey % 48 AS INT) AS customer_term_in_months,
        CAST(12 + o_orderkey % 48 AS INT) AS term_in_months, CASE WHEN o_orderkey % 5 = 0 THEN 'Pending' ELSE 'Approved' END AS approval_status,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Operating' ELSE 'Finance' END AS lease_contract_type, CAST(o_orderkey % 28 + 1 AS INT) AS due_day FROM orders
    UNION ALL SELECT o_orderkey * 2, o_orderkey, 0, 0, 0, 0, 'Monthly', 12, 12, 'Pending', 'Old', 1 FROM orders WHERE o_orderkey % 3 = 0""",
    "fact_lease_finance_detail": "\n    UNION ALL ".join(
        [
            finance_record("o_orderkey * 4 + 1", 0, "0.5", "1 = 1"),
            finance_record(f"({NOW_SK})", 20, "0.25", "o_orderstatus <> 'P' OR o_orderkey % 2 = 0"),
            finance_record(f"({NOW_SK})", 50, "0.75", "o_orderkey % 5 = 0 AND (o_orderstatus <> 'P' OR o_orderkey % 2 = 0)"),
        ]
    ),
    "dim_lease_interest_rate": "SELECT o_orderkey * 10 AS sk_lease_interest_rate, o_orderkey AS lease_finance_detail_id, o_orderkey % 25 AS interest_rate_detail_id, 1 AS current_flag FROM orders WHERE o_orderkey % 6 <> 0",
    "dim_interest_rate_detail": f"SELECT CAST(n_nationkey AS BIGINT) AS bk_interest_rate_detail_id, {dec('n_nationkey')} AS base_rate, {dec('n_regionkey')} AS spread, 1 AS is_active, 1 AS current_flag FROM nation",
    "dim_branch": "SELECT CAST(n_nationkey AS BIGINT) AS sk_branch, CAST(n_nationkey AS BIGINT) AS bk_branch_id, n_name AS branch_name, 1 AS current_flag FROM nation",
    "dim_line_of_business": """SELECT CAST(r_regionkey AS BIGINT) AS sk_line_of_business, CAST(r_regionkey AS BIGINT) AS bk_line_of_business_id, r_name AS name,
        CASE r_regionkey WHEN 0 THEN 'Bus and Coach' WHEN 1 THEN 'Contract Hire Leasing and Rental' ELSE r_name END AS description, 1 AS current_flag FROM region""",
    "dim_legal_entity": "SELECT CAST(r_regionkey AS BIGINT) AS sk_legal_entity, CAST(r_regionkey AS BIGINT) AS bk_legal_entity_id, 'LE' || CAST(r_regionkey AS STRING) AS legal_entity_number, r_name || ' Ltd' AS name, 1 AS current_flag FROM region",
    "dim_cost_center": """SELECT CAST(n_nationkey AS BIGINT) AS sk_cost_center, CAST(n_nationkey AS BIGINT) AS bk_cost_center_id, 1 AS current_flag,
        CASE n_nationkey WHEN 0 THEN 'Lease Sales' WHEN 1 THEN 'Extension -Lease' WHEN 2 THEN 'Lease (Used Asset)' WHEN 3 THEN 'Rental (New Asset)' WHEN 4 THEN 'Rental'
        WHEN 5 THEN 'Extension - Rental Std' WHEN 6 THEN 'Lease (Re-Profile)' WHEN 7 THEN 'Vendor Finance' WHEN 8 THEN 'Traffic Managment' WHEN 9 THEN 'Fleet Management' ELSE 'Other' END AS description
        FROM nation WHERE n_nationkey < 11""",
    "dim_deal_product_type": """SELECT CAST(n_nationkey AS BIGINT) AS bk_deal_product_type_id, 1 AS current_flag, 1 AS is_active,
        CASE n_nationkey WHEN 1 THEN 'Contract Hire' WHEN 2 THEN 'Hire Purchase' WHEN 3 THEN 'Operating Lease' WHEN 4 THEN 'Finance Lease' ELSE 'Rental' END AS transaction_type,
        CASE n_nationkey WHEN 1 THEN 'CH' WHEN 2 THEN 'HP' WHEN 3 THEN 'OL' WHEN 4 THEN 'FL' ELSE 'RE' END AS code FROM nation WHERE n_nationkey BETWEEN 1 AND 5""",
    "dim_classification_code": "SELECT CAST(n_nationkey AS BIGINT) AS bk_classification_code_id, 'SIC' || CAST(n_nationkey AS STRING) AS code, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_name END AS description, 1 AS current_flag FROM nation",
    "dim_business_type": "SELECT CAST(r_regionkey AS BIGINT) AS bk_business_type_id, r_name AS name, 1 AS current_flag FROM region",
    "dim_asset": "\n    UNION ALL ".join([asset_version(1, "1", "1 = 1"), asset_version(0, "0", "p_partkey % 2 = 0")]),
    "dim_asset_status": """SELECT CAST(r_regionkey AS BIGINT) AS sk_asset_status, 1 AS current_flag, CASE r_regionkey WHEN 0 THEN 'Leased' WHEN 1 THEN 'Inventory' WHEN 2 THEN 'AwaitingDelivery'
        WHEN 3 THEN 'Sold' ELSE 'OnHold' END AS asset_status FROM region""",
    "fact_asset_status": f"""SELECT p_partkey * 2 + 1 AS sk_asset, CAST(CASE {STATUS_OF_PART} WHEN 'Leased' THEN 0 WHEN 'Inventory' THEN 1 WHEN 'AwaitingDelivery' THEN 2 ELSE 3 END AS BIGINT) AS sk_asset_status,
        p_partkey AS sk_additional_details, p_partkey AS sk_vehicle_detail, p_partkey % 3 AS sk_legal_entity, CAST(20010201 AS BIGINT) AS sk_date_record, CAST(1 AS BIGINT) AS sk_time_record FROM part
    UNION ALL SELECT p_partkey * 2, CAST(2 AS BIGINT), p_partkey + 1000000000, p_partkey, p_partkey % 3, CAST(20010101 AS BIGINT), CAST(1 AS BIGINT) FROM part WHERE p_partkey % 2 = 0""",
    "dim_additional_details": """SELECT p_partkey AS sk_additional_details, p_partkey AS bk_additional_details_id, 1 AS current_flag, p_partkey % 25 AS allocated_status_id, (p_partkey + 3) % 25 AS asset_sub_type_id,
        (p_partkey + 5) % 30 AS axle_config_id, (p_partkey + 6) % 25 AS steer_axle_id, (p_partkey + 7) % 25 AS drive_axle_id, (p_partkey + 8) % 25 AS lift_axle_id, (p_partkey + 9) % 25 AS axles_id,
        (p_partkey + 2) % 25 AS mot_booking_status_id, DATE '2001-02-10' + CAST(p_partkey % 50 AS INT) AS start_date, DATE '9999-12-31' AS end_date, DATE '2001-02-10' AS created_time,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE DATE '2001-03-01' + CAST(p_partkey % 40 AS INT) END AS available_from, DATE '2001-05-01' AS mot_passed_date, 'T' || CAST(p_size AS STRING) AS tyre_configuration FROM part
    UNION ALL SELECT p_partkey + 1000000000, p_partkey, 0, (p_partkey + 11) % 25, (p_partkey + 3) % 25, p_partkey % 25, p_partkey % 25, p_partkey % 25, p_partkey % 25, p_partkey % 25, p_partkey % 25,
        DATE '1900-01-01', DATE '2001-02-10' + CAST(p_partkey % 50 AS INT), DATE '2001-01-10', CAST(NULL AS DATE), CAST(NULL AS DATE), 'T' FROM part""",
    "dim_detail_config": """SELECT CAST(n_nationkey AS BIGINT) AS bk_detail_config_id, 1 AS current_flag, CASE n_nationkey % 8 WHEN 0 THEN 'VOF Signed' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Soft' WHEN 3 THEN 'Firm - No VOF'
        WHEN 4 THEN 'No' WHEN 5 THEN 'Company Car' WHEN 6 THEN 'Reserved' END AS value FROM nation""",
    "dim_vehicle_detail": "SELECT p_partkey AS sk_vehicle_detail, p_partkey AS bk_vehicle_detail_id, 1 AS current_flag, CAST(p_size * 1000 + p_partkey % 1000 AS INT) AS gvw, p_partkey % 5 AS body_type_config_id, p_partkey % 5 AS body_builder_config_id, CAST(p_partkey % 9 AS INT) AS axle_index, CAST(p_size * 100 AS INT) AS contract_mileage FROM part",
    "dim_body_type_config": "SELECT CAST(r_regionkey AS BIGINT) AS bk_body_type_config_id, CASE r_regionkey WHEN 0 THEN 'Bus body' WHEN 1 THEN '' ELSE r_name END AS body_type_code, CASE WHEN r_regionkey = 4 THEN 0 ELSE 1 END AS is_active, 1 AS current_flag FROM region",
    "dim_body_builder_config": "SELECT CAST(r_regionkey AS BIGINT) AS bk_body_builder_config_id, r_name || ' bodies' AS name, 1 AS current_flag FROM region",
    "dim_asset_location": "SELECT p_partkey AS asset_id, p_partkey % 25 AS location_id, CASE WHEN p_partkey % 10 = 3 THEN 0 ELSE 1 END AS is_current, 1 AS is_active, 1 AS current_flag FROM part",
    "dim_location": "SELECT CAST(n_nationkey AS BIGINT) AS bk_location_id, 'D' || CAST(n_nationkey AS STRING) AS depot_code, n_name AS city, 1 AS is_active, 1 AS current_flag FROM nation",
    "dim_registration": f"""SELECT p_partkey * 2 AS bk_registration_id, p_partkey AS asset_id, 'R' || CAST(p_partkey AS STRING) AS registration_number, DATE '1999-01-01' AS effective_date, 1 AS is_active, 1 AS current_flag FROM part
    UNION ALL SELECT p_partkey * 2 + 1, p_partkey, 'N' || CAST(p_partkey AS STRING), DATE '2000-01-01', 1, CASE WHEN p_partkey % 12 = 0 THEN 0 ELSE 1 END FROM part WHERE p_partkey % 3 = 0""",
    "dim_serial_number": "SELECT p_partkey AS bk_serial_number_id, p_partkey AS asset_id, 'SN' || CAST(p_partkey AS STRING) AS serial_number, DATE '2000-01-01' AS created_time, 1 AS current_flag FROM part WHERE p_partkey % 9 <> 0",
    "dim_asset_features": """SELECT p_partkey AS bk_asset_feature_id, p_partkey AS asset_id, 'EQ' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS equipment_id, p_partkey % 5 AS asset_category_id,
        CAST(p_partkey % 2 AS INT) AS is_synced, CASE WHEN p_partkey % 3 = 0 THEN 'done' END AS sync_status, 1 AS current_flag FROM part""",
    "dim_asset_category": "SELECT CAST(r_regionkey AS BIGINT) AS bk_asset_category_id, r_name AS name, 1 AS current_flag FROM region",
    "asset_sheet": f"""SELECT p_partkey AS asset_id, 1 AS current_flag, 'R' || CAST(p_partkey AS STRING) AS registration_number, 'REG' || CAST(p_partkey AS STRING) || 'LONG' AS alias,
        CASE WHEN p_partkey % 9 <> 0 THEN 'SN' || CAST(p_partkey AS STRING) END AS serial_number, {STATUS_OF_PART} AS asset_status,
        CASE p_size % 4 WHEN 0 THEN 'Rental' WHEN 1 THEN 'Lease' WHEN 2 THEN 'Stock' ELSE 'BackedOffAsset' END AS asset_contract_type,
        CASE WHEN p_partkey % 13 = 0 THEN 'Ancillary' ELSE 'Vehicle' END AS asset_type, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Sub' || CAST(p_size % 3 AS STRING) END AS asset_sub_type,
        p_type AS product_name, p_brand AS manufacturer_name, p_name AS make_name, 'M' || CAST(p_size AS STRING) AS model_name, CAST(1990 + p_size % 10 AS INT) AS model_year,
        CAST(p_size * 1000.5 AS DOUBLE) AS gvw, p_brand || ' ' || p_name AS description, 'City' || CAST(p_size % 7 AS STRING) AS city, 'EQ' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS equipment_id,
        'F' || CAST(p_partkey AS STRING) AS fleet_number, 'LE' || CAST(p_partkey % 3 AS STRING) AS legal_entity_number,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE {dec("p_retailprice * 50")} END AS equipment_nbv, {dec("p_retailprice * 100")} AS book_value_amount,
        CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE {dec("p_retailprice * 10")} END AS residual_value_amount, CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE {dec("p_size")} END AS depreciation_value,
        {dec("p_retailprice * 90")} AS adjusted_book_value, CASE WHEN p_partkey % 3 = 0 THEN 'FullyFunded' WHEN p_partkey % 3 = 1 THEN NULL ELSE 'NotFunded' END AS asset_funding_status,
        CASE WHEN p_partkey % 5 = 0 THEN 'ann' END AS reserved_by, CASE WHEN p_partkey % 5 = 0 THEN DATE '2001-04-01' + CAST(p_size AS INT) END AS reserve_date,
        DATE '1999-01-01' + CAST(p_partkey % 500 AS INT) AS acquisition_date, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE DATE '2001-03-01' + CAST(p_partkey % 200 AS INT) END AS available_from,
        CASE WHEN p_partkey % 25 % 8 = 7 THEN NULL WHEN p_partkey % 3 = 0 THEN 'VOF Signed' WHEN p_partkey % 3 = 1 THEN 'Soft' ELSE 'Reserved' END AS allocated_status,
        DATE '2002-06-30' + CAST(p_partkey % 300 AS INT) AS rv_maturity_date, DATE '2001-05-01' - CAST(p_partkey % 300 AS INT) AS mot_passed_date, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS procurement_program,
        CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'PRJ' || CAST(p_size AS STRING) END AS project_number, CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS INT) AS is_migrated,
        CASE WHEN p_partkey % 3 = 0 THEN 'Trailers' ELSE 'Commercial Vehicles' END AS category_name, CAST(p_partkey % 100 AS INT) AS service_intervals_vehicle,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '2001-05-20' + CAST(p_size AS INT) END AS delivered_on, DATE '2001-06-20' + CAST(p_size AS INT) AS planned_delivery, CAST(12 + p_size AS INT) AS term
    FROM part""",
    "fact_lease_asset": f"""SELECT {NOW_SK} AS sk_contract, l_partkey * 2 + 1 AS sk_asset, {LINE} AS sk_lease_asset, l_orderkey * 2 + 1 AS sk_lease_finance, o_custkey * 2 + 1 AS sk_customer,
        o_custkey % 25 AS sk_branch, o_custkey % 5 AS sk_line_of_business, o_orderkey % 3 AS sk_legal_entity, o_custkey % 11 AS sk_cost_center,
        CASE WHEN l_returnflag = 'R' THEN {ymd(SHIPPED)} ELSE -1 END AS sk_date_termination_date, {ymd(SHIPPED)} AS sk_date_record, l_linenumber * 1000000 + l_suppkey AS sk_time_record,
        {NET} AS nbv_amount, {dec("l_extendedprice")} AS customer_cost_amount, CASE WHEN l_quantity < 3 THEN {dec("0.01")} ELSE {dec("l_quantity * 10")} END AS rent_amount,
        {dec("l_quantity")} AS true_down_payment_amount, {dec("l_quantity * 2")} AS booked_residual_amount, {dec("l_quantity * 3")} AS fmv_amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dim_lease_asset": f"SELECT {LINE} AS sk_lease_asset, MAX(CASE WHEN l_quantity < 3 OR l_quantity > 10 THEN 1 ELSE 0 END) AS is_approved, MAX(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) AS is_eligible_for_billing, 1 AS current_flag FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "dim_sundry_recurring": f"""SELECT o_orderkey AS bk_sundry_recurring_id, o_orderkey AS contract_id, o_custkey AS customer_id, o_orderkey % 7 AS receivable_code_id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS is_asset_based,
        1 AS is_active, 1 AS current_flag, 'ReceivableOnly' AS sundry_type, 'Approved' AS status, {dec("o_orderkey % 50")} AS regular_amount, 'Monthly' AS frequency FROM orders WHERE o_orderkey % 3 <> 1""",
    "dim_recurring_detail": f"""SELECT {LINE_ID} AS bk_recurring_detail_id, l_orderkey AS sundry_recurring_id, l_partkey AS asset_id, {dec("l_quantity * l_linenumber")} AS amount, {dec("l_quantity * l_linenumber * 0.2")} AS vat_amount, 1 AS current_flag
        FROM lineitem""",
    "dim_recurring_schedule": f"SELECT {LINE_ID} AS bk_recurring_schedule_id, l_orderkey AS sundry_recurring_id, {SHIPPED} AS due_date, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS is_active, 1 AS current_flag, {dec('l_quantity')} AS amount FROM lineitem",
    "dim_receivable_code": """SELECT CAST(n_nationkey AS BIGINT) AS bk_receivable_code_id, 1 AS is_active, 1 AS current_flag, CASE n_nationkey WHEN 0 THEN 'Maintenance Cost Budget - General' WHEN 1 THEN 'Third Party Maintenance' WHEN 2 THEN 'Maintenance Cost Budget - Overhead'
        WHEN 3 THEN 'Penalty Charge Notice Cost Recharge' WHEN 4 THEN 'Rental Income' ELSE 'Maintenance Cost Budget - Tyres' END AS name FROM nation WHERE n_nationkey < 6""",
    "dim_sundry": f"""SELECT event_id AS bk_sundry_id, user_id AS customer_id, event_id AS contract_id, event_id AS receivable_id, event_id % 6 AS receivable_code_id, event_id % 5 AS payable_code_id,
        CASE WHEN event_type IN ('click', 'error') THEN 'PayableOnly' ELSE 'ReceivableOnly' END AS sundry_type, {dec("value")} AS amount, {dec("value * 0.2")} AS vat_amount,
        {HAPPENED} AS receivable_due_date, {HAPPENED} + 3 AS payable_due_date, {HAPPENED} - 5 AS created_time, 'Approved' AS status, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS is_active, 1 AS current_flag FROM events""",
    "dim_sundry_detail": "SELECT event_id AS bk_sundry_detail_id, event_id AS sundry_id, event_id % 200 AS asset_id, 1 AS is_active, 1 AS current_flag FROM events WHERE event_id % 7 <> 0",
    "dim_payable_code": "SELECT CAST(r_regionkey AS BIGINT) AS bk_payable_code_id, r_name || ' cost' AS name, 1 AS current_flag FROM region",
    # One in ten belongs to no receivable, so left joins to taxes have misses.
    "dim_receivable_tax": f"SELECT CASE WHEN event_id % 10 = 7 THEN -event_id ELSE event_id END AS receivable_id, {dec('value * 0.1')} AS balance_amount, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS is_active, 1 AS current_flag FROM events",
    "dim_lease_finance_charge": "SELECT o_orderkey AS lease_finance_id, o_orderkey % 25 AS additional_charge_id, o_orderkey AS recurring_sundry_id, 1 AS current_flag FROM orders WHERE o_orderkey % 3 <> 1",
    "dim_additional_charge": f"SELECT CAST(n_nationkey AS BIGINT) AS bk_additional_charge_id, {dec('n_nationkey * 10')} AS amount, CAST(n_nationkey % 6 AS BIGINT) AS receivable_code_id, 1 AS current_flag FROM nation",
    "dim_receipt": f"""SELECT event_id AS bk_receipt_id, 'RC' || CAST(event_id AS STRING) AS number, CASE WHEN event_id % 8 = 0 THEN NULL ELSE user_id END AS customer_id, event_id AS contract_id, {dec("value")} AS receipt_amount,
        CASE WHEN event_id % 4 = 0 THEN {dec("0")} ELSE {dec("value")} END AS balance_amount, CASE WHEN event_type = 'error' THEN 'Reversed' ELSE 'Posted' END AS status, {HAPPENED} AS received_date, {HAPPENED} + 1 AS post_date,
        event_id % 5 AS type_id, event_id % 10 AS created_by_id, (event_id + 1) % 10 AS updated_by_id, event_id % 3 AS legal_entity_id, 1 AS current_flag FROM events WHERE event_type IN ('purchase', 'error')""",
    "dim_receipt_type": "SELECT CAST(r_regionkey AS BIGINT) AS bk_receipt_type_id, CASE r_regionkey WHEN 0 THEN 'DD' WHEN 1 THEN 'BACS' ELSE 'Cash' END AS receipt_type_name, 1 AS current_flag FROM region",
    "fact_receivable_invoice_detail": f"""SELECT {LINE} AS sk_invoice_detail, l_orderkey * 2 + CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS sk_receivable_invoice, {LINE} AS sk_receivable, o_custkey * 2 + 1 AS sk_customer,
        {ymd(SHIPPED)} AS sk_due_date, {ymd(ORDERED)} AS sk_invoice_run_date, CAST(l_linenumber % 3 AS BIGINT) AS sk_receivable_type, CAST(l_linenumber % 2 AS BIGINT) AS sk_receivable_category,
        CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_quantity > 48 THEN {dec("0")} ELSE {NET} END AS balance_amount, CASE WHEN l_quantity > 48 THEN {dec("0")} ELSE {dec("l_quantity")} END AS tax_balance_amount,
        CASE WHEN l_returnflag = 'A' THEN {dec("0")} ELSE {NET} END AS effective_balance_amount, {NET} AS invoice_amount, {dec("l_quantity")} AS tax_amount,
        {ymd(SHIPPED)} AS sk_date_record, ((l_linenumber * 1000000 + l_suppkey) * 100000 + l_partkey) AS sk_time_record FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dim_receivable_invoice": """SELECT o_orderkey * 2 + 1 AS sk_receivable_invoice, o_orderkey AS bk_receivable_invoice_id, 1 AS current_flag, 'INV' || CAST(o_orderkey AS STRING) AS number, CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE 1 END AS is_active,
        CASE WHEN o_orderkey % 33 = 0 THEN 1 ELSE 0 END AS is_dummy, CAST(o_orderkey % 90 AS INT) AS days_late_count, 'Cust' || CAST(o_custkey AS STRING) AS customer_name FROM orders
    UNION ALL SELECT o_orderkey * 2, o_orderkey, 0, 'INV' || CAST(o_orderkey AS STRING), 1, 0, 0, 'Cust' || CAST(o_custkey AS STRING) FROM orders""",
    "dim_invoice_detail": f"""SELECT {LINE} AS sk_invoice_detail, CASE WHEN l_orderkey % 10 = 0 THEN 'CU' ELSE 'CT' END AS entity_type, CASE WHEN l_orderkey % 10 = 0 THEN l_orderkey % 100 ELSE l_orderkey END AS entity_id,
        'L' || CAST(l_orderkey AS STRING) AS sequence_number, 1 AS current_flag FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "dim_receivable": f"SELECT {LINE} AS sk_receivable, {LINE} AS bk_receivable_id, MIN({SHIPPED}) AS due_date, 1 AS current_flag FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "dim_receivable_type": "SELECT CAST(r_regionkey AS BIGINT) AS sk_receivable_type, CASE r_regionkey WHEN 0 THEN 'SundrySeparate' WHEN 1 THEN 'OperatingLeaseRental' ELSE 'Sundry' END AS name, 1 AS current_flag FROM region",
    "dim_receivable_category": "SELECT CAST(r_regionkey AS BIGINT) AS sk_receivable_category, CASE r_regionkey WHEN 0 THEN 'Rental' ELSE 'Misc' END AS name, 1 AS current_flag FROM region",
    "dim_opportunity": """SELECT o_orderkey AS bk_opportunity_id, 'OPP' || CAST(o_orderkey AS STRING) AS number, o_custkey AS customer_id, o_custkey % 25 AS branch_id, o_custkey % 11 AS cost_center_id, o_orderkey % 10 AS created_by_id,
        o_orderkey % 3 AS legal_entity_id, o_custkey % 5 AS line_of_business_id, CASE WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Closed' END AS report_status, 1 AS current_flag FROM orders""",
    "dim_credit_profile": f"""SELECT o_orderkey * 2 + 1 AS sk_credit_profile, o_orderkey AS bk_credit_profile_id, o_orderkey AS opportunity_id, o_custkey AS customer_id, 'CP' || CAST(o_orderkey AS STRING) AS number, o_custkey % 11 AS cost_center_id,
        CASE o_orderkey % 6 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Amendment' WHEN 4 THEN 'CreditAnalysis' WHEN 5 THEN 'Approved' ELSE 'Declined' END AS status, 1 AS current_flag,
        CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS is_pre_approval, CASE WHEN o_orderkey % 11 = 2 THEN 1 ELSE 0 END AS all_assets_taken_down, {dec("o_totalprice")} AS approved_amount, o_orderkey % 10 AS assigned_to_user_id,
        {ORDERED} - 30 AS created_time, {ORDERED} - 3 AS dp_process_date FROM orders WHERE o_orderkey % 4 <> 3
    UNION ALL SELECT o_orderkey * 2, o_orderkey, o_orderkey, o_custkey, 'CP' || CAST(o_orderkey AS STRING), o_custkey % 11, 'Approved', 0, 0, 0, {dec("o_totalprice")}, o_orderkey % 10, {ORDERED} - 40, {ORDERED} - 10
        FROM orders WHERE o_orderkey % 4 = 0""",
    "dim_credit_application": f"""SELECT o_orderkey AS bk_credit_application_id, CASE WHEN o_orderkey % 8 IN (3, 5) THEN 'Pending' WHEN o_orderkey % 8 IN (7, 2) THEN 'SubmittedToCredit' ELSE 'Approved' END AS status, o_orderkey % 10 AS created_by_id,
        {ORDERED} - 40 AS created_time, {ORDERED} - 35 AS submitted_to_credit_date, 1 AS current_flag FROM orders""",
    "dim_application_asset": f"SELECT {LINE_ID} AS bk_application_asset_id, l_orderkey AS credit_application_id, l_partkey AS asset_id, 1 AS current_flag FROM lineitem WHERE l_orderkey % 8 IN (3, 5, 7)",
    "dim_application_structure": f"SELECT o_orderkey AS bk_application_structure_id, o_orderkey AS credit_application_id, 1 AS number, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS transaction_type_id, {ORDERED} + 15 AS expected_disbursement_date, 1 AS is_active, 1 AS current_flag FROM orders WHERE o_orderkey % 8 = 7",
    "dim_application_structure_asset": f"SELECT {LINE_ID} AS bk_application_structure_asset_id, l_orderkey AS application_structure_id, l_partkey AS asset_id, 1 AS is_active, 1 AS current_flag FROM lineitem WHERE l_orderkey % 8 = 7",
    "dim_approved_structure": f"""SELECT o_orderkey AS bk_approved_structure_id, o_orderkey AS credit_profile_id, 1 AS number, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS deal_product_type_id, {ORDERED} + 5 AS expected_commencement_date,
        CAST(12 + o_orderkey % 48 AS INT) AS customer_term, {dec("o_orderkey % 321")} AS balloon_amount, 1 AS is_active, 1 AS current_flag FROM orders WHERE o_orderkey % 4 <> 3""",
    "dim_approved_structure_asset": f"SELECT {LINE_ID} AS bk_approved_structure_asset_id, l_orderkey AS approved_structure_id, l_partkey AS asset_id, 1 AS is_active, 1 AS current_flag FROM lineitem WHERE l_orderkey % 4 <> 3",
    "dim_profile_asset": f"SELECT {LINE_ID} AS bk_profile_asset_id, l_orderkey AS credit_profile_id, l_partkey AS asset_id, 1 AS current_flag FROM lineitem WHERE l_orderkey % 4 <> 3",
    "dim_payment_schedule": f"""SELECT {LINE_ID} AS sk_payment_schedule, l_orderkey AS lease_finance_detail_id, CAST(l_linenumber AS INT) AS payment_number, {SHIPPED} AS due_date, {dec("l_quantity * 20")} AS amount, {dec("l_extendedprice")} AS begin_balance_amount,
        {NET} AS end_balance_amount, {dec("l_quantity")} AS interest_amount, CASE WHEN l_linenumber % 3 = 0 THEN {dec("l_quantity")} ELSE {dec("0")} END AS deferred_tax_amount, CASE WHEN l_linenumber = 7 THEN 'OTP' WHEN l_linenumber = 6 THEN 'Other' ELSE 'FixedTerm' END AS payment_type,
        1 AS is_active, 1 AS current_flag FROM lineitem""",
    "dim_asset_value_history": f"""SELECT {LINE_ID} AS bk_asset_value_history_id, l_partkey AS asset_id, {SHIPPED} AS income_date, {dec("l_extendedprice")} AS begin_book_value_amount, {NET} AS end_book_value_amount, {dec("l_quantity * 7")} AS cost_amount, {NET} AS net_value_amount,
        1 AS is_lessor_owned, CASE WHEN l_linenumber < 6 THEN 1 ELSE 0 END AS is_schedule, 1 AS is_accounted, CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS is_cleared, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey END AS gl_journal_id,
        CASE WHEN l_linenumber = 2 THEN 'AssetValueAdjustment' ELSE 'Depreciation' END AS source_module, 1 AS current_flag FROM lineitem""",
    "dim_book_depreciation": f"""SELECT {LINE_ID} AS sk_book_depreciation, l_partkey AS asset_id, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_orderkey END AS contract_id, {SHIPPED} AS begin_date, {SHIPPED} + 365 AS end_date,
        CASE WHEN l_returnflag = 'R' THEN {SHIPPED} + 100 END AS terminated_date, {dec("l_quantity * 0.01")} AS per_day_factor, CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS is_active, 1 AS current_flag FROM lineitem""",
    "fact_payable_invoice_asset": f"""SELECT l_partkey * 2 + 1 AS sk_asset, l_orderkey AS sk_payable_invoice, l_suppkey AS vendor_id, {ymd(SHIPPED)} AS sk_date_record, ((l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey) AS sk_time_record, {dec("l_quantity * 50")} AS acquisition_cost_amount,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE {dec("l_quantity")} END AS other_cost_amount, {dec("l_quantity * 10")} AS vat_amount FROM lineitem""",
    "dim_vendor": "SELECT s_suppkey AS bk_vendor_id, s_name AS company_name FROM supplier",
    "dim_asset_sale": f"""SELECT o_orderkey AS bk_asset_sale_id, {ORDERED} AS transaction_date, 'broker' || CAST(o_custkey % 9 AS STRING) AS attention_to, o_custkey AS buyer_id, 'SQ' || CAST(o_orderkey AS STRING) AS transaction_number,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Submitted' ELSE 'Pending' END AS status, CAST(o_orderkey % 2 AS INT) AS finance_company_funded, o_custkey % 25 AS branch_id, o_orderkey % 6 AS receivable_code_id,
        o_orderkey AS first_receivable_invoice_id, 1 AS current_flag FROM orders""",
    "dim_asset_sale_detail": f"SELECT {LINE_ID} AS bk_asset_sale_detail_id, l_orderkey AS asset_sale_id, l_partkey AS asset_id, {NET} AS fair_market_value_amount, {dec('l_quantity * 1000')} AS net_value_amount, {dec('l_quantity * 5')} AS projected_vat_amount, 1 AS is_active, 1 AS current_flag FROM lineitem",
    "dim_asset_sale_employee": "SELECT o_orderkey AS asset_sale_id, o_orderkey % 10 AS employee_id, 1 AS is_primary, 1 AS is_active, 1 AS current_flag FROM orders",
    "fact_receivable_invoice": f"SELECT o_orderkey * 2 + 1 AS sk_receivable_invoice, CASE WHEN o_orderkey % 3 = 0 THEN {dec('0')} ELSE {dec('o_totalprice')} END AS balance_amount, {dec('0')} AS tax_balance_amount FROM orders",
    "dim_insurance_policy": "SELECT c_custkey AS bk_insurance_policy_id, c_custkey AS customer_id, DATE '2001-06-30' + CAST(c_custkey % 100 - 50 AS INT) AS expiration_date, DATE '2000-01-01' + CAST(c_custkey % 30 AS INT) AS activation_date, 'POL' || CAST(c_custkey AS STRING) AS policy_number, 'Fleet' AS type, c_custkey % 5 AS insurance_company_id, CAST(c_custkey % 2 AS INT) AS is_self_insured, 1 AS is_active, 1 AS current_flag FROM customer WHERE c_custkey % 6 <> 5",
    "dim_insurance_company": "SELECT CAST(r_regionkey AS BIGINT) AS bk_insurance_company_id, r_name || ' Mutual' AS name, 1 AS is_active, 1 AS current_flag FROM region",
    "dim_customer_exposure": f"""SELECT c_custkey * 2 AS bk_customer_exposure_id, c_custkey AS exposure_customer_id, DATE '2001-01-01' AS exposure_date, {dec("c_acctbal")} AS total_proposed_exposure, 1 AS is_active, 1 AS current_flag FROM customer
    UNION ALL SELECT c_custkey * 2 + 1, c_custkey, DATE '2001-05-01', {dec("c_acctbal * 2")}, 1, 1 FROM customer WHERE c_custkey % 2 = 0""",
    "dim_credit_summary_exposure": f"SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 9 = 0 THEN 'XX' ELSE 'EF' END AS exposure_type, {dec('c_acctbal * 0.5')} AS primary_customer_amount, {dec('100')} AS direct_amount, {dec('50')} AS indirect_amount, 1 AS current_flag FROM customer",
    "dim_party_address": "SELECT c_custkey AS bk_party_address_id, 'Street ' || CAST(c_custkey AS STRING) AS address_line1, 'PC' || CAST(c_nationkey AS STRING) AS postal_code, 1 AS current_flag FROM customer WHERE c_custkey % 10 <> 4",
    "dim_transaction_instance": "SELECT o_orderkey AS bk_transaction_instance_id, o_orderkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CreditProfile' ELSE 'LeaseFinance' END AS entity_name, CASE WHEN o_orderkey % 5 = 0 THEN 'Done' ELSE 'Active' END AS status, 1 AS current_flag FROM orders",
    "dim_work_item": "SELECT o_orderkey AS transaction_instance_id, (o_orderkey + 4) % 10 AS owner_user_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Done' ELSE 'Assigned' END AS status, 1 AS current_flag FROM orders",
    "dim_remaining_investment": f"SELECT o_orderkey AS contract_id, {ORDERED} + 100 AS income_date, {dec('o_totalprice * 0.3')} AS remaining_amount, {dec('o_totalprice * 0.9')} AS financed_amount, 1 AS is_active, 1 AS current_flag FROM orders UNION ALL SELECT o_orderkey, {ORDERED} + 130, {dec('o_totalprice * 0.2')}, {dec('o_totalprice * 0.9')}, 1, 1 FROM orders WHERE o_orderkey % 2 = 0",
    "flat_assets": """SELECT CAST(p_partkey AS STRING) AS id, 'REG' || CAST(p_partkey AS STRING) AS alias, 'R' || CAST(p_partkey AS STRING) AS registration_number, 'EQ' || CAST(p_partkey AS STRING) AS equipment_id, 'current' AS source_system,
        CASE WHEN p_partkey % 6 = 1 THEN CAST(p_partkey - 1 AS STRING) END AS parent_asset_id, CASE WHEN p_partkey % 13 = 0 THEN 'Ancillary' ELSE p_type END AS vehicle_category, CASE WHEN p_partkey % 9 = 0 THEN 'Fleet Managed Asset' ELSE 'Sub' END AS asset_sub_type, 'Leased' AS status FROM part
    UNION ALL SELECT 'X' || CAST(p_partkey AS STRING), 'REG' || CAST(p_partkey AS STRING), 'R' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 10 = 0 THEN 'OLD' ELSE 'EQ' END || CAST(p_partkey AS STRING), 'legacy', CAST(NULL AS STRING), p_type, 'Sub', 'Sold'
        FROM part WHERE p_partkey % 2 = 0""",
    "flat_contracts": f"""SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 40 = 0 THEN 'L' || CAST(o_orderkey AS STRING) || 'novated' ELSE 'L' || CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) END AS sequence_number, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' ELSE 'current' END AS source_system,
        CASE WHEN o_orderkey % 12 = 0 THEN '8' ELSE 'S' END || CAST(o_orderkey AS STRING) AS schedule_number, 'Customer ' || CAST(o_custkey AS STRING) AS customer_name, 'ACC' || CAST(o_custkey AS STRING) AS account_number, 'ORG' || CAST(o_custkey AS STRING) AS organization_id,
        'APP' || CAST(o_custkey AS STRING) AS application_name, CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'FullyPaidOff' ELSE 'Commenced' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Contract Hire Plus' WHEN '2' THEN 'Hire Purchase (HP)' WHEN '3' THEN 'Operating Lease' WHEN '4' THEN 'Finance Lease' ELSE 'Rental Flex' END AS product,
        CASE o_custkey % 3 WHEN 0 THEN 'Bus and Coach' WHEN 1 THEN 'Contract Hire Leasing and Rental' ELSE 'Vans' END AS line_of_business, 'bdm' || CAST(o_custkey % 8 AS STRING) AS bdm, {ORDERED} AS created_date, {ORDERED} + 20 AS commencement_date, {ORDERED} + 750 AS maturity_date,
        {dec("o_totalprice")} AS financed_amount, {dec("o_orderkey % 100")} AS vat_on_asset, {dec("o_orderkey % 70")} AS down_payment_amount, {dec("o_orderkey % 30")} AS tax_deferral_amount, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INT) AS was_migrated, CAST(36 AS INT) AS term FROM orders""",
    "flat_equipment": f"SELECT CAST(l_orderkey AS STRING) AS contract_id, CAST(l_partkey AS STRING) AS asset_id, CAST(l_orderkey % 30 AS STRING) AS customer_id, CASE WHEN l_returnflag = 'R' THEN {SHIPPED} END AS terminated_on, l_linestatus AS status, CAST(l_quantity * 100 AS INT) AS contract_mileage FROM lineitem",
    "flat_budgets": f"SELECT 'B' || CAST({LINE_ID} AS STRING) AS id, CAST(l_partkey AS STRING) AS asset_id, CAST(l_orderkey AS STRING) AS contract_id, {dec('l_quantity')} AS amount, {SHIPPED} AS invoice_date, CASE l_linenumber WHEN 1 THEN 'Tyre Budget' WHEN 2 THEN 'Fleet Overhead Budget' WHEN 3 THEN 'Utilities' WHEN 4 THEN ' Waiver ' ELSE 'Maintenance Budget' END AS fee_name, 'Cust' || CAST(l_orderkey % 50 AS STRING) AS customer_name, 'current' AS source_system, 'Budget' AS category FROM lineitem",
    "flat_recharges": f"SELECT CAST(event_id AS STRING) AS id, CAST(event_id % 200 AS STRING) AS asset_id, CAST(event_id AS STRING) AS contract_id, {dec('value')} AS amount, {HAPPENED} AS invoice_date, CASE event_type WHEN 'click' THEN 'Penalty Charge Notice Cost Recharge' WHEN 'error' THEN 'TYRE Recharge' WHEN 'signup' THEN 'Penalty Charge Admin Fee Recharge' WHEN 'view' THEN 'Damage' END AS fee_name, CASE WHEN event_id % 15 = 0 THEN 'EOL work' WHEN event_id % 2 = 0 THEN 'work' END AS description, 'Cust' || CAST(user_id AS STRING) AS customer_name, 'current' AS source_system, CASE WHEN event_id % 3 = 0 THEN 'Sundry' ELSE 'Fee' END AS category FROM events",
    "flat_expenses": f"SELECT 'E' || CAST(event_id AS STRING) AS id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST(event_id % 150 AS STRING) END AS asset_id, {dec('value * 0.5')} AS amount, {HAPPENED} AS invoice_date, CASE event_type WHEN 'click' THEN 'Penalty Charge Notice Cost Charge' WHEN 'error' THEN 'Tyre fitting' ELSE 'Workshop' END AS fee_name, 'Vend' || CAST(user_id AS STRING) AS account_name, 'legacy' AS source_system, 'Expense' AS category FROM events",
    "flat_application_documents": "SELECT o_orderkey AS document_id, 'APP' || CAST(o_custkey AS STRING) AS application_name, 'doc ' || CAST(o_orderkey AS STRING) AS title FROM orders",
    "flat_lease_documents": "SELECT o_orderkey AS document_id, 'S' || CAST(o_orderkey AS STRING) AS lease_name, 'lease ' || CAST(o_orderkey AS STRING) AS title FROM orders",
    "dim_date": f"""WITH span AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) + 1500 AS hi FROM orders),
    days AS (SELECT day_expansion AS bk_date FROM span)
    SELECT {ymd("bk_date")} AS sk_date, bk_date, CAST(year(bk_date) AS INT) AS year_num, CAST(month(bk_date) AS INT) AS month_num FROM days
    UNION ALL SELECT CAST(-1 AS BIGINT), DATE '9999-01-01', 9999, 1""",
}

# The one place where the engines spell things differently: listing the days of a range.
DAY_LIST = {
    "spark": "explode(sequence(lo, hi, interval 1 day))",
    "duckdb": "CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE)",
}
