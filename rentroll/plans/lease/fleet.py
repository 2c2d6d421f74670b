"""Fleet reports and their checks."""

from rentroll.lease import fleet
from rentroll.plans.lease.base import DAY
from rentroll.plans.lease.fixture import lease_query


def zero(*columns, source=""):
    return ", ".join(f"CAST(COALESCE({source}{c}, 0) AS DOUBLE) AS {c}" for c in columns)


def uk(*columns):
    return ", ".join(f"strftime({c}, '%d/%m/%Y') AS {c}" for c in columns)


def leases(assets, columns, where="TRUE", joins=""):
    return f"""SELECT {columns} FROM {assets} l JOIN asset_sheet s ON s.asset_id = l.asset_id JOIN v_contracts c ON c.contract_id = l.contract_id {joins} WHERE {where}"""


lease_query("all_asset", "V038 C03 P02", fleet.all_asset,
    f"""SELECT asset_id, registration_number, COALESCE(serial_number, '-') AS serial_number, '-' AS collateral_category, asset_status, asset_contract_type,
        {zero('residual_value_amount', 'book_value_amount', 'equipment_nbv', 'depreciation_value')}, 0 AS fair_value_adjustment FROM asset_sheet WHERE asset_status <> 'Sold'""")
DELIVERY = f"""SELECT asset_id, registration_number, COALESCE(serial_number, '-') AS chassis_number, project_number, CAST(trunc(gvw) AS INTEGER) AS gvw, allocated_status, asset_status,
    {uk('acquisition_date', 'delivered_on', 'planned_delivery', 'reserve_date', 'rv_maturity_date', 'available_from')}
    FROM asset_sheet WHERE asset_type <> 'Ancillary' AND asset_contract_type <> 'BackedOffAsset' AND asset_status IN """
lease_query("available_assets", "V046 T08 K01 P04", fleet.available_assets, DELIVERY + "('Inventory', 'AwaitingDelivery')")
lease_query("assets_awaiting_delivery", "V120 T08 K01 C03", fleet.awaiting_delivery, DELIVERY + "('AwaitingDelivery')")
lease_query("stock_assets", "V062 K02 C03", fleet.stock_assets,
    f"""SELECT asset_id, substr(alias, 1, 8) AS registration_number, COALESCE(asset_funding_status, '-') AS funding_status, COALESCE(asset_sub_type, '-') AS asset_sub_type, {zero('book_value_amount')},
        COALESCE(serial_number, '-') AS chassis_number FROM asset_sheet WHERE asset_contract_type = 'Stock'""")
lease_query("rental_availability", "V063 T09 C01 P04", fleet.rental_availability,
    """SELECT asset_id, registration_number, CAST(mot_passed_date + INTERVAL 1 YEAR AS DATE) AS mot_expiry_date, CASE WHEN application_stage IS NULL THEN 0 ELSE 1 END AS in_application, asset_status, utilised
        FROM v_rentals WHERE category_name = 'Commercial Vehicles' AND utilised IN ('In Application', 'No') AND asset_status IN ('Inventory', 'Leased')""")
lease_query("assets_not_on_hire", "V064 A09 P04", fleet.assets_not_on_hire,
    f"""SELECT DISTINCT asset_sub_type, rv_maturity_date, asset_status, CAST(book_value_amount AS DOUBLE) AS book_value_amount, {zero('depreciation_value')}, 0 AS in_application, registration_number
        FROM asset_sheet WHERE asset_status IN ('Inventory', 'AwaitingDelivery')""")
lease_query("asset_funding_analysis", "V068 A09 K02 P04", fleet.asset_funding_analysis,
    """SELECT DISTINCT substr(alias, 1, 8) AS registration_number, asset_contract_type, is_migrated, asset_status, COALESCE(asset_funding_status, '-') AS funding_status, COALESCE(serial_number, '-') AS chassis_number,
        COALESCE(allocated_status, '-') AS allocated_status, COALESCE(reserved_by, '-') AS reserved_by
        FROM asset_sheet WHERE asset_type <> 'Ancillary' AND asset_status IN ('Inventory', 'AwaitingDelivery', 'OnHold') AND asset_contract_type IN ('Lease', 'Rental')""")
lease_query("asset_nbv", "V069 A09 C03", fleet.asset_nbv,
    f"""SELECT DISTINCT asset_id, registration_number, equipment_id, acquisition_date, COALESCE(serial_number, '-') AS serial_number,
        {zero('book_value_amount', 'equipment_nbv', 'residual_value_amount', 'depreciation_value')} FROM asset_sheet""")
lease_query("sale_stock", "V080 T02 K01 J02", fleet.sale_stock,
    f"""SELECT s.asset_id, s.registration_number, CAST(s.equipment_nbv AS DOUBLE) AS stock_nbv, s.asset_status, CAST(trunc(s.gvw) AS INTEGER) AS gvw, l.termination_date,
        CAST(date_diff('day', l.termination_date, {DAY}) AS INTEGER) AS days_standing FROM asset_sheet s LEFT JOIN v_lease_assets_live l ON l.asset_id = s.asset_id""")
lease_query("warehouse_assets", "V082 C01 J03 K01", fleet.warehouse_assets,
    """SELECT s.asset_id, s.alias, CAST(trunc(s.gvw) AS INTEGER) AS gvw, s.asset_sub_type, CASE WHEN a.asset_id IS NULL THEN 'FALSE' ELSE 'TRUE' END AS in_application
        FROM asset_sheet s LEFT JOIN v_assets_in_app a ON a.asset_id = s.asset_id AND a.latest_application = 1 WHERE s.asset_status = 'Inventory'""")
lease_query("terminated_assets", "V045 J01 J03 C03", fleet.terminated_assets,
    leases("v_lease_assets", """l.contract_id, l.asset_id, l.sequence_number, c.company_name, COALESCE(s.serial_number, '-') AS serial_number, c.payment_frequency, c.product_name, c.branch_name, c.commencement_date, l.termination_date,
        c.payment_method, c.cost_center, c.sales_rep, CAST(l.rent_amount AS DOUBLE) AS rent_amount, CAST(l.total_charge AS DOUBLE) AS total_charge""", "l.sk_date_termination_date > 0"))
lease_query("contracts_created", "V048 J11 C02", fleet.contracts_created,
    leases("v_lease_assets_live", """l.contract_id, l.asset_id, l.sequence_number, c.company_name, c.product_name, c.status, COALESCE(c.sales_rep, '-') AS sales_rep, c.contract_created_by,
        COALESCE(c.created_date, c.lease_start_date) AS created_on, c.maturity_date, c.is_migrated, l.termination_date, CAST(l.rent_amount AS DOUBLE) AS rent_amount"""))
lease_query("terminations_on_live_contracts", "V049 F01 P02", fleet.terminations_on_live_contracts,
    leases("v_lease_assets", """l.contract_id, l.asset_id, 'LES-' || l.sequence_number AS account_id, c.product_name, c.company_name, c.payment_method, l.termination_date, c.maturity_date, 'GBP' AS rent_currency,
        CAST(l.rent_amount AS DOUBLE) AS rent_amount, CAST(l.total_charge AS DOUBLE) AS total_charge""", "l.sk_date_termination_date > 0 AND l.contract_status <> 'Inactive'"))
for kind, view, build in (("Lease", "V053", fleet.evergreen_leased), ("Rental", "V054", fleet.evergreen_rental)):
    lease_query(build.__name__, f"{view} P02 T08", build,
        leases("v_lease_assets_live", """l.contract_id, l.asset_id, l.sequence_number, c.company_name, c.branch_name, strftime(c.commencement_date, '%d/%m/%Y') AS commencement_date,
            strftime(c.maturity_date, '%d/%m/%Y') AS maturity_date, strftime(s.acquisition_date, '%d/%m/%Y') AS acquisition_date""", f"s.asset_contract_type = '{kind}' AND c.is_over_term_lease = 1"))
OPEN = "s.asset_status = 'Leased' AND lower(c.status) = 'commenced'"
lease_query("individual_customers", "V056 P04 F03 J11", fleet.individual_customers,
    leases("v_lease_assets_live", """l.contract_id, l.asset_id, l.sequence_number, c.company_name, c.product_name, c.commencement_date, c.maturity_date, c.branch_name, c.cost_center, c.sales_rep,
        CAST(l.rent_amount AS DOUBLE) AS rent_amount, CAST(s.equipment_nbv AS DOUBLE) AS equipment_nbv""", OPEN + " AND s.asset_contract_type NOT IN ('Stock', 'BackedOffAsset')"))
lease_query("open_lease_customers", "V057 J11 C03", fleet.open_lease_customers,
    leases("v_lease_assets_live", """l.contract_id, l.asset_id, c.company_name, COALESCE(s.serial_number, '-') AS serial_number, s.service_intervals_vehicle, c.payment_method, c.commencement_date, c.maturity_date, s.term,
        CAST(l.total_charge AS DOUBLE) AS total_charge""", OPEN))
lease_query("open_lease_file", "V058 J11 P06", fleet.open_lease_file,
    leases("v_lease_assets_live", """l.contract_id, l.asset_id, c.company_name, u.account_manager AS sales_person, s.rv_maturity_date, 'xxx' AS renewal_action, 'xxx' AS opt_out, COALESCE(c.sales_rep, '-') AS sales_rep, c.maturity_date,
        CAST(l.total_charge AS DOUBLE) AS total_charge""", OPEN, "LEFT JOIN v_customers u ON u.customer_id = l.customer_id"))
lease_query("funding_migration", "V070 P04 J11", fleet.funding_migration,
    leases("v_lease_assets_live", f"""l.contract_id, l.asset_id, s.registration_number, COALESCE(s.asset_funding_status, '-') AS funding_status, s.acquisition_date, c.company_name AS reserved_for, {zero('depreciation_value', source='s.')},
        CAST(s.equipment_nbv AS DOUBLE) AS equipment_nbv""", "s.asset_status = 'Leased' AND s.asset_contract_type NOT IN ('Stock', 'BackedOffAsset') AND s.is_migrated = 0"))
lease_query("contracts_not_activated", "V071 J11 F03", fleet.contracts_not_activated,
    leases("v_lease_assets_live", """l.contract_id, l.asset_id, 'LES-' || l.sequence_number AS account_id, c.status, c.company_name, c.product_name, d.charge_name, c.branch_name, c.cost_center, c.sales_rep, c.maturity_date,
        CAST(a.approved_amount AS DOUBLE) AS approved_amount""", "s.asset_status = 'Leased' AND lower(c.status) IN ('installingassets', 'pending')",
        "LEFT JOIN v_credit_apps a ON a.opportunity_number = c.opportunity_number LEFT JOIN v_charges_detail d ON d.contract_id = l.contract_id AND d.asset_id = l.asset_id"))
lease_query("accruals_by_charge", "V073 J11 C03", fleet.accruals_by_charge,
    leases("v_lease_assets_live", f"""l.contract_id, l.asset_id, l.sequence_number, c.product_name, c.company_name, c.status, COALESCE(c.lease_start_date, c.commencement_date) AS created_on, c.maturity_date,
        COALESCE(d.charge_name, '-') AS charge_name, {zero('charges', source='d.')}, {zero('rent_amount', 'nbv_amount', source='l.')}, CAST(COALESCE(l.booked_residual_amount, 0) AS DOUBLE) AS asset_residual""",
        "lower(s.asset_contract_type) <> 'stock' AND lower(s.asset_status) IN ('inventory', 'leased')", "LEFT JOIN v_charges_detail d ON d.contract_id = l.contract_id AND d.asset_id = l.asset_id"))
lease_query("maturity_timeframes", "V084 D03 C04 T02", fleet.maturity_timeframes,
    f"""SELECT contract_id, asset_id, sequence_number, registration_number, product_name, maturity_date, days_left, CASE WHEN days_left <= 0 THEN 'Already Matured' WHEN days_left <= 30 THEN '1 Month or Less'
        WHEN days_left <= 60 THEN '1-2 Months' WHEN days_left <= 90 THEN '2-3 Months' WHEN days_left <= 180 THEN '3-6 Months' WHEN days_left <= 365 THEN '6-12 Months' WHEN days_left > 365 THEN 'More than 1 Year' END AS timeframe,
        sales_rep, total_charge FROM (SELECT l.contract_id, l.asset_id, c.sequence_number, s.registration_number, c.product_name, c.maturity_date, CAST(date_diff('day', {DAY}, c.maturity_date) AS INTEGER) AS days_left, c.sales_rep,
        CAST(l.total_charge AS DOUBLE) AS total_charge FROM v_lease_assets_live l LEFT JOIN v_contracts c ON c.contract_id = l.contract_id LEFT JOIN asset_sheet s ON s.asset_id = l.asset_id)""")
lease_query("origination_assets", "V109 J02", fleet.origination_assets,
    "SELECT l.contract_id, l.asset_id, s.alias, s.service_intervals_vehicle, s.term FROM v_lease_assets_live l LEFT JOIN asset_sheet s ON s.asset_id = l.asset_id")
lease_query("sync_status", "V060 A09 C01 C03", fleet.sync_status,
    """SELECT DISTINCT f.equipment_id, s.fleet_number, f.registration_number AS vehicle_registration, CASE WHEN f.is_synced = 1 THEN 'Success' ELSE 'Error' END AS sent, COALESCE(f.sync_status, '-') AS last_status
        FROM asset_sheet s JOIN v_features f ON f.asset_id = s.asset_id""")
