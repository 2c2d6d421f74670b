"""Small frames that most reports share: lookups, days, people, registrations."""

from pyspark.sql import functions as F

from rentroll.lease.warehouse import view
from rentroll.operators.versions import first_per_key


def lookup(w, table, key, as_key, **columns):
    """Current rows of a dimension under the key name of the caller: ``new_name="column"``."""
    return w.current(table).select(F.col(key).alias(as_key), *[F.col(c).alias(n) for n, c in columns.items()])


def with_day(w, df, date_key, out, how="left"):
    """Replace a date key by its day; Spark broadcasts the calendar if it is small."""
    days = w("dim_date").select(F.col("sk_date").alias(date_key), F.col("bk_date").alias(out))
    return df.join(days, date_key, how)


def as_amounts(df, *columns):
    """Report form of exact amounts."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@view
def party_people(w):
    """Primary, active staff of each party with role and name."""
    held = w.active("dim_party_employee").filter(F.col("is_primary") == 1)
    role = lookup(w, "dim_role_function", "bk_role_function_id", "role_function_id", role_function="name", system_name="system_defined_name")
    user = lookup(w, "dim_user", "bk_user_id", "employee_id", employee_name="full_name")
    return (
        held.join(role, "role_function_id")
        .join(user, "employee_id")
        .select(F.col("party_id").alias("customer_id"), "employee_id", "employee_name", "role_function", "system_name")
        .distinct()
    )


def person(w, role, out):
    """One role's staff per customer."""
    return party_people(w).filter(F.col("role_function") == role).select("customer_id", F.col("employee_name").alias(out))


def with_people(w, df):
    """Account manager and sales rep of a customer, both optional."""
    return df.join(person(w, "Account Manager", "account_manager"), "customer_id", "left").join(
        person(w, "Sales Rep", "sales_rep"), "customer_id", "left"
    )


@view
def registrations(w):
    """Latest registration of each asset."""
    latest = first_per_key(
        w.current("dim_registration"), ["asset_id"], F.col("effective_date").desc(), F.col("bk_registration_id").desc()
    )
    return latest.select("asset_id", "registration_number", "effective_date", "is_active")


@view
def serials(w):
    """Latest serial number of each asset."""
    order = F.col("created_time").desc(), F.col("bk_serial_number_id").desc()
    return first_per_key(w.current("dim_serial_number"), ["asset_id"], *order).select("asset_id", "serial_number")


@view
def config_values(w):
    """Id to text of the shared configuration list."""
    return w.current("dim_detail_config").select("bk_detail_config_id", "value")


def config(w, key, out):
    return config_values(w).select(F.col("bk_detail_config_id").alias(key), F.col("value").alias(out))


@view
def current_assets(w):
    return w.current("dim_asset").withColumnRenamed("bk_asset_id", "asset_id")


@view
def current_contracts(w):
    return w.current("dim_contract").withColumnRenamed("bk_contract_id", "contract_id")


@view
def current_customers(w):
    return w.current("dim_customer").withColumnRenamed("bk_customer_id", "customer_id")


@view
def products(w):
    return lookup(w, "dim_deal_product_type", "bk_deal_product_type_id", "deal_product_type_id", product_name="transaction_type", product_code="code")


@view
def cost_centers(w):
    return lookup(w, "dim_cost_center", "bk_cost_center_id", "cost_center_id", cost_center="description")
