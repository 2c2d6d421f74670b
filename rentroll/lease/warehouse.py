"""The lease warehouse: tables by name, current versions, report settings."""

from dataclasses import dataclass, field
from datetime import date
from functools import wraps

from pyspark.sql import functions as F

from rentroll.sources.tables import Tables


@dataclass(frozen=True)
class Settings:
    """Business values that reports need and data cannot tell. Names of people are never built in."""

    as_of: date
    new_system: str = "current"
    old_system: str = "legacy"
    migration_day: date = date(2001, 1, 31)
    own_company: str = ""
    contract_prefix: str = "LES-"
    currency: str = "GBP"
    key_account_ids: tuple = ()
    key_account_label: str = "Key Accounts"
    cash_users: tuple = ()
    controllers: dict = field(default_factory=dict)
    """Owner by name rule: ``{"prefix": {prefix: owner}, "initial": {(low, high): owner}, "other": owner}``."""


class Warehouse:
    """Reads tables through ``table(name)`` and remembers the views built on them.

    ``scan(name)`` is for a large table that a report reads once and of which it needs a part: it is never taken from a copy
    that would hold all columns and rows.
    """

    def __init__(self, spark, table, settings, is_part=False, scan=None):
        self.spark = spark
        self.is_part = is_part
        self._table = table
        self.scan = scan or self
        self.settings = settings
        self.as_of = settings.as_of
        self._tables = {}
        self._views = {}

    @classmethod
    def of_lake(cls, spark, root, settings, prefix="", renamed=None):
        """A warehouse in Parquet files named ``<prefix><table>``; ``renamed`` maps foreign column names."""
        files = Tables(spark, root)
        return cls(spark, lambda name: files(prefix + name).withColumnsRenamed(renamed or {}), settings)

    def __call__(self, name):
        if name not in self._tables:
            self._tables[name] = self._table(name)
        return self._tables[name]

    def current(self, name):
        """Current versions only."""
        return self(name).filter(F.col("current_flag") == 1).drop("current_flag")

    def active(self, name):
        """Current and active versions."""
        return self.current(name).filter(F.col("is_active") == 1).drop("is_active")


# Tables with rows of one asset each, by the column that names it.
ASSET_ROWS = [
    "asset_sheet", "dim_application_asset", "dim_application_structure_asset", "dim_approved_structure_asset", "dim_asset_value_history",
    "dim_book_depreciation", "dim_profile_asset", "dim_recurring_detail", "dim_registration", "dim_serial_number",
]
ASSET_FACTS = ["fact_lease_asset"]


def of_assets(w, assets):
    """The warehouse with no other assets than these (a frame of ``asset_id``), for reports on a part of the fleet.

    Rows of other assets leave at the first join and not at the last. Only for views that are kept per asset: what a
    contract sums over its assets comes from the whole warehouse.
    """
    assets = assets.select("asset_id").distinct()
    own = assets.withColumnRenamed("asset_id", "bk_asset_id")
    versions = w("dim_asset").join(own, "bk_asset_id", "left_semi")

    def table(name):
        if name == "dim_asset":
            return versions
        if name in ASSET_FACTS:
            return w(name).join(versions.select("sk_asset"), "sk_asset", "left_semi")
        if name in ASSET_ROWS:
            return w(name).join(assets, "asset_id", "left_semi")
        return w(name)

    return Warehouse(w.spark, table, w.settings, is_part=True)


def view(build):
    """A named view: built once per warehouse, however many reports stack on it."""

    @wraps(build)
    def cached(w):
        if build.__name__ not in w._views:
            w._views[build.__name__] = build(w)
        return w._views[build.__name__]

    return cached
