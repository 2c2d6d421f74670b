"""Fixture warehouse for Spark, and whole SQL checks from named pieces."""

import re

from rentroll.lease.warehouse import Settings, Warehouse
from rentroll.plans.base import AS_OF
from rentroll.plans.lease.star import DAY_LIST, STAR
from rentroll.plans.registry import query
from rentroll.sources.tables import scratch_path

SETTINGS = Settings(
    as_of=AS_OF,
    own_company="Customer#000000003",
    key_account_ids=("3", "5", "17"),
    cash_users=("Supplier#000000001", "Supplier#000000004", "Supplier#000000007"),
    controllers={
        "prefix": {"MACH": "desk 2"},
        "initial": {("A", "E"): "desk 1", ("F", "O"): "desk 2"},
        "other": "desk 3",
    },
)


STORED = {}
"""Where each star table of a session has been written: (application, root, table) -> (path, schema)."""

SOURCES = "region|nation|customer|supplier|part|orders|lineitem|events"


def derived(t, name):
    """A star table as a query on the fixture tables."""
    text = STAR[name].replace("day_expansion", DAY_LIST["spark"])
    used = set(re.findall(rf"\b(?:FROM|JOIN)\s+({SOURCES})\b", text))
    marked = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", text)
    return t.spark.sql(marked, **{source: t(source) for source in used})


def is_lookup(name):
    """Whether a star table stays small, however large the sources are: the calendar, and lists of regions and nations."""
    return name == "dim_date" or set(re.findall(rf"\b(?:FROM|JOIN)\s+({SOURCES})\b", STAR[name])) <= {"region", "nation"}


COPIED = ["fact_receivable_invoice_detail"]
"""Large star tables that are written all the same, unless a report reads them by ``scan``."""


def stored(t, name):
    """A star table: its query on the fixture tables, or for the small ones that most joins read, files in the shared folder.

    A report needs a few columns of a table and often a part of its rows, and its scan of the sources brings no more than
    these. A copy of a whole table would be shuffled, written and read with all its columns.
    """
    if not is_lookup(name) and name not in COPIED:
        return derived(t, name)
    key = (t.spark.sparkContext.applicationId, t.root, name)
    if key not in STORED:
        rows = derived(t, name)
        path = scratch_path(t.spark, name)
        rows.write.parquet(path)
        STORED[key] = (path, rows.schema)
    path, schema = STORED[key]
    return t.spark.read.schema(schema).parquet(path)


def warehouse(t):
    return Warehouse(t.spark, lambda name: stored(t, name), SETTINGS, scan=lambda name: derived(t, name))


VIEWS = {}
"""SQL of the base views that reports stack on, for the checks only."""


def whole_sql(body):
    """Put every star table and base view that a check names in front of it, in order of need."""
    needed, order = {}, []

    def visit(text):
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text):
            if name in needed or name not in (VIEWS.keys() | STAR.keys()):
                continue
            needed[name] = VIEWS.get(name) or STAR[name].replace("day_expansion", DAY_LIST["duckdb"])
            visit(needed[name])
            order.append(name)

    visit(body)
    if not order:
        return body
    parts = [f"{name} AS (\n{needed[name]}\n)" for name in order]
    body = body.strip()
    joint = ",\n" + body[len("WITH "):] if body.startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(parts) + joint


def lease_query(name, covers, build, sql):
    """Register a report of the lease warehouse."""
    query(name, covers, whole_sql(sql))(lambda t: build(warehouse(t)))
