"""Run named queries against their SQL on one scale: python check.py [sf] [name ...]"""

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

from rentroll.plans import load
from rentroll.session import spark_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """Same form for equal values of both engines."""
    if isinstance(v, Decimal):
        return f"decimal {v:f}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return repr(v)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def compare(spark, con, q, sf_dir):
    """Differences between a query and its SQL, as text; empty when equal."""
    df = q(spark, sf_dir)
    rows = df.collect()
    if q.oracle is None:
        return [] if rows else ["no rows"]
    rel = con.sql(q.oracle)
    theirs = rel.fetchall()
    problems = []
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} / {sorted(rel.columns)}"]
    kinds = {c: KINDS.get(str(k), str(k)) for c, k in zip(rel.columns, rel.types)}
    for c, k in df.dtypes:
        if k != kinds[c]:
            problems.append(f"type {c}: {k} / {kinds[c]}")
    at = [rel.columns.index(c) for c in names]
    a = sorted(tuple(plain(r[c]) for c in names) for r in rows)
    b = sorted(tuple(plain(r[i]) for i in at) for r in theirs)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} / {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"{names}\n  spark {only_a[:2]}\n  sql   {only_b[:2]}")
    if not rows:
        problems.append("no rows")
    return problems


def main(argv):
    sf = argv[0] if argv else "0.01"
    chosen = [a for a in argv[1:] if a != "-v"]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = spark_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    registry = load()
    todo = [q for n, q in registry.items() if not chosen or any(n.startswith(c) for c in chosen)]
    for q in todo:
        start = time.time()
        try:
            problems = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on to the next query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        if problems or chosen or "-v" in sys.argv:
            print(f"{'FAIL' if problems else 'ok'} {q.name} {time.time() - start:.2f}s", *problems, sep="\n  ")
    print(f"{len(todo) - bad} of {len(todo)} equal at sf{sf}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
