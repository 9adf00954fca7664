"""Runs registered queries beside their check SQL and compares the rows.

    python compare.py [--sf 0.01] [name or name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from decimal import Decimal

import duckdb

from consentry.queries import ORACLES, QUERIES, Frames
from consentry.queries.base import TABLES
from consentry.session import build_session


def _plain(value):
    if value is None:
        return None
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, bool):
        return value
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def _kind(text: str) -> str:
    """Family of a column type, for the schema comparison."""
    t = text.lower()
    for family, names in {
        "int": ("bigint", "int", "hugeint", "long", "short", "tinyint", "ubigint"),
        "float": ("double", "float"),
        "text": ("varchar", "string"),
        "time": ("timestamp",),
        "bool": ("bool",),
    }.items():
        if t.startswith(names):
            return family
    return t.split("(")[0]


# Operators that pair every row with every other.
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def check_one(spark, con, name: str, sf_dir: str) -> tuple[bool, str, float]:
    start = time.time()
    df = QUERIES[name](Frames(spark, sf_dir))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    if any(p in plan for p in PAIRWISE):
        return False, "the plan pairs all rows", 0.0
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    seconds = time.time() - start
    if name not in ORACLES:
        return True, f"rows only: {len(rows)}", seconds
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != columns:
        return False, f"columns {columns} against {sorted(names)}", seconds
    at = [names.index(c) for c in columns]
    want = [tuple(_plain(r[i]) for i in at) for r in result.fetchall()]
    got = [tuple(_plain(v) for v in r) for r in rows]
    mine = dict(df.dtypes)
    kinds = [c for c in columns if _kind(mine[c]) != _kind(types[c])]
    key = lambda r: tuple(("", "") if v is None else (type(v).__name__, v) for v in r)
    got.sort(key=lambda r: repr(key(r)))
    want.sort(key=lambda r: repr(key(r)))
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        extra, missing = sorted(a - b)[:2], sorted(b - a)[:2]
        return False, f"{len(got)} rows against {len(want)}; spark {extra}; check {missing}", seconds
    note = f" types differ: {[(c, mine[c], types[c]) for c in kinds]}" if kinds else ""
    return True, f"{len(got)} rows{note}", seconds


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    sf_dir = f"/root/testdata/sf{options.sf}"
    spark, con = build_session(), connect(sf_dir)
    picked = [n for n in QUERIES if not options.names or n.startswith(tuple(options.names))]
    failed = 0
    for name in picked:
        try:
            good, note, seconds = check_one(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            good, note, seconds = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {seconds:.1f}s {note}", flush=True)
    print(f"{len(picked) - failed} of {len(picked)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
