"""Run registered queries next to their SQL on DuckDB and report differences.

    python -m sightline.plans.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from pathlib import Path


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in records),
        key=lambda t: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in t),
    )


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def compare(spark, sf: str, name: str, queries, oracles, con) -> tuple[str, str]:
    started = time.time()
    df = queries[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if name not in oracles:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows, {spent:.1f}s"
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return "COLUMNS", f"{sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return "COUNT", f"{len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return "VALUES", f"{sorted(columns)}\n   {x}\n   {y}"
    return ("same" if a else "EMPTY"), f"{len(a)} rows, {spent:.1f}s"


def main() -> int:
    from sightline.plans.catalog import ORACLES, QUERIES
    from sightline.session import local_session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8")
    con = connect(args.sf)
    bad = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, detail = compare(spark, args.sf, name, QUERIES, ORACLES, con)
        except Exception as exc:  # noqa: BLE001 - a report, not a handler
            status, detail = "ERROR", f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += status not in ("same", "rows")
        print(f"{status:8s} {name:34s} {detail}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
