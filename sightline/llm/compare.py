"""``python -m sightline.llm.compare [--sf DIR] [name ...]``: queries beside their SQL."""

from __future__ import annotations

import argparse

from sightline.llm.catalog import ORACLES, QUERIES
from sightline.plans.compare import compare, connect
from sightline.session import local_session


def main() -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con, bad = local_session("8"), connect(args.sf), 0
    for name in QUERIES:
        if not args.names or any(name.startswith(n) for n in args.names):
            status, detail = compare(spark, args.sf, name, QUERIES, ORACLES, con)
            bad += status not in ("same", "rows")
            print(f"{status:8s} {name:34s} {detail}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
