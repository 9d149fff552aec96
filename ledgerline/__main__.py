"""Run registered queries from the command line.

    python -m ledgerline --list
    python -m ledgerline q09_pareto --sf-dir /root/testdata/sf0.1 --show 20
    python -m ledgerline rec_top_k --out /shared/out/rec_top_k   # write Parquet

Without ``--out`` the first ``--show`` rows are printed (``show`` reads only
those rows); with it the whole result is written as Parquet.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerline")
    ap.add_argument("queries", nargs="*", help="registered query names")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01", help="folder with the source tables")
    ap.add_argument("--list", action="store_true", help="list registered queries")
    ap.add_argument("--show", type=int, default=20, help="rows to print")
    ap.add_argument("--out", help="write results as Parquet under this folder")
    ap.add_argument("--master", default=None, help="Spark master for a local run, e.g. local[8]")
    args = ap.parse_args(argv)

    from ledgerline.registry import QUERIES

    if args.list or not args.queries:
        for name, q in QUERIES.items():
            print(f"{name:26s} {(q.__doc__ or '').strip().splitlines()[0] if q.__doc__ else ''}")
        return 0
    unknown = [q for q in args.queries if q not in QUERIES]
    if unknown:
        print(f"unknown queries: {', '.join(unknown)}", file=sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    from ledgerline.session import build_session

    spark = build_session(args.master) if args.master else SparkSession.builder.getOrCreate()
    for name in args.queries:
        df = QUERIES[name](spark, args.sf_dir)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
            print(f"{name}: written to {args.out.rstrip('/')}/{name}")
        else:
            print(f"== {name}")
            df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
