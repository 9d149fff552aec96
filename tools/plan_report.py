"""Shape of the final (adaptive) physical plan of registered queries.

    python tools/plan_report.py [--sf-dir DIR] [name ...]

Per query: shuffle exchanges, reused exchanges, single-partition exchanges,
sort-merge and broadcast-hash joins, file scans. Each query is executed once
so the adaptive plan is final.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict[str, int]:
    final = plan.split("== Initial Plan ==")[0]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", final)),
        "reused": final.count("ReusedExchange"),
        "single": final.count("Exchange SinglePartition"),
        "smj": final.count("SortMergeJoin"),
        "bhj": final.count("BroadcastHashJoin"),
        "scans": final.count("FileScan parquet") + final.count("Scan parquet"),
    }


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from ledgerline.registry import QUERIES
    from ledgerline.session import build_session

    spark = build_session("local[8]", 16)
    for name in args.names or list(QUERIES):
        df = QUERIES[name](spark, args.sf_dir)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()
        s = summarize(qe.executedPlan().toString())
        print(f"{name:26s} " + " ".join(f"{k}={v}" for k, v in s.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
