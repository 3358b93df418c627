"""Physical-plan summary of every registered plan (markdown table).

usage: python tools/plan_report.py [sf_dir] [name ...]
Columns: shuffle exchanges, single-partition exchanges (and the largest
operator below each), broadcast exchanges, nested-loop/cartesian joins,
Python stages, and whether any scan received pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    lines = plan.splitlines()
    single = [i for i, l in enumerate(lines) if "Exchange SinglePartition" in l]
    below = []
    for i in single:
        # the first aggregate/window/scan under the exchange tells what it gathers
        for l in lines[i + 1:i + 8]:
            m = re.search(r"(HashAggregate|ObjectHashAggregate|SortAggregate|Window|FileScan|LocalTableScan|TakeOrderedAndProject)\S*(\([^)]*\)|\s\[[^\]]{0,60})?", l)
            if m:
                txt = m.group(0)
                below.append("carries" if "_pfx_bucket" in l or "_cb" in l else txt.split("(")[0].split(" ")[0])
                break
    return {
        "shuffles": sum(1 for l in lines if re.search(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)", l)),
        "single": len(single), "single_below": ",".join(sorted(set(below))) or "-",
        "broadcast": sum(1 for l in lines if "BroadcastExchange" in l),
        "nested_loop": sum(1 for l in lines if "BroadcastNestedLoopJoin" in l or "CartesianProduct" in l),
        "python": sum(1 for l in lines if re.search(r"(ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroupsInPandas)", l)),
        "pushed": any(re.search(r"PushedFilters: \[(?!\])", l) for l in lines),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tabsmith.session import build_session
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    from tabsmith.plans.registry import QUERIES
    names = sys.argv[2:] or list(QUERIES)
    print("| plan | shuffles | single-partition (over) | broadcasts | nested-loop | python | pushed filters |")
    print("|---|---|---|---|---|---|---|")
    for n in names:
        df = QUERIES[n](spark, sf)
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{n}` | {s['shuffles']} | {s['single']} ({s['single_below']}) | {s['broadcast']} | "
              f"{s['nested_loop']} | {s['python']} | {'yes' if s['pushed'] else 'no'} |", flush=True)


if __name__ == "__main__":
    main()
