"""Write PLANS.md: for every registered query, the operators of its final
(adaptive) physical plan after running it on the given scale.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

COUNTED = ["Exchange hashpartitioning", "Exchange rangepartitioning", "BroadcastExchange",
           "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "HashAggregate", "SortAggregate",
           "FileScan parquet"]


def main() -> None:
    from rollbook.plans.inspect import physical_plan
    from rollbook.session import get_session
    from rollbook import registry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    lines = ["# PLANS", "",
             f"Final adaptive plans of every registered query, run on `{sf}` with local[8] and",
             "8 shuffle partitions (`python tests/plan_report.py`). Counts are operators in the",
             "final plan; a join counted as BroadcastHashJoin was planned as a shuffle join and",
             "converted by AQE after measuring its smaller side, or was under the broadcast threshold.",
             "", "| query | hash exch. | range exch. | bcast exch. | BHJ | SMJ | SHJ | HashAgg | SortAgg | scans | jobs | stages |",
             "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    tracker = spark.sparkContext.statusTracker()
    for name, fn in registry.queries().items():
        spark.sparkContext.setJobGroup(name, name)
        df = fn(spark, sf)
        df.collect()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
        ran = [len(jobs), sum(len(j.stageIds) for j in jobs if j)]
        plan = physical_plan(df, "simple")
        final = plan.split("== Initial Plan ==")[0]
        counts = [len(re.findall(re.escape(k), final)) for k in COUNTED]
        lines.append(f"| {name} | " + " | ".join(str(c) for c in counts + ran) + " |")
        print(name, counts, flush=True)
    lines += ["", "Operators are those of a query's own last plan.  Jobs and stages are all that ran for it,",
              "with the helper jobs (current maximum id, counts for dense ids, scratch tables) and",
              "stages that were skipped because their shuffle files were there.", ""]
    with open(os.path.join(os.path.dirname(HERE), "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
