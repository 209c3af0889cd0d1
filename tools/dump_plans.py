"""Write PLANS.md: the final (AQE) physical plan outline of headline queries.

Usage: python tools/dump_plans.py [sf_dir]
Each query is executed once; the outline keeps operator lines only
(exchanges, joins, aggregates, windows, scans with their pushed filters and
read schema), so shuffles and broadcasts can be counted at a glance.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

QUERIES_TO_SHOW = [
    "running_trainings",
    "running_splits",
    "running_activity_details",
    "running_derived_splits",
    "running_workout_results",
    "running_workout_results_summary",
    "running_workout_summary",
    "latest_training_context",
    "payload_descriptor_metrics",
    "incremental_upsert",
    "recent_context",
    "prompt_assembly",
]

NOTES = {
    "running_trainings": "Scan + project only; columns pruned at the scan; no shuffle.",
    "running_splits": "One shuffle: the per-order window (the lineitem spread, when used, *is* that "
    "exchange). Orders and the running-trainings dimension are broadcast (size-checked).",
    "running_activity_details": "Chunked numbering of sensor samples: small shuffles for chunk counts/offsets, "
    "one shuffle of samples for the per-(user, hour) window; then the pivot's partial aggregation. "
    "No task ever holds a whole user.",
    "running_derived_splits": "Adds one partial aggregation per (activity, km bucket) and a `lag` over the "
    "small bucket table.",
    "running_workout_results": "The lap window's shuffle is computed once and reused by the warmup/cooldown "
    "branch and the interval-matching branch; planned steps and workout names are broadcast after one "
    "size check.",
    "running_workout_results_summary": "Two ordered `listagg` aggregations over small groups (laps of one step, "
    "steps of one activity).",
    "running_workout_summary": "Window over each plan's steps assigns block membership (replaces the theta and "
    "range self-joins); one aggregation per block; one `listagg` per plan.",
    "latest_training_context": "Global `max_by`: each task forwards one row; single-partition final step.",
    "payload_descriptor_metrics": "Extraction runs inside each document row (no shuffle); the exchanges come "
    "from building the documents out of `events` and spreading them over tasks.",
    "incremental_upsert": "Anti-join with the batch keys (broadcast when small) + union; the mark is a scalar "
    "subquery.",
    "recent_context": "`row_number() <= N` runs as a WindowGroupLimit (partial top-N per task before the "
    "shuffle), then joins the per-session counts.",
    "prompt_assembly": "History of each turn = equi-join on (session, position) with the N preceding "
    "positions; groups never exceed N messages.",
}

KEEP = re.compile(
    r"(Exchange|QueryStage|Reused|Join|Aggregate|Window|Scan|Generate|Union|TakeOrdered|Limit|Sort |Filter|Subquery)"
)


def outline(plan: str) -> str:
    final = plan.split("+- == Initial Plan ==")[0]
    out = []
    for line in final.split("\n"):
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            out.append(line[:200])
    return "\n".join(out)


def main() -> None:
    from stridelake.query_registry import QUERIES
    from stridelake.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    parts = [
        "# PLANS\n",
        f"Final adaptive physical plans (operator outline) of headline queries at `{sf}`,",
        "produced by `tools/dump_plans.py`. Count `Exchange` lines for shuffles; `BroadcastExchange`",
        "sides passed the size check; `ReusedExchange` marks a shuffle computed once for two branches.\n",
    ]
    for name in QUERIES_TO_SHOW:
        df = QUERIES[name](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        text = outline(plan)
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning", text))
        parts.append(f"## {name}\n\n{NOTES.get(name, '')}\n\nshuffle exchanges: {shuffles}, "
                     f"broadcasts: {text.count('BroadcastExchange')}, reused: {text.count('Reused')}\n\n"
                     f"```text\n{text}\n```\n")
    with open(os.path.join(ROOT, "PLANS.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
