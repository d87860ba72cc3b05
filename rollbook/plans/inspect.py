"""Plan inspection through the public explain output."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

WATCHED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
           "SinglePartition", "SortAggregate", "Window", "BroadcastHashJoin", "SortMergeJoin")


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_flags(df: DataFrame) -> set[str]:
    """Which watched operators appear in the (initial) physical plan."""
    plan = physical_plan(df, "extended")
    return {w for w in WATCHED if w in plan}
