"""What a plan does: operators, pushed filters, pruned partitions, and times."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def plan(df: DataFrame, mode: str = "formatted") -> str:
    spark = df.sparkSession
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def operators(df: DataFrame) -> list[str]:
    """The physical operators, top first."""
    return re.findall(r"^[ +\-:|*()\d]*([A-Z][A-Za-z]+)", df._jdf.queryExecution().executedPlan().toString(), re.MULTILINE)


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", plan(df, "simple")) + re.findall(r"PartitionFilters: \[(.*?)\]", plan(df, "simple"))


def best_of(f: Callable[[], object], n: int = 3) -> float:
    """The least seconds of ``n`` calls."""
    out = []
    for _ in range(n):
        began = time.perf_counter()
        f()
        out.append(time.perf_counter() - began)
    return min(out)


def analyze(df: DataFrame) -> dict:
    """Runs the query and returns its plan as it ended: operator, metrics (rows, bytes, milliseconds) and estimated rows, with children.

    Adaptive stages are opened, so the tree holds the operators that ran; ``json.dumps`` of it is its report.
    """
    df.collect()
    estimate = df._jdf.queryExecution().optimizedPlan().stats()
    top = _node(df._jdf.queryExecution().executedPlan())
    top["estimated_bytes"] = int(str(estimate.sizeInBytes()))
    return top


#: Wrappers that stand for the plan inside them.
INSIDE = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan", "TableCacheQueryStage": "plan"}


def _node(plan) -> dict:
    name = plan.nodeName()
    if name in INSIDE:
        return _node(getattr(plan, INSIDE[name])())
    metrics, it = {}, plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        label = pair._2().name()
        metrics[label.get() if label.isDefined() else pair._1()] = pair._2().value()
    children, it = [], plan.children().iterator()
    while it.hasNext():
        children.append(_node(it.next()))
    return {"operator": name, "metrics": metrics, "children": children}


def nodes(tree: dict):
    """The tree's operators, top first."""
    yield tree
    for child in tree["children"]:
        yield from nodes(child)


def measured_spill(spark, work: Callable[[], object]) -> tuple[object, dict[str, int]]:
    """What ``work`` returns, and the bytes that its stages spilled to disk and held in memory before, and shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = {(s["id"], s["attempt"]) for s in _stages(store)}
    result = work()
    new = [s for s in _stages(store) if (s["id"], s["attempt"]) not in seen]
    return result, {k: sum(s[k] for s in new) for k in ("disk_spilled", "memory_spilled", "shuffle_written")}


def _stages(store) -> list[dict]:
    out, it = [], store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)]).iterator()
    while it.hasNext():
        s = it.next()
        out.append({"id": s.stageId(), "attempt": s.attemptId(), "disk_spilled": s.diskBytesSpilled(), "memory_spilled": s.memoryBytesSpilled(), "shuffle_written": s.shuffleWriteBytes()})
    return out
