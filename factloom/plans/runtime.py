"""Evaluation: one round, or all rounds, of a workflow over root facts."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.compiler import Compiled, root_facts
from factloom.plans.workflow import Workflow


def react(workflow: Workflow, roots: DataFrame, rounds: int = 1, **options: Any) -> Compiled:
    """The nodes within so many causal levels of the root."""
    return Compiled(workflow.run_hooks("before"), roots, max_depth=rounds, **options)


class DeadlineExceededError(TimeoutError):
    """An evaluation took longer than it may."""


def within(spark: SparkSession, seconds: float | None, evaluate: Callable[[], Any]) -> Any:
    """What evaluate() gives; after so many seconds the Spark jobs it has started are cancelled."""
    if seconds is None:
        return evaluate()
    group, late = uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    began, timer = time.monotonic(), threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, f"within {seconds} s", True)
    timer.start()
    try:
        made = evaluate()
    except Exception as e:
        if late.is_set():
            raise DeadlineExceededError(f"took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)
    if time.monotonic() - began > seconds:
        raise DeadlineExceededError(f"took more than {seconds} s")
    return made


def react_until_satisfied(workflow: Workflow, roots: DataFrame, deadline: float | None = None, on_checkpoint: Callable[[str], None] | None = None, **options: Any) -> Compiled:
    """The whole graph. before-hooks may change it first. Lazy, but with a deadline (seconds) or on_checkpoint every frame
    is evaluated and written now."""
    done = Compiled(workflow.run_hooks("before"), roots, **options)
    if deadline is not None or on_checkpoint is not None:
        within(roots.sparkSession, deadline, lambda: done.materialize(on_checkpoint))
    return done


def plan(workflow: Workflow, roots: DataFrame, **options: Any) -> DataFrame:
    """(k, seq, root_id, condition) of the conditions that hold: the match phase alone."""
    done = Compiled(workflow, roots, **options)
    outs = [o for o in done.outs.values() if o.node is not None and o.node.kind == "condition" and o.frame is done.root]
    held = F.array_compact(F.array(*(F.when(o.fired(), F.lit(o.node.name)) for o in outs)))
    return done.root.df.select("k", "seq", "root_id", F.explode(held).alias("condition"))


def feedback(compiled: Compiled, name: str) -> DataFrame:
    """A component's values as new root facts."""
    df = compiled.value_of(name)
    return df.select("k", "seq", "root_id", "value")


def check(rule_workflow: Workflow, roots: DataFrame) -> bool:
    """Whether any fact matches."""
    return not plan(rule_workflow, roots).isEmpty()


def run_component(spark: SparkSession, component: Any, value: Any, schema: str, **options: Any) -> list[Any]:
    """What one component makes of one value: a list with its output, or an empty one if it does not fire.
    schema is the value's type."""
    wf = Workflow().add(component)
    rows = spark.createDataFrame([(0, value)], f"seq long, value {schema}")
    done = Compiled(wf, root_facts(rows, "seq", value=F.col("value")), **options)
    return [r["value"] for r in done.value_of(list(wf.components)[-1]).collect()]


def check_component(spark: SparkSession, component: Any, value: Any, schema: str, **options: Any) -> bool:
    """Whether a rule or condition fires for one value."""
    return bool(run_component(spark, component, value, schema, **options))


def invoke(workflow: Workflow, roots: DataFrame, name: str, **options: Any) -> DataFrame:
    """One component's values, with nothing compiled but what it depends on."""
    found, open_ = set(), [workflow.output_of(name)]
    while open_:
        n = open_.pop()
        if n and n not in found:
            found.add(n)
            node = workflow.nodes[n]
            open_ += [*node.parents, *node.gates, *(workflow.output_of(r.target) for r in node.refs.values() if r.kind != "context")]
    return Compiled(workflow, roots, only=found, **options).value_of(name)


def resolve(log: DataFrame, ids: DataFrame) -> DataFrame:
    """(fact_id, value) of the facts named in ids (column fact_id)."""
    return log.join(ids.select("fact_id").distinct(), "fact_id", "left_semi").select("fact_id", "value")


def events_since(log: DataFrame, root_id: Any, depth: int) -> DataFrame:
    """Facts that a root fact caused beyond a causal depth."""
    return log.filter((F.col("root_id") == F.lit(root_id)) & (F.col("depth") > depth))


def frontier(log: DataFrame) -> DataFrame:
    """Facts that are no other fact's parent: what must stay in memory to go on."""
    parents = log.filter("parent_id is not null").select(F.col("parent_id").alias("fact_id")).distinct()
    return log.join(parents, "fact_id", "left_anti")


def dehydrated(log: DataFrame) -> DataFrame:
    """The log with the values of all facts but the frontier's left out, and a flag that says so."""
    parents = log.filter("parent_id is not null").select(F.col("parent_id").alias("fact_id"), F.lit(True).alias("cold")).distinct()
    marked = log.join(parents, "fact_id", "left").withColumn("value_stripped", F.coalesce("cold", F.lit(False)))
    return marked.withColumn("value", F.when(~F.col("value_stripped"), F.col("value"))).drop("cold")


def rehydrated(log: DataFrame, values: DataFrame) -> DataFrame:
    """A dehydrated log with its values looked up again; values: fact_id, value."""
    found = values.select("fact_id", F.col("value").alias("__value"))
    out = log.join(found, "fact_id", "left")
    return out.withColumn("value", F.coalesce("value", "__value")).withColumn("value_stripped", F.lit(False)).drop("__value")


__all__ = ["Compiled", "DeadlineExceededError", "check", "check_component", "dehydrated", "events_since", "feedback", "frontier", "invoke", "plan", "react", "react_until_satisfied", "rehydrated", "resolve", "root_facts", "run_component", "within"]
