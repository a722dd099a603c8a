"""Managed runs: a workflow with an id, inputs that come in batches, state that goes from one to the next, a log in a
store, and resumption."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.compiler import Compiled
from factloom.plans.cuts import written
from factloom.plans.policy import PolicyRule
from factloom.plans.runtime import dehydrated, react_until_satisfied, rehydrated, within
from factloom.plans.workflow import Workflow
from factloom.sources.store import MemoryStore, Store

LOG = ("k", "seq", "root_id", "pos", "fact_id", "parent_id", "producer", "component", "label", "depth", "value")


def pending(log: DataFrame) -> DataFrame:
    """Dispatched runnables that neither completed nor failed. log: runnable_id, event."""
    done = log.filter(F.col("event").isin("completed", "failed")).select("runnable_id").distinct()
    return log.filter("event = 'dispatched'").join(done, "runnable_id", "left_anti")


class Runner:
    """Runs workflows by id. A run evaluates its batch, writes what it made, and keeps the state of each key
    (what accumulators and state components hold, and what is read as counts and latest values); the next
    batch goes on from there, so batches in order of seq give what one batch of them all gives. A run is noted as dispatched
    before, with its inputs, and as completed only after it was evaluated. checkpoint: every_run, every_n
    (with n), on_stop or manual, says when the facts of finished runs go to the store.

    What listeners hear of: workflow_started, workflow_stopped, run_started, run_completed, run_failed, checkpoint, resume."""

    def __init__(self, spark: SparkSession, store: Store | None = None, checkpoint: str = "every_run", n: int = 1, listeners: tuple[Callable[[str, dict[str, Any]], None], ...] = (), keep_inputs: bool = True) -> None:
        if checkpoint not in ("every_run", "every_n", "on_stop", "manual"):
            raise ValueError(checkpoint)
        self.spark, self.store, self.strategy, self.n, self.listeners, self.keep_inputs = spark, store or MemoryStore(), checkpoint, n, listeners, keep_inputs
        self.workflows: dict[str, Workflow] = {}
        self.runs: dict[str, dict[int, Compiled]] = {}
        self.unsaved: dict[str, dict[int, Compiled]] = {}
        self.carried: dict[str, dict[str, DataFrame]] = {}
        self.next: dict[str, int] = {}

    def _tell(self, event: str, **what: Any) -> None:
        for listener in self.listeners:
            listener(event, what)

    def _begin(self, workflow_id: str, workflow: Workflow) -> None:
        self.workflows[workflow_id] = workflow
        self.runs[workflow_id], self.unsaved[workflow_id], self.carried[workflow_id], self.next[workflow_id] = {}, {}, {}, 0

    def start_workflow(self, workflow_id: str, workflow: Workflow) -> None:
        if workflow_id in self.workflows:
            raise ValueError(f"{workflow_id} runs already")
        self._begin(workflow_id, workflow)
        self.store.save(workflow_id, {"name": workflow.name, "hash": workflow.content_hash(), "build": workflow.spec()})
        self._tell("workflow_started", id=workflow_id)

    def dispatch(self, workflow_id: str, roots: DataFrame) -> int:
        """Note a run and its inputs, to be evaluated later; its number."""
        number = self.next[workflow_id]
        self.next[workflow_id] += 1
        if self.keep_inputs:
            self.store.append(workflow_id, "inputs", roots, str(number))
        self._note(workflow_id, number, "dispatched")
        return number

    def run(self, workflow_id: str, roots: DataFrame, policies: tuple[PolicyRule, ...] = (), context: dict[str, Any] | None = None, deadline: float | None = None) -> Compiled:
        """Evaluate a batch of root facts; one that takes more than deadline seconds fails."""
        return self._evaluate(workflow_id, self.dispatch(workflow_id, roots), roots, policies, context, deadline)

    def _evaluate(self, workflow_id: str, number: int, roots: DataFrame, policies: tuple[PolicyRule, ...] = (), context: dict[str, Any] | None = None, deadline: float | None = None) -> Compiled:
        workflow, began = self.workflows[workflow_id], time.time()
        self._tell("run_started", id=workflow_id, run=number)
        try:
            done, left = within(self.spark, deadline, lambda: self._once(workflow, roots, self.carried[workflow_id], context, policies))
            for name, rows in left.items():
                self.store.append(workflow_id, f"state {name}", rows, str(number))
            if any(o.status for o in done.outs.values()):
                self.store.append(workflow_id, "failures", done.failures(), str(number))
            self.carried[workflow_id] = left
            self.runs[workflow_id][number] = self.unsaved[workflow_id][number] = done
            if self.strategy == "every_run" or self.strategy == "every_n" and len(self.unsaved[workflow_id]) >= self.n:
                self.checkpoint(workflow_id)
        except Exception as e:
            self._note(workflow_id, number, "failed", repr(e)[:1000])
            self._tell("run_failed", id=workflow_id, run=number, error=repr(e))
            raise
        self.workflows[workflow_id] = workflow.run_hooks("after")
        self._note(workflow_id, number, "completed")
        self._tell("run_completed", id=workflow_id, run=number, seconds=time.time() - began)
        return done

    def _once(self, workflow: Workflow, roots: DataFrame, carried: dict[str, DataFrame], context: dict[str, Any] | None, policies: tuple[PolicyRule, ...]) -> tuple[Compiled, dict[str, DataFrame]]:
        done = react_until_satisfied(workflow, roots, context=context, policies=policies, carried=carried, eager=True).materialize()
        return done, {name: written(done.left_behind(name)) for name in done.workflow.kept_components()}

    def _note(self, workflow_id: str, run: int, event: str, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(run, event, error)], "runnable_id long, event string, error string")
        self.store.append(workflow_id, "runs", row, f"{run} {event}")

    def checkpoint(self, workflow_id: str) -> None:
        """Save the facts of runs that were not saved yet; a run's facts are one part, so once more changes nothing."""
        for number, done in self.unsaved[workflow_id].items():
            text = [F.col(c).cast("string").alias(c) if c in ("k", "seq", "root_id") else F.col(c) for c in LOG]
            self.store.append(workflow_id, "facts", done.facts().select(*text), str(number))
        self.unsaved[workflow_id] = {}
        self._tell("checkpoint", id=workflow_id)

    def get_results(self, workflow_id: str, names: list[str] | None = None) -> DataFrame:
        """Results of all runs since the start."""
        frames = [r.results(names) for r in self.runs[workflow_id].values()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def get_workflow(self, workflow_id: str) -> Workflow:
        return self.workflows[workflow_id]

    def facts(self, workflow_id: str) -> DataFrame | None:
        return self.store.stream(workflow_id, "facts")

    def failures(self, workflow_id: str) -> DataFrame | None:
        """Python steps that did not complete, of all runs."""
        return self.store.stream(workflow_id, "failures")

    def pending(self, workflow_id: str) -> DataFrame:
        return pending(self.store.stream(workflow_id, "runs"))

    def purge(self, workflow_id: str) -> None:
        """Drop the facts, inputs and failures that were kept; the state of each key stays, and runs go on from it."""
        for kind in ("facts", "inputs", "failures"):
            self.store.purge(workflow_id, kind)
        self.runs[workflow_id], self.unsaved[workflow_id] = {}, {}

    def list_workflows(self) -> list[str]:
        return sorted(self.workflows)

    def stop(self, workflow_id: str, save: bool = True) -> None:
        if save and self.strategy != "manual":
            self.checkpoint(workflow_id)
        for held in (self.workflows, self.runs, self.unsaved, self.carried, self.next):
            held.pop(workflow_id)
        self._tell("workflow_stopped", id=workflow_id)

    def resume(self, workflow_id: str, workflow: Workflow, mode: str = "full") -> DataFrame | None:
        """Take a stored workflow up again with the state that its last completed run left, and give its fact
        log; go_on() then evaluates the runs that were dispatched and never ended. The graph comes from the caller,
        as no code is stored; it must be the one that was saved. mode: full has all values, lazy none but the
        frontier's, hybrid the frontier's and those of state components."""
        if self.store.load(workflow_id)["hash"] != workflow.content_hash():
            raise ValueError(f"{workflow_id} was saved with another graph")
        self._begin(workflow_id, workflow)
        runs = self.store.stream(workflow_id, "runs")
        if runs is not None:
            last = runs.agg(F.max("runnable_id"), F.max(F.when(F.col("event") == "completed", F.col("runnable_id")))).first()
            self.next[workflow_id] = last[0] + 1
            if last[1] is not None:
                found = {name: self.store.stream(workflow_id, f"state {name}", str(last[1])) for name in workflow.kept_components()}
                self.carried[workflow_id] = {name: rows for name, rows in found.items() if rows is not None}
        log = self.facts(workflow_id)
        self._tell("resume", id=workflow_id, mode=mode)
        if log is None or mode == "full":
            return log
        lean = dehydrated(log)
        if mode == "lazy":
            return lean
        hot = log.filter(F.col("label").isin("state_produced", "state_initiated", "reduced")).select("fact_id", "value")
        back = rehydrated(lean, hot)
        return back.withColumn("value_stripped", F.col("value").isNull() & F.col("parent_id").isNotNull())

    def go_on(self, workflow_id: str, **options: Any) -> list[Compiled]:
        """Evaluate the pending runs from the inputs that were kept, in order, under their own numbers."""
        out = []
        for number in sorted(r["runnable_id"] for r in self.pending(workflow_id).collect()):  # a row for each open run
            if (roots := self.store.stream(workflow_id, "inputs", str(number))) is None:
                raise LookupError(f"run {number} of {workflow_id} has no inputs kept")
            out.append(self._evaluate(workflow_id, number, roots, **options))
        return out
