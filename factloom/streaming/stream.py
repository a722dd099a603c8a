"""Workflows over streams of root facts.

Row-wise graphs compile as they are: a streaming DataFrame goes through the same projections. State
components keep one state for each key in the state store: stream_fold() runs the very folds of the batch
engine through applyInPandasWithState, in order within each micro-batch, and stream_graph() puts the row-wise
parts of a graph before and after it. Event-time windows with watermarks are there for counts over time.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.components import Node
from factloom.plans.compiler import Compiled, Frame, Out, Reducer, root_facts
from factloom.plans.workflow import Workflow

STATEFUL = ("accumulator", "fold", "fan_in")
OUT = "k string, seq long, root_id long, state string, tag string, payload string"
COLUMNS = ["k", "seq", "root_id", "state", "tag", "payload"]


def stream_roots(df: DataFrame, seq: str, key: str | None = None, value: Column | None = None) -> DataFrame:
    """Root facts of a streaming DataFrame."""
    return root_facts(df, seq, key, value)


def stream_rowwise(workflow: Workflow, roots: DataFrame, name: str, **options: Any) -> DataFrame:
    """(k, seq, root_id, ..., value) of a component whose ancestors keep no state."""
    found, open_ = set(), [workflow.output_of(name)]
    while open_:
        n = open_.pop()
        if n and n not in found:
            found.add(n)
            open_ += [*workflow.nodes[n].parents, *workflow.nodes[n].gates]
            if workflow.nodes[n].kind in STATEFUL or any(r.kind != "context" for r in workflow.nodes[n].refs.values()):
                raise ValueError(f"{n} keeps or reads state; use stream_fold()")
    return Compiled(workflow, roots, only=found, **options).value_of(name)


def _needed(workflow: Workflow, name: str) -> set[str]:
    """The nodes that a node depends on, itself included."""
    found, open_ = set(), [name]
    while open_:
        n = open_.pop()
        if n and n not in found:
            found.add(n)
            node = workflow.nodes[n]
            open_ += [*node.parents, *node.gates, *(workflow.output_of(r.target) for r in node.refs.values() if r.kind != "context")]
    return found


class NativeFold:
    """A mergeable accumulator as a fold of Python values."""

    def __init__(self, native: str, init: Any) -> None:
        self.native, self.init = native, init

    def initial(self) -> Any:
        return self.init

    def advance(self, state: Any, event: Any) -> tuple[Any, list[tuple[str, Any]]]:
        if event is None:
            return state, []
        if self.native == "collect":
            return [*(state or []), event], []
        made = {"sum": lambda: state + event, "count": lambda: state + 1, "min": lambda: min(state, event), "max": lambda: max(state, event), "last": lambda: event}
        return made[self.native](), []


def _fold_of(node: Node) -> tuple[Any, str]:
    """(fold, type of its state) of a state node."""
    o = node.options
    if "fold" in o:
        return o["fold"], o["state_type"]
    fold = Reducer(node.fn, o["init"]) if o["native"] is None else NativeFold(o["native"], o["init"])
    return fold, o["state_type"]


def stream_graph(workflow: Workflow, roots: DataFrame, name: str, **options: Any) -> DataFrame:
    """(k, seq, root_id, value) of a component of a graph with one state component on its way: the row-wise part above
    it, the fold with its state in the state store, and the row-wise part below, which sees the state after each fact."""
    needed = _needed(workflow, workflow.output_of(name))
    states = [n for n in workflow.order() if n.name in needed and n.kind in ("accumulator", "fold")]
    if not states:
        return stream_rowwise(workflow, roots, name, **options)
    if len(states) > 1 or any(workflow.nodes[n].kind == "fan_in" for n in needed):
        raise ValueError(f"{name}: a stream can have one state component on its way, and no reduce")
    (state,) = states
    above = set().union(*(_needed(workflow, p) for p in state.parents if p))
    before = Compiled(workflow, roots, only=above, **options)
    parent = before.outs[state.parents[0]]
    if parent.frame is not before.root:
        raise ValueError(f"{state.name}: the facts of a stream's state component are those of root facts")
    events = parent.frame.df.filter(parent.fired()).select("k", "seq", "root_id", F.col(f"`{parent.value}`").alias("value"))
    fold, kind = _fold_of(state)
    rows = stream_fold(fold, events).filter("tag is null")
    value = F.from_json(F.concat(F.lit('{"v":'), "state", F.lit("}")), f"v {kind}")["v"]
    frame = Frame(rows.select(F.col("k").cast(roots.schema["k"].dataType).alias("k"), "seq", "root_id", value.alias("v:state")))
    given = {state.name: Out(frame, "v:state", None, state, workflow.depth(state.name))}
    below = needed - above - {state.name}
    if stray := [n for n in below if not all(p in below or p == state.name for p in (*workflow.nodes[n].parents, *workflow.nodes[n].gates))]:
        raise ValueError(f"{', '.join(sorted(stray))}: needs facts of a stream from beside its state")
    return Compiled(workflow, roots, only=below, given=given, **options).value_of(name)


def advance(fold: Any, key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int = 0, on_timeout: Callable[[Any], list[tuple[str, Any]]] | None = None) -> Iterator[pd.DataFrame]:
    """One key's facts of a micro-batch, in order of seq; or its time-out."""
    k = None if key[0] is None else str(key[0])
    text = lambda p: p if isinstance(p, str) else json.dumps(p)
    if state.hasTimedOut:
        now = json.loads(state.get[0])
        state.remove()
        rows = [(k, None, None, None, t, text(p)) for t, p in (on_timeout(now) if on_timeout else [])]
        yield pd.DataFrame(rows, columns=COLUMNS)
        return
    now = json.loads(state.get[0]) if state.exists else fold.initial()
    facts = sorted((f for part in parts for f in zip(part["seq"].tolist(), part["root_id"].tolist(), part["value"].tolist(), strict=True)), key=lambda f: f[0])
    rows = []
    for seq, root, value in facts:
        now, made = fold.advance(now, json.loads(value).get("v"))
        said = json.dumps(now)
        rows.append((k, seq, root, said, None, None))
        rows += [(k, seq, root, said, t, text(p)) for t, p in made]
    state.update((json.dumps(now),))
    if timeout_ms:
        state.setTimeoutDuration(timeout_ms)
    yield pd.DataFrame(rows, columns=COLUMNS)


def stream_fold(fold: Any, events: DataFrame, timeout_ms: int = 0, on_timeout: Callable[[Any], list[tuple[str, Any]]] | None = None) -> DataFrame:
    """Advance a fold over a stream of (k, seq, root_id, value): a row for each fact, with the state
    after it as JSON, and for each fact that it emits a row with its tag and payload.

    The state of a key outlives micro-batches and restarts. Within a micro-batch the facts of a key go in
    order of seq, and are held together for that: files_per_trigger bounds them. One that arrives after later ones of an
    earlier batch is folded when it arrives. With a timeout, a key that hears nothing for so long emits what
    on_timeout(state) gives and is forgotten; a process manager's shortest timer is its timeout, and emits `timeout`.
    """
    if not timeout_ms and (timers := getattr(fold, "timeouts", None)):
        first = min(timers, key=timers.get)
        timeout_ms, on_timeout = int(timers[first] * 1000), on_timeout or (lambda _: [("timeout", first)])
    run = partial(advance, fold, timeout_ms=timeout_ms, on_timeout=on_timeout)
    facts = events.select("k", F.col("seq").cast("long"), F.col("root_id").cast("long"), F.to_json(F.struct(F.col("value").alias("v"))).alias("value"))
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return facts.groupBy("k").applyInPandasWithState(lambda key, parts, state: run(key, parts, state), OUT, "state string", "append", kind)


def windowed_counts(df: DataFrame, time: str, size: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts in event-time windows; rows later than `late` are left out once their window is closed."""
    grouped = df.withWatermark(time, late).groupBy(F.window(time, size, slide or size), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Counts in sessions that end after a gap."""
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one in
    local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="factloom-stream-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and read what it wrote."""
    spark = df.sparkSession
    at = shared_folder(spark, name)
    run_stream(df, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def run_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet and stop when what is there now is done. A restart goes on where the
    checkpoint says; no fact is written twice."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
