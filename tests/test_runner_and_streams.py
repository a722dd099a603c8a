"""Stores, the runner, resumption, and streams that give what batches give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators.components import accumulator, map_each, python_step, step
from factloom.operators.state import Fsm, ProcessManager
from factloom.plans.compiler import root_facts
from factloom.plans.runtime import DeadlineExceededError, react_until_satisfied
from factloom.plans.workflow import workflow
from factloom.queries import LIFECYCLE
from factloom.runner import Runner
from factloom.sources.store import MemoryStore, ParquetStore
from factloom.streaming.stream import advance, run_stream, sessions, stream_fold, stream_graph, stream_roots, stream_rowwise, windowed_counts


def graph():
    return workflow("g").add(step(lambda v: v["x"] + 1, "plus")).add(accumulator(0, name="sum", native="sum"), to="plus").add(step(lambda s: -s, "minus"), to="sum")


def roots(spark, values):
    return root_facts(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x long"), "i")


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_runner_store_and_resume(spark, tmp_path, kind):
    def store():
        return memory if kind == "memory" else ParquetStore(spark, str(tmp_path / "store"))

    memory, told = MemoryStore(), []
    runner = Runner(spark, store(), listeners=(lambda e, what: told.append(e),))
    runner.start_workflow("w", graph())
    runner.run("w", roots(spark, [1, 2]))
    runner.run("w", roots(spark, [5]))
    assert sorted(r["plus"] for r in runner.get_results("w", ["plus"]).collect()) == [2, 3, 6]
    assert runner.pending("w").count() == 0 and runner.list_workflows() == ["w"]
    n = runner.facts("w").count()
    with pytest.raises(ValueError):
        runner.start_workflow("w", graph())
    runner.stop("w")
    assert told[0] == "workflow_started" and told[-1] == "workflow_stopped" and told.count("checkpoint") == 3
    again = Runner(spark, store())
    assert again.store.list() == ["w"] and again.store.exists("w")
    assert again.resume("w", graph()).count() == n
    lazy, hybrid = again.resume("w", graph(), "lazy"), again.resume("w", graph(), "hybrid")
    assert lazy.filter("value is null").count() > hybrid.filter("value is null").count() > 0
    with pytest.raises(ValueError):
        again.resume("w", graph().add(step(1, "more")))
    again.store.delete("w")
    assert again.store.list() == [] and again.store.stream("w", "facts") in (None,) or again.store.stream("w", "facts").count() == 0


def test_failed_run_is_noted(spark):
    from factloom.functions.meta import context

    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", workflow().add(step(lambda v, *, c=context("c"): c, "s")))
    with pytest.raises(LookupError):
        runner.run("w", roots(spark, [1]))
    assert runner.store.stream("w", "runs").filter("event = 'failed'").count() == 1 and runner.pending("w").count() == 0


@pytest.fixture
def event_stream(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/events.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))


def test_rowwise_stream_matches_batch(spark, event_stream, tmp_path):
    batch, stream = event_stream
    wf = workflow().add(step(lambda v: F.round(v["value"] * 100).cast("long"), "cents")).add(accumulator(0, name="sum", native="sum"), to="cents")
    out = stream_rowwise(wf, stream_roots(stream, "event_id", "user_id"), "cents")
    run_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = react_until_satisfied(wf, root_facts(batch, "event_id", "user_id")).value_of("cents")
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(want).count() == 0
    with pytest.raises(ValueError):
        stream_rowwise(wf, stream_roots(stream, "event_id"), "sum")


def test_stateful_stream_matches_batch(spark, event_stream, tmp_path):
    batch, stream = event_stream
    fsm = Fsm(name="life", initial_state="new", states=LIFECYCLE, on_entry={"blocked": "alert"})
    out = stream_fold(fsm, stream_roots(stream, "event_id", "user_id", F.col("event_type")))
    run_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    done = react_until_satisfied(workflow().add(fsm), root_facts(batch, "event_id", "user_id", F.col("event_type")))
    states = {r["root_id"]: r["value"] for r in done.value_of("life").collect()}
    assert {r["root_id"]: r["state"].strip('"') for r in got.filter("tag is null").collect()} == states
    assert got.filter("tag = 'entered'").count() == done.emitted("life").count()


def test_event_time_windows(spark, event_stream, tmp_path):
    batch, stream = event_stream
    out = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 day", ["event_type"])
    run_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = windowed_counts(batch.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 day", ["event_type"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.count() <= want.count() and got.exceptAll(want).count() == 0
    by = sessions(batch.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", ["user_id"])
    assert by.agg(F.sum("n")).first()[0] == batch.count()


def test_state_goes_from_run_to_run(spark):
    """Inputs 10 and then 5 into a sum give 10 and 15, by a window and by a fold in Python."""
    wf = workflow().add(step(lambda v: v["x"], "x")).add(accumulator(0, name="sum", native="sum"), to="x").add(accumulator(0, lambda x, s: s + x, "fold"), to="x")
    wf = wf.add(accumulator(0, name="top", native="max"), to="x").add(accumulator(F.expr("cast(array() as array<bigint>)"), name="all", native="collect"), to="x")
    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", wf)
    first = root_facts(spark.createDataFrame([(1, 10)], "i long, x long"), "i")
    second = root_facts(spark.createDataFrame([(2, 5), (3, 1)], "i long, x long"), "i")
    runner.run("w", first)
    runner.run("w", second)
    got = runner.get_results("w", ["sum", "fold", "top", "all"]).orderBy("seq").collect()
    assert [(r["sum"], r["fold"], r["top"], r["all"]) for r in got] == [(10, 10, 10, [10]), (15, 15, 10, [10, 5]), (16, 16, 10, [10, 5, 1])]


def test_null_and_new_keys_carry_their_own_state(spark):
    wf = workflow().add(step(lambda v: v["x"], "x")).add(accumulator(100, lambda x, s: s + x, "fold"), to="x")
    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", wf)
    for rows in ([(1, None, 1), (2, "a", 2)], [(3, "b", 4), (4, None, 8)], [(5, "a", 16), (6, "b", 32)]):
        runner.run("w", root_facts(spark.createDataFrame(rows, "i long, k string, x long"), "i", "k"))
    got = {r["seq"]: r["fold"] for r in runner.get_results("w", ["fold"]).collect()}
    assert got == {1: 101, 2: 102, 3: 104, 4: 109, 5: 118, 6: 136}


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_resume_goes_on_with_open_runs(spark, tmp_path, kind):
    store = MemoryStore() if kind == "memory" else ParquetStore(spark, str(tmp_path / "a b"))
    first = Runner(spark, store)
    first.start_workflow("w/1", graph())
    first.run("w/1", roots(spark, [1, 2]))
    later = root_facts(spark.createDataFrame([(10, 7)], "i long, x long"), "i")
    first.dispatch("w/1", later)
    second = Runner(spark, store)
    second.resume("w/1", graph())
    assert [r["runnable_id"] for r in second.pending("w/1").collect()] == [1]
    (done,) = second.go_on("w/1")
    assert [r["value"] for r in done.value_of("sum").collect()] == [2 + 3 + 8]
    assert second.pending("w/1").count() == 0 and second.store.list() == ["w/1"]
    # a run's facts are one part: saved again, they are there once
    n = second.facts("w/1").count()
    second.unsaved["w/1"][1] = done
    second.checkpoint("w/1")
    assert second.facts("w/1").count() == n
    second.purge("w/1")
    assert second.facts("w/1") is None and second.store.exists("w/1")
    second.run("w/1", root_facts(spark.createDataFrame([(11, 0)], "i long, x long"), "i"))
    assert [r["sum"] for r in second.get_results("w/1", ["sum"]).collect()] == [14]


def test_failures_and_python_steps_once(spark, tmp_path):
    """A manual run evaluates its Python step once for each fact, however often its results are read; failures
    are in the store."""
    at = str(tmp_path)

    def slow(x):
        import os
        import uuid

        open(os.path.join(at, f"{x}-{uuid.uuid4().hex}"), "w").close()
        if x == 2:
            raise ValueError("two")
        return x

    wf = workflow().add(step(lambda v: v["x"], "x")).add(python_step(slow, "bigint", "py"), to="x").add(step(lambda x: F.array(x, x), "two"), to="py").add(map_each(lambda x: x + 1, "each"), to="two")
    wf = wf.add(accumulator(0, lambda x, s: s + x, "fold"), to="py")
    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", wf)
    done = runner.run("w", roots(spark, [1, 2, 3]))
    for _ in range(2):
        assert runner.get_results("w", ["py", "fold"]).count() == 3 and done.value_of("each").count() == 4
    assert [(r["producer"], r["status"]) for r in runner.failures("w").collect()] == [("py", "failed")]
    assert len(list(tmp_path.iterdir())) == 3


def test_a_failing_batch_is_noted_and_changes_no_state(spark):
    wf = workflow().add(step(lambda v: F.assert_true(v["x"] > 0).cast("string"), "ok")).add(step(lambda v: v["x"], "x")).add(accumulator(0, name="sum", native="sum"), to="x")
    runner = Runner(spark, checkpoint="on_stop")
    runner.start_workflow("w", wf)
    runner.run("w", roots(spark, [1]))
    with pytest.raises(Exception, match="not true"):
        runner.run("w", roots(spark, [-1]))
    runner.run("w", roots(spark, [5]))
    log = [(r["runnable_id"], r["event"]) for r in runner.store.stream("w", "runs").orderBy("runnable_id", "event").collect()]
    assert log == [(0, "completed"), (0, "dispatched"), (1, "dispatched"), (1, "failed"), (2, "completed"), (2, "dispatched")]
    assert sorted(r["sum"] for r in runner.get_results("w", ["sum"]).collect()) == [1, 6]


def test_deadlines(spark):
    def wait(x):
        import time

        time.sleep(30)
        return x

    wf = workflow().add(step(lambda v: v["x"], "x")).add(python_step(wait, "bigint", "py"), to="x")
    seen = []
    react_until_satisfied(graph(), roots(spark, [1]), deadline=60, on_checkpoint=seen.append)
    assert seen == [""]
    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", wf)
    with pytest.raises(DeadlineExceededError):
        runner.run("w", roots(spark, [1]), deadline=1.5)
    assert runner.store.stream("w", "runs").filter("event = 'failed'").count() == 1
    assert spark.range(3).count() == 3


class Held:
    """A key's state in a stream, for tests of time-outs."""

    def __init__(self, value=None, late=False):
        self.value, self.hasTimedOut, self.timeout = value, late, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: (self.value,))

    def update(self, value):
        (self.value,) = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802 - Spark's name
        self.timeout = ms


def test_stream_states_and_timeouts():
    pm = ProcessManager(name="pm", state_type="map<string,boolean>", init={"seen": False}, on={"go": (lambda s, e: {"seen": True}, lambda s, e: "work")}, timeouts={"late": 5.0, "later": 60.0})
    facts = [pd.DataFrame({"seq": [2, 1], "root_id": [2, 1], "value": ['{"v":"go"}', '{"v":"other"}']}), pd.DataFrame({"seq": [0], "root_id": [0], "value": ["{}"]})]
    held = Held()
    (out,) = advance(pm, ("k",), iter(facts), held, 5000, lambda s: [("timeout", "late")])
    assert out[["seq", "tag", "payload"]].astype(object).where(out[["seq", "tag", "payload"]].notna(), None).values.tolist() == [[0, None, None], [1, None, None], [2, None, None], [2, "command", "work"]]
    assert held.value == '{"seen": true}' and held.timeout == 5000
    (out,) = advance(pm, ("k",), iter([]), (late := Held(held.value, late=True)), 5000, lambda s: [("timeout", "late")])
    assert out[["k", "tag", "payload"]].values.tolist() == [["k", "timeout", "late"]] and not late.exists


def test_stream_graph_refuses_what_it_cannot_do(spark, event_stream):
    _, stream = event_stream
    at = stream_roots(stream, "event_id", "user_id")
    wf = workflow().add(step(lambda v: v["event_id"], "a")).add(accumulator(0, name="s", native="sum"), to="a").add(accumulator(0, name="t", native="sum"), to="s")
    with pytest.raises(ValueError):
        stream_graph(wf, at, "t")
    with pytest.raises(ValueError):
        stream_graph(wf.add(step(lambda a, b: a + b, "both"), to=["a", "s"]), at, "both")
    assert stream_graph(wf, at, "a").isStreaming
