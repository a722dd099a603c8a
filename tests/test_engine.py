"""Components and graphs on small facts; randomised parity with a plain interpreter."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import meta
from factloom.functions.patterns import Bind
from factloom.operators.components import Map, Step, accumulator, all_of, any_of, as_component, condition, go_on, halt, map_each, python_step, reduce, rule, step
from factloom.operators.state import Aggregate, Fsm, ProcessManager, Saga, StateMachine
from factloom.plans import viz
from factloom.plans.compiler import Compiled, root_facts
from factloom.plans.policy import Policy, PolicyRule, Retry, fast_fail, io_policy, llm_policy
from factloom.plans.runtime import events_since, feedback, plan, react, react_until_satisfied
from factloom.plans.types import CycleError, IncompatiblePortError, UnresolvedReferenceError, compatible, ports, ports_compatible
from factloom.plans.workflow import Workflow, from_log, transmute, workflow


def facts(spark, values, kind="bigint", keys=None):
    rows = [(i, (keys or [0] * len(values))[i], v) for i, v in enumerate(values)]
    return root_facts(spark.createDataFrame(rows, f"seq long, k long, value {kind}"), "seq", "k", F.col("value"))


def values(df):
    return sorted((r["value"] for r in df.collect()), key=str)


def produced(done):
    return sorted(done.productions().select(F.get_json_object("value", "$.v").alias("v")).toPandas().v.tolist())


# F01 - F12


def test_chain_and_branches(spark):
    wf = workflow(steps=[(step(lambda x: x + 1, "a"), [step(lambda x: x + 2, "b"), step(lambda x: x + 4, "c")])])
    assert produced(react_until_satisfied(wf, facts(spark, [2]))) == ["3", "5", "7"]
    assert produced(react(wf, facts(spark, [2]))) == ["3"]
    assert produced(react(wf, facts(spark, [2]), rounds=2)) == ["3", "5", "7"]


def test_rules(spark):
    wf = workflow(rules=[rule(lambda x: x * 2, lambda x: x > 0, "double"), rule(lambda x: x * 3, lambda x: x < 0, "triple"), rule(lambda x: (x / 2).cast("long"), lambda x: x % 2 == 0, "half")])
    done = react_until_satisfied(wf, facts(spark, [2, -3, 4, None]))
    got = {(r["root_id"], r["component"]) for r in done.productions().collect()}
    assert got == {(0, "double"), (0, "half"), (1, "triple"), (2, "double"), (2, "half")}


def test_given_where_then(spark):
    kind = "struct<customer:struct<tier:string,id:string>,items:array<int>,total:bigint>"
    given = {"customer": {"tier": "premium", "id": Bind("id")}, "items": Bind("items"), "total": Bind("total")}
    made = rule(lambda id, items, total: F.struct(id.alias("id"), total.alias("total"), F.size(items).alias("n")), name="r", given=given, where=lambda id, items, total: (total > 50) & (F.size(items) > 0))
    rows = [(("premium", "C123"), [1, 2, 3], 100), (("basic", "C1"), [1], 100), (("premium", None), [1], 100), (("premium", "C2"), [], 100), None]
    got = react_until_satisfied(workflow().add(made), facts(spark, rows, kind)).value_of("r").select("value.*").collect()
    assert [tuple(r) for r in got] == [("C123", 100, 3)]


def test_tuple_pattern_and_two_argument_rule(spark):
    wf = workflow().add(rule(lambda b: b, name="r", given=(3, Bind("b")))).add(rule(lambda a, b: a + b, lambda a, b: a < b, "sum"))
    got = react_until_satisfied(wf, facts(spark, [[3, 4], [3], [4, 3]], "array<bigint>")).results()
    assert [(r["r"], r["sum"]) for r in got.orderBy("seq").collect()] == [(4, 7), (None, None), (None, None)]


def test_boolean_conditions_fire_once(spark):
    wf = workflow().add(condition(lambda x: x > 1, "big")).add(condition(lambda x: x % 2 == 0, "even"))
    wf = wf.add(rule(lambda x: x, any_of("big", "even"), "or")).add(rule(lambda x: x, all_of("big", any_of("even", lambda x: x == 3)), "mix")).add(rule(lambda x: x, all_of("big", lambda x: x < 4), "and"))
    done = react_until_satisfied(wf, facts(spark, [0, 1, 2, 3, 4, 5]))
    assert [values(done.value_of(n)) for n in ("or", "mix", "and")] == [[0, 2, 3, 4, 5], [2, 3, 4], [2, 3]]
    held = plan(wf, facts(spark, [0, 4])).filter("condition in ('big', 'even')").collect()
    assert {(r["root_id"], r["condition"]) for r in held} == {(0, "even"), (1, "big"), (1, "even")}


def test_errors_of_one_row_are_false_not_fatal(spark):
    wf = workflow().add(rule(lambda x: x, lambda x: F.try_divide(F.lit(10), x) > 2, "r"))
    assert values(react_until_satisfied(wf, facts(spark, [0, 2, 10, None])).value_of("r")) == [2]


def test_constants_dicts_and_functions_as_components(spark):
    wf = Workflow().add(7, name="seven").add({"type": "custom_processor", "function": lambda x: x * 2, "metadata": {"name": "custom"}})
    got = react_until_satisfied(wf, facts(spark, [4])).results(["seven", "custom"]).first()
    assert (got["seven"], got["custom"]) == (7, 8)
    assert as_component(lambda x: x).name == as_component(lambda x: x).name


# joins


def test_join_and_lineage(spark):
    wf = workflow().add(step(lambda x: x * 2, "a")).add(step(lambda x: x * 3, "b")).add(step(lambda a, b: a * b, "p"), to=["a", "b"])
    done = react_until_satisfied(wf, facts(spark, [2, 1]))
    assert values(done.value_of("p")) == [24, 6] and '{"_1":4,"_2":6}' in produced(done)
    log = done.facts()
    assert log.select("fact_id").distinct().count() == log.count() == 10
    assert {r["producer"] for r in events_since(log, 0, 1).collect()} == {"p.join", "p"}


def test_join_of_reduce_and_step(spark):
    wf = workflow().add(step(lambda v: F.concat(F.lit("overall: "), F.size(v).cast("string")), "overall")).add(map_each(lambda x: x * 10, "m")).add(reduce(F.lit(""), lambda acc, x: F.concat(acc, F.lit("|"), x.cast("string")), "r"), to="m")
    wf = wf.add(step(lambda a, b: F.concat(a, b), "both"), to=["overall", "r"])
    assert values(react_until_satisfied(wf, facts(spark, [[1, 2, 3], []], "array<bigint>")).value_of("both")) == ["overall: 3|10|20|30"]


# map and reduce


def test_map_reduce_edges(spark):
    rows = [[1, 1, 2], [], None, [3]]
    wf = workflow().add(map_each(lambda x: x * 2, "m")).add(reduce(0, name="sum", native=F.sum), to="m")
    wf = wf.add(reduce(F.expr("cast(array() as array<bigint>)"), lambda acc, x: F.concat(acc, F.array(x)), "list"), to="m")
    done = react_until_satisfied(wf, facts(spark, rows, "array<bigint>"))
    assert [(r["sum"], r["list"]) for r in done.results(["sum", "list"]).orderBy("seq").collect()] == [(8, [2, 2, 4]), (None, None), (None, None), (6, [6])]


def test_reduce_waits_for_every_element(spark):
    wf = workflow().add(map_each(Step(name="s", fn=lambda x: x), "m")).add(rule(lambda x: x, lambda x: x > 0, "positive"), to="s").add(reduce(0, name="sum", native=F.sum), to="positive")
    done = react_until_satisfied(wf, facts(spark, [[1, 2], [1, -2]], "array<bigint>"))
    assert values(done.value_of("sum")) == [3]


def test_simple_reduce_halts_and_gives_init_for_empty(spark):
    fold = reduce(F.lit(0).cast("long"), lambda acc, x: F.when(x >= 3, halt(acc)).otherwise(go_on(acc + x)), "r", stops=True)
    assert values(react_until_satisfied(workflow().add(fold), facts(spark, [[1, 2, 3, 4, 1], [], [5]], "array<bigint>")).value_of("r")) == [0, 0, 3]


def test_nested_map_and_map_type(spark):
    wf = workflow().add(Map(name="o", each=map_each(lambda x: x + 1, "i")))
    assert values(react_until_satisfied(wf, facts(spark, [[[1, 2], [3]], [[]]], "array<array<bigint>>")).value_of("o")) == [2, 3, 4]
    wf = workflow().add(map_each(lambda e: e["value"], "m"))
    assert values(react_until_satisfied(wf, facts(spark, [{"a": 1, "b": 2}], "map<string,bigint>")).value_of("m")) == [1, 2]
    wf = workflow().add(map_each(lambda e: e, "m"))
    assert values(react_until_satisfied(wf, facts(spark, [1])).value_of("m")) == []


# state


def test_accumulators(spark):
    roots = facts(spark, [5, 1, None, 7, 2], keys=[0, 0, 0, 1, 1])
    wf = workflow().add(accumulator(0, name="sum", native="sum")).add(accumulator(100, lambda x, s: s - (x or 0), "down")).add(accumulator(3, name="max", native="max")).add(accumulator(0, name="n", native="count"))
    got = [tuple(r) for r in react_until_satisfied(wf, roots).results(["sum", "down", "max", "n"]).orderBy("seq").select("sum", "down", "max", "n").collect()]
    assert got == [(5, 95, 5, 1), (6, 94, 5, 2), (6, 94, 5, 2), (7, 93, 7, 1), (9, 91, 7, 2)]


def test_state_is_seen_before_beside_and_after_below(spark):
    wf = workflow().add(accumulator(0, name="sum", native="sum")).add(step(lambda x, *, s=meta.state_of("sum"): s, "beside")).add(step(lambda x, *, s=meta.state_of("sum"): s, "below"), to="sum")
    got = react_until_satisfied(wf, facts(spark, [1, 2, 3])).results(["beside", "below"]).orderBy("seq").collect()
    assert [(r["beside"], r["below"]) for r in got] == [(0, 1), (1, 3), (3, 6)]


def test_state_in_another_grain(spark):
    wf = workflow().add(map_each(lambda x: x, "m")).add(accumulator(0, name="sum", native="sum"), to="m")
    wf = wf.add(step(lambda v: v, "a")).add(step(lambda v: v, "b"), to="a").add(step(lambda v: v, "c"), to="b").add(step(lambda v, *, s=meta.state_of("sum"), n=meta.fact_count("sum"): F.struct(s.alias("s"), n.alias("n")), "seen"), to="c")
    got = react_until_satisfied(wf, facts(spark, [[1, 2], [], [3]], "array<bigint>")).value_of("seen").orderBy("seq").select("value.*").collect()
    assert [tuple(r) for r in got] == [(3, 2), (3, 2), (6, 3)]


def test_meta_of_path_and_nonstate(spark):
    wf = workflow().add(step(lambda x: F.struct(x.alias("deep")), "s")).add(step(lambda x, *, v=meta.latest_value_of("s").deep, z=meta.state_of("s"): F.coalesce(z, v), "r"), to="s")
    assert values(react_until_satisfied(wf, facts(spark, [4])).value_of("r")) == [4]


def test_fsm_validates_and_steps(spark):
    with pytest.raises(ValueError):
        Fsm(initial_state="a", states={"a": {"x": "nowhere"}})
    light = Fsm(name="light", initial_state="red", states={"red": {"timer": "green"}, "green": {"timer": ("red", lambda e: True), "never": ("red", lambda e: False)}}, on_entry={"green": "go"})
    done = react_until_satisfied(workflow().add(light), facts(spark, ["timer", "never", "noise", "timer", None], "string"))
    assert [r["value"] for r in done.value_of("light").orderBy("seq").collect()] == ["green", "green", "green", "red", "red"]
    assert [(r["root_id"], r["payload"]) for r in done.emitted("light").collect()] == [(0, "go")]


def test_state_machine_with_reducer_and_reactors(spark):
    lock = StateMachine(name="lock", init={"code": "secret", "state": "locked"}, state_type="struct<code:string,state:string>", reducer=lambda e, s: {**s, "state": "unlocked"} if e == s["code"] else s, reactions={"opened": (lambda s: s["state"] == "unlocked", lambda s: F.lit("open"))})
    done = react_until_satisfied(workflow().add(lock), facts(spark, ["no", "secret", "no"], "string"))
    assert values(done.value_of(("lock", "opened"))) == ["open", "open"]


def test_aggregate_rejects_and_folds(spark):
    counter = Aggregate(name="c", init=0, state_type="bigint", commands={"dec": (lambda s, c: s > 0, lambda s, c: {"tag": "decremented", "by": 1}), "inc": (None, lambda s, c: {"tag": "incremented", "by": 1})}, events={"decremented": lambda s, e: s - e["by"], "incremented": lambda s, e: s + e["by"], "reset": lambda s, e: 0})
    done = react_until_satisfied(workflow().add(counter), facts(spark, ["dec", "inc", "inc", "dec", "reset", "?"], "string"))
    assert [r["value"] for r in done.value_of("c").orderBy("seq").collect()] == [0, 1, 2, 1, 0, 0]
    assert [(r["root_id"], r["tag"]) for r in done.emitted("c").orderBy("root_id").collect()] == [(0, "rejected"), (1, "incremented"), (2, "incremented"), (3, "decremented")]


def test_process_manager(spark):
    pm = ProcessManager(name="pm", init={"n": 0}, state_type="map<string,bigint>", on={"start": (lambda s, e: {"n": s["n"] + 1}, lambda s, e: "do_work"), "finish": (lambda s, e: {"done": 1}, None)}, complete=lambda s: s.get("done") == 1)
    done = react_until_satisfied(workflow().add(pm), facts(spark, ["start", "other", "finish"], "string"))
    assert [r["value"] for r in done.value_of("pm").orderBy("seq").collect()] == [{"n": 1}, {"n": 1}, {"n": 1, "done": 1}]
    assert [(r["tag"], r["payload"]) for r in done.emitted("pm").orderBy("seq").collect()] == [("command", "do_work"), ("process_completed", "pm")]


def test_saga(spark):
    saga = Saga(name="s", transactions={"a": lambda r: F.when(r["input"] > 0, r["input"]), "b": lambda r: F.when(r["a"] > 5, r["a"] * 2), "c": lambda r: F.when(r["b"] > 20, F.lit(1))}, compensations={n: lambda r, n=n: F.lit(f"undo {n}") for n in "abc"})
    got = react_until_satisfied(workflow().add(saga), facts(spark, [-1, 3, 8, 50])).value_of("s").orderBy("seq").select("value.*").collect()
    assert [(r["status"], r["failed"], [c["name"] for c in r["compensated"]]) for r in got] == [("aborted", "a", []), ("compensating", "b", ["a"]), ("compensating", "c", ["b", "a"]), ("completed", None, [])]


# composition


def test_merge_remove_sub_workflow_and_log(spark):
    inner = workflow("in").add(step(lambda x: x * 10, "ten"))
    wf = workflow("out").add(step(lambda x: x + 1, "one")).add(inner, to="one").merge(workflow().add(step(lambda x: -x, "neg")))
    assert values(react_until_satisfied(wf, facts(spark, [2])).value_of("ten")) == [30]
    less = wf.remove("one")
    assert "one" not in less.components and values(react_until_satisfied(less, facts(spark, [2])).value_of("ten")) == [20]
    assert from_log(less.log).content_hash() == less.content_hash() and len(less.spec()) == 4
    assert list(transmute(lambda x: x).components) and transmute(wf) is wf
    assert wf.connected_components() == [("one", "ten")] and wf.next_steps("one") == ["ten"]
    with pytest.raises(UnresolvedReferenceError):
        wf.add(step(1, "x"), to="missing")
    with pytest.raises(UnresolvedReferenceError):
        wf.remove("missing")


def test_same_name_is_numbered_and_hash_ignores_names():
    wf = workflow().add(step(1, "x")).add(step(2, "x"))
    assert list(wf.components) == ["x", "x_2"]
    f = lambda x: x + 1
    assert step(f, "a").content_hash() == step(f, "b").content_hash() != step(lambda x: x + 2, "a").content_hash()


def test_circles_are_refused():
    wf = workflow().add(step(lambda x: x, "a"))
    with pytest.raises(UnresolvedReferenceError):
        wf.add(step(lambda x, *, s=meta.latest_value_of("b"): x, "c"))
    with pytest.raises(CycleError):
        wf.add(step(lambda x, *, s=meta.latest_value_of("me"): x, "me"))


def test_ports():
    assert compatible("integer", "any") and not compatible("integer", "float")
    assert compatible(("list", "integer"), ("list", "any")) and compatible("string", ("one_of", ("integer", "string")))
    assert ports_compatible(ports({"a": "integer", "b": "string"}), ports({"x": "string"}))
    assert not ports_compatible(ports({"a": "integer"}), ports({"a": "string", "b": {"type": "integer", "required": False}}))
    with pytest.raises(TypeError):
        ports({"a": {"type": "integer", "colour": 1}})
    wf = workflow().add(step(lambda x: x, "s", outputs={"o": "integer"}))
    bad = step(lambda x: x, "t", inputs={"i": "string"})
    with pytest.raises(IncompatiblePortError):
        wf.add(bad, to="s")
    with pytest.warns(UserWarning):
        wf.add(bad, to="s", validate="warn")
    assert wf.add(bad, to="s", validate="off") and wf.connectables(bad) == [] and not wf.connectable(bad, "s")


def test_context(spark):
    wf = workflow().add(rule(lambda x: x, lambda x, *, t=meta.context("t"): x > t, "r")).add(step(lambda x, *, d=meta.context("d", default=lambda: 5): x + d, "s"))
    assert wf.required_context() == ["t"] and wf.validate_context({"t": 1}) == [] and wf.validate_context() == ["t"]
    with pytest.raises(UnresolvedReferenceError):
        react_until_satisfied(wf, facts(spark, [1]))
    done = react_until_satisfied(wf.put_context({"t": 1}, "r"), facts(spark, [1, 2]), context={"t": 100})
    assert values(done.value_of("r")) == [2] and values(done.value_of("s")) == [6, 7]


def test_dependencies_and_diagrams(spark):
    wf = workflow("w").add(accumulator(0, name="sum", native="sum")).add(rule(lambda x: x, lambda x, *, s=meta.state_of("sum"): s > 1, "r"))
    assert wf.dependencies("r") == ["sum"] and wf.dependents("sum") == ["r"]
    assert "sum -> r.condition [state_of]" in viz.to_edgelist(wf)
    assert viz.to_mermaid(wf).startswith("flowchart TD") and "n_r_condition" in viz.to_dot(wf)
    assert {e["data"].get("kind") for e in viz.to_cytoscape(wf)} >= {"root", "component", "accumulator", "condition", "step"}
    log = react_until_satisfied(wf, facts(spark, [1, 2, 3])).facts()
    assert "sequenceDiagram" in viz.to_mermaid_sequence(log, 2)


def test_feedback_and_hooks(spark):
    wf = workflow().add(step(lambda x: x + 1, "a"))
    done = react_until_satisfied(wf, facts(spark, [1]))
    assert values(react_until_satisfied(wf, feedback(done, "a")).value_of("a")) == [3]
    seen = []
    hooked = wf.attach_before("a", lambda w, n: seen.append(1)).attach_before("a", lambda w, n: w.add(step(lambda x: x * 2, "late"), to="a")).attach_before("a", lambda w, n: seen.append(3))
    assert values(react_until_satisfied(hooked, facts(spark, [1])).value_of("late")) == [4] and seen == [1, 3]


def test_single_components_and_events(spark):
    from factloom.plans.runtime import check_component, run_component
    from factloom.sources.inputs import table_facts, value_facts

    r = rule(lambda x: x * 2, lambda x: x > 0, "r")
    assert run_component(spark, r, 4, "bigint") == [8] and run_component(spark, r, -4, "bigint") == []
    assert check_component(spark, condition(lambda x: x > 1), 2, "bigint") and not check_component(spark, condition(lambda x: x > 1), None, "bigint")
    wf, made = Workflow().add_with_events(r)
    assert [e.component.name for e in made] == ["r"] and len(wf.log) == 1
    assert values(react_until_satisfied(wf, value_facts(spark, [1, -1, 3], "bigint")).value_of("r")) == [2, 6]
    spark.range(3).createOrReplaceTempView("three")
    assert table_facts(spark, "three", "id").count() == 3


def test_sources_of_files(spark, tmp_path):
    from factloom.sources.inputs import read_facts

    spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string").write.json(str(tmp_path / "j"))
    wf = Workflow().add(step(lambda v: F.upper(v["s"]), "up"))
    got = react_until_satisfied(wf, read_facts(spark, str(tmp_path / "j"), "i", format="json", schema="i long, s string")).value_of("up")
    assert values(got) == ["A", "B"]
    assert read_facts(spark, str(tmp_path / "j"), format="json").select("root_id").distinct().count() == 2


# policies


def test_policy_runs():
    calls, waits = [], []

    def fails(x):
        calls.append(x)
        raise ValueError("no")

    p = Policy(retries=2, backoff="exponential", base_delay=1, max_delay=1.5, fallback=lambda v, e: "other")
    assert p.run(fails, 1, sleep=waits.append) == ("other", "completed", None, 3) and len(calls) == 3 and waits == [1, 1.5]
    assert Policy(on_failure="skip").run(fails, 1)[1] == "skipped" and Policy().run(fails, 1)[1] == "failed"
    assert Policy(fallback=lambda v, e: Retry(plus=2)).run(lambda x, plus=0: x // plus, 4)[:2] == (2, "completed")
    import time

    assert Policy(timeout=0.05).run(lambda x: time.sleep(0.5), 1)[1] == "failed"
    assert (llm_policy().retries, io_policy().on_failure, fast_fail().timeout) == (3, "skip", 5.0)
    assert Policy(backoff="linear").delay(3) == 1.5 and 0 <= Policy(backoff="jitter").delay(2) <= 1


def test_policy_matchers_and_failure_of_one_fact(spark):
    import re

    def odd(x):
        if x % 2:
            raise ValueError("odd")
        return x

    wf = workflow().add(python_step(odd, "bigint", "odd")).add(step(lambda x: x + 1, "next"), to="odd").add(step(lambda x: x, "free"))
    for matcher in ("odd", re.compile("^o"), Step, lambda c: c.name == "odd"):
        assert wf.add_policy(PolicyRule(matcher, Policy(retries=1))).policy_of("odd").retries == 1
    assert wf.set_policies([PolicyRule("default", Policy())]).append_policy(PolicyRule("odd", Policy(retries=9))).policy_of("odd").retries == 0
    done = react_until_satisfied(wf, facts(spark, [1, 2, 3]))
    assert values(done.value_of("next")) == [3] and values(done.value_of("free")) == [1, 2, 3]
    assert {(r["root_id"], r["status"]) for r in done.failures().collect()} == {(0, "failed"), (2, "failed")}


# randomised parity with an interpreter


def interpret(nodes, x):
    """name -> value for the nodes that fire; nodes: (name, kind, parents, number)."""
    out = {"": x}
    for name, kind, parents, n in nodes:
        if all(p in out for p in parents):
            v = [out[p] for p in parents]
            if kind == "join":
                out[name] = v[0] * 2 + v[1] + n
            elif kind == "rule":
                if v[0] % 3 != n % 3:
                    out[name] = v[0] - n
            else:
                out[name] = v[0] + n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs_match_the_interpreter(spark, seed):
    rnd = random.Random(seed)
    nodes, wf = [], Workflow()
    for i in range(12):
        name, n = f"n{i}", rnd.randrange(10)
        names = [x[0] for x in nodes]
        kind = rnd.choice(["step", "rule", "join"]) if len(names) > 1 else "step"
        if kind == "join":
            parents = rnd.sample(names, 2)
            wf = wf.add(step(lambda a, b, n=n: a * 2 + b + n, name), to=parents)
        else:
            parents = [rnd.choice(["", *names])]
            c = step(lambda x, n=n: x + n, name) if kind == "step" else rule(lambda x, n=n: x - n, lambda x, n=n: F.pmod(x, F.lit(3)) != n % 3, name)
            wf = wf.add(c, to=parents[0] or None)
        nodes.append((name, kind, parents, n))
    inputs = [rnd.randrange(50) for _ in range(8)]
    got = react_until_satisfied(wf, facts(spark, inputs)).results([n[0] for n in nodes]).orderBy("seq").collect()
    for r, x in zip(got, inputs, strict=True):
        want = interpret(nodes, x)
        assert {n[0]: r[n[0]] for n in nodes if r[n[0]] is not None} == {k: v for k, v in want.items() if k}


def test_native_reduces_take_the_initial_value_in(spark):
    roots = root_facts(spark.createDataFrame([(0, [1, 2])], "i long, x array<long>"), "i", value=F.col("x"))
    for native, want in ((F.max, 5), (F.min, 1), (F.sum, 8), (F.count, 7)):
        for gate in (False, True):  # within the row, and by aggregation
            wf = workflow().add(map_each(lambda x: x, "each"))
            wf = wf.add(condition(lambda x: x > 0, "any"), to="each") if gate else wf
            wf = wf.add(reduce(5, name="r", native=native), to="any" if gate else "each")
            assert [r["value"] for r in Compiled(wf, roots).value_of("r").collect()] == [want], (native, gate)
    with pytest.raises(ValueError):
        reduce(1, native=F.stddev)


def test_null_keys_meet_across_frames(spark):
    df = spark.createDataFrame([(1, None, [1, 2, 3]), (2, "a", [4])], "i long, k string, x array<long>")
    wf = workflow().add(step(lambda v: v["x"], "x")).add(map_each(lambda x: x, "each"), to="x").add(condition(lambda x: x > 0, "any"), to="each").add(reduce(0, name="sum", native=F.sum), to="any")
    wf = wf.add(step(lambda v: F.size(v["x"]).cast("long"), "n")).add(step(lambda s, n: s * 10 + n, "both"), to=["sum", "n"])
    done = Compiled(wf, root_facts(df, "i", "k"))
    assert sorted(r["value"] for r in done.value_of("both").collect()) == [41, 63]
    assert {r["root_id"]: (r["sum"], r["both"]) for r in done.results(["sum", "both"]).collect()} == {1: (6, 63), 2: (4, 41)}


def test_equal_rows_are_facts_of_their_own(spark, tmp_path):
    from factloom.sources.inputs import read_facts

    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a long, `b.c` string")
    for kind in ("parquet", "json"):
        rows.write.format(kind).save(str(tmp_path / kind))
        roots = read_facts(spark, str(tmp_path / kind), format=kind)
        wf = workflow().add(step(lambda v: F.array(v["a"], v["a"]), "two")).add(map_each(lambda x: x, "each"), to="two").add(condition(lambda x: x > 0, "any"), to="each").add(reduce(0, name="sum", native=F.sum), to="any")
        done = Compiled(wf, roots)
        assert sorted(r["value"] for r in done.value_of("sum").collect()) == [2, 2, 4], kind
        assert done.reactions().filter("label = 'input'").count() == 3


def test_typed_productions(spark):
    roots = root_facts(spark.createDataFrame([(0, 5)], "i long, x long"), "i")
    wf = workflow().add(step(lambda v: v["x"] + 1, "a")).add(step(lambda v: F.lit("t"), "b"))
    done = Compiled(wf, roots)
    assert [r["value"] for r in done.productions(["a"], typed=True).collect()] == [6]
    with pytest.raises(TypeError):
        done.productions(typed=True)


def test_plans_of_folds_and_maps(spark, small):
    """One Python pass over few columns, and one evaluation of what a map fans out."""
    from factloom import queries

    plan = queries.aggregate_balance(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 - ("Initial Plan" not in plan) and "props" not in plan and "ts#" not in plan
    plan = queries.word_count_map(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_hooks_round_python_steps(spark, tmp_path):
    at = str(tmp_path)

    def note(event, context):
        import os

        open(os.path.join(at, f"{event['component']}-{event['value']}-{event.get('result', 'before')}-{context['c']}"), "w").close()

    def refuse(event, context):
        if event["value"] == 3:
            raise ValueError("refused")

    roots = root_facts(spark.createDataFrame([(i, i) for i in (2, 3)], "i long, x long"), "i")
    wf = workflow().add(step(lambda v: v["x"], "x")).add(python_step(lambda x: x * 10, "bigint", "ten"), to="x").put_context({"c": 7})
    wf = wf.attach_around("ten", note, note).attach_around("ten", before=refuse)
    done = Compiled(wf, roots)
    assert {r["root_id"]: r["status"] for r in done.outcomes("ten").collect()} == {2: "completed", 3: "failed"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ten-2-20-7", "ten-2-before-7", "ten-3-before-7"]
    with pytest.raises(LookupError):
        wf.attach_around("x", note)


def test_hashes_follow_the_source(spark):
    one, two = step(lambda x: x + 1, "a"), step(lambda x: x + 1, "b")
    assert one.content_hash() == two.content_hash() != step(lambda x: x + 2).content_hash()
    held = [step(lambda x, n=n: x + n) for n in (1, 1, 2)]
    assert held[0].content_hash() == held[1].content_hash() != held[2].content_hash()


def test_registered_types_become_components(spark):
    from factloom.operators.components import register_component

    class Times:
        def __init__(self, by):
            self.by = by

    class Twice(Times):
        def __init__(self):
            super().__init__(2)

    register_component(Times, lambda x, name: step(lambda v, by=x.by: v * by, name or "times"))
    assert values(Compiled(Workflow().add(Twice()), facts(spark, [3, 4])).value_of("times")) == [6, 8]


def test_a_shared_condition_outlives_its_rule(spark):
    big = rule(lambda v: v, all_of(lambda v: v > 2, lambda v: v < 9), "big")
    wf = Workflow().add(big).add(rule(lambda v: v * 10, "big.condition_0", "user")).remove("big")
    assert "big" not in wf.components and values(Compiled(wf, facts(spark, [1, 3, 20])).value_of("user")) == [200, 30]
    shared = Workflow().add(big).add(rule(lambda v: v, "big.condition", "user"))
    with pytest.raises(UnresolvedReferenceError):
        shared.remove("big")


def test_hooks_of_a_new_workflow(spark):
    called = []
    wf = workflow(steps=[step(lambda v: v, "s")], before={"s": lambda w, name: called.append(name)})
    react_until_satisfied(wf, facts(spark, [1]))
    assert called == ["s"]
