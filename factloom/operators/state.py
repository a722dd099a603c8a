"""Components with state that are more than a plain fold: machines, aggregates, sagas, managers.

Each is an ordered fold over the facts of a key, written as a Python function of (state, event) that
returns the new state and what it emits. It runs as one stream per partition over rows sorted by key and
order, and holds one state at a time, in batch as in Structured Streaming. Events and states are Python
values; a struct is a dict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators.components import Component, Node

#: What every fold yields for a fact: the state after it, and the emitted facts as (tag, JSON payload).
EMITTED = "array<struct<tag:string,payload:string>>"


@dataclass(frozen=True, kw_only=True)
class Fold(Component):
    """An ordered fold. initial() makes a state; advance(state, event) -> (state, [(tag, payload)])."""

    state_type: str = "string"

    def initial(self) -> Any:
        raise NotImplementedError

    def advance(self, state: Any, event: Any) -> tuple[Any, list[tuple[str, Any]]]:
        raise NotImplementedError

    def reactors(self) -> dict[str, tuple[Callable[..., Any], Callable[..., Any]]]:
        """name -> (condition on the new state, reaction to it), both over columns."""
        return {}

    def _fold_name(self) -> str:
        return self.name

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        main = self._node("accumulator", "fold", parents, None, self.name, fold=self, state_type=self.state_type)
        nodes.append(main)
        out = []
        for name, (test, react) in self.reactors().items():
            out.append(self._node(f"{name}_condition", "condition", (main.name,), test))
            out.append(self._node(name, "step", (main.name,), react, f"{self.name}.{name}", gates=(out[-1].name,)))
        return [*nodes[:-1], *out, main]


@dataclass(frozen=True, kw_only=True)
class StateMachine(Fold):
    """reducer(event, state) -> state, and reactors that look at the state after each fact.
    native: a mergeable fold (see Accumulator) instead of a reducer."""

    init: Any = 0
    reducer: Callable[[Any, Any], Any] | None = None
    native: str | None = None
    reactions: dict[str, tuple[Callable[..., Any], Callable[..., Any]]] = field(default_factory=dict)

    def initial(self) -> Any:
        return self.init

    def advance(self, state: Any, event: Any) -> tuple[Any, list[tuple[str, Any]]]:
        return self.reducer(event, state), []

    def reactors(self) -> dict[str, tuple[Callable[..., Any], Callable[..., Any]]]:
        return self.reactions

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes = super().lower(parents)
        if self.native:
            main = nodes[-1]
            nodes[-1] = Node(main.name, "accumulator", main.parents, main.component, main.part, None, (), {"init": self.init, "native": self.native, "state_type": self.state_type})
        return nodes


@dataclass(frozen=True, kw_only=True)
class Fsm(Fold):
    """Named states with transitions: states = {state: {event: target or (target, guard)}}; on_entry =
    {state: payload}. An event that a state does not list changes nothing. Emits the tag `entered` with
    the payload of a state that is entered by a transition."""

    initial_state: str = ""
    states: dict[str, dict[str, Any]] = field(default_factory=dict)
    on_entry: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__post_init__()
        targets = [t[0] if isinstance(t, tuple) else t for on in self.states.values() for t in on.values()]
        if unknown := {self.initial_state, *targets, *self.on_entry} - self.states.keys():
            raise ValueError(f"{self.name}: no such state: {', '.join(sorted(unknown))}")

    def initial(self) -> str:
        return self.initial_state

    def advance(self, state: str, event: Any) -> tuple[str, list[tuple[str, Any]]]:
        key = event["tag"] if isinstance(event, dict) else event
        to = self.states[state].get(key)
        if isinstance(to, tuple):
            to = to[0] if to[1](event) else None
        if to is None:
            return state, []
        return to, [("entered", self.on_entry[to])] if to in self.on_entry else []


@dataclass(frozen=True, kw_only=True)
class Aggregate(Fold):
    """Commands guarded by the state emit events, and events are folded into it.

    commands = {tag: (guard(state, command) or None, emit(state, command) -> event)}; events =
    {tag: fold(state, event) -> state}. An input with a command's tag is a command: if its guard holds its event is
    emitted and folded, otherwise `rejected` is. Any other input whose tag is an event's is folded.
    """

    init: Any = None
    commands: dict[str, tuple[Callable | None, Callable]] = field(default_factory=dict)
    events: dict[str, Callable[[Any, Any], Any]] = field(default_factory=dict)

    def initial(self) -> Any:
        return self.init

    def advance(self, state: Any, event: Any) -> tuple[Any, list[tuple[str, Any]]]:
        tag = event["tag"] if isinstance(event, dict) else event
        if tag in self.commands:
            guard, emit = self.commands[tag]
            if guard is not None and not guard(state, event):
                return state, [("rejected", tag)]
            made = emit(state, event)
            fold = self.events.get(made["tag"])
            return fold(state, made) if fold else state, [(made["tag"], {k: v for k, v in made.items() if k != "tag"})]
        return self.events[tag](state, event) if tag in self.events else state, []


@dataclass(frozen=True, kw_only=True)
class ProcessManager(Fold):
    """Follows a process: on = {tag: (update(state, event) -> changes, emit(state, event) -> command or
    None)}; changes are merged into the state, a map. Emits `command`, and `process_completed` with each
    fact after which complete(state) holds. timeouts = {name: seconds} are timers for streams."""

    init: dict[str, Any] = field(default_factory=dict)
    on: dict[str, tuple[Callable | None, Callable | None]] = field(default_factory=dict)
    complete: Callable[[dict[str, Any]], bool] | None = None
    timeouts: dict[str, float] = field(default_factory=dict)

    def initial(self) -> dict[str, Any]:
        return dict(self.init)

    def advance(self, state: dict[str, Any], event: Any) -> tuple[dict[str, Any], list[tuple[str, Any]]]:
        tag = event["tag"] if isinstance(event, dict) else event
        if tag not in self.on:
            return state, []
        update, emit = self.on[tag]
        state = {**state, **(update(state, event) if update else {})}
        out = [("command", made)] if emit and (made := emit(state, event)) is not None else []
        if self.complete and self.complete(state):
            out.append(("process_completed", self.name))
        return state, out


@dataclass(frozen=True, kw_only=True)
class Saga(Component):
    """Transactions in order, each a column function of the results so far; the first that fails is
    followed by the compensations of those that succeeded, last first.

    transactions = {name: fn(results) -> column}, null is a failure; compensations = {name: fn(results) ->
    column}. The output is struct<status, failed, results, compensated>: completed, aborted (the first
    failed, with abort_at_start) or compensating. Runs as plain columns of the row.
    """

    transactions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    compensations: dict[str, Callable[..., Column]] = field(default_factory=dict)
    abort_at_start: bool = True

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        run = self._node("run", "step", parents, self._run, self.name)
        done = self._node("completed", "condition", (self.name,), lambda s: s["status"] == "completed")
        failed = self._node("failed", "condition", (self.name,), lambda s: s["status"] != "completed")
        return [*nodes, done, failed, run]

    def _run(self, value: Column) -> Column:
        results: dict[str, Column] = {}
        ok, failed = F.lit(True), F.lit(None).cast("string")
        for name, fn in self.transactions.items():
            made = F.when(ok, fn({"input": value} | results))
            failed = F.when(ok & made.isNull(), F.lit(name)).otherwise(failed)
            ok = ok & made.isNotNull()
            results[name] = made
        undone = [F.when(~ok & results[n].isNotNull(), F.struct(F.lit(n).alias("name"), self.compensations[n]({"input": value} | results).cast("string").alias("result"))) for n in reversed(self.transactions) if n in self.compensations]
        compensated = F.array_compact(F.array(*undone)) if undone else F.expr("cast(array() as array<struct<name:string,result:string>>)")
        first = next(iter(self.transactions))
        at_start = (failed == first) if self.abort_at_start else F.lit(False)
        status = F.when(ok, "completed").when(at_start, "aborted").otherwise("compensating")
        return F.struct(status.alias("status"), failed.alias("failed"), F.struct(*(c.alias(n) for n, c in results.items())).alias("results"), compensated.alias("compensated"))
