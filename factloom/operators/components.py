"""Components: what users build graphs of, and how each is lowered to primitive nodes.

Functions work on columns and are called once, when the plan is built: ``step(lambda x: x * 2)``. A
function with several parameters gets the values of a join, or the elements or fields of its input. A
python_step() works on Python values instead and runs in Arrow batches.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import linecache
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from types import CodeType
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.meta import Ref, arity, refs_of
from factloom.functions.patterns import ANY, match
from factloom.plans.types import Port, ports

#: Primitive kinds that the compiler knows; everything else is lowered to these.
KINDS = ("step", "condition", "all_of", "any_of", "join", "fan_out", "fan_in", "accumulator", "fold", "custom")


@dataclass(frozen=True)
class Node:
    """A primitive of the graph. parents: names of nodes, or "" for the root. gates: conditions that must
    hold for the row besides the parents' own."""

    name: str
    kind: str
    parents: tuple[str, ...]
    component: str
    part: str
    fn: Callable[..., Any] | None = None
    gates: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)

    @property
    def refs(self) -> dict[str, Ref]:
        return refs_of(self.fn) | {k: v for k, v in self.options.items() if isinstance(v, Ref)}


def _parsed(path: str) -> list[ast.AST]:
    """The functions of a source file. Not cached here: what functions refer to travels with them to executors."""
    text = "".join(linecache.getlines(path))
    return [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.Lambda, ast.FunctionDef))]


def source_of(code: CodeType) -> str | None:
    """A function's syntax tree as text, without places or names of its own; None if its source is not at hand.
    Unlike bytecode it does not change with the version of Python."""
    try:
        places = [p for p in code.co_positions() if p[0] and p[2] is not None and p[0] >= code.co_firstlineno]
        line, col = min((p[0], p[2]) for p in places if p[0] > code.co_firstlineno or p[2] > 0)
        around = [n for n in _parsed(code.co_filename) if (n.lineno, n.col_offset) <= (line, col) < (n.end_lineno, n.end_col_offset)]
        node = max(around, key=lambda n: (n.lineno, n.col_offset))
    except (SyntaxError, OSError, ValueError):
        return None
    name = getattr(node, "name", "<lambda>")
    body = node.body if isinstance(node.body, list) else [node.body]
    return " ".join(ast.dump(x) for x in (node.args, *body)) if name == code.co_name else None


def described(value: Any) -> Any:
    """A value as data for hashing: functions by their source (or else their code) and what they hold, not by
    their address."""
    if callable(value) and hasattr(value, "__code__"):
        code = value.__code__
        free = [described(c.cell_contents) for c in value.__closure__ or ()]
        source = source_of(code)
        inner = [source] if source else [code.co_code.hex(), [c.co_code.hex() if inspect.iscode(c) else repr(c) for c in code.co_consts], list(code.co_names)]
        kept = sorted((k, described(v)) for k, v in (value.__kwdefaults__ or {}).items())
        return ["function", *inner, free, [described(v) for v in value.__defaults__ or ()], kept]
    if isinstance(value, dict):
        return {str(k): described(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [described(v) for v in value]
    if isinstance(value, Component):
        return value.content_hash()
    return repr(value)


@dataclass(frozen=True, kw_only=True)
class Component:
    """Base of all components. params are values that belong to a component's identity."""

    name: str = ""
    inputs: dict[str, Port] = field(default_factory=dict)
    outputs: dict[str, Port] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "inputs", ports(self.inputs))
        object.__setattr__(self, "outputs", ports(self.outputs))
        if not self.name:
            object.__setattr__(self, "name", f"{type(self).__name__.lower()}_{self.content_hash()[:8]}")

    def content_hash(self) -> str:
        """Hash of what the component does; its name and docs do not count."""
        fields_ = {k: described(v) for k, v in vars(self).items() if k not in ("name", "inputs", "outputs")}
        return hashlib.sha256(json.dumps([type(self).__name__, fields_], sort_keys=True, default=repr).encode()).hexdigest()

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        """The component's nodes, in order; the last one is where others attach."""
        raise NotImplementedError

    def _node(self, part: str, kind: str, parents: tuple[str, ...], fn: Callable | None = None, name: str = "", gates: tuple[str, ...] = (), **options: Any) -> Node:
        return Node(name or f"{self.name}.{part}", kind, parents, self.name, part, fn, gates, options)

    def _joined(self, parents: tuple[str, ...]) -> tuple[list[Node], tuple[str, ...]]:
        """A join node first if there are several parents."""
        if len(parents) < 2:
            return [], parents
        node = self._node("join", "join", parents)
        return [node], (node.name,)


@dataclass(frozen=True, kw_only=True)
class Step(Component):
    """One output per input: fn(value). No parameters: a constant. returns: makes fn a Python function of
    that Spark type, run in Arrow batches under the policy that applies to the step."""

    fn: Callable[..., Any]
    returns: str | None = None

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        return [*nodes, self._node("step", "step", parents, self.fn, self.name, returns=self.returns)]


@dataclass(frozen=True, kw_only=True)
class Condition(Component):
    """Passes its input on where fn(value) holds; null and failure are false."""

    fn: Callable[..., Any]

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        return [*nodes, self._node("condition", "condition", parents, self.fn, self.name)]


class Test:
    """A boolean tree over conditions: functions, names of conditions in the workflow, &, |."""

    def __init__(self, op: str, parts: Sequence[Any]) -> None:
        self.op, self.parts = op, list(parts)

    def __and__(self, other: Any) -> Test:
        return Test("all_of", [self, other])

    def __or__(self, other: Any) -> Test:
        return Test("any_of", [self, other])


def all_of(*parts: Any) -> Test:
    """Every one of the parts: functions, names of conditions, or tests."""
    return Test("all_of", parts)


def any_of(*parts: Any) -> Test:
    """One or more of the parts; what follows runs once."""
    return Test("any_of", parts)


@dataclass(frozen=True, kw_only=True)
class Rule(Component):
    """then(value) where the test holds.

    when: a function, a name of a shared condition, or a tree of all_of / any_of over them. given: a pattern whose
    bound parts are passed to where and then by name instead of the value.
    """

    then: Callable[..., Any]
    when: Any = None
    given: Any = None
    where: Callable[..., Any] | None = None

    def __post_init__(self) -> None:
        if self.when is not None and (self.given is not None or self.where is not None):
            raise ValueError("a rule has either `when` or `given` / `where`")
        super().__post_init__()

    def _with_bindings(self, fn: Callable[..., Any]) -> Callable[..., Any]:
        def bound(value: Column, **meta: Any) -> Column:
            _, names = match(self.given, value)
            return fn(**names, **meta) if names else fn(value, **meta)

        bound.__kwdefaults__ = refs_of(fn)
        bound.__signature__ = inspect.Signature([inspect.Parameter("value", inspect.Parameter.POSITIONAL_OR_KEYWORD), *(inspect.Parameter(k, inspect.Parameter.KEYWORD_ONLY, default=v) for k, v in refs_of(fn).items())])
        return bound

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        gates: list[str] = []

        def build(test: Any, part: str) -> str:
            if isinstance(test, str):
                return test  # a condition of the workflow: evaluated once, observed by many
            if isinstance(test, Test):
                own = [build(t, f"{part}_{i}") for i, t in enumerate(test.parts)]
                nodes.append(self._node(part, test.op, parents, gates=tuple(own)))
            else:
                fn = test.fn if isinstance(test, Condition) else test
                nodes.append(self._node(part, "condition", parents, fn))
            return nodes[-1].name

        then = self.then
        if self.given is not None or self.where is not None:
            pattern = ANY if self.given is None else self.given
            nodes.append(self._node("match", "condition", parents, lambda value: match(pattern, value)[0]))
            gates.append(nodes[-1].name)
            if self.where is not None:
                nodes.append(self._node("where", "condition", parents, self._with_bindings(self.where)))
                gates.append(nodes[-1].name)
            then = self._with_bindings(self.then)
        elif self.when is not None:
            gates.append(build(self.when, "condition"))
        return [*nodes, self._node("reaction", "step", parents, then, self.name, gates=tuple(gates))]


@dataclass(frozen=True, kw_only=True)
class Map(Component):
    """Fan an array out to one fact per element and run steps on each.

    each: a function, a Step, a nested Map, or a list of these (siblings); a tuple (x, [y, ...]) puts the
    y after x; ([a, b], [y]) joins a and b for y.
    """

    each: Any

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        nodes.append(self._node("fan_out", "fan_out", parents))
        leaves = self._pipeline(self.each, (nodes[-1].name,), nodes, "")
        # the last leaf is where a reduce attaches by default
        nodes.append(nodes.pop(next(i for i, n in enumerate(nodes) if n.name == leaves[-1])))
        return nodes

    def _pipeline(self, spec: Any, at: tuple[str, ...], nodes: list[Node], path: str) -> list[str]:
        if isinstance(spec, list):
            return [leaf for i, s in enumerate(spec) for leaf in self._pipeline(s, at, nodes, f"{path}{i}")]
        if isinstance(spec, tuple):
            head, rest = spec
            heads = self._pipeline(head, at, nodes, f"{path}h")
            return [leaf for i, s in enumerate(rest) for leaf in self._pipeline(s, tuple(heads), nodes, f"{path}t{i}")]
        if isinstance(spec, Map):
            inner = replace(spec, name=f"{self.name}.{spec.name}").lower(at)
            nodes += [replace(n, component=self.name) for n in inner]
            return [inner[-1].name]
        fn, name = (spec.fn, spec.name) if isinstance(spec, Step) else (spec, f"{self.name}.leaf{path}")
        if len(at) > 1:
            nodes.append(self._node(f"join{path}", "join", at))
            at = (nodes[-1].name,)
        nodes.append(self._node("leaf", "step", at, fn, name, returns=getattr(spec, "returns", None)))
        return [name]


@dataclass(frozen=True, kw_only=True)
class Reduce(Component):
    """Fold the elements of a map for each fact that was fanned out, in element order, or an array value.

    fn(acc, x) works on columns; it may return halt(acc) or go_on(acc) to end the fold early. native is an aggregate
    function of Spark (F.sum, F.max, ...) that does the same with partial aggregation; combine(init,
    result) takes the initial value in, which sums and counts add and minima and maxima compare with.
    """

    init: Any = None
    fn: Callable[..., Any] | None = None
    native: Callable[[Column], Column] | None = None
    combine: Callable[[Column, Column], Column] | None = None
    stops: bool = False
    over: str | None = None

    def __post_init__(self) -> None:
        if self.native is not None and self.init is not None and self.combine is None and self.native not in (F.sum, F.count, F.min, F.max):
            raise ValueError("this native aggregate needs `combine` to take an initial value in")
        super().__post_init__()

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        return [self._node("fan_in", "fan_in", parents, self.fn, self.name, init=self.init, native=self.native, combine=self.combine, stops=self.stops)]


def go_on(acc: Column) -> Column:
    """The fold goes on with acc."""
    return F.struct(F.lit(False).alias("halted"), acc.alias("acc"))


def halt(acc: Column) -> Column:
    """The fold ends with acc; later elements change nothing."""
    return F.struct(F.lit(True).alias("halted"), acc.alias("acc"))


@dataclass(frozen=True, kw_only=True)
class Accumulator(Component):
    """Running state over the facts of a key, in order; every fact yields the new state.

    native names a mergeable fold that runs as a window: sum, count, min, max, last, collect. Otherwise
    fn(value, state) is a Python function, and state_type its Spark type; it runs as one ordered stream
    per partition and holds one state at a time.
    """

    init: Any = 0
    fn: Callable[..., Any] | None = None
    native: str | None = None
    state_type: str = "bigint"

    def __post_init__(self) -> None:
        if (self.native is None) == (self.fn is None):
            raise ValueError("an accumulator has either `native` or `fn`")
        super().__post_init__()

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        return [*nodes, self._node("accumulator", "accumulator", parents, self.fn, self.name, init=self.init, native=self.native, state_type=self.state_type)]


@dataclass(frozen=True, kw_only=True)
class Custom(Component):
    """A node of one's own: compile(df, value, out) gets the rows of its frame and the name of the input
    column, and returns the same rows with a column `out` more, by whatever plan."""

    compile: Callable[..., Any]

    def lower(self, parents: tuple[str, ...]) -> list[Node]:
        nodes, parents = self._joined(parents)
        return [*nodes, self._node("custom", "custom", parents, None, self.name, compile=self.compile)]


#: type -> how a value of it becomes a component; see register_component().
CONVERSIONS: dict[type, Callable[[Any, str], Component]] = {}


def register_component(kind: type, convert: Callable[[Any, str], Component]) -> None:
    """Values of the type, and of those derived from it, may be added to workflows: convert(value, name) makes the
    component. The nearest type in a value's order of classes counts."""
    CONVERSIONS[kind] = convert


def as_component(x: Any, name: str = "") -> Component:
    """A component from a value of a registered type, a function, a dict description, a plain value."""
    if isinstance(x, Component):
        return x
    for kind in type(x).__mro__:
        if kind in CONVERSIONS:
            return CONVERSIONS[kind](x, name)
    if isinstance(x, dict) and x.get("type") == "custom_processor":
        return Step(name=x.get("metadata", {}).get("name", name), fn=x["function"])
    if callable(x):
        return Step(name=name, fn=x)
    return Step(name=name, fn=lambda: F.lit(x))


def step(fn: Any, name: str = "", **options: Any) -> Step:
    return Step(name=name, fn=fn if callable(fn) else (lambda: F.lit(fn)), **options)


def python_step(fn: Callable[..., Any], returns: str, name: str = "", **options: Any) -> Step:
    """A step whose function works on Python values."""
    return Step(name=name, fn=fn, returns=returns, **options)


def condition(fn: Callable[..., Any], name: str = "", **options: Any) -> Condition:
    return Condition(name=name, fn=fn, **options)


def rule(then: Callable[..., Any], when: Any = None, name: str = "", **options: Any) -> Rule:
    return Rule(name=name, when=when, then=then, **options)


def map_each(each: Any, name: str = "", **options: Any) -> Map:
    return Map(name=name, each=each, **options)


def reduce(init: Any, fn: Callable[..., Any] | None = None, name: str = "", over: str | None = None, **options: Any) -> Reduce:
    return Reduce(name=name, init=init, fn=fn, over=over, **options)


def accumulator(init: Any, fn: Callable[..., Any] | None = None, name: str = "", **options: Any) -> Accumulator:
    return Accumulator(name=name, init=init, fn=fn, **options)


__all__ = [n for n in dir() if n[0].isupper() or n in ("accumulator", "all_of", "any_of", "arity", "as_component", "condition", "described", "go_on", "halt", "map_each", "python_step", "reduce", "register_component", "rule", "step")]
