"""The workflow: an immutable graph of components. It holds no data; every edit returns a new one."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from factloom.functions.meta import MISSING, Ref
from factloom.operators.components import Component, Condition, Map, Node, Reduce, Step, as_component
from factloom.plans.policy import Policy, PolicyRule
from factloom.plans.types import CycleError, IncompatiblePortError, Port, UnresolvedReferenceError, ports, ports_compatible

Target = Any  # a name, (name, part), a list of these, or None for the root


@dataclass(frozen=True)
class Added:
    """A build event: the component and where it was attached."""

    component: Component
    to: Any


@dataclass(frozen=True)
class Removed:
    name: str


@dataclass(frozen=True)
class Workflow:
    """Components by name, their primitive nodes, and what was declared about the whole."""

    name: str = "workflow"
    components: dict[str, Component] = field(default_factory=dict)
    nodes: dict[str, Node] = field(default_factory=dict)
    attached: dict[str, Any] = field(default_factory=dict)
    input_ports: dict[str, Port] = field(default_factory=dict)
    output_ports: dict[str, Port] = field(default_factory=dict)
    policies: tuple[PolicyRule, ...] = ()
    run_context: dict[str, dict[str, Any]] = field(default_factory=dict)
    before: dict[str, tuple[Callable, ...]] = field(default_factory=dict)
    after: dict[str, tuple[Callable, ...]] = field(default_factory=dict)
    around: dict[str, tuple[tuple[Callable | None, Callable | None], ...]] = field(default_factory=dict)
    log: tuple[Any, ...] = ()

    # ---- building -------------------------------------------------------------------------------

    def add(self, component: Any, to: Target = None, name: str = "", validate: str = "error") -> Workflow:
        """Attach a component (or what as_component() takes, a workflow, or a pipeline tuple) to `to`.
        Several targets are joined. validate: error, warn or off for the ports."""
        if isinstance(component, Workflow):
            return self._add_workflow(component, to)
        if isinstance(component, tuple) and len(component) == 2 and isinstance(component[1], list):
            return self._add_pipeline(component, to)
        if isinstance(component, list):
            return self._each(component, to)
        component = as_component(component, name)
        if component.name in self.components:
            component = replace(component, name=self._free(component.name))
        targets = self._targets(to if to is not None else getattr(component, "over", None))
        self._check_ports(component, targets, validate)
        parents = tuple(self.output_of(t) for t in targets) or ("",)
        nodes = component.lower(parents)
        for n in nodes:
            for gate in n.gates:
                if gate not in self.nodes and gate not in {x.name for x in nodes}:
                    raise UnresolvedReferenceError(f"{component.name}: no condition {gate!r}")
        out = replace(
            self,
            components=self.components | {component.name: component},
            nodes=self.nodes | {n.name: n for n in nodes},
            attached=self.attached | {component.name: targets},
            log=(*self.log, Added(component, to)),
        )
        out.order()  # raises on circles and unknown reads
        return out

    def add_with_events(self, component: Any, to: Target = None, **options: Any) -> tuple[Workflow, list[Any]]:
        """The workflow with the component, and the build events that this made."""
        out = self.add(component, to, **options)
        return out, list(out.log[len(self.log) :])

    def _free(self, name: str) -> str:
        i = 2
        while f"{name}_{i}" in self.components:
            i += 1
        return f"{name}_{i}"

    def _each(self, items: Iterable[Any], to: Target) -> Workflow:
        out = self
        for x in items:
            out = out.add(x, to)
        return out

    def _add_pipeline(self, tree: tuple[Any, list[Any]], to: Target) -> Workflow:
        head, rest = tree
        if isinstance(head, list):
            out, names = self, []
            for h in head:
                h = as_component(h)
                out = out.add(h, to)
                names.append(list(out.components)[-1])
            return out._each(rest, names)
        out = self.add(as_component(head), to)
        return out._each(rest, list(out.components)[-1])

    def _add_workflow(self, other: Workflow, to: Target) -> Workflow:
        """The other's root components go below `to`; its declared ports and context come along."""
        out, names = self, {}
        for name, component in other.components.items():
            targets = [(names.get(t, t) if isinstance(t, str) else (names.get(t[0], t[0]), t[1])) for t in other.attached[name]]
            at = targets if len(targets) > 1 else targets[0] if targets else to
            if isinstance(component, Reduce) and component.over:
                component = replace(component, over=None)
            out = out.add(component, at)
            names[name] = list(out.components)[-1]
        context = {k: {**out.run_context.get(k, {}), **v} for k, v in other.run_context.items()}
        return replace(out, run_context=out.run_context | context, policies=(*out.policies, *other.policies))

    def merge(self, other: Workflow) -> Workflow:
        """Both graphs side by side below one root."""
        return self._add_workflow(other, None)

    def remove(self, name: str) -> Workflow:
        """Take a component out; what hung on it hangs on its parents then. Conditions of it that others share
        stay, as components of their own."""
        if name not in self.components:
            raise UnresolvedReferenceError(name)
        own = {n.name for n in self.nodes.values() if n.component == name}
        used = {g for n in self.nodes.values() if n.component != name for g in n.gates if g in own}
        out, up = Workflow(self.name, input_ports=self.input_ports, output_ports=self.output_ports, policies=self.policies, run_context=self.run_context, before=self.before, after=self.after, around={k: v for k, v in self.around.items() if k != name}), self.attached[name]
        for other, component in self.components.items():
            if other == name:
                for n in (self.nodes[g] for g in sorted(used)):
                    if n.kind != "condition":
                        raise UnresolvedReferenceError(f"{name} holds {n.name}, which others share and which is no single condition")
                    out = out.add(Condition(name=n.name, fn=n.fn), up if len(up) > 1 else up[0] if up else None)
                continue
            targets: list[Any] = []
            for t in self.attached[other]:
                targets += up if (t if isinstance(t, str) else t[0]) == name else [t]
            if isinstance(component, Reduce) and component.over == name:
                component = replace(component, over=None)
            out = out.add(component, targets if len(targets) > 1 else targets[0] if targets else None)
        return replace(out, log=(*self.log, Removed(name)))

    def with_ports(self, inputs: dict[str, Any] | None = None, outputs: dict[str, Any] | None = None) -> Workflow:
        """Declare boundary ports; an output's source is the component whose value it is."""
        return replace(self, input_ports=ports(inputs), output_ports=ports(outputs))

    def put_context(self, values: dict[str, Any], component: str = "_global") -> Workflow:
        return replace(self, run_context=self.run_context | {component: self.run_context.get(component, {}) | values})

    def get_context(self, component: str | None = None) -> dict[str, Any]:
        return self.run_context.get("_global", {}) | (self.run_context.get(component, {}) if component else {})

    def set_policies(self, rules: Iterable[PolicyRule]) -> Workflow:
        return replace(self, policies=tuple(rules))

    def add_policy(self, rule: PolicyRule) -> Workflow:
        """The rule goes before the others, and so wins."""
        return replace(self, policies=(rule, *self.policies))

    def append_policy(self, rule: PolicyRule) -> Workflow:
        return replace(self, policies=(*self.policies, rule))

    def policy_of(self, name: str) -> Policy | None:
        for r in self.policies:
            if r.matches(name, self.components.get(self.nodes[name].component if name in self.nodes else name)):
                return r.policy
        return None

    def attach_before(self, name: str, hook: Callable) -> Workflow:
        """hook(workflow, name) is called before each round; it may return a changed workflow."""
        return replace(self, before=self.before | {name: (*self.before.get(name, ()), hook)})

    def attach_after(self, name: str, hook: Callable) -> Workflow:
        return replace(self, after=self.after | {name: (*self.after.get(name, ()), hook)})

    def attach_around(self, name: str, before: Callable | None = None, after: Callable | None = None) -> Workflow:
        """before(event, context) and after(event, context) are called on the executor round each attempt at a
        Python step's fact. event: component and value, and for after the result too. An error in a hook is one of the attempt."""
        if not any(n.component == name and n.options.get("returns") for n in self.nodes.values()):
            raise UnresolvedReferenceError(f"{name} is no Python step; columns have no moment at which a hook could be called")
        return replace(self, around=self.around | {name: (*self.around.get(name, ()), (before, after))})

    def run_hooks(self, when: str) -> Workflow:
        """Call the hooks in the order in which they were attached; changes take effect in the next round."""
        out = self
        for name, hooks in getattr(self, when).items():
            for hook in hooks:
                changed = hook(out, name)
                out = changed if isinstance(changed, Workflow) else out
        return out

    # ---- looking ---------------------------------------------------------------------------------

    def _targets(self, to: Target) -> list[Any]:
        targets = to if isinstance(to, list) else [] if to is None else [to]
        for t in targets:
            self.output_of(t)
        return list(targets)

    def output_of(self, target: Any) -> str:
        """The node where things attach: the component's last, or the named part's."""
        name, part = target if isinstance(target, tuple) else (target, None)
        own = [n for n in self.nodes.values() if n.component == name]
        if part is not None:
            own = [n for n in own if n.part == part]
        elif target in self.nodes and self.nodes[target].component != target:
            return target
        if not own:
            raise UnresolvedReferenceError(f"nothing named {target!r} in {self.name}")
        return own[-1].name

    def get_component(self, name: str) -> Component:
        if name not in self.components:
            raise UnresolvedReferenceError(name)
        return self.components[name]

    def sub_components(self, name: str) -> dict[str, list[str]]:
        """part -> nodes of a component."""
        out: dict[str, list[str]] = {}
        for n in self.nodes.values():
            if n.component == name:
                out.setdefault(n.part, []).append(n.name)
        return out

    def steps(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.kind == "step"]

    def conditions(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.kind == "condition"]

    def next_steps(self, name: str) -> list[str]:
        """Nodes that take the named component's output."""
        out = self.output_of(name) if name else ""
        return [n.name for n in self.nodes.values() if out in n.parents]

    def connected_components(self) -> list[tuple[str, str]]:
        """Edges between components."""
        return [((t if isinstance(t, str) else t[0]), c) for c, ts in self.attached.items() for t in ts]

    def connectable(self, component: Component, to: Target) -> bool:
        """Whether the ports allow it to be added there."""
        try:
            self._check_ports(component, self._targets(to), "error")
        except IncompatiblePortError:
            return False
        return True

    def connectables(self, component: Component) -> list[str]:
        return [name for name in self.components if self.connectable(component, name)]

    def _check_ports(self, component: Component, targets: list[Any], validate: str) -> None:
        if validate == "off":
            return
        for t in targets:
            producer = self.components[t if isinstance(t, str) else t[0]] if (t if isinstance(t, str) else t[0]) in self.components else None
            if producer is not None and not isinstance(component, Map) and not ports_compatible(producer.outputs, component.inputs):
                if validate == "warn":
                    import warnings

                    warnings.warn(f"{producer.name} -> {component.name}: ports do not fit", stacklevel=3)
                    continue
                raise IncompatiblePortError(f"{producer.name} -> {component.name}: ports do not fit")

    def reads(self) -> list[tuple[str, str, Ref]]:
        """(node, parameter, what it reads) of the whole graph."""
        return [(n.name, k, r) for n in self.nodes.values() for k, r in n.refs.items()]

    def dependencies(self, name: str) -> list[str]:
        """Components that the named one reads."""
        return list(dict.fromkeys(r.target if isinstance(r.target, str) else r.target[0] for n, _, r in self.reads() if r.kind != "context" and self.nodes[n].component == name))

    def dependents(self, name: str) -> list[str]:
        """Components that read the named one."""
        return list(dict.fromkeys(self.nodes[n].component for n, _, r in self.reads() if r.kind != "context" and name in (r.target, r.target[0])))

    def kept_components(self) -> list[str]:
        """Components whose state, count or latest value a later batch goes on from."""
        kinds = {n.component for n in self.nodes.values() if n.kind in ("accumulator", "fold")}
        read = {r.target for _, _, r in self.reads() if r.kind not in ("context", "ran_here") and isinstance(r.target, str)}
        return [c for c in self.components if c in kinds | read]

    def required_context(self) -> list[str]:
        """Context keys that are read without a default."""
        return sorted({r.target for _, _, r in self.reads() if r.kind == "context" and r.default is MISSING})

    def validate_context(self, values: dict[str, Any] | None = None) -> list[str]:
        """Required keys that are missing."""
        have = self.get_context().keys() | (values or {}).keys() | {k for c in self.run_context.values() for k in c}
        return [k for k in self.required_context() if k not in have]

    def depth(self, name: str) -> int:
        """Static causal depth of a node: 1 below the root; a gate counts as a level."""
        if not name:
            return 0
        n = self.nodes[name]
        return 1 + max([self.depth(p) for p in n.parents] + [self.depth(g) for g in n.gates])

    def order(self) -> list[Node]:
        """Nodes so that parents, gates and what is read come first."""
        out: dict[str, Node] = {}
        open_: set[str] = set()

        def visit(name: str) -> None:
            if not name or name in out:
                return
            if name in open_:
                raise CycleError(f"{name} depends on itself")
            open_.add(name)
            node = self.nodes[name]
            for p in (*node.parents, *node.gates):
                visit(p)
            for r in node.refs.values():
                if r.kind != "context":
                    visit(self.output_of(r.target))
            open_.discard(name)
            out[name] = node

        for name in self.nodes:
            visit(name)
        return list(out.values())

    def content_hash(self) -> str:
        """Equal for graphs of equal components wired alike."""
        spec = [[self.components[c].content_hash(), [str(t) for t in self.attached[c]]] for c in self.components]
        return hashlib.sha256(json.dumps(spec).encode()).hexdigest()

    def spec(self) -> list[dict[str, Any]]:
        """The build log as data: what was added where. Functions are named by hash, never stored as code."""
        return [{"added": e.component.name, "type": type(e.component).__name__, "hash": e.component.content_hash(), "to": e.to} if isinstance(e, Added) else {"removed": e.name} for e in self.log]


def workflow(name: str = "workflow", steps: Iterable[Any] = (), rules: Iterable[Any] = (), inputs: dict | None = None, outputs: dict | None = None, before: dict[str, Callable] | None = None, after: dict[str, Callable] | None = None) -> Workflow:
    """A workflow of pipelines and rules, with optional boundary ports, and hooks by component."""
    out = Workflow(name)
    for x in (*steps, *rules):
        out = out.add(x)
    for component, hook in (before or {}).items():
        out = out.attach_before(component, hook)
    for component, hook in (after or {}).items():
        out = out.attach_after(component, hook)
    return out.with_ports(inputs, outputs)


def transmute(x: Any) -> Workflow:
    """A workflow of its own from a component, function, pipeline or workflow."""
    return x if isinstance(x, Workflow) else Workflow().add(x)


def from_log(events: Iterable[Any], name: str = "workflow") -> Workflow:
    """Rebuild a workflow from its build events."""
    out = Workflow(name)
    for e in events:
        out = out.remove(e.name) if isinstance(e, Removed) else out.add(copy.copy(e.component), e.to)
    return out


__all__ = ["Added", "Removed", "Step", "Workflow", "from_log", "transmute", "workflow"]
