"""Markers for what a component reads besides its input.

They are the defaults of keyword-only parameters: ``lambda x, *, total=state_of("sum"): x > total``. The
compiler replaces each by a column (a window over the other component's output) or, for context, a value.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

MISSING = object()


@dataclass(frozen=True)
class Ref:
    """kind of read, the component (or (component, part)) that is read, and a path into its value."""

    kind: str
    target: Any
    path: tuple[str, ...] = ()
    default: Any = MISSING

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("_"):
            raise AttributeError(name)
        return Ref(self.kind, self.target, (*self.path, name), self.default)


def state_of(target: Any) -> Ref:
    """The latest state of an accumulator or state component; before any input, its initial state."""
    return Ref("state_of", target)


def step_ran(target: Any) -> Ref:
    """Whether the component produced anything so far."""
    return Ref("step_ran", target)


def ran_here(target: Any) -> Ref:
    """Whether the component produced something for the same root fact."""
    return Ref("ran_here", target)


def fact_count(target: Any) -> Ref:
    """How many facts the component produced so far."""
    return Ref("fact_count", target)


def latest_value_of(target: Any) -> Ref:
    return Ref("latest_value_of", target)


def latest_fact_of(target: Any) -> Ref:
    return Ref("latest_fact_of", target)


def all_values_of(target: Any) -> Ref:
    """All values so far, in order. The list is as long as the history, so use it on short ones."""
    return Ref("all_values_of", target)


def all_facts_of(target: Any) -> Ref:
    return Ref("all_facts_of", target)


def context(key: str, default: Any = MISSING) -> Ref:
    """A run-time parameter: the component's own value, else the global one, else the default (a value or
    a function without arguments)."""
    return Ref("context", key, (), default)


def refs_of(fn: Callable[..., Any] | None) -> dict[str, Ref]:
    """The markers among a function's keyword-only defaults, by parameter."""
    if fn is None:
        return {}
    try:
        parameters = inspect.signature(fn).parameters.values()
    except (TypeError, ValueError):
        return {}
    return {p.name: p.default for p in parameters if isinstance(p.default, Ref)}


def arity(fn: Callable[..., Any]) -> int:
    """How many positional values a function needs; one that takes any number counts as one."""
    parameters = inspect.signature(fn).parameters.values()
    if any(p.kind is p.VAR_POSITIONAL for p in parameters):
        return 1
    return sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty for p in parameters)
