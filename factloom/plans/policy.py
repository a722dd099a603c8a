"""What happens when a Python step fails: retries with backoff, timeout, fallback, skip or halt."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, replace
from typing import Any


class Retry:
    """A fallback may return Retry(changes) to run the step once more with other named values."""

    def __init__(self, **values: Any) -> None:
        self.values = values


@dataclass(frozen=True)
class Policy:
    """retries after the first attempt; backoff none, linear, exponential or jitter between base_delay
    and max_delay seconds; timeout seconds of one attempt; fallback(value, error) -> a value or Retry; otherwise
    on_failure: halt (the row fails, and all below it) or skip (the row is left out quietly)."""

    retries: int = 0
    backoff: str = "none"
    base_delay: float = 0.5
    max_delay: float = 30.0
    timeout: float | None = None
    on_failure: str = "halt"
    fallback: Callable[[Any, Exception], Any] | None = None

    def __post_init__(self) -> None:
        if self.backoff not in ("none", "linear", "exponential", "jitter") or self.on_failure not in ("halt", "skip"):
            raise ValueError("unknown backoff or on_failure")

    def delay(self, attempt: int) -> float:
        """Seconds to wait after the attempt-th failure, counted from 1."""
        if self.backoff == "none":
            return 0.0
        step = self.base_delay * (attempt if self.backoff == "linear" else 2 ** (attempt - 1))
        step = min(step, self.max_delay)
        return random.uniform(0, step) if self.backoff == "jitter" else step

    def run(self, fn: Callable[..., Any], *args: Any, sleep: Callable[[float], None] = time.sleep, **kw: Any) -> tuple[Any, str, str | None, int]:
        """(value, status, error, attempts); status is completed, failed or skipped."""
        attempt, error = 0, None
        while attempt <= self.retries:
            attempt += 1
            try:
                return self._once(fn, args, kw), "completed", None, attempt
            except Exception as e:  # noqa: BLE001 - any failure of user code counts
                error = e
                if attempt <= self.retries and (wait := self.delay(attempt)):
                    sleep(wait)
        if self.fallback is not None:
            try:
                made = self.fallback(args[0] if args else None, error)
                if isinstance(made, Retry):
                    made = self._once(fn, args, kw | made.values)
                return made, "completed", None, attempt
            except Exception as e:  # noqa: BLE001
                error = e
        return None, "skipped" if self.on_failure == "skip" and self.fallback is None else "failed", repr(error), attempt

    def _once(self, fn: Callable[..., Any], args: tuple, kw: dict[str, Any]) -> Any:
        if self.timeout is None:
            return fn(*args, **kw)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(fn, *args, **kw).result(self.timeout)
        except Late:
            raise TimeoutError(f"took more than {self.timeout} s") from None
        finally:
            pool.shutdown(wait=False)


# The numbers of the three presets.


def llm_policy(**changes: Any) -> Policy:
    return replace(Policy(retries=3, backoff="exponential", base_delay=1.0, max_delay=30.0, timeout=30.0), **changes)


def io_policy(**changes: Any) -> Policy:
    return replace(Policy(retries=2, backoff="linear", timeout=10.0, on_failure="skip"), **changes)


def fast_fail(**changes: Any) -> Policy:
    return replace(Policy(timeout=5.0), **changes)


@dataclass(frozen=True)
class PolicyRule:
    """Which components a policy is for: a name, 'default', a compiled pattern, types, or a predicate."""

    matcher: Any
    policy: Policy

    def matches(self, name: str, component: Any) -> bool:
        m = self.matcher
        if m == "default":
            return True
        if isinstance(m, str):
            return m in (name, getattr(component, "name", None))
        if isinstance(m, re.Pattern):
            return bool(m.search(name))
        if isinstance(m, type) or isinstance(m, tuple):
            return isinstance(component, m)
        return bool(m(component))


def merge_policies(own: tuple[PolicyRule, ...], run: tuple[PolicyRule, ...], mode: str = "merge") -> tuple[PolicyRule, ...]:
    """Those of a run before the workflow's own, or instead of them."""
    return run if mode == "replace" else (*run, *own)
