"""Optional port types of components, and the errors that wiring raises."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


class IncompatiblePortError(TypeError):
    """A producer's ports do not fit a consumer's."""


class UnresolvedReferenceError(LookupError):
    """A name that is read or attached to is not in the workflow."""


class CycleError(ValueError):
    """Components read each other in a circle."""


@dataclass(frozen=True)
class Port:
    """One named input or output. type: 'any', a scalar's name, ('list', t) or ('one_of', (t, ...))."""

    type: Any = "any"
    doc: str = ""
    cardinality: str = "one"
    required: bool = True
    to: str | None = None
    source: str | None = None


#: The Spark type of each scalar port type; 'any' has none and is not checked.
SCALARS: dict[str, T.DataType] = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "binary": T.BinaryType(),
}


def ports(spec: Mapping[str, Any] | None) -> dict[str, Port]:
    """Port objects from {name: Port | type | dict of Port fields}; unknown fields are an error."""
    out = {}
    for name, p in (spec or {}).items():
        out[name] = p if isinstance(p, Port) else Port(**p) if isinstance(p, Mapping) else Port(p)
        if out[name].cardinality not in ("one", "many"):
            raise ValueError(f"port {name}: cardinality is 'one' or 'many'")
    return out


def compatible(produced: Any, wanted: Any) -> bool:
    """Whether a value of one port type may go where the other is wanted. There is no numeric widening."""
    if "any" in (produced, wanted) or produced == wanted:
        return True
    for x, y in ((produced, wanted), (wanted, produced)):
        if isinstance(x, tuple) and x[0] == "one_of":
            return any(compatible(t, y) for t in x[1])
    if isinstance(produced, tuple) and isinstance(wanted, tuple):
        return produced[0] == wanted[0] == "list" and compatible(produced[1], wanted[1])
    return False


def ports_compatible(produced: Mapping[str, Port], wanted: Mapping[str, Port]) -> bool:
    """One to one: by type. Several to one: any that fits. Otherwise each required port by its name."""
    if not produced or not wanted:
        return True
    if len(wanted) == 1:
        (only,) = wanted.values()
        return any(compatible(p.type, only.type) for p in produced.values())
    return all(n in produced and compatible(produced[n].type, p.type) for n, p in wanted.items() if p.required)


def spark_type(port_type: Any) -> T.DataType | None:
    """The Spark type of a port type, None where any will do."""
    if isinstance(port_type, tuple):
        inner = spark_type(port_type[1]) if port_type[0] == "list" else None
        return T.ArrayType(inner) if inner is not None else None
    return SCALARS.get(port_type)


def check_schema(port: Port, found: T.DataType) -> None:
    """Raise if a column's type is not the port's."""
    wanted = spark_type(port.type)
    if wanted is not None and type(wanted) is not type(found):
        raise IncompatiblePortError(f"port wants {wanted.simpleString()}, the column has {found.simpleString()}")
