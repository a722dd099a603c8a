"""Diagrams of a workflow as text, and of the facts of one root."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from factloom.plans.workflow import Workflow

#: Brackets of Mermaid and shapes of DOT for each kind of node.
BRACKETS = {"condition": ("{{", "}}"), "all_of": ("{{", "}}"), "any_of": ("{{", "}}"), "join": ("[/", "/]"), "fan_out": ("[/", "\\]"), "fan_in": ("[\\", "/]"), "accumulator": ("[(", ")]"), "fold": ("[(", ")]")}
SHAPES = {"condition": "diamond", "all_of": "diamond", "any_of": "diamond", "join": "trapezium", "fan_out": "triangle", "fan_in": "invtriangle", "accumulator": "cylinder", "fold": "cylinder"}


def _id(name: str) -> str:
    return "root" if not name else "n_" + re.sub(r"\W", "_", name)


def edges(workflow: Workflow, reads: bool = False) -> list[tuple[str, str, str]]:
    """(from, to, label) of the node graph; gates are labelled, reads are listed on demand."""
    out = [(p, n.name, "flow") for n in workflow.nodes.values() for p in n.parents]
    out += [(g, n.name, "gate") for n in workflow.nodes.values() for g in n.gates]
    if reads:
        out += [(workflow.output_of(r.target), n, r.kind) for n, _, r in workflow.reads() if r.kind != "context"]
    return out


def to_edgelist(workflow: Workflow) -> str:
    return "\n".join(f"{a or 'root'} -> {b} [{label}]" for a, b, label in edges(workflow, True))


def to_mermaid(workflow: Workflow, direction: str = "TD") -> str:
    lines = [f"flowchart {direction}", "    root((root))"]
    for component in workflow.components:
        own = [n for n in workflow.nodes.values() if n.component == component]
        pad = "    " + "    " * (len(own) > 1)
        if len(own) > 1:
            lines.append(f"    subgraph {_id(component)}_parts [{component}]")
        for n in own:
            a, b = BRACKETS.get(n.kind, ("[", "]"))
            label = n.name.replace('"', "#quot;")
            lines.append(f'{pad}{_id(n.name)}{a}"{label}"{b}')
        if len(own) > 1:
            lines.append("    end")
    arrows = {"flow": "-->", "gate": "-. gate .->"}
    lines += [f"    {_id(a)} {arrows.get(label, f'-. {label} .->')} {_id(b)}" for a, b, label in edges(workflow, True)]
    return "\n".join(lines)


def to_dot(workflow: Workflow) -> str:
    lines = [f"digraph {json.dumps(workflow.name)} {{", "  rankdir=TB;", "  root [shape=circle];"]
    lines += [f"  {_id(n.name)} [label={json.dumps(n.name)}, shape={SHAPES.get(n.kind, 'box')}];" for n in workflow.nodes.values()]
    lines += [f"  {_id(a)} -> {_id(b)}" + ("" if label == "flow" else f" [style=dashed, label={json.dumps(label)}]") + ";" for a, b, label in edges(workflow, True)]
    return "\n".join([*lines, "}"])


def to_cytoscape(workflow: Workflow) -> list[dict]:
    """Elements for Cytoscape: nodes below their components, and edges."""
    out = [{"data": {"id": "root", "label": "root", "kind": "root"}}]
    out += [{"data": {"id": f"c_{_id(c)}", "label": c, "kind": "component"}} for c in workflow.components]
    out += [{"data": {"id": _id(n.name), "label": n.name, "kind": n.kind, "parent": f"c_{_id(n.component)}"}} for n in workflow.nodes.values()]
    return out + [{"data": {"id": f"e{i}", "source": _id(a), "target": _id(b), "label": label}} for i, (a, b, label) in enumerate(edges(workflow, True))]


def to_mermaid_sequence(log: DataFrame, root_id: object, limit: int = 200) -> str:
    """The facts of one root fact in causal order. A drawing: at most `limit` facts are shown."""
    rows = log.filter(log["root_id"] == root_id).orderBy("depth", "producer", "pos").limit(limit).collect()
    by = {r["fact_id"]: r["producer"] for r in rows}
    lines = ["sequenceDiagram"] + [f"    participant {_id(p)} as {p}" for p in dict.fromkeys(r["producer"] for r in rows)]
    for r in rows:
        source = by.get(r["parent_id"], r["producer"])
        said = (r["value"] or "").replace("\n", " ")[:60]
        lines.append(f"    {_id(source)}->>{_id(r['producer'])}: {said}")
    return "\n".join(lines)
