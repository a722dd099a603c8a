"""Compile a workflow over a DataFrame of root facts.

A frame is a DataFrame whose rows are facts of one grain: the root facts, or the elements of a fan-out
(root_id plus a position for each level). Row-wise nodes only add columns to their frame, so a whole region of steps,
conditions, rules and joins is one projection and one pass. The grain changes at a map (posexplode) and
a reduce (groupBy on the outer grain); only nodes whose parents live in different frames are joined, on
root_id. State is a window over (key, order) where the fold is mergeable; any other fold is an ordered stream of
(key, order, event) alone, whose states are a frame of their own. State may begin with what earlier batches left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.functions.meta import MISSING, Ref, arity
from factloom.operators.components import Node
from factloom.operators.state import EMITTED
from factloom.plans.cuts import matched, written
from factloom.plans.policy import Policy, PolicyRule, merge_policies
from factloom.plans.types import UnresolvedReferenceError, check_schema
from factloom.plans.workflow import Workflow

KEYS = ("k", "seq", "root_id")
#: The labels of facts in the log.
PRODUCED = ("produced", "state_initiated", "state_produced", "reduced")
LABELS = {"step": "produced", "custom": "produced", "join": "produced", "fan_out": "fan_out", "fan_in": "reduced", "accumulator": "state_produced", "fold": "state_produced"}


@dataclass
class Frame:
    """Rows of one grain; positions are the columns that tell the elements of a root fact apart."""

    df: DataFrame
    positions: tuple[str, ...] = ()
    settled: bool = False
    done: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return (*KEYS, *self.positions)

    def add(self, **columns: Column) -> None:
        self.df = self.df.withColumns(columns)

    def window(self, last: int = 0) -> Any:
        order = ["seq", *self.positions]
        return Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


@dataclass
class Out:
    """Where a node's output is: its frame, value column, and the column that says whether it fired."""

    frame: Frame
    value: str
    active: str | None
    node: Node | None
    depth: int
    parents: list[Out] = field(default_factory=list)
    status: str | None = None

    def fired(self) -> Column:
        return F.col(self.active) if self.active else F.lit(True)


def root_facts(df: DataFrame, seq: str, key: str | None = None, value: Column | None = None, root_id: str | None = None) -> DataFrame:
    """Lift rows to root facts: k (the workflow instance), seq (order within it), root_id, value (the
    whole row as a struct by default)."""
    whole = F.struct(*(F.col(c) for c in df.columns)) if value is None else value
    return df.select((F.col(key) if key else F.lit(0)).alias("k"), F.col(seq).alias("seq"), F.col(root_id or seq).alias("root_id"), whole.alias("value"))


class Compiled:
    """The frames and outputs of a workflow over given root facts; everything in it is lazy."""

    def __init__(self, workflow: Workflow, roots: DataFrame, context: dict[str, Any] | None = None, policies: tuple[PolicyRule, ...] = (), mode: str = "merge", max_depth: int | None = None, only: set[str] | None = None, carried: dict[str, DataFrame] | None = None, eager: bool = False, given: dict[str, Out] | None = None) -> None:
        self.workflow = workflow.put_context(context) if context else workflow
        if missing := self.workflow.validate_context():
            raise UnresolvedReferenceError(f"no value for context {', '.join(missing)}")
        self.policies = merge_policies(workflow.policies, tuple(policies), mode)
        if workflow.input_ports:
            for name, port in workflow.input_ports.items():
                schema = roots.schema["value"].dataType
                if isinstance(schema, T.StructType) and name in schema.names:
                    check_schema(port, schema[name].dataType)
        #: component -> (k, n, latest) that earlier batches left: how many facts, and the value of the last one
        self.carried = carried or {}
        self.eager = eager
        self.root = Frame(roots)
        self.outs: dict[str, Out] = {"": Out(self.root, "value", None, None, 0)} | (given or {})
        for node in self.workflow.order():
            if node.name not in self.outs and (max_depth is None or self.workflow.depth(node.name) <= max_depth) and (only is None or node.name in only):
                self.outs[node.name] = self._compile(node)

    def _settle(self, frame: Frame) -> Frame:
        """Before another frame is made of this one: write it if it holds what Python steps made, so that
        they do not run once for each frame."""
        if self.eager and any(c.startswith("r:") for c in frame.df.columns) and not frame.settled:
            frame.df, frame.settled = written(frame.df), True
        return frame

    def materialize(self, on_checkpoint: Callable[[str], None] | None = None) -> Compiled:
        """Evaluate every frame now, and write it; all that is asked for later reads what was written.
        on_checkpoint is called with the name of each frame's first node."""
        for name, out in self.outs.items():
            if not out.frame.done:
                out.frame.df, out.frame.done = written(out.frame.df), True
                if on_checkpoint is not None:
                    on_checkpoint(name)
        return self

    # ---- nodes -----------------------------------------------------------------------------------

    def _compile(self, node: Node) -> Out:
        parents = [self.outs[p] for p in node.parents]
        out: Out = getattr(self, f"_{node.kind}")(node, parents)
        out.parents, out.depth = parents, self.workflow.depth(node.name)
        return out

    def _name(self, node: Node, what: str = "v") -> str:
        return f"{what}:{node.name}".replace(".", "/").replace("`", "")

    def _gated(self, node: Node, parent: Out, extra: Column | None = None) -> str | None:
        """The activity column of a node: its parent's, its gates', and a condition of its own."""
        tests = [F.col(c) for c in ([parent.active] if parent.active else [])]
        tests += [self._bring(self.outs[g], self.outs[g].fired(), parent.frame, f"{node.name}|{g}") for g in node.gates]
        tests += [extra] if extra is not None else []
        if not tests:
            return None
        if len(tests) == 1 and extra is None and parent.active and not node.gates:
            return parent.active
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        name = self._name(node, "a")
        parent.frame.add(**{name: F.coalesce(test, F.lit(False))})
        return name

    def _bring(self, out: Out, column: Column, frame: Frame, tag: str) -> Column:
        """A column of another frame in this one. Frames of a coarser grain are joined on what they share;
        of a finer one, any element that holds counts."""
        if out.frame is frame:
            return column
        if (name := f"b:{tag}".replace(".", "/")) in frame.df.columns:
            return F.coalesce(F.col(f"`{name}`"), F.lit(False))
        shared = [c for c in frame.positions if c in out.frame.positions]
        on = [*KEYS, *shared] if len(shared) == len(out.frame.positions) else [*KEYS]
        self._settle(out.frame)
        other = out.frame.df.groupBy(*on).agg(F.max(column).alias(name)) if len(on) < len(out.frame.keys) else out.frame.df.select(*on, column.alias(name))
        frame.df = matched(frame.df, other, on, "left")
        return F.coalesce(F.col(f"`{name}`"), F.lit(False))

    def _arguments(self, node: Node, parent: Out) -> list[Column]:
        n, value = arity(node.fn), F.col(f"`{parent.value}`")
        if n < 2:
            return [value] * n
        kind = parent.frame.df.schema[parent.value].dataType
        if isinstance(kind, T.StructType):
            return [value[f] for f in kind.names[:n]]
        if isinstance(kind, T.ArrayType):
            return [F.get(value, F.lit(i)) for i in range(n)]
        raise TypeError(f"{node.name} takes {n} values, its input is {kind.simpleString()}")

    def _step(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        active = self._gated(node, parent)
        if node.options.get("returns"):
            return self._python(node, parent, active)
        made = node.fn(*self._arguments(node, parent), **self._reads(node, parent))
        name = self._name(node)
        parent.frame.add(**{name: made if isinstance(made, Column) else F.lit(made)})
        return Out(parent.frame, name, active, node, 0)

    def _python(self, node: Node, parent: Out, active: str | None) -> Out:
        policy = next((r.policy for r in self.policies if r.matches(node.name, self.workflow.components.get(node.component))), Policy())
        values = {k: self._context(node, r) for k, r in node.refs.items() if r.kind == "context"}
        fn = node.fn
        if hooks := self.workflow.around.get(node.component):
            fn = _Hooked(node.component, fn, hooks, self.workflow.get_context(node.component))
        run = F.udf(partial(_run_python, fn=fn, policy=policy, spread=arity(node.fn), values=values), f"struct<value:{node.options['returns']},status:string,error:string,attempts:int>", useArrow=True).asNondeterministic()
        got, value, fired = self._name(node, "r"), self._name(node), self._name(node, "a")
        parent.frame.add(**{got: run(F.col(f"`{parent.value}`"), F.col(active) if active else F.lit(True))})
        parent.frame.add(**{value: F.col(f"`{got}`")["value"], fired: F.coalesce(F.col(f"`{got}`")["status"] == "completed", F.lit(False))})
        return Out(parent.frame, value, fired, node, 0, status=got)

    def _custom(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        name = self._name(node)
        parent.frame.df = node.options["compile"](parent.frame.df, parent.value, name)
        return Out(parent.frame, name, self._gated(node, parent), node, 0)

    def _condition(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        made = node.fn(*self._arguments(node, parent), **self._reads(node, parent))
        made = F.coalesce(made if isinstance(made, Column) else F.lit(made), F.lit(False))
        return Out(parent.frame, parent.value, self._gated(node, parent, made), node, 0)

    def _all_of(self, node: Node, parents: list[Out]) -> Out:
        return Out(parents[0].frame, parents[0].value, self._gated(node, parents[0]), node, 0)

    def _any_of(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        tests = [self._bring(self.outs[g], self.outs[g].fired(), parent.frame, f"{node.name}|{g}") for g in node.gates]
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        name = self._name(node, "a")
        parent.frame.add(**{name: F.coalesce(test & parent.fired(), F.lit(False))})
        return Out(parent.frame, parent.value, name, node, 0)

    def _join(self, node: Node, parents: list[Out]) -> Out:
        """One fact of each parent for the same root fact (and element): columns of one frame, or else an
        equi-join on the grain that the parents share."""
        fields = [f"_{i + 1}" for i in range(len(parents))]
        name = self._name(node)
        if all(p.frame is parents[0].frame for p in parents):
            frame, active = parents[0].frame, None
            if tests := list(dict.fromkeys(p.active for p in parents if p.active)):
                test = F.col(tests[0])
                for t in tests[1:]:
                    test = test & F.col(t)
                active = tests[0] if len(tests) == 1 else self._name(node, "a")
                if len(tests) > 1:
                    frame.add(**{active: test})
            frame.add(**{name: F.struct(*(F.col(f"`{p.value}`").alias(f) for p, f in zip(parents, fields, strict=True)))})
            return Out(frame, name, active, node, 0)
        positions = tuple(c for c in parents[0].frame.positions if all(c in p.frame.positions for p in parents))
        on = [*KEYS, *positions]
        for p in parents:
            self._settle(p.frame)
        sides = [p.frame.df.filter(p.fired()).select(*on, F.col(f"`{p.value}`").alias(f)) for p, f in zip(parents, fields, strict=True)]
        df = sides[0]
        for side in sides[1:]:
            df = matched(df, side, on)
        df = df.select(*on, F.struct(*fields).alias(name))
        return Out(Frame(df, positions), name, None, node, 0)

    def _fan_out(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        frame, value, pos = self._settle(parent.frame), F.col(f"`{parent.value}`"), self._name(node, "p")
        kind = frame.df.schema[parent.value].dataType
        rows = frame.df.filter(parent.fired())
        name = self._name(node)
        if isinstance(kind, T.MapType):
            value, kind = F.map_entries(value), T.ArrayType(T.StringType())
        if isinstance(kind, T.ArrayType):
            # an outer generator, as Catalyst would evaluate a plain one's input once more in a filter of its own
            df = rows.select(*frame.keys, F.posexplode_outer(value).alias(pos, name)).filter(F.col(f"`{pos}`").isNotNull())
        else:  # what cannot be enumerated is consumed
            df = rows.filter(F.lit(False)).select(*frame.keys, F.lit(0).alias(pos), value.alias(name))
        return Out(Frame(df, (*frame.positions, pos)), name, None, node, 0)

    def _fan_in(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        frame, value, name, o = parent.frame, F.col(f"`{parent.value}`"), self._name(node), node.options
        if (inline := self._in_row(node)) is not None:
            return inline
        if not frame.positions:
            kind = frame.df.schema[parent.value].dataType
            if not isinstance(kind, T.ArrayType):
                raise TypeError(f"{node.name} reduces a map or an array, its input is {kind.simpleString()}")
            frame.add(**{name: self._folded(node, parent, value)})
            return Out(frame, name, parent.active, node, 0)
        outer = frame.positions[:-1]
        group = frame.df.groupBy(*KEYS, *outer)
        whole = (F.count(F.when(parent.fired(), 1)) == F.count(F.lit(1))).alias("__whole")
        if o.get("native"):
            made = o["native"](F.when(parent.fired(), value))
            df = group.agg(made.alias("__made"), whole).filter("__whole")
            df = df.select(*KEYS, *outer, _from_init(o, F.col("__made")).alias(name))
            return Out(Frame(df, outer), name, None, node, 0)
        listed = F.array_sort(F.collect_list(F.when(parent.fired(), F.struct(F.col(f"`{frame.positions[-1]}`").alias("pos"), value.alias("x")))))
        df = group.agg(listed.alias("__list"), whole).filter("__whole")
        result = Out(Frame(df, outer), "__list", None, node, 0)
        made = self._folded(node, result, F.transform(F.col("__list"), lambda s: s["x"]))
        result.frame.df = df.select(*KEYS, *outer, made.alias(name))
        result.value = name
        return result

    def _in_row(self, node: Node) -> Out | None:
        """A reduce of elements that only went through steps and joins since their fan-out needs no
        regrouping: they are still one array of one row. None if that is not so."""
        source: list[Node] = []

        def element(name: str, x: Column) -> Any:
            n = self.workflow.nodes.get(name)
            if n is None or n.gates or n.options.get("returns") or any(r.kind != "context" for r in n.refs.values()):
                raise LookupError
            if n.kind == "fan_out":
                source.append(n)
                return x
            if n.kind == "join":
                return [element(p, x) for p in n.parents]
            if n.kind != "step":
                raise LookupError
            below, count = element(n.parents[0], x), arity(n.fn)
            if count > 1 and not isinstance(below, list):
                raise LookupError
            if count < 2 and isinstance(below, list):
                below = F.struct(*(b.alias(f"_{i + 1}") for i, b in enumerate(below)))
            made = n.fn(*(below[:count] if count > 1 else [below] * count), **{k: F.lit(self._context(n, r)) for k, r in n.refs.items()})
            return made if isinstance(made, Column) else F.lit(made)

        def whole(x: Column) -> Column:
            made = element(node.parents[0], x)
            return F.struct(*(b.alias(f"_{i + 1}") for i, b in enumerate(made))) if isinstance(made, list) else made

        try:
            whole(F.lit(None))
        except (LookupError, TypeError):
            return None
        if len({n.name for n in source}) != 1:
            return None
        parent = self.outs[source[0].parents[0]]
        frame, name, o = parent.frame, self._name(node), node.options
        if not isinstance(frame.df.schema[parent.value].dataType, T.ArrayType):
            return None
        array = F.transform(F.col(f"`{parent.value}`"), whole)
        if o.get("native"):
            kind = frame.df.select(array.alias("x")).schema["x"].dataType.elementType
            made = _native_in_row(o["native"], array, kind)
            if made is None:
                return None
            made = _from_init(o, made)
        else:
            made = self._folded(node, parent, array)
        active = self._name(node, "a")
        frame.add(**{name: made, active: F.coalesce(parent.fired() & (F.size(f"`{parent.value}`") > 0), F.lit(False))})
        return Out(frame, name, active, node, 0)

    def _folded(self, node: Node, parent: Out, array: Column) -> Column:
        reads = self._reads(node, parent)
        init = node.options["init"]
        init = init if isinstance(init, Column) else F.lit(init)
        if not node.options.get("stops"):
            return F.aggregate(array, init, lambda acc, x: node.fn(acc, x, **reads))
        start = F.struct(F.lit(False).alias("halted"), init.alias("acc"))
        return F.aggregate(array, start, lambda s, x: F.when(s["halted"], s).otherwise(node.fn(s["acc"], x, **reads)), lambda s: s["acc"])

    def _accumulator(self, node: Node, parents: list[Out]) -> Out:
        (parent,) = parents
        o, frame, name = node.options, parent.frame, self._name(node)
        if o["native"] is None:
            return self._stream(node, parent, Reducer(node.fn, o["init"]), o["state_type"])
        w, seen = frame.window(), F.when(parent.fired(), F.col(f"`{parent.value}`"))
        init = F.lit(o["init"])
        if node.component in self.carried:
            init = F.coalesce(self._carry(node.component, frame)[1], init)
        made = {
            "sum": lambda: init + F.coalesce(F.sum(seen).over(w), F.lit(0)),
            "count": lambda: init + F.count(seen).over(w),
            "min": lambda: F.least(init, F.min(seen).over(w)),
            "max": lambda: F.greatest(init, F.max(seen).over(w)),
            "last": lambda: F.coalesce(F.last(seen, True).over(w), init),
            "collect": lambda: F.collect_list(seen).over(w) if node.component not in self.carried else F.concat(F.coalesce(self._carry(node.component, frame)[1], F.array()), F.collect_list(seen).over(w)),
        }[o["native"]]()
        frame.add(**{name: made})
        return Out(frame, name, parent.active, node, 0)

    def _fold(self, node: Node, parents: list[Out]) -> Out:
        fold = node.options["fold"]
        return self._stream(node, parents[0], fold, node.options["state_type"])

    def _stream(self, node: Node, parent: Out, fold: Any, state_type: str) -> Out:
        frame, name, emitted = self._settle(parent.frame), self._name(node), self._name(node, "e")
        keys = [F.col(f"`{c}`") for c in frame.keys]
        rows = frame.df.filter(parent.fired()).select(*keys, F.col(f"`{parent.value}`").alias("__event"))
        if node.component in self.carried:
            before = self.carried[node.component].select("k", F.col("latest").alias("__before"))
            rows = matched(rows, before, ["k"], "left")
        extra = T.StructType.fromDDL(f"s {state_type}, e {EMITTED}")
        schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField(name, extra[0].dataType), T.StructField(emitted, extra[1].dataType)])
        kinds_out = (*(to_arrow_type(f.dataType) for f in extra), isinstance(extra[0].dataType, T.MapType))
        sort = ["k", "seq", *(f"`{p}`" for p in frame.positions)]
        df = rows.repartition("k").sortWithinPartitions(*sort).mapInArrow(partial(run_stream, fold=fold, state=name, emitted=emitted, kinds=kinds_out), schema)
        return Out(Frame(df, frame.positions), name, None, node, 0)

    def _carry(self, component: str, frame: Frame) -> tuple[Column, Column]:
        """(n, latest) of earlier batches for each row's key, joined to the frame once."""
        n, latest = f"n:{component}", f"l:{component}"
        if n not in frame.df.columns:
            before = self.carried[component].select("k", F.col("n").alias(n), F.col("latest").alias(latest))
            frame.df = matched(frame.df, before, ["k"], "left")
        return F.coalesce(F.col(f"`{n}`"), F.lit(0)), F.col(f"`{latest}`")

    # ---- reads -----------------------------------------------------------------------------------

    def _context(self, node: Node, ref: Ref) -> Any:
        have = self.workflow.get_context(node.component)
        if ref.target in have:
            return have[ref.target]
        if ref.default is MISSING:
            raise UnresolvedReferenceError(f"{node.name}: no value for context {ref.target!r}")
        return ref.default() if callable(ref.default) else ref.default

    def _reads(self, node: Node, parent: Out) -> dict[str, Column]:
        out = {}
        for k, ref in node.refs.items():
            if ref.kind == "context":
                out[k] = F.lit(self._context(node, ref))
                continue
            made = self._read(node, parent.frame, ref)
            for p in ref.path:
                made = made[p]
            out[k] = made
        return out

    def _read(self, node: Node, frame: Frame, ref: Ref) -> Column:
        """State before this fact if the component is not above the reader, else after it."""
        target = self.outs[self.workflow.output_of(ref.target)]
        last = 0 if target.depth < self.workflow.depth(node.name) else -1
        o = target.node.options if target.node else {}
        init = o["fold"].initial() if "fold" in o else o.get("init")
        if target.frame is frame:
            value, fired, w = F.col(f"`{target.value}`"), target.fired(), frame.window(last)
            one = F.when(fired, F.lit(1))
        else:
            value, fired, w, one = self._as_of(node, frame, target, ref, last)
        if target.frame is frame and not last and not target.active and target.node.kind in ("accumulator", "fold") and ref.kind in ("state_of", "latest_value_of"):
            return value  # below a state that every row of the frame has advanced: no window is needed
        before_n, before = F.lit(0), None
        if target.node is not None and target.node.component in self.carried and target.node.kind not in ("condition", "all_of", "any_of"):
            before_n, before = self._carry(target.node.component, frame)
        if ref.kind == "ran_here":
            return F.coalesce(fired, F.lit(False))
        if ref.kind in ("step_ran", "fact_count"):
            n = (before_n + F.coalesce(F.sum(one).over(w), F.lit(0))).cast("long")
            return n > 0 if ref.kind == "step_ran" else n
        seen = F.when(fired, value)
        fact = F.when(fired, F.struct("seq", "root_id", value.alias("value")))
        if ref.kind == "all_values_of":
            return F.collect_list(seen).over(w)
        if ref.kind == "all_facts_of":
            return F.collect_list(fact).over(w)
        if ref.kind == "latest_fact_of":
            return F.last(fact, True).over(w)
        latest = F.last(seen, True).over(w)
        if before is not None:
            latest = F.coalesce(latest, before)
        if ref.kind == "state_of":
            if target.node is None or target.node.kind not in ("accumulator", "fold"):
                return F.lit(None)
            return latest if init is None else F.coalesce(latest, _literal(init, target.frame.df.schema[target.value].dataType))
        return latest

    def _as_of(self, node: Node, frame: Frame, target: Out, ref: Ref, last: int) -> tuple[Column, Column, Any, Column]:
        """The target's last value and count for each root fact, joined to this frame."""
        tag = f"{node.name}|{target.node.name}".replace(".", "/")
        if f"m:{tag}" not in frame.df.columns:
            order = F.struct(*(F.col(f"`{p}`") for p in target.frame.positions)) if target.frame.positions else F.lit(0)
            per = target.frame.df.filter(target.fired()).groupBy(*KEYS).agg(F.max_by(F.col(f"`{target.value}`"), order).alias(f"m:{tag}"), F.count(F.lit(1)).alias(f"c:{tag}"))
            frame.df = matched(frame.df, per, [*KEYS], "left")
        first = F.lit(True)
        for p in frame.positions:
            first = first & (F.col(f"`{p}`") == 0)
        fired = F.col(f"`c:{tag}`").isNotNull()
        return F.col(f"`m:{tag}`"), fired, frame.window(last), F.when(fired & first, F.col(f"`c:{tag}`"))

    # ---- what comes out --------------------------------------------------------------------------

    def value_of(self, name: str, many: bool = False) -> DataFrame:
        """(k, seq, root_id, [positions,] value) of a component's facts."""
        out = self.outs[self.workflow.output_of(name)]
        return out.frame.df.filter(out.fired()).select(*(f"`{c}`" for c in out.frame.keys), F.col(f"`{out.value}`").alias("value"))

    def left_behind(self, name: str) -> DataFrame:
        """(k, n, latest): how many facts a component has made for each key, earlier batches included, and the
        value of the last one. What a later batch takes as carried."""
        out = self.outs[self.workflow.output_of(name)]
        order = F.struct("seq", *(F.col(f"`{p}`") for p in out.frame.positions))
        now = out.frame.df.filter(out.fired()).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.col(f"`{out.value}`"), order).alias("latest"))
        if name not in self.carried:
            return now
        # of two rows of a key the later one has the latest value, and the counts add up
        both = self.carried[name].withColumn("turn", F.lit(0)).unionByName(now.withColumn("turn", F.lit(1)))
        return both.groupBy("k").agg(F.sum("n").alias("n"), F.max_by("latest", "turn").alias("latest"))

    def transitions(self, name: str) -> DataFrame:
        """(k, seq, root_id, [positions,] value, emitted) of a state component: the state after each fact and
        the array of (tag, payload) that the fact made it emit, in one pass."""
        out = self.outs[self.workflow.output_of(name)]
        return out.frame.df.select(*(f"`{c}`" for c in out.frame.keys), F.col(f"`{out.value}`").alias("value"), F.col(f"`{self._name(out.node, 'e')}`").alias("emitted"))

    def emitted(self, name: str) -> DataFrame:
        """(k, seq, root_id, n, tag, payload) of what a state component emitted."""
        out = self.outs[self.workflow.output_of(name)]
        column = f"`{self._name(out.node, 'e')}`"
        return out.frame.df.select(*KEYS, F.posexplode(column).alias("n", "e")).select(*KEYS, "n", "e.tag", "e.payload")

    def facts(self, names: list[str] | None = None, inputs: bool = True, typed: bool = False) -> DataFrame:
        """The fact log: one row per fact, with its lineage. One pass over each frame. Values are JSON texts, or
        as they are if typed, for components whose values have one type.

        fact_id and parent_id are hashes of (producer, root fact, position), so equal values of different
        root facts stay different facts.
        """
        wanted = [o for n, o in self.outs.items() if o.node is None and inputs or o.node is not None and o.node.kind in LABELS and (names is None or o.node.component in names)]
        frames: list[Frame] = []
        for o in wanted:
            if o.frame not in frames:
                frames.append(o.frame)
        if typed and len(kinds := {str(o.frame.df.schema[o.value].dataType) for o in wanted}) > 1:
            raise TypeError(f"values of several types: {', '.join(sorted(kinds))}")
        return _union([self._log(f, [o for o in wanted if o.frame is f], typed) for f in frames])

    def _id(self, out: Out) -> Column:
        where = [F.col(f"`{p}`").cast("string") for p in out.frame.positions]
        return F.xxhash64(F.lit(out.node.name if out.node else "input"), F.col("root_id").cast("string"), F.col("k").cast("string"), *where)

    def _log(self, frame: Frame, outs: list[Out], typed: bool = False) -> DataFrame:
        rows = []
        kinds = frame.df.schema
        where = F.concat_ws(",", *(F.col(f"`{p}`").cast("string") for p in frame.positions))
        for o in outs:
            kind = kinds[o.value].dataType
            text = F.to_json(F.struct(F.col(f"`{o.value}`").alias("v"))) if not isinstance(kind, T.NullType) else F.lit(None).cast("string")
            text = F.col(f"`{o.value}`") if typed else text
            known = [p for p in o.parents if set(p.frame.positions) <= set(frame.positions)]
            rows.append(
                F.struct(
                    o.fired().alias("on"),
                    self._id(o).alias("fact_id"),
                    (self._id(known[-1]) if known else F.lit(None).cast("long")).alias("parent_id"),
                    F.lit(o.node.name if o.node else "input").alias("producer"),
                    F.lit(o.node.component if o.node else "input").alias("component"),
                    F.lit(LABELS[o.node.kind] if o.node else "input").alias("label"),
                    F.lit(o.depth).alias("depth"),
                    text.alias("value"),
                )
            )
        df = frame.df.select("k", "seq", "root_id", where.alias("pos"), F.inline(F.array(*rows)))
        df = df.filter("on").drop("on")
        first = [o for o in outs if o.node is not None and o.node.kind in ("accumulator", "fold")]
        for o in first:
            init = o.node.options["fold"].initial() if "fold" in o.node.options else o.node.options["init"]
            started = frame.df.filter(o.fired()).groupBy("k").agg(F.min_by("root_id", "seq").alias("root_id"), F.min("seq").alias("seq"))
            value = _literal(init, kinds[o.value].dataType)
            value = value if typed else F.to_json(F.struct(value.alias("v")))
            if o.node.component in self.carried:  # initiated in an earlier batch, for these keys
                begun = self.carried[o.node.component].select("k")
                started = started.join(begun, started["k"].eqNullSafe(begun["k"]), "left_anti")
            name = o.node.name
            df = df.unionByName(started.select("k", "seq", "root_id", F.lit("").alias("pos"), F.xxhash64(F.lit(f"{name}#init"), F.col("k").cast("string")).alias("fact_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(name).alias("producer"), F.lit(o.node.component).alias("component"), F.lit("state_initiated").alias("label"), F.lit(o.depth).alias("depth"), value.alias("value")))
        return df

    def productions(self, names: list[str] | None = None, typed: bool = False) -> DataFrame:
        """Facts that components produced: no inputs, no fan-out elements."""
        return self.facts(names, inputs=False, typed=typed).filter(F.col("label").isin(*PRODUCED))

    def productions_by_component(self, parts: int = 1) -> DataFrame:
        """(component, part, values): each component's produced values, as sorted arrays of JSON texts. An array is held
        by one task, so components with many facts go in so many parts, dealt by the facts' ids."""
        part = F.pmod("fact_id", F.lit(parts)).cast("int").alias("part")
        return self.productions().groupBy("component", part).agg(F.array_sort(F.collect_list("value")).alias("values"))

    def reactions(self) -> DataFrame:
        """Inputs and productions, each fact once."""
        return self.facts().filter(F.col("label").isin("input", *PRODUCED)).dropDuplicates(["fact_id"])

    def results(self, names: list[str] | None = None) -> DataFrame:
        """One row per root fact with a column for each name: declared output ports by default, else all
        components. A port of cardinality many, or a component below a map, is an array in order; others
        are the last value."""
        ports = self.workflow.output_ports
        wanted = {n: (ports[n].source or n, ports[n].cardinality) if n in ports else (n, "one") for n in (names or list(ports) or list(self.workflow.components))}
        df, plain, others = self.root.df, {}, []
        for name, (source, many) in wanted.items():
            out = self.outs[self.workflow.output_of(source)]
            value = F.when(out.fired(), F.col(f"`{out.value}`"))
            if out.frame is self.root:
                plain[name] = F.array_compact(F.array(value)) if many == "many" else value
            else:
                if not out.frame.positions:  # one row for each root fact already
                    single = F.col(f"`{out.value}`")
                    others.append((name, out.frame.df.filter(out.fired()).select(*KEYS, (F.array_compact(F.array(single)) if many == "many" else single).alias(name))))
                    continue
                order = F.struct(*(F.col(f"`{p}`") for p in out.frame.positions))
                listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(f"`{out.value}`").alias("x")))), lambda s: s["x"])
                made = listed if many == "many" else F.max_by(F.col(f"`{out.value}`"), order)
                others.append((name, out.frame.df.filter(out.fired()).groupBy(*KEYS).agg(made.alias(name))))
        df = df.select(*KEYS, *(c.alias(n) for n, c in plain.items()))
        for _, other in others:
            df = matched(df, other, [*KEYS], "left")
        return df.select(*KEYS, *wanted)

    def outcomes(self, name: str, also: list[str] | None = None) -> DataFrame:
        """(k, seq, root_id, value, status, error, attempts) of a Python step, completed or not, in one pass;
        also: components of the same frame whose values come along, null where they did not fire."""
        out = self.outs[self.workflow.output_of(name)]
        if not out.status:
            raise UnresolvedReferenceError(f"{name} is no Python step")
        got = F.col(f"`{out.status}`")
        more = [(n, self.outs[self.workflow.output_of(n)]) for n in also or []]
        if any(o.frame is not out.frame for _, o in more):
            raise ValueError("these components are of another grain")
        values = [F.when(o.fired(), F.col(f"`{o.value}`")).alias(n) for n, o in more]
        return out.frame.df.filter(got["attempts"] > 0).select(*KEYS, got["value"].alias("value"), got["status"].alias("status"), got["error"].alias("error"), got["attempts"].alias("attempts"), *values)

    def failures(self) -> DataFrame:
        """(k, seq, root_id, producer, status, error, attempts) of Python steps that did not complete."""
        outs = [o for o in self.outs.values() if o.status]
        if not outs:
            raise UnresolvedReferenceError("the workflow has no Python step")
        return _union([o.frame.df.select(*KEYS, F.lit(o.node.name).alias("producer"), F.col(f"`{o.status}`.status").alias("status"), F.col(f"`{o.status}`.error").alias("error"), F.col(f"`{o.status}`.attempts").alias("attempts")).filter("status in ('failed', 'skipped') and attempts > 0") for o in outs])


def _from_init(options: dict[str, Any], made: Column) -> Column:
    """A native aggregate's result with the initial value; what is null counts for nothing."""
    if options["init"] is None:
        return made
    init = F.lit(options["init"])
    if options.get("combine"):
        return options["combine"](init, made)
    if options["native"] in (F.min, F.max):
        return (F.least if options["native"] is F.min else F.greatest)(init, made)
    return init + F.coalesce(made, F.lit(0))


def _native_in_row(native: Callable[[Column], Column], array: Column, kind: T.DataType) -> Column | None:
    """What a native aggregate makes of an array's elements, nulls ignored; None if it is not known here."""
    known = F.filter(array, lambda x: x.isNotNull())
    if native is F.min:
        return F.array_min(array)
    if native is F.max:
        return F.array_max(array)
    if native is F.count:
        return F.size(known).cast("long")
    if native is F.sum and isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType)):
        to = "bigint" if isinstance(kind, T.IntegralType) else "double"
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(to), lambda a, x: a + x.cast(to)))
    return None


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, Column):
        return value.cast(kind)
    if isinstance(value, dict):
        import json

        return F.from_json(F.lit(json.dumps(value)), kind)
    if isinstance(value, (list, tuple)):
        return F.array(*(F.lit(v) for v in value)).cast(kind)
    return F.lit(value).cast(kind)


def _run_python(value: Any, on: bool, fn: Callable[..., Any], policy: Policy, spread: int, values: dict[str, Any]) -> dict[str, Any]:
    if not on:
        return {"value": None, "status": None, "error": None, "attempts": 0}
    args = [] if spread == 0 else list(value)[:spread] if spread > 1 else [value]
    made, status, error, attempts = policy.run(fn, *args, **values)
    return {"value": made, "status": status, "error": error, "attempts": attempts}


class _Hooked:
    """A Python step's function with its hooks called round it, in the order in which they were attached."""

    def __init__(self, component: str, fn: Callable[..., Any], hooks: tuple, context: dict[str, Any]) -> None:
        self.component, self.fn, self.hooks, self.context = component, fn, hooks, context

    def __call__(self, *args: Any, **values: Any) -> Any:
        event = {"component": self.component, "value": args[0] if len(args) == 1 else args}
        for before, _ in self.hooks:
            if before is not None:
                before(event, self.context)
        made = self.fn(*args, **values)
        for _, after in self.hooks:
            if after is not None:
                after(event | {"result": made}, self.context)
        return made


class Reducer:
    """A plain reducer fn(value, state) as a fold."""

    def __init__(self, fn: Callable[[Any, Any], Any], init: Any) -> None:
        self.fn, self.init = fn, init

    def initial(self) -> Any:
        return self.init

    def advance(self, state: Any, event: Any) -> tuple[Any, list[tuple[str, Any]]]:
        return self.fn(event, state), []


def run_stream(batches: Iterator[pa.RecordBatch], fold: Any, state: str, emitted: str, kinds: tuple[pa.DataType, pa.DataType, bool]) -> Iterator[pa.RecordBatch]:
    """Advance a fold over rows sorted by (k, order): keys, __event, and __before, the state that earlier batches
    left, if there are any. The state starts anew with each k. kinds: the Arrow types of states and of what
    is emitted, and whether states are maps."""
    state_kind, emitted_kind, is_map = kinds
    key, now = object(), None
    for batch in batches:
        states, made = [], []
        before = batch.column("__before").to_pylist() if "__before" in batch.schema.names else [None] * batch.num_rows
        for k, event, start in zip(batch.column("k").to_pylist(), batch.column("__event").to_pylist(), before, strict=True):
            if k != key:
                key, now = k, fold.initial() if start is None else dict(start) if is_map else start
            now, out = fold.advance(now, event)
            states.append(list(now.items()) if is_map and now is not None else now)
            made.append([{"tag": t, "payload": _text(p)} for t, p in out])
        keep = [n for n in batch.schema.names if n not in ("__event", "__before")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(states, state_kind), pa.array(made, emitted_kind)], [*keep, state, emitted])


def _text(payload: Any) -> str:
    import json

    return payload if isinstance(payload, str) else json.dumps(payload, sort_keys=True, default=str)
