"""Flows: a graph of inputs, vars, actions, streams and outputs compiled to Columns over an iteration DataFrame.

A row is one iteration, ordered by ``seq`` within ``by`` (an entity; without it one task orders all rows). A node's value is
one column; a value used twice is computed once, as Catalyst keeps the column. State across iterations is a window:
``getPrev`` is a lag, ``getCount`` a row number, ``cache`` the first non-null value so far, ``start_if`` a running maximum
and ``stop_if`` a running stop after which a stream is at its end.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.cel.compiler import Compiler, Value, names_of
from loomwright.cel.parser import CelError, parse

KINDS = ("connections", "inputs", "vars", "actions", "streams", "outputs")
#: Kinds that an expression of a kind must not refer to; connections and inputs have no expressions.
FORBIDDEN = {"vars": {"connections", "outputs"}, "actions": {"connections", "outputs"}, "streams": {"connections", "outputs"}, "outputs": {"connections"}}
ZERO = {"bool": False, "bytes": b"", "double": 0.0, "float": 0.0, "int64": 0, "uint64": 0, "int32": 0, "uint32": 0, "string": ""}
SPARK = {"bool": "boolean", "bytes": "binary", "double": "double", "float": "float", "int64": "bigint", "uint64": "decimal(20,0)", "int32": "int", "uint32": "bigint", "string": "string"}


class FlowError(ValueError):
    """A flow that can't run: a cycle, a bad reference, a missing value."""


def is_expression(v) -> bool:
    return isinstance(v, str) and v.lstrip(" ").startswith("=") and len(v) - len(v.lstrip(" ")) <= 1


def source(v: str) -> str:
    return v.lstrip(" ")[1:].strip()


def references(node, found: set | None = None) -> set[tuple[str, str]]:
    """(kind, id) of the nodes that a syntax tree selects; only the form kind.id counts."""
    found = set() if found is None else found
    if isinstance(node, (tuple, list)):
        if len(node) == 3 and node[0] == "sel" and isinstance(node[1], tuple) and node[1][0] == "id" and node[1][1] in KINDS:
            found.add((node[1][1], node[2]))
        for x in node:
            references(x, found)
    return found


def texts(spec) -> list[str]:
    """All expressions below a value."""
    if is_expression(spec):
        return [source(spec)]
    if isinstance(spec, dict):
        return [t for k, v in spec.items() if k not in ("id", "connection") for t in texts(v)]
    return [t for v in spec for t in texts(v)] if isinstance(spec, list) else []


@dataclass
class Flow:
    spec: dict
    nodes: dict[tuple[str, str], dict] = field(default_factory=dict)
    edges: dict[tuple[str, str], set] = field(default_factory=dict)

    def __post_init__(self):
        self.spec = self.spec.get("spec", self.spec)
        for kind in KINDS:
            for n in self.spec.get(kind, []):
                if (kind, n["id"]) in self.nodes:
                    raise FlowError(f"two nodes {kind}.{n['id']}")
                self.nodes[kind, n["id"]] = n
        for key, n in self.nodes.items():
            refs = set() if key[0] in ("connections", "inputs") else {r for t in texts(n) for r in references(parse(t))}
            for r in refs:
                if r not in self.nodes:
                    raise FlowError(f"{key[0]}.{key[1]}: no node {r[0]}.{r[1]}")
                if r[0] in FORBIDDEN.get(key[0], ()):
                    raise FlowError(f"{key[0]}.{key[1]} must not refer to {r[0]}")
            self.edges[key] = refs
        self.levels()

    def levels(self) -> list[list[tuple[str, str]]]:
        """Groups in order: a node stands one group after the last that it depends on."""
        level: dict = {}
        rest = dict(self.edges)
        while rest:
            ready = [k for k, needs in rest.items() if all(r in level for r in needs)]
            if not ready:
                raise FlowError("cycle through " + ", ".join(sorted(f"{a}.{b}" for a, b in rest)))
            for k in ready:
                level[k] = max((level[r] + 1 for r in rest[k]), default=0)
            for k in ready:
                del rest[k]
        return [[k for k in self.nodes if level[k] == i] for i in range(max(level.values(), default=-1) + 1)]

    def reduced_edges(self) -> set[tuple]:
        """Edges (from, to) without those that a longer path implies."""
        above: dict = {}
        for group in self.levels():
            for k in group:
                above[k] = set().union(*(above[r] | {r} for r in self.edges[k])) if self.edges[k] else set()
        return {(r, k) for k, refs in self.edges.items() for r in refs if not any(r in above[x] for x in refs if x != r)}


class NodeCompiler(Compiler):
    """CEL with node references: kind.id, with getValue, getPrev and getCount."""

    def __init__(self, df: DataFrame, values: dict[tuple[str, str], Value], window):
        super().__init__(names_of(df.schema))
        self.values, self.window = values, window

    def node_of(self, n):
        if isinstance(n, tuple) and n[0] == "sel" and n[1][0] == "id" and (n[1][1], n[2]) in self.values:
            return n[1][1], n[2]
        return None

    def _sel(self, a, name) -> Value:
        if a[0] == "id" and (a[1], name) in self.values:
            return self.values[a[1], name]
        return super()._sel(a, name)

    def _call(self, target, name, args) -> Value:
        key = self.node_of(target) if target is not None else None
        if key and name == "getValue":
            return self.values[key]
        if key and name == "getPrev":
            v = self.values[key]
            return Value(F.lag(v.col).over(self.window), v.type)
        if key and name == "getCount":
            return Value(F.row_number().over(self.window).cast("decimal(20,0)"), T.DecimalType(20, 0))
        return super()._call(target, name, args)

    def template(self, v) -> Value:
        """A value with expressions inside: text that starts with = is one, lists and maps recurse, the rest is literal."""
        if is_expression(v):
            return self.compile(source(v))
        if isinstance(v, dict):
            parts = [(k, self.template(x)) for k, x in v.items()]
            return Value(F.struct(*[x.col.alias(k) for k, x in parts]), T.StructType([T.StructField(k, x.type) for k, x in parts]))
        if isinstance(v, list):
            parts = [self.template(x) for x in v]
            if len({x.type.simpleString() for x in parts}) > 1:  # a list of several types is one of JSON values
                return Value(F.array(*[F.try_variant_get(F.parse_json(F.to_json(F.array(x.col))), "$[0]", "variant") for x in parts]), T.ArrayType(T.VariantType()))
            return Value(F.array(*[x.col for x in parts]), T.ArrayType(parts[0].type if parts else T.StringType()))
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        return self._lit(v, kind)


def input_column(df: DataFrame, n: dict) -> Value:
    """An input's value: its column, else its default; null means default, zero value (nullable scalar) or an error."""
    kind = n.get("type") or next((k for k in n if k in (*ZERO, "list", "map", "message")), None)
    if kind is None:
        raise FlowError(f"inputs.{n['id']}: no type")
    options = n.get(kind) if isinstance(n.get(kind), dict) else n
    default, nullable = options.get("default"), options.get("nullable", False)
    if kind in ZERO:
        t = T._parse_datatype_string(SPARK[kind])
    elif kind == "list":
        t = T.ArrayType(T._parse_datatype_string(SPARK[options["items"]] if options.get("items") in SPARK else "variant"))
    elif kind == "map":
        t = T.MapType(T._parse_datatype_string(SPARK[options.get("key") or "string"]), T._parse_datatype_string(SPARK[options["value"]]))
    else:
        t = df.schema[n["id"]].dataType if n["id"] in df.columns else T.StringType()
    col = F.col(f"`{n['id']}`").cast(t) if n["id"] in df.columns else F.lit(None).cast(t)
    if default is not None:
        lit = F.array(*[F.lit(x) for x in default]).cast(t) if isinstance(default, list) else F.from_json(F.lit(json.dumps(default)), t) if isinstance(default, dict) else F.lit(default).cast(t)
        col = F.coalesce(col, lit)
    elif nullable:
        col = F.coalesce(col, F.lit(ZERO[kind]).cast(t)) if kind in ZERO else col
    else:
        col = F.coalesce(col, F.raise_error(F.lit(f"inputs.{n['id']} cannot be null")).cast(t))
    return Value(col, T.LongType() if kind in ("int64", "int32", "uint32") else t)


def run(flow: Flow | dict, df: DataFrame, seq: list[str], by: list[str] | None = None, actions: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """``by``, ``seq`` and one column for each output. actions: name -> function of a Value that gives a Column and its type."""
    flow = flow if isinstance(flow, Flow) else Flow(flow)
    order = Window.partitionBy(*(by or [])).orderBy(*seq)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values: dict[tuple[str, str], Value] = {}
    for group in flow.levels():
        for key in group:
            kind, name = key
            n, c = flow.nodes[key], NodeCompiler(df, values, order)
            if kind == "connections":
                continue
            if kind == "inputs":
                v = input_column(df, n)
            elif "switch" in n:
                v = switch(c, n["switch"])
            elif kind == "streams":
                v = gated(c, n, so_far)
            elif kind == "actions":
                v = action(c, n, actions or {})
            elif is_expression(n.get("value")) or kind != "outputs":
                v = c.template(n.get("value"))
            else:
                raise FlowError(f"outputs.{name} must be an expression")
            if n.get("cache"):
                v = Value(F.first(v.col, ignorenulls=True).over(so_far), v.type, v.enum)
            col = f"{kind}__{name}"
            df = df.withColumn(col, v.col)
            if v.eof is not None:
                df = df.withColumn(f"{col}__eof", v.eof)
            values[key] = Value(F.col(col), v.type, v.enum, F.col(f"{col}__eof") if v.eof is not None else None)
    return df.select(*(by or []), *seq, *(keep or []), *[values[k].col.alias(k[1]) for k in flow.nodes if k[0] == "outputs"])


def switch(c: NodeCompiler, s: dict) -> Value:
    """The return of the first case whose value equals (null equals null), else the default."""
    v, out, kind = c.template(s["value"]), None, None
    for case in s.get("cases", []):
        want, then = c.template(case["value"]), c.template(case["return"])
        test = v.col.eqNullSafe(want.col)
        out = F.when(test, then.col) if out is None else out.when(test, then.col)
        kind = kind or then.type
    default = c.template(s["default"]) if "default" in s else None
    if out is None:
        return default
    return Value(out.otherwise(default.col) if default is not None else out, kind)


def action(c: NodeCompiler, n: dict, actions: dict) -> Value:
    """A typed call; null unless run_if is exactly true; on_error replaces a value that failed."""
    if n.get("on_error") is not None:
        c.safe += 1
    v = c.template(n.get("request", n.get("value")))
    if name := n.get("call"):
        if name not in actions:
            raise FlowError(f"actions.{n['id']}: no action {name}")
        v = Value(*actions[name](v))
    if n.get("response") is not None:  # an expression over the answer replaces it
        old, c.names["response"] = c.names.get("response"), v
        v = c.compile(source(n["response"]))
        c.names = {k: x for k, x in c.names.items() if k != "response"} | ({"response": old} if old is not None else {})
    if n.get("on_error") is not None:
        c.safe -= 1
        v = Value(F.coalesce(v.col, c.template(n["on_error"]).col), v.type)
    if n.get("run_if") is not None:
        cond = c.compile(source(n["run_if"]))
        if not isinstance(cond.type, T.BooleanType):
            raise CelError("run_if isn't a bool")
        v = Value(F.when(cond.col, v.col), v.type)
    return v


def gated(c: NodeCompiler, n: dict, so_far) -> Value:
    """A stream's value: null before the first true start_if, and at its end from the first true stop_if on (``isEOF``, null)."""
    v = c.template(n.get("value"))
    open_, ended = F.lit(True), F.lit(False)
    if n.get("stop_if") is not None:
        ended = F.coalesce(F.max(c.compile(source(n["stop_if"])).col).over(so_far), F.lit(False))
        open_ = ~ended
    if n.get("start_if") is not None:
        stop = c.compile(source(n["stop_if"])).col if n.get("stop_if") is not None else F.lit(False)
        open_ = open_ & F.coalesce(F.max(c.compile(source(n["start_if"])).col & ~F.coalesce(stop, F.lit(False))).over(so_far), F.lit(False))
    return Value(F.when(open_, v.col), v.type, v.enum, ended)


def until_done(out: DataFrame, done: str, seq: list[str], by: list[str] | None = None) -> DataFrame:
    """The iterations of a run, with the one whose output ``done`` is the first that isn't null as the last."""
    before = Window.partitionBy(*(by or [])).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col(done).isNotNull()).over(before), F.lit(False))
    return out.withColumn("__ended", ended).where(~F.col("__ended")).drop("__ended")


def expression(df: DataFrame, text: str) -> Column:
    return NodeCompiler(df, {}, None).compile(text).col
