"""jq programs over JSON text, compiled to Columns (VARIANT inside, no Python on executors).

Covered: ``.``, ``.a``, ``."a b"``, ``.[n]`` (negative too), ``.[]``, chains of these, ``p | q``, ``map(p)``, ``select(p op literal)``,
``p // literal``, ``length``, ``keys``, ``first``, ``last``. Anything else is a ValueError when the program is compiled.
A program gives a stream of values: an array of JSON texts. A step that jq refuses at run time (``.a`` of a number) gives null;
text that isn't JSON is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]  # variant to array of variants
TOKEN = re.compile(r'\s*(//|==|!=|<=|>=|[|()<>.\[\]]|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|[A-Za-z_]\w*)')


def _tokens(program: str) -> list[str]:
    out, at = [], 0
    while program[at:].strip():
        m = TOKEN.match(program, at)
        if not m:
            raise ValueError(f"jq: {program[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


def _one(f: Step) -> Step:
    return lambda v: F.array(f(v))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _elements(v: Column) -> Column:
    """Elements of an array, values of an object, else nothing."""
    none = F.array().cast("array<variant>")
    return F.coalesce(_as(v, "array<variant>"), F.map_values(_as(v, "map<string,variant>")), none)


def _length(v: Column) -> Column:
    sizes = [F.size(_as(v, "array<variant>")), F.size(_as(v, "map<string,variant>"))]
    kind = F.schema_of_variant(v)
    sized = F.when(kind.startswith("ARRAY"), sizes[0]).when(kind.startswith("OBJECT"), sizes[1]).when(kind == "STRING", F.length(_as(v, "string")))
    return F.parse_json(F.coalesce(sized.cast("string"), F.when(kind != "BOOLEAN", F.abs(_as(v, "double")).cast("string")), F.lit("0")))


def _keys(v: Column) -> Column:
    names = F.array_sort(F.map_keys(_as(v, "map<string,variant>")))
    places = F.transform(_as(v, "array<variant>"), lambda x, i: i)
    return F.parse_json(F.coalesce(F.to_json(names), F.to_json(places)))


class Parser:
    def __init__(self, program: str):
        self.tokens, self.at = _tokens(program), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if t is None or (wanted and t != wanted):
            raise ValueError(f"jq: {t!r} where {wanted or 'more'!r} was expected")
        self.at += 1
        return t

    def pipe(self) -> Step:
        f = self.alternative()
        while self.peek() == "|":
            self.take()
            f = (lambda a, b: lambda v: F.flatten(F.transform(a(v), b)))(f, self.alternative())
        return f

    def alternative(self) -> Step:
        f = self.term()
        if self.peek() != "//":
            return f
        self.take()
        other = F.parse_json(F.lit(json.dumps(self.literal())))

        def either(v):
            some = F.filter(f(v), lambda x: x.isNotNull() & ~F.schema_of_variant(x).isin("VOID") & ~F.coalesce(_as(x, "string") == "false", F.lit(False)))
            return F.when(F.size(some) > 0, some).otherwise(F.array(other))

        return either

    def literal(self):
        return json.loads(self.take())

    def term(self) -> Step:
        t = self.take()
        if t == ".":
            return self.path()
        if t == "map":
            self.take("(")
            f = self.pipe()
            self.take(")")
            return _one(lambda v: F.parse_json(F.to_json(F.flatten(F.transform(_elements(v), f)))))
        if t == "select":
            self.take("(")
            f, op, value = self.term(), self.take(), self.literal()
            self.take(")")
            return lambda v: F.filter(F.array(v), lambda x: F.coalesce(F.exists(f(x), lambda y: self.compare(y, op, value)), F.lit(False)))
        simple = {"length": _length, "keys": _keys, "first": lambda v: F.get(_as(v, "array<variant>"), 0), "last": lambda v: F.try_element_at(_as(v, "array<variant>"), F.lit(-1))}
        if t in simple:
            return _one(simple[t])
        raise ValueError(f"jq: {t!r}")

    @staticmethod
    def compare(y: Column, op: str, value) -> Column:
        if value is None or op not in ("==", "!=", "<", "<=", ">", ">="):
            raise ValueError(f"jq: {op} {value!r}")
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        named = {"boolean": F.schema_of_variant(y) == "BOOLEAN", "string": F.schema_of_variant(y) == "STRING"}
        same = named.get(kind, F.schema_of_variant(y).rlike("^(BIGINT|DOUBLE|DECIMAL)"))
        a, b = _as(y, kind), F.lit(value)
        result = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return F.when(same, result).otherwise(F.lit(op == "!="))

    def path(self) -> Step:
        steps: list[Step] = []
        t = self.peek()
        first = True
        while t is not None:
            if t == "[":
                self.take()
                if self.peek() == "]":
                    steps.append(_elements)
                else:
                    n = self.literal()
                    if not isinstance(n, int):
                        raise ValueError(f"jq: [{n!r}]")
                    steps.append(_one(lambda v, n=n: F.try_element_at(_as(v, "array<variant>"), F.lit(n + 1 if n >= 0 else n))))
                self.take("]")
            elif t == "." or first and re.match(r'[A-Za-z_"]', t):
                if t == "." and not first:
                    self.take()
                    if self.peek() == "[":
                        t = self.peek()
                        continue
                name = self.take()
                name = json.loads(name) if name[0] == '"' else name
                steps.append(_one(lambda v, name=name: F.try_element_at(_as(v, "map<string,variant>"), F.lit(name))))
            else:
                break
            first, t = False, self.peek()

        def run(v):
            out = F.array(v)
            for s in steps:
                out = F.flatten(F.transform(out, s))
            return out

        return run


def query(text: Column, program: str) -> Column:
    """All values that a program gives, as JSON texts."""
    p = Parser(program)
    f = p.pipe()
    if p.peek() is not None:
        raise ValueError(f"jq: {p.peek()!r}")
    v = F.try_parse_json(text)
    return F.when(v.isNotNull(), F.transform(f(v), lambda x: F.coalesce(F.to_json(x), F.lit("null"))))


def exists(text: Column, program: str) -> Column:
    """Whether a program gives a value that isn't null."""
    return F.coalesce(F.exists(query(text, program), lambda x: x != "null"), F.lit(False))


def equals(text: Column, program: str, wanted) -> Column:
    """Whether a program's first value is the wanted one; false if it gives none."""
    return F.coalesce(value(text, program) == F.to_json(F.parse_json(F.lit(json.dumps(wanted)))), F.lit(False)) if wanted is not None else F.coalesce(value(text, program) == "null", F.lit(False))


def is_null(text: Column, program: str) -> Column:
    return equals(text, program, None)


def is_true(text: Column, program: str) -> Column:
    return equals(text, program, True)


def is_false(text: Column, program: str) -> Column:
    return equals(text, program, False)


def merge(left: Column, right: Column) -> Column:
    """The JSON text of two objects' fields; the right one's win."""
    kind = "map<string,variant>"
    a, b = _as(F.try_parse_json(left), kind), _as(F.try_parse_json(right), kind)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def value(text: Column, program: str) -> Column:
    """The first value, null if there is none."""
    return F.get(query(text, program), 0)
