"""CEL to Columns.

Every value carries a static Spark type, so int and double division, list and map access and timestamps compile to the
right built-in. A CEL error is a Spark ANSI error. Inside ``&&`` and ``||`` operands are compiled with try functions, null
standing for an error: false (true) absorbs it, and only a result that depends on it raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.cel.parser import CelError, parse

ANY = T.NullType()


@dataclass
class Value:
    """A Column, its static type, the names of its enum (number -> name), and whether a stream is at its end."""

    col: Column
    type: T.DataType
    enum: dict | None = None
    eof: Column | None = None


def number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def floating(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


LITERALS = {"int": T.LongType(), "uint": T.DecimalType(20, 0), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType(), "null": T.NullType()}
GETTERS = {
    "getFullYear": lambda c: F.year(c), "getMonth": lambda c: F.month(c) - 1, "getDayOfMonth": lambda c: F.dayofmonth(c) - 1, "getDate": lambda c: F.dayofmonth(c), "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1, "getHours": lambda c: F.hour(c), "getMinutes": lambda c: F.minute(c), "getSeconds": lambda c: F.second(c), "getMilliseconds": lambda c: F.floor(F.date_format(c, "SSS").cast("int")),
}
#: Seconds of each unit of a duration text such as 1h30m.
UNITS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


#: Texts of durations; an empty text and 0 are durations too.
DURATION = r"^[-+]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:h|ms|us|ns|m|s))+$"


def is_duration(text: Column) -> Column:
    return F.trim(text).rlike(DURATION) | F.trim(text).isin("", "0")


def duration_micros(text: Column) -> Column:
    """Microseconds of a duration text; an empty text is 0, a bad one an error."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d*)?|\.\d+)(?:h|ms|us|ns|m|s)"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"(?:\d+(?:\.\d*)?|\.\d+)(h|ms|us|ns|m|s)"), F.lit(1))
    scale = F.create_map(*[x for u, s in UNITS.items() for x in (F.lit(u), F.lit(float(s) * 1e6))])
    total = F.aggregate(F.zip_with(parts, units, lambda p, u: p.cast("double") * F.element_at(scale, u)), F.lit(0.0), lambda a, x: a + x)
    ok = is_duration(text)
    sign = F.when(F.trim(text).startswith("-"), -1.0).otherwise(1.0)
    return F.when(ok, F.round(sign * total).cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad duration: "), text)).cast("long"))


class Compiler:
    """names: root variables with their Columns and types."""

    def __init__(self, names: dict[str, Value]):
        self.names = names
        self.safe = 0

    def compile(self, text: str) -> Value:
        return self.visit(parse(text))

    def visit(self, node) -> Value:
        return getattr(self, f"_{node[0]}")(*node[1:])

    def _lit(self, value, kind) -> Value:
        t = LITERALS[kind]
        return Value(F.lit(value) if kind in ("null", "bytes") else F.lit(value).cast(t), t)

    def _id(self, name) -> Value:
        if name not in self.names:
            raise CelError(f"undeclared reference to {name!r}")
        return self.names[name]

    def field_name(self, t: T.StructType, name: str) -> str:
        """A field by its name, or by its snake or camel case alias."""
        plain = name.replace("_", "").lower()
        for f in t.fields:
            if f.name == name:
                return f.name
        for f in t.fields:
            if f.name.replace("_", "").lower() == plain:
                return f.name
        raise CelError(f"no such field {name!r}")

    def _sel(self, a, name) -> Value:
        v = self.visit(a)
        if isinstance(v.type, T.StructType):
            real = self.field_name(v.type, name)
            return Value(v.col.getField(real), v.type[real].dataType, v.type[real].metadata.get("enum"))
        if isinstance(v.type, T.MapType):
            return self.key(v, F.lit(name))
        raise CelError(f"no field {name!r} in {v.type.simpleString()}")

    def key(self, m: Value, k: Column) -> Value:
        if self.safe:
            return Value(F.try_element_at(m.col, k), m.type.valueType)
        return Value(F.when(F.map_contains_key(m.col, k), F.try_element_at(m.col, k)).otherwise(F.raise_error(F.concat(F.lit("no such key: "), k.cast("string"))).cast(m.type.valueType)), m.type.valueType)

    def _idx(self, a, b) -> Value:
        v, i = self.visit(a), self.visit(b)
        if isinstance(v.type, T.ArrayType):
            at = (i.col + 1).cast("int")
            return Value(F.get(v.col, i.col.cast("int")) if self.safe else F.element_at(v.col, F.when(i.col < 0, F.lit(2**31 - 1)).otherwise(at)), v.type.elementType)
        if isinstance(v.type, T.MapType):
            return self.key(v, i.col.cast(v.type.keyType))
        if isinstance(v.type, T.StructType) and b[0] == "lit":
            return self._sel(a, b[1])
        raise CelError("no index")

    def _un(self, op, a) -> Value:
        v = self.visit(a)
        return Value(~v.col, v.type) if op == "!" else Value(-v.col, v.type)

    def _if(self, c, a, b) -> Value:
        cond, x, y = self.visit(c), self.visit(a), self.visit(b)
        if not isinstance(cond.type, T.BooleanType):
            raise CelError("condition isn't a bool")
        t = y.type if isinstance(x.type, T.NullType) else x.type
        return Value(F.when(cond.col, x.col).otherwise(y.col), t)

    def _list(self, items) -> Value:
        vs = [self.visit(i) for i in items]
        kinds = {v.type.simpleString() for v in vs}
        t = vs[0].type if vs else T.StringType()
        if len(kinds) > 1:
            t = T.StringType()
            vs = [Value(v.col.cast("string"), t) for v in vs]
        return Value(F.array(*[v.col for v in vs]) if vs else F.array().cast(T.ArrayType(t)), T.ArrayType(t))

    def _map(self, pairs) -> Value:
        ks, vs = [self.visit(k) for k, _ in pairs], [self.visit(v) for _, v in pairs]
        t = T.MapType(ks[0].type if ks else T.StringType(), vs[0].type if vs else T.StringType())
        return Value(F.create_map(*[x.col for p in zip(ks, vs, strict=True) for x in p]) if ks else F.create_map().cast(t), t)

    def _msg(self, name, fields) -> Value:
        vs = [(n, self.visit(v)) for n, v in fields]
        t = T.StructType([T.StructField("type", T.StringType()), *[T.StructField(n, v.type) for n, v in vs]])
        return Value(F.struct(F.lit(name).alias("type"), *[v.col.alias(n) for n, v in vs]), t)

    def _bin(self, op, a, b) -> Value:
        if op in ("&&", "||"):
            self.safe += 1
            x, y = self.visit(a), self.visit(b)
            self.safe -= 1
            if not (isinstance(x.type, T.BooleanType) and isinstance(y.type, T.BooleanType)):
                raise CelError(f"{op} needs bools")
            out = x.col & y.col if op == "&&" else x.col | y.col
            return Value(out if self.safe else F.coalesce(out, F.raise_error(F.lit(f"error in {op}")).cast("boolean")), T.BooleanType())
        x, y = self.visit(a), self.visit(b)
        if op in ("==", "!="):
            same = x.col.eqNullSafe(y.col)
            return Value(same if op == "==" else ~same, T.BooleanType())
        if op == "in":
            if isinstance(y.type, T.MapType):
                return Value(F.map_contains_key(y.col, x.col), T.BooleanType())
            return Value(F.array_contains(y.col, x.col), T.BooleanType())
        if op in ("<", "<=", ">", ">="):
            return Value({"<": x.col < y.col, "<=": x.col <= y.col, ">": x.col > y.col, ">=": x.col >= y.col}[op], T.BooleanType())
        return self.arithmetic(op, x, y)

    def arithmetic(self, op: str, x: Value, y: Value) -> Value:
        if op == "+" and isinstance(x.type, (T.StringType, T.BinaryType, T.ArrayType)):
            if type(x.type) is not type(y.type):
                raise CelError("no matching overload for +")
            return Value(F.concat(x.col, y.col), x.type)
        if isinstance(x.type, (T.TimestampType, T.TimestampNTZType)) or isinstance(x.type, T.DayTimeIntervalType):
            t = x.type if isinstance(y.type, T.DayTimeIntervalType) or op != "-" else T.DayTimeIntervalType()
            return Value(x.col + y.col if op == "+" else x.col - y.col, y.type if op == "+" and isinstance(x.type, T.DayTimeIntervalType) else t)
        if not (number(x.type) and number(y.type)):
            raise CelError(f"no matching overload for {op}")
        if floating(x.type) != floating(y.type):
            raise CelError(f"no matching overload for {op}: int and double don't mix")
        if floating(x.type):
            if op == "%":
                raise CelError("no matching overload for %")
            if op == "/":  # IEEE: a division by zero is an infinity or no number
                zero = F.when(x.col == 0, F.lit(float("nan"))).when(x.col > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
                return Value(F.when(y.col == 0, zero).otherwise(F.try_divide(x.col, y.col)), T.DoubleType())
            return Value({"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}[op], T.DoubleType())
        t = x.type if isinstance(x.type, T.DecimalType) else T.LongType()
        l, r = x.col.cast(t), y.col.cast(t)
        if self.safe:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": lambda a, b: F.when(b != 0, F.call_function("div", a, b)), "%": F.try_mod}[op](l, r)
        else:
            out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.call_function("div", a, b), "%": lambda a, b: a % b}[op](l, r)
        return Value(out.cast(t), t)

    # calls

    def macro(self, v: Value, name: str, args) -> Value:
        items = Value(F.map_keys(v.col), T.ArrayType(v.type.keyType)) if isinstance(v.type, T.MapType) else v
        if not isinstance(items.type, T.ArrayType) or args[0][0] != "id":
            raise CelError(f"{name} needs a list and a variable")
        inner, kinds = args[0][1], {}

        def run(node, key):
            def body(x):
                old = self.names.get(inner)
                self.names[inner] = Value(x, items.type.elementType)
                out = self.visit(node)
                if old is None:
                    del self.names[inner]
                else:
                    self.names[inner] = old
                kinds[key] = out.type
                return out.col

            return body

        if name == "filter":
            return Value(F.filter(items.col, run(args[1], 0)), items.type)
        if name == "exists":
            return Value(F.exists(items.col, run(args[1], 0)), T.BooleanType())
        if name == "all":
            return Value(F.forall(items.col, run(args[1], 0)), T.BooleanType())
        if name in ("exists_one", "existsOne"):
            return Value(F.size(F.filter(items.col, run(args[1], 0))) == 1, T.BooleanType())
        if name == "sortBy":
            pairs = F.transform(items.col, lambda x: F.struct(run(args[1], 0)(x).alias("k"), x.alias("v")))
            return Value(F.transform(F.array_sort(pairs), lambda p: p["v"]), items.type)
        source = F.filter(items.col, run(args[1], 1)) if len(args) == 3 else items.col
        out = F.transform(source, run(args[-1], 0))
        return Value(out, T.ArrayType(kinds[0]))

    def _call(self, target, name, args) -> Value:
        if name == "has" and target is None:
            return self.present(args[0])
        if target is not None and target[0] == "id" and target[1] in ("base64", "strings", "lists", "proto") and target[1] not in self.names:
            return self.spaced(target[1], name, [self.visit(a) for a in args])
        if target is not None and name in ("filter", "exists", "all", "exists_one", "existsOne", "map", "sortBy"):
            return self.macro(self.visit(target), name, args)
        if name == "format" and target is not None and args and args[0][0] == "list":
            return self.formatted(target, args[0][1])
        if name == "flatten" and target is not None:
            if args and args[0][0] != "lit":
                raise CelError("flatten needs a literal depth")
            return self._call_flatten(self.visit(target), args[0][1] if args else 1)
        if name == "enumName" and target is None and len(args) in (1, 2):
            if len(args) == 2 and args[1][0] != "lit":
                raise CelError("enumName needs a literal flag")
            return self.enum_name(self.visit(args[0]), bool(args[1][1]) if len(args) == 2 else False)
        vs = [self.visit(a) for a in ([target] if target is not None else []) + list(args)]
        f = getattr(self, f"f_{name}", None)
        if f is not None:
            return f(*vs)
        if name in GETTERS:
            return self.getter(name, *vs)
        raise CelError(f"undeclared function {name!r}")

    def present(self, node) -> Value:
        if node[0] != "sel":
            raise CelError("has() needs a field")
        v = self.visit(node[1])
        if isinstance(v.type, T.MapType):
            return Value(F.map_contains_key(v.col, F.lit(node[2])), T.BooleanType())
        return Value(v.col.getField(self.field_name(v.type, node[2])).isNotNull(), T.BooleanType())

    def spaced(self, space: str, name: str, vs: list[Value]) -> Value:
        if (space, name) == ("base64", "encode"):
            return Value(F.base64(vs[0].col.cast("binary")), T.StringType())
        if (space, name) == ("base64", "decode"):
            return Value(F.unbase64(vs[0].col), T.BinaryType())
        if (space, name) == ("lists", "range"):
            n = vs[0].col
            return Value(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(T.LongType()))
        if (space, name) == ("strings", "quote"):
            s = F.replace(F.replace(vs[0].col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
            for raw, mark in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
                s = F.replace(s, F.lit(raw), F.lit(mark))
            return Value(F.concat(F.lit('"'), s, F.lit('"')), T.StringType())
        raise CelError(f"undeclared function {space}.{name}")

    def getter(self, name, v: Value, tz: Value | None = None) -> Value:
        if isinstance(v.type, T.DayTimeIntervalType):
            micros = interval_micros(v.col)
            return Value(F.call_function("div", micros, F.lit({"getHours": 3_600_000_000, "getMinutes": 60_000_000, "getSeconds": 1_000_000, "getMilliseconds": 1000}[name]).cast("long")), T.LongType())
        c = v.col if tz is None else F.from_utc_timestamp(v.col.cast("timestamp"), tz.col)
        return Value(GETTERS[name](c).cast("long"), T.LongType())

    def f_size(self, v):
        c = F.octet_length(v.col) if isinstance(v.type, T.BinaryType) else F.length(v.col) if isinstance(v.type, T.StringType) else F.size(v.col)
        return Value(c.cast("long"), T.LongType())

    f_contains = lambda self, s, x: Value(s.col.contains(x.col), T.BooleanType())
    f_startsWith = lambda self, s, x: Value(s.col.startswith(x.col), T.BooleanType())
    f_endsWith = lambda self, s, x: Value(s.col.endswith(x.col), T.BooleanType())
    f_matches = lambda self, s, x: Value(F.regexp_like(s.col, x.col), T.BooleanType())
    f_dyn = lambda self, v: v
    f_type = lambda self, v: Value(F.lit(type_name(v.type)), T.StringType())

    def f_int(self, v):
        if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
            return Value(F.unix_timestamp(v.col.cast("timestamp")), T.LongType())
        return Value(v.col.try_cast("bigint") if self.safe else v.col.cast("bigint"), T.LongType())

    def f_uint(self, v):
        c = v.col.cast("decimal(20,0)")
        return Value(F.when(c >= 0, c).otherwise(F.raise_error(F.lit("uint overflow")).cast("decimal(20,0)")), T.DecimalType(20, 0))

    def f_double(self, v):
        return Value(v.col.try_cast("double") if self.safe else v.col.cast("double"), T.DoubleType())

    def f_string(self, v):
        return Value(F.decode(v.col, "UTF-8") if isinstance(v.type, T.BinaryType) else v.col.cast("string"), T.StringType())

    f_bytes = lambda self, v: Value(F.encode(v.col, "UTF-8"), T.BinaryType())
    f_bool = lambda self, v: Value(v.col.cast("boolean"), T.BooleanType())
    f_timestamp = lambda self, v: Value(v.col.cast("timestamp"), T.TimestampType())
    f_now = lambda self: Value(F.current_timestamp(), T.TimestampType())

    def f_duration(self, v):
        return Value(F.make_dt_interval(secs=(duration_micros(v.col) / 1_000_000).cast("decimal(18,6)")), T.DayTimeIntervalType())

    def f_charAt(self, s, i):
        return Value(F.substring(s.col, (i.col + 1).cast("int"), F.lit(1)), T.StringType())

    def f_indexOf(self, s, x, at=None):
        start = F.lit(1) if at is None else (at.col + 1).cast("int")
        return Value(F.call_function("locate", x.col, s.col, start).cast("long") - 1, T.LongType())

    def f_lastIndexOf(self, s, x, upto=None):
        if upto is not None:  # occurrences that start at upto or before
            s = Value(F.substring(s.col, F.lit(1), (upto.col + F.length(x.col)).cast("int")), s.type)
        at = F.call_function("locate", F.reverse(x.col), F.reverse(s.col))
        return Value(F.when(at == 0, F.lit(-1)).otherwise(F.length(s.col) - at - F.length(x.col) + 1).cast("long"), T.LongType())

    f_lowerAscii = lambda self, s: Value(F.translate(s.col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), T.StringType())
    f_upperAscii = lambda self, s: Value(F.translate(s.col, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), T.StringType())

    def f_replace(self, s, a, b, n=None):
        if n is None:
            return Value(F.replace(s.col, a.col, b.col), T.StringType())
        # the first n occurrences: split at all, join the first n with the new text and the others with the old
        parts = F.split(s.col, F.concat(F.lit("\\Q"), a.col, F.lit("\\E")))
        k = F.least(n.col.cast("int"), F.size(parts) - 1)
        k = F.when(n.col < 0, F.size(parts) - 1).otherwise(k)
        head, tail = F.slice(parts, F.lit(1), k), F.slice(parts, k + 1, F.size(parts))
        return Value(F.concat(F.array_join(F.transform(head, lambda x: F.concat(x, b.col)), ""), F.aggregate(F.slice(tail, F.lit(2), F.size(parts)), F.element_at(tail, 1), lambda acc, x: F.concat(acc, a.col, x))), T.StringType())

    def f_split(self, s, sep, n=None):
        quoted = F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))
        return Value(F.split(s.col, quoted) if n is None else F.when(n.col == 0, F.array().cast("array<string>")).otherwise(F.call_function("split", s.col, quoted, n.col.cast("int"))), T.ArrayType(T.StringType()))

    def f_join(self, l, sep=None):
        return Value(F.when(F.size(l.col) == 0, F.lit("")).otherwise(F.call_function("array_join", l.col, sep.col if sep else F.lit(""))), T.StringType())

    def f_substring(self, s, a, b=None):
        end = F.length(s.col) if b is None else b.col
        return Value(F.substring(s.col, (a.col + 1).cast("int"), (end - a.col).cast("int")), T.StringType())

    f_trim = lambda self, s: Value(F.regexp_replace(s.col, r"^[\s\u0085   -     　]+|[\s\u0085   -     　]+$", ""), T.StringType())
    f_reverse = lambda self, v: Value(F.reverse(v.col), v.type)

    def formatted(self, target, items) -> Value:
        """``format`` with a list literal: %s %d %f %e %x %X %o; %b is binary digits. Arguments keep their own types."""
        text, vs = self.visit(target), [self.visit(i) for i in items]
        if target[0] == "lit":
            kinds = re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([sdfexXob%])", target[1])
            kinds = [k for k in kinds if k != "%"]
            vs = [Value(F.bin(v.col), T.StringType()) if k == "b" and not isinstance(v.type, T.BooleanType) else Value(v.col.cast("string"), T.StringType()) if k in "sb" else v for v, k in zip(vs, kinds, strict=False)]
            text = Value(F.lit(re.sub(r"%b", "%s", target[1])), T.StringType())
        return Value(F.call_function("format_string", text.col, *[v.col for v in vs]), T.StringType())

    def f_slice(self, l, a, b):
        return Value(F.slice(l.col, (a.col + 1).cast("int"), (b.col - a.col).cast("int")), l.type)

    def _call_flatten(self, v: Value, depth: int) -> Value:
        while depth and isinstance(v.type.elementType, T.ArrayType):
            v, depth = Value(F.flatten(v.col), v.type.elementType), depth - 1
        return v

    def enum_name(self, v: Value, trim: bool) -> Value:
        """An enum's name by its number; unknown numbers give an empty text. The prefix is the name of 0 without UNSPECIFIED."""
        if v.enum is None:
            raise CelError("no matching overload for enumName")
        names = {int(k): n for k, n in v.enum.items()}
        prefix = names.get(0, "").removesuffix("UNSPECIFIED") if trim else ""
        table = F.create_map(*[x for k, n in names.items() for x in (F.lit(k).cast("long"), F.lit(n.removeprefix(prefix)))])
        return Value(F.coalesce(F.try_element_at(table, v.col.cast("long")), F.lit("")), T.StringType())

    f_distinct = lambda self, l: Value(F.array_distinct(l.col), l.type)
    f_sort = lambda self, l: Value(F.array_sort(l.col), l.type)

    # URLs
    f_isURL = lambda self, s: Value(F.coalesce(s.col.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"), F.lit(False)), T.BooleanType())
    f_url = lambda self, s: s

    def url_part(self, s, part):
        return Value(F.coalesce(F.try_parse_url(s.col, F.lit(part)), F.lit("")), T.StringType())

    f_getScheme = lambda self, s: self.url_part(s, "PROTOCOL")
    f_getHostname = lambda self, s: self.url_part(s, "HOST")
    f_getHost = lambda self, s: self.url_part(s, "AUTHORITY")
    f_getEscapedPath = lambda self, s: self.url_part(s, "PATH")
    f_getPort = lambda self, s: Value(F.regexp_extract(F.coalesce(F.try_parse_url(s.col, F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1), T.StringType())

    def f_getQuery(self, s):
        pairs = F.filter(F.split(F.coalesce(F.try_parse_url(s.col, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")
        keys = F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1))))
        return Value(F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == k), lambda p: F.split_part(p, F.lit("="), F.lit(2))))), T.MapType(T.StringType(), T.ArrayType(T.StringType())))

    def f_isEOF(self, v):
        if v.eof is not None:
            return Value(v.eof, T.BooleanType())
        return Value(v.col["type"].eqNullSafe(F.lit("EOF")) if isinstance(v.type, T.StructType) and "type" in v.type.names else F.lit(False), T.BooleanType())


def interval_micros(c: Column) -> Column:
    return F.call_function("div", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz") + c), F.lit(1).cast("long"))


def type_name(t: T.DataType) -> str:
    """CEL's name of a type."""
    if number(t):
        return "double" if floating(t) else "uint" if isinstance(t, T.DecimalType) else "int"
    names = {"string": "string", "boolean": "bool", "binary": "bytes", "void": "null_type", "timestamp": "google.protobuf.Timestamp", "timestamp_ntz": "google.protobuf.Timestamp"}
    return "list" if isinstance(t, T.ArrayType) else "map" if isinstance(t, (T.MapType, T.StructType)) else "google.protobuf.Duration" if isinstance(t, T.DayTimeIntervalType) else names.get(t.simpleString(), t.simpleString())


def names_of(schema: T.StructType) -> dict[str, Value]:
    """The columns as variables. A field's metadata may hold the names of its enum: ``{"enum": {"0": "KIND_UNSPECIFIED", ...}}``."""
    return {f.name: Value(F.col(f"`{f.name}`"), T.LongType() if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else f.dataType, f.metadata.get("enum")) for f in schema.fields}


def cel(df, text: str) -> Column:
    """The Column of a CEL expression over the columns of df."""
    return Compiler(names_of(df.schema)).compile(text).col
