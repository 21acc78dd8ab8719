"""Text, resource-name, URI, duration, hash, JSON and collection functions as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.cel.compiler import duration_micros, is_duration


def tidy(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def words(s: Column) -> Column:
    """Words of an identifier: other characters, lower-to-upper steps and the end of an acronym separate."""
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(s, r"[^A-Za-z0-9]+", " "), " "), lambda w: w != "")


def snake(s: Column) -> Column:
    return F.lower(F.array_join(words(s), "_"))


def kebab(s: Column) -> Column:
    return F.lower(F.array_join(words(s), "-"))


def pascal(s: Column) -> Column:
    return F.array_join(F.transform(words(s), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def slugify(s: Column, separator: str = "-") -> Column:
    return F.lower(F.array_join(words(s), separator))


def sanitize_field(s: Column) -> Column:
    s = F.regexp_replace(s, r"[^A-Za-z0-9_]", "_")
    return F.when(s.rlike(r"^\d"), F.concat(F.lit("_"), s)).otherwise(s)


def split_lines(s: Column) -> Column:
    return F.split(s, r"\r?\n")


def regex_groups(s: Column, pattern: str, names: list[str] | None = None) -> Column:
    """Groups of the first match as a map, by the names that the pattern gives them (``(?P<name>``, ``(?<name>``), or by those given in order."""
    pattern = pattern.replace("(?P<", "(?<")
    opened = re.findall(r"(?<!\\)\((?:\?<([A-Za-z]\w*)>|(?!\?))", pattern)
    numbers = {n: i + 1 for i, n in enumerate(names)} if names else {n: i + 1 for i, n in enumerate(opened) if n}
    return F.create_map(*[x for n, i in numbers.items() for x in (F.lit(n), F.regexp_extract(s, pattern, i))])


def trim_enum(s: Column, prefix: str) -> Column:
    return F.regexp_replace(s, f"^{prefix}_?", "")


def add_enum(s: Column, zero: str) -> Column:
    """A name with its enum's prefix, which is the name of number 0 without UNSPECIFIED."""
    return F.concat(F.lit(zero.removesuffix("UNSPECIFIED")), s)


def any_text(c: Column, kind: T.DataType) -> Column:
    """A value as text: floats with six digits, bytes as they are, null as an empty text."""
    out = F.format_string("%.6f", c) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.decode(c, "UTF-8") if isinstance(kind, T.BinaryType) else c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), out), F.lit(""))


#: How a text is scanned for a kind: base and bits. Fixed values.
SCANS = {"int": (10, 64), "uint": (10, 64), "int8": (2, 8), "uint8": (2, 8), "int16": (8, 16), "uint16": (8, 16), "int32": (16, 32), "uint32": (16, 32), "int64": (16, 64), "uint64": (16, 64)}


def scan_value(s: Column, kind: str) -> Column:
    """A text's leading value of a kind (decimal, binary, octal or hexadecimal, see SCANS); null where there is none, or none that fits."""
    if kind == "bool":
        return F.when(s.rlike(r"^\s*(true|false)"), F.ltrim(s).startswith("true"))
    if kind == "string":
        return F.nullif(F.regexp_extract(s, r"^\s*(\S+)", 1), F.lit(""))
    base, bits = SCANS[kind]
    digits = F.regexp_extract(s, r"^\s*[-+]?(" + {2: "[01]", 8: "[0-7]", 10: "[0-9]", 16: "[0-9a-fA-F]"}[base] + "+)", 1)
    sign = F.when(F.ltrim(s).startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    whole = F.when((digits != "") & (F.length(F.ltrim(digits, F.lit("0"))) <= {2: 63, 8: 21, 10: 19, 16: 16}[base]), F.conv(digits, base, 10).try_cast("decimal(20,0)")) * sign
    top = F.lit(str(1 << (bits - 1))).cast("decimal(20,0)")
    return F.when((whole >= -top) & (whole < top), whole.cast("long"))


#: The range of each kind of whole number.
RANGES = {"INT32": (-(1 << 31), (1 << 31) - 1), "INT64": (-(1 << 63), (1 << 63) - 1), "UINT32": (0, (1 << 32) - 1), "UINT64": (0, (1 << 64) - 1)}


def parse_number(s: Column, kind: str) -> Column:
    """The number of a whole text, strictly: null if it isn't one, or is out of the kind's range."""
    if kind in ("FLOAT", "DOUBLE"):
        ok = s.rlike(r"(?i)^[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|inf(inity)?|nan)$")
        return F.when(ok, s.try_cast("float" if kind == "FLOAT" else "double"))
    least, most = RANGES[kind]
    n = F.when(s.rlike(r"^\d+$" if least == 0 else r"^[-+]?\d+$"), s.try_cast("decimal(38,0)"))
    return F.when((n >= F.lit(str(least)).cast("decimal(38,0)")) & (n <= F.lit(str(most)).cast("decimal(38,0)")), n).cast("decimal(20,0)" if kind == "UINT64" else "int" if kind == "INT32" else "long")


def duration_error(s: Column, least: str | None = None, most: str | None = None) -> Column:
    """Why a duration text isn't accepted, or null: it must be above zero, or lie between least and most if they are given."""
    micros = duration_micros(F.when(is_duration(s), s))
    if least is None:
        wrong = F.when(micros <= 0, F.lit("duration must be greater than zero"))
    else:
        wrong = F.when(micros < duration_micros(F.lit(least)), F.lit(f"duration must be greater than: {least}")).when(micros > duration_micros(F.lit(most)), F.lit(f"duration must be less than: {most}"))
    return F.when(~F.coalesce(is_duration(s), F.lit(False)), F.lit("no duration")).otherwise(wrong)


def name_pairs(name: Column) -> Column:
    """(kind, id) pairs of a resource name; an odd tail is dropped."""
    parts = F.split(name, "/")
    n = F.floor(F.size(parts) / 2).cast("int")
    return F.when(n < 1, F.array().cast("array<struct<kind:string,id:string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(parts, i * 2).alias("kind"), F.get(parts, i * 2 + 1).alias("id"))))


def name_parent(name: Column) -> Column:
    pairs = name_pairs(name)
    return F.array_join(F.transform(F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))), lambda p: F.concat_ws("/", p["kind"], p["id"])), "/")


def name_short(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def package_parts(s: Column) -> Column:
    """name@version: name, version, major, minor, patch."""
    v = F.split_part(s, F.lit("@"), F.lit(2))
    part = lambda i: F.nullif(F.regexp_extract(v, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")).cast("int")
    return F.struct(F.split_part(s, F.lit("@"), F.lit(1)).alias("name"), v.alias("version"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def uri_scheme(s: Column) -> Column:
    """The scheme before ``://``, of two characters or more; empty if there is none."""
    return F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]+)://", 1)


#: Fixed value: the parts of an address, all of which may be absent.
URI = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//([A-Za-z0-9.-]+(:\d+)?)?)?(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def uri_valid(s: Column) -> Column:
    return F.coalesce(s.rlike(URI), F.lit(False))


def uri_parts(s: Column) -> Column:
    """scheme (``file`` if there is none), host, path, query and fragment; absent parts are empty."""
    full = F.when(uri_scheme(s) != "", s).otherwise(F.concat(F.lit("file://"), s))
    part = lambda i: F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i)
    return F.struct(*[part(i + 1).alias(n) for i, n in enumerate(("scheme", "host", "path", "query", "fragment"))])


def trim_scheme(s: Column) -> Column:
    return F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]+://", "")


def int_from_text(s: Column) -> Column:
    """Text is cut at its first full stop before it is parsed."""
    return F.split_part(s, F.lit("."), F.lit(1)).cast("bigint")


def int_from_float(x: Column) -> Column:
    """A float is printed with two digits first, so 1.999 gives 2."""
    return F.split_part(F.format_string("%.2f", x), F.lit("."), F.lit(1)).cast("bigint")


def sha256(s: Column) -> Column:
    return F.concat(F.lit("SHA256:"), F.sha2(s, 256))


def sha256_short(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 12)


def fnv1a(s: Column) -> Column:
    """FNV-1a, 64 bits, as hexadecimal text without leading zeros, in native operators: two 32-bit halves, so that products stay below 2^63."""
    low = 0xFFFFFFFF
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("h"), F.lit(0x84222325).cast("bigint").alias("l"))
    octets = F.regexp_extract_all(F.hex(s), F.lit(".."), F.lit(0))

    def step(a, b):  # times 2^40 + 0x1B3
        x = a["l"].bitwiseXOR(F.conv(b, 16, 10).cast("bigint"))
        p = x * 0x1B3
        h = (a["h"] * 0x1B3 + F.shiftright(p, 32) + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8)).bitwiseAND(low)
        return F.struct(h.alias("h"), p.bitwiseAND(low).alias("l"))

    out = F.aggregate(octets, start, step)
    return F.regexp_replace(F.lower(F.concat(F.lpad(F.hex(out["h"]), 8, "0"), F.lpad(F.hex(out["l"]), 8, "0"))), "^0+(?=.)", "")


def fnv1a_short(s: Column, n: int = 12) -> Column:
    """The first n digits, one at least."""
    return F.substring(fnv1a(s), 1, max(1, n))


def canonical_hash(c: Column) -> Column:
    """SHA-256 of a value's JSON text with the keys of all objects sorted."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(F.array(c)))), 256)


def json_path(s: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(s), path, kind)


def without(xs: Column, drop: Column) -> Column:
    """Difference that keeps repeated elements of the rest."""
    return F.filter(xs, lambda x: ~F.array_contains(drop, x))


def merge_maps(a: Column, b: Column) -> Column:
    """The right map wins."""
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def filter_map(xs: Column, keep, value) -> Column:
    return F.transform(F.filter(xs, keep), value)


def from_end(xs: Column, i: int) -> Column:
    return F.try_element_at(xs, F.lit(i + 1 if i >= 0 else i))


# collections


def list_of(*values: Column) -> Column:
    return F.array(*values)


def as_texts(xs: Column, kind: T.DataType) -> Column:
    """A list as texts, see any_text."""
    return F.transform(xs, lambda x: any_text(x, kind))


def count_where(xs: Column, keep) -> Column:
    return F.size(F.filter(xs, keep)).cast("long")


def collected(xs: Column, f) -> Column:
    """A map over a list that goes on after failures: ``values`` of those that f gives a value for, and the places of the ``failed``."""
    tried = F.transform(xs, lambda x, i: F.struct(i.alias("i"), f(x).alias("v")))
    return F.struct(F.transform(F.filter(tried, lambda t: t["v"].isNotNull()), lambda t: t["v"]).alias("values"), F.transform(F.filter(tried, lambda t: t["v"].isNull()), lambda t: t["i"]).alias("failed"))


def all_or_error(xs: Column, f, kind: str, error: str = "failed") -> Column:
    """A map over a list that is an error if f gives null for an element."""
    return F.transform(xs, lambda x: F.coalesce(f(x), F.raise_error(F.lit(error)).cast(kind)))


def map_where(m: Column, keep) -> Column:
    return F.map_filter(m, keep)


def map_to_list(m: Column, f) -> Column:
    """A list of f(key, value), by key."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: f(e["key"], e["value"]))


# ordered maps: lists of (key, value) in the order of insertion


def entry(entries: Column, i: int) -> Column:
    """The entry at a place, from the end if negative; null if there is none."""
    return from_end(entries, i)


def popped(entries: Column) -> Column:
    """The last entry, and the map without it."""
    return F.struct(from_end(entries, -1).alias("entry"), F.slice(entries, F.lit(1), F.greatest(F.size(entries) - 1, F.lit(0))).alias("rest"))


def entry_keys(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def entry_values(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["value"])


def find_entry(entries: Column, test) -> Column:
    """The first entry for which test(key, value) holds."""
    return F.get(F.filter(entries, lambda e: test(e["key"], e["value"])), 0)


def failure_map(index: Column, error: Column) -> Column:
    """An aggregate: the errors of a batch by the place of their request."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(error.isNotNull(), F.struct(index.alias("key"), error.alias("value"))))))
