"""GeoJSON: codecs, bounding boxes, bounds predicates and geohashes. Boxes and hashes are native Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
GEOMETRY = "type string, coordinates string, geometries array<struct<type:string,coordinates:string>>"


def parse_geometry(s: Column) -> Column:
    return F.from_json(s, GEOMETRY)


def positions(coordinates: Column) -> Column:
    """All [x, y] of a coordinates text of any depth, as an array of arrays."""
    pairs = F.regexp_extract_all(coordinates, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\s*,\s*-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(1))
    return F.transform(pairs, lambda p: F.transform(F.split(p, ","), lambda x: F.trim(x).cast("double")))


def bbox(geometry: Column) -> Column:
    """[minX, minY, maxX, maxY]; null without positions."""
    of = lambda c: F.coalesce(positions(c), F.array().cast("array<array<double>>"))
    nested = F.coalesce(F.flatten(F.transform(geometry["geometries"], lambda g: of(g["coordinates"]))), F.array().cast("array<array<double>>"))
    every = F.concat(of(geometry["coordinates"]), nested)
    x, y = F.transform(every, lambda p: p[0]), F.transform(every, lambda p: p[1])
    return F.when(F.size(every) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def center(box: Column) -> Column:
    return F.struct(((box[0] + box[2]) / 2).alias("lon"), ((box[1] + box[3]) / 2).alias("lat"))


def covers(box: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The bounds cover the box: all of it lies inside."""
    return (box[0] >= x0) & (box[1] >= y0) & (box[2] <= x1) & (box[3] <= y1)


def intersects(box: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return (box[0] <= x1) & (box[2] >= x0) & (box[1] <= y1) & (box[3] >= y0)


def point_within(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def within(box: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The box lies within the bounds, which is what ``covers`` says of the bounds."""
    return covers(box, x0, y0, x1, y1)


#: How bounds are meant: a feature lies in them, touches them, or holds them.
BOUNDS = {"WITHIN": within, "INTERSECTS": intersects, "COVERS": lambda box, x0, y0, x1, y1: (box[0] <= x0) & (box[1] <= y0) & (box[2] >= x1) & (box[3] >= y1)}


def in_bounds(geometry: Column, kind: str, x0: float, y0: float, x1: float, y1: float, centroid: bool = False) -> Column:
    """A geometry's box against bounds; with centroid, the centre of its box instead. Geometries without positions are outside."""
    box = bbox(geometry)
    if centroid:
        c = center(box)
        box = F.array(c["lon"], c["lat"], c["lon"], c["lat"])
    return F.coalesce(BOUNDS[kind](box, x0, y0, x1, y1), F.lit(False))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon's ring: an odd number of its edges cross the ray to the right."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            crossed = crossed + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax)).cast("int")
    return crossed % 2 == 1


def within_ring(geometry: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether all positions of a geometry lie in a ring (exact for points, and for any geometry if the ring is convex)."""
    of = lambda c: F.coalesce(positions(c), F.array().cast("array<array<double>>"))
    every = F.concat(of(geometry["coordinates"]), F.coalesce(F.flatten(F.transform(geometry["geometries"], lambda g: of(g["coordinates"]))), F.array().cast("array<array<double>>")))
    return (F.size(every) > 0) & F.forall(every, lambda p: in_ring(p[0], p[1], ring))


def property_kind(t: T.DataType) -> str | None:
    """The kind of a property by its column's type; whole numbers, lists and messages have none."""
    if isinstance(t, T.StringType):
        return "STRING"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "NUMBER"
    return "BOOLEAN" if isinstance(t, T.BooleanType) else None


def scan(df, geo_field: str, prop_fields: list[str], bounds: tuple | None = None, id_field: str | None = None):
    """``value``: a Feature for each row that lies in the bounds (kind, x0, y0, x1, y1[, centroid]); GeoJSON texts in geo_field."""
    if bounds is not None:
        df = df.where(in_bounds(parse_geometry(F.col(geo_field)), *bounds))
    props = F.struct(*[F.col(f"`{c}`") for c in prop_fields]) if prop_fields else F.create_map().cast("map<string,string>")
    return df.select(feature(F.col(geo_field), props, F.col(id_field).cast("string") if id_field else F.lit(None).cast("string")).alias("value"))


def sources(tables: dict) -> list[tuple[str, str, str]]:
    """(table, column, kind) of the columns whose metadata names a geo type."""
    return [(t, f.name, f.metadata["geo_type"]) for t, df in sorted(tables.items()) for f in df.schema.fields if "geo_type" in f.metadata]


def geohash_uint64(lat: Column, lon: Column) -> Column:
    """The 64-bit interleaved hash as decimal(20,0): longitude bits first."""
    high = _interleave(F.floor((lon + 180) / 360 * (1 << 32)), F.floor((lat + 90) / 180 * (1 << 32)), 31, 16)
    low = _interleave(F.floor((lon + 180) / 360 * (1 << 32)), F.floor((lat + 90) / 180 * (1 << 32)), 15, 16)
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")


def _interleave(x: Column, y: Column, top: int, n: int) -> Column:
    x, y = F.least(x, F.lit((1 << 32) - 1)).cast("bigint"), F.least(y, F.lit((1 << 32) - 1)).cast("bigint")
    out = F.lit(0).cast("bigint")
    for i in range(n):
        bit = top - i
        out = out + F.shiftright(x, bit).bitwiseAND(1) * (1 << (2 * (n - i) - 1)) + F.shiftright(y, bit).bitwiseAND(1) * (1 << (2 * (n - i) - 2))
    return out


def geohash(lat: Column, lon: Column, length: int = 12) -> Column:
    """The base-32 text: five interleaved bits a character."""
    bits = 5 * length
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * float(1 << nx)), F.lit((1 << nx) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * float(1 << ny)), F.lit((1 << ny) - 1)).cast("bigint")
    chars = []
    for k in range(length):
        v = F.lit(0).cast("bigint")
        for j in range(5):
            b = 5 * k + j
            source, at = (x, nx - 1 - b // 2) if b % 2 == 0 else (y, ny - 1 - b // 2)
            v = v * 2 + F.shiftright(source, at).bitwiseAND(1)
        chars.append(F.substring(F.lit(BASE32), (v + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def feature(geometry: Column, properties: Column, id_: Column, box: Column | None = None) -> Column:
    """A GeoJSON Feature text; a numeric id other than 0 is a number, any other a text, and a null id is left out, as is a null box."""
    text = F.to_json(F.array(id_.cast("string")))
    number = F.when(id_.cast("string").rlike("^-?[1-9][0-9]{0,18}$") & id_.cast("string").try_cast("bigint").isNotNull(), id_.cast("string")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))
    ident = F.coalesce(F.concat(F.lit(',"id":'), number), F.lit(""))
    bounds = F.coalesce(F.concat(F.lit(',"bbox":'), F.to_json(box)), F.lit("")) if box is not None else F.lit("")
    return F.concat(F.lit('{"type":"Feature"'), ident, bounds, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def parse_feature(text: Column) -> Column:
    """``id_number, id_text`` (one of them, or none; a numeric text is a number, 0 is none), ``geometry, properties`` (JSON texts), ``bbox``."""
    v = F.try_parse_json(text)
    ident = F.try_variant_get(v, "$.id", "string")
    number = F.nullif(ident.try_cast("bigint"), F.lit(0).cast("bigint"))
    json_of = lambda path: F.nullif(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("null"))
    return F.when(
        F.try_variant_get(v, "$.type", "string") == "Feature",
        F.struct(number.alias("id_number"), F.when(ident.try_cast("bigint").isNull(), ident).alias("id_text"), json_of("$.geometry").alias("geometry"), json_of("$.properties").alias("properties"), F.try_variant_get(v, "$.bbox", "array<double>").alias("bbox")),
    )


def collection_features(text: Column) -> Column:
    """The Feature texts of a FeatureCollection's text."""
    v = F.try_parse_json(text)
    return F.when(F.try_variant_get(v, "$.type", "string") == "FeatureCollection", F.transform(F.try_variant_get(v, "$.features", "array<variant>"), lambda f: F.to_json(f)))


@F.pandas_udf(T.BinaryType())
def to_wkb(geometry: pd.Series) -> pd.Series:
    """Well-known binary (little-endian, XY) of a GeoJSON geometry text; Spark has no such codec enabled."""
    import json
    import struct

    codes = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
    one = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}

    def write(g) -> bytes:
        kind, c = g["type"], g.get("coordinates")
        head = struct.pack("<BI", 1, codes[kind])
        line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p[:2]) for p in ps)
        if kind == "Point":
            return head + struct.pack("<dd", *c[:2])
        if kind == "LineString":
            return head + line(c)
        if kind == "Polygon":
            return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
        parts = g["geometries"] if kind == "GeometryCollection" else [{"type": one[kind], "coordinates": x} for x in c]
        return head + struct.pack("<I", len(parts)) + b"".join(map(write, parts))

    return geometry.map(lambda t: None if t is None else write(json.loads(t)))


@F.pandas_udf(T.StringType())
def from_wkb(data: pd.Series) -> pd.Series:
    """The GeoJSON text of well-known binary."""
    import json
    import struct

    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}

    def read(b, at):
        mark = "<" if b[at] == 1 else ">"
        kind = struct.unpack_from(mark + "I", b, at + 1)[0]
        at += 5

        def points(at):
            n = struct.unpack_from(mark + "I", b, at)[0]
            return [list(struct.unpack_from(mark + "dd", b, at + 4 + 16 * i)) for i in range(n)], at + 4 + 16 * n

        if kind == 1:
            return {"type": "Point", "coordinates": list(struct.unpack_from(mark + "dd", b, at))}, at + 16
        if kind == 2:
            c, at = points(at)
            return {"type": "LineString", "coordinates": c}, at
        n, at, parts = struct.unpack_from(mark + "I", b, at)[0], at + 4, []
        for _ in range(n):
            part, at = points(at) if kind == 3 else read(b, at)
            parts.append(part)
        if kind == 3:
            return {"type": "Polygon", "coordinates": parts}, at
        return ({"type": names[kind], "geometries": parts} if kind == 7 else {"type": names[kind], "coordinates": [p["coordinates"] for p in parts]}), at

    return data.map(lambda b: None if b is None else json.dumps(read(bytes(b), 0)[0]))
