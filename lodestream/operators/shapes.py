"""Geometries of all seven kinds: holes, parts, collections, Z and M, as nested columns.

A shape is struct<kind, dims, members: array<struct<kind, parts>>>, where parts are
arrays of rings, rings arrays of points (x, y, z, m; what a shape has not is null):

- a POINT or LINESTRING has one part of one ring, its points;
- a POLYGON has one part: its shell, then its holes;
- a MULTI shape has a part for each point, line or polygon;
- a GEOMETRYCOLLECTION has a member for each of its shapes, all others have one;
- EMPTY has a member without parts, an empty collection no members. A part that is
  EMPTY within a MULTI shape has no rings.

Collections do not nest. ``dims`` is XY, XYZ, XYM or XYZM. Everything is an
expression, so it stays in the JVM and composes with other columns. Null in, null
out; ``path_of`` leads to the kernels of ``geo`` that take one path.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.geo import _segments, covers_point, distance
from lodestream.operators.geo import area as _ring_area
from lodestream.operators.overlay import _let

POINT = "struct<x:double,y:double,z:double,m:double>"
PARTS = f"array<array<array<{POINT}>>>"
MEMBER = f"struct<kind:string,parts:{PARTS}>"
SHAPE = f"struct<kind:string,dims:string,members:array<{MEMBER}>>"
SINGLE = ("POINT", "LINESTRING", "POLYGON")
MULTI = tuple(f"MULTI{k}" for k in SINGLE)
COLLECTION = "GEOMETRYCOLLECTION"

_KIND = "|".join((*MULTI, *SINGLE, COLLECTION))
_HEAD = rf"(?s)^({_KIND})\s*(ZM|Z|M)?\s*(EMPTY|\(.*\))$"


def _once(f):
    """``f`` with its first column computed once, however often it is used."""
    @wraps(f)
    def with_value(shape: Column, *more, **named):
        return _let(shape, lambda s: f(s, *more, **named))

    return with_value


# --- reading text
def _tokens(body: Column) -> Column:
    """A body as JSON: parentheses to brackets, the numbers of a point to one string, EMPTY to an empty array."""
    joined = F.regexp_replace(F.regexp_replace(body, "EMPTY", "()"), r"(?<=[^\s(),])\s+(?=[^\s(),])", ";")
    return F.translate(F.regexp_replace(F.regexp_replace(joined, r"[^\s(),]+", '"$0"'), r"\s+", ""), "()", "[]")


def _nested(kind: Column, text: Column) -> Column:
    """That JSON as parts of rings of points, whatever the kind's own depth."""
    bare = F.regexp_replace(text, r'\[("[^"]*")\]', "$1")  # the points of a MULTIPOINT may have their own parentheses
    deep = (
        F.when(kind.isin("POINT", "LINESTRING"), F.concat(F.lit("[["), text, F.lit("]]")))
        .when(kind == "POLYGON", F.concat(F.lit("["), text, F.lit("]")))
        .when(kind == "MULTIPOINT", F.regexp_replace(F.when(bare.startswith("["), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]"))), r'"[^"]*"', "[[$0]]"))
        .when(kind == "MULTILINESTRING", F.regexp_replace(F.regexp_replace(text, r'\["', '[["'), r'"\]', '"]]'))
        .otherwise(text)
    )
    # in an array of its own, so that anything behind it is another element, or no JSON
    return _let(F.from_json(F.concat(F.lit("["), deep, F.lit("]")), "array<array<array<array<string>>>>"), lambda z: F.when(F.size(z) == 1, F.get(z, F.lit(0))))


def _number(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def _member(text: Column, kinds: tuple[str, ...], given: Column) -> Column:
    """struct(kind, dims, parts, reason) of one shape that is no collection; ``given``: dims of the collection around it, or null."""
    def parsed(head: Column) -> Column:
        kind, body = head["kind"], head["body"]
        empty = body == "EMPTY"
        json = F.when(~empty, _tokens(body))
        strings = F.when(empty, F.array().cast("array<array<array<string>>>")).otherwise(_nested(kind, json))

        def flat(z: Column) -> Column:
            rings = F.flatten(z["strings"])
            return F.struct(z["strings"].alias("strings"), rings.alias("rings"), F.flatten(rings).alias("points"))

        def with_dims(z: Column) -> Column:
            count = F.when(F.size(z["points"]) > 0, F.size(F.split(F.get(z["points"], F.lit(0)), ";")))
            plain = F.when(count == 3, "XYZ").when(count == 4, "XYZM").otherwise("XY")
            undeclared = F.when(count.isNull() & given.isNotNull(), given).otherwise(plain)
            dims = F.when(F.coalesce(head["dims"], F.lit("")) == "", undeclared).otherwise(F.concat(F.lit("XY"), head["dims"]))
            return F.struct(*(z[k].alias(k) for k in ("strings", "rings", "points")), dims.alias("dims"))

        def read(z: Column) -> Column:
            """Whatever is used for each point is a field of ``z``, so that it is computed once."""
            strings, rings, points, dims = (z[k] for k in ("strings", "rings", "points", "dims"))

            def point(s: Column) -> Column:
                def numbered(v: Column) -> Column:
                    at = lambda i: _number(F.get(v, F.lit(i)))
                    return F.struct(at(0).alias("x"), at(1).alias("y"), F.when(dims != "XYM", at(2)).alias("z"), F.when(dims == "XYM", at(2)).otherwise(at(3)).alias("m"))

                return _let(F.split(s, ";"), numbered)

            parts = F.transform(strings, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
            sized = F.forall(points, lambda s: F.size(F.split(s, ";")) == F.length(dims))
            numbers = F.forall(points, lambda s: F.forall(F.split(s, ";"), lambda n: n.rlike(r"^[-+]?[0-9.]+(?:E[-+]?[0-9]+)?$") & _number(n).isNotNull()))
            # what was read must be all there is: as many points as texts between separators, and every parenthesis closed
            whole = F.size(points) == F.size(F.filter(F.split(body, r"[(),]+"), lambda s: (F.trim(s) != "") & (F.trim(s) != "EMPTY")))
            whole &= F.length(F.regexp_replace(body, r"[^(]", "")) == F.length(F.regexp_replace(body, r"[^)]", ""))
            whole &= F.when(empty | ~kind.isin(*SINGLE), True).otherwise((F.size(strings) == 1) & ((kind == "POLYGON") | (F.size(rings) == 1)))
            lines = kind.isin("LINESTRING", "MULTILINESTRING") & F.exists(rings, lambda r: F.size(r) == 1)
            areas = kind.isin("POLYGON", "MULTIPOLYGON")
            short = areas & F.exists(rings, lambda r: (F.size(r) > 0) & (F.size(r) < 4))
            open_ = areas & F.exists(rings, lambda r: (F.size(r) > 0) & (F.get(r, F.lit(0)) != F.get(r, F.size(r) - 1)))
            one = (kind == "POINT") & ~empty & (F.size(points) != 1)
            gap = F.exists(strings, lambda p: p.isNull() | F.exists(p, lambda r: r.isNull() | F.exists(r, lambda s: s.isNull())))
            reason = (
                F.when(~empty & (strings.isNull() | gap | ~whole), "bad nesting")
                .when(~numbers, "bad numbers")
                .when(~sized | (given.isNotNull() & (dims != given)), "mixed dimensions")
                .when(one, "not one point")
                .when(lines | short, "too few points")
                .when(open_, "ring not closed")
            )
            return F.struct(kind.alias("kind"), dims.alias("dims"), parts.alias("parts"), reason.alias("reason"))

        return F.when(kind.isin(*kinds), _let(_let(_let(F.struct(strings.alias("strings")), flat), with_dims), read)).otherwise(_failed(F.when(kind == COLLECTION, "nested collection").otherwise("unknown kind")))

    t = F.trim(text)
    head = F.struct(F.regexp_extract(t, _HEAD, 1).alias("kind"), F.regexp_extract(t, _HEAD, 2).alias("dims"), F.regexp_extract(t, _HEAD, 3).alias("body"))
    return _let(head, parsed)


def _failed(reason: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("dims"), F.lit(None).cast(PARTS).alias("parts"), reason.alias("reason"))


def read_wkt(wkt: Column) -> Column:
    """struct(shape, reason): the shape of a text, or null and why: unknown kind, bad nesting, bad numbers, mixed dimensions, not one point, too few points, ring not closed, nested collection."""
    def of_collection(head: Column) -> Column:
        inner = F.substring(head["body"], F.lit(2), F.length(head["body"]) - 2)
        texts = F.when(head["body"] == "EMPTY", F.array().cast("array<string>")).otherwise(F.split(inner, rf",\s*(?={_KIND})"))
        given = F.when(head["dims"] != "", F.concat(F.lit("XY"), head["dims"]))
        members = F.transform(texts, lambda t: _member(t, SINGLE + MULTI, given))

        def built(z: Column) -> Column:
            bad = F.filter(F.transform(z, lambda m: m["reason"]), lambda r: r.isNotNull())
            dims = F.coalesce(given, F.get(z, F.lit(0))["dims"], F.lit("XY"))
            mixed = F.exists(z, lambda m: m["dims"] != dims)
            reason = F.coalesce(F.get(bad, F.lit(0)), F.when(mixed, "mixed dimensions"))
            shape = F.struct(F.lit(COLLECTION).alias("kind"), dims.alias("dims"), F.transform(z, lambda m: F.struct(m["kind"].alias("kind"), m["parts"].alias("parts"))).alias("members"))
            return F.struct(F.when(reason.isNull(), shape).alias("shape"), reason.alias("reason"))

        return _let(members, built)

    def of_one(m: Column) -> Column:
        shape = F.struct(m["kind"].alias("kind"), m["dims"].alias("dims"), F.array(F.struct(m["kind"].alias("kind"), m["parts"].alias("parts"))).alias("members"))
        return F.struct(F.when(m["reason"].isNull(), shape).alias("shape"), m["reason"].alias("reason"))

    def read(t: Column) -> Column:
        head = F.struct(F.regexp_extract(t, _HEAD, 1).alias("kind"), F.regexp_extract(t, _HEAD, 2).alias("dims"), F.regexp_extract(t, _HEAD, 3).alias("body"))
        none = F.lit(None).cast("string")
        return F.when(t.startswith(COLLECTION), _let(head, lambda h: F.when(h["kind"] == COLLECTION, of_collection(h)).otherwise(F.struct(F.lit(None).cast(SHAPE).alias("shape"), F.lit("bad nesting").alias("reason"))))).otherwise(_let(_member(t, SINGLE + MULTI, none), of_one))

    return F.when(wkt.isNotNull(), _let(F.upper(F.trim(wkt)), read))


def from_wkt(wkt: Column) -> Column:
    """The shape of a text; null where ``read_wkt`` gives a reason."""
    return read_wkt(wkt)["shape"]


# --- writing text
@_once
def to_wkt(shape: Column, precision: int | None = None) -> Column:
    """Canonical text: upper case, no trailing zeros; ``precision``: decimals."""
    dims = shape["dims"]

    def number(v: Column) -> Column:
        v = v if precision is None else F.round(v, precision)
        plain = F.regexp_replace(v.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")  # from ten million on, Spark writes exponents
        return F.when((F.abs(v) >= 1e7) & (F.abs(v) < 1e18), plain).otherwise(F.regexp_replace((v + 0.0).cast("string"), r"\.0(?=E|$)", ""))

    def point(p: Column) -> Column:
        return F.concat_ws(" ", number(p["x"]), number(p["y"]), F.when(dims.contains("Z"), number(p["z"])), F.when(dims.endswith("M"), number(p["m"])))

    listed = lambda texts: F.concat(F.lit("("), F.array_join(texts, ", "), F.lit(")"))
    ring = lambda r: listed(F.transform(r, point))
    part = lambda p, inner: F.when(F.size(p) == 0, F.lit("EMPTY")).otherwise(inner)

    def member(m: Column) -> Column:
        kind, parts = m["kind"], m["parts"]
        first = F.get(parts, F.lit(0))
        polygon = lambda p: listed(F.transform(p, ring))
        body = (
            F.when(F.size(parts) == 0, F.lit("EMPTY"))
            .when(kind == "POLYGON", polygon(first))
            .when(kind.isin("POINT", "LINESTRING"), ring(F.get(first, F.lit(0))))
            .when(kind == "MULTIPOLYGON", listed(F.transform(parts, lambda p: part(p, polygon(p)))))
            .otherwise(listed(F.transform(parts, lambda p: part(p, ring(F.get(p, F.lit(0)))))))
        )
        return F.concat(kind, _suffix(dims), F.lit(" "), body)

    members = F.transform(shape["members"], member)
    collection = F.concat(F.lit(COLLECTION), _suffix(dims), F.lit(" "), F.when(F.size(members) == 0, F.lit("EMPTY")).otherwise(listed(members)))
    return F.when(shape.isNotNull(), F.when(shape["kind"] == COLLECTION, collection).otherwise(F.get(members, F.lit(0))))


def _suffix(dims: Column) -> Column:
    return F.when(dims == "XY", F.lit("")).otherwise(F.concat(F.lit(" "), F.substring(dims, 3, 2)))


# --- building
def _shape(kind, parts: Column, dims=None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    dims = F.lit("XY") if dims is None else dims
    return F.struct(kind.alias("kind"), dims.alias("dims"), F.array(F.struct(kind.alias("kind"), parts.cast(PARTS).alias("parts"))).alias("members"))


def _points(path: Column) -> Column:
    """Points of ``geo`` (x, y) as points of shapes."""
    none = lambda k: F.lit(None).cast("double").alias(k)
    return F.transform(path, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), none("z"), none("m")))


def point_shape(p: Column) -> Column:
    return F.when(p.isNotNull(), _shape("POINT", F.array(F.array(_points(F.array(p))))))


def line_shape(path: Column) -> Column:
    return F.when(path.isNotNull(), _shape("LINESTRING", F.array(F.array(_points(path)))))


def polygon_shape(shell: Column, holes: Column | None = None) -> Column:
    """A shell, and an array of holes, of ``geo`` rings."""
    rings = F.array(_points(shell))
    if holes is not None:
        rings = F.concat(rings, F.transform(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), _points))
    return F.when(shell.isNotNull(), _shape("POLYGON", F.array(rings)))


def multi(shapes: Column) -> Column:
    """An array of shapes of one single kind as its MULTI kind; of several kinds, or of MULTI shapes, as a collection."""
    kinds = F.array_distinct(F.transform(shapes, lambda s: s["kind"]))
    dims = F.coalesce(F.get(shapes, F.lit(0))["dims"], F.lit("XY"))
    one = (F.size(kinds) == 1) & F.get(kinds, F.lit(0)).isin(*SINGLE)
    members = F.flatten(F.transform(shapes, lambda s: s["members"]))
    whole = F.struct(F.lit(COLLECTION).alias("kind"), dims.alias("dims"), members.alias("members"))
    return F.when(shapes.isNotNull(), F.when(one, _shape(F.concat(F.lit("MULTI"), F.get(kinds, F.lit(0))), F.flatten(F.transform(members, lambda m: m["parts"])), dims)).otherwise(whole))


# --- taking apart
def _parts(shape: Column) -> Column:
    """struct(kind, rings) of each part of each member, EMPTY ones too; the kind is a single one."""
    single = lambda m: F.regexp_replace(m["kind"], "^MULTI", "")
    return F.flatten(F.transform(shape["members"], lambda m: F.transform(m["parts"], lambda p: F.struct(single(m).alias("kind"), p.alias("rings")))))


def parts(shape: Column) -> Column:
    """Array of the single shapes that a shape is made of; what is EMPTY has none."""
    return F.transform(F.filter(_parts(shape), lambda p: F.size(p["rings"]) > 0), lambda p: _shape(p["kind"], F.array(p["rings"]), shape["dims"]))


def explode_parts(df: DataFrame, shape: str, output: str = "part", position: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each part; ``outer`` keeps shapes without any, with a null part."""
    found = parts(F.col(shape))
    if position is None:
        return df.withColumn(output, (F.explode_outer if outer else F.explode)(found))
    return df.select("*", (F.posexplode_outer if outer else F.posexplode)(found).alias(position, output))


def path(points: Column) -> Column:
    """Points of a shape as a path of ``geo``."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def path_of(shape: Column) -> Column:
    """The first ring of the first part, for the kernels of ``geo``."""
    return path(F.get(F.get(F.get(shape["members"], F.lit(0))["parts"], F.lit(0)), F.lit(0)))


def rings_of(shape: Column) -> Column:
    """Every ring and line of a shape, as paths of ``geo``."""
    return F.transform(F.flatten(F.transform(_parts(shape), lambda p: p["rings"])), path)


def points_of(shape: Column) -> Column:
    return F.flatten(rings_of(shape))


def _of_kind(shape: Column, kind: str) -> Column:
    return F.filter(_parts(shape), lambda p: p["kind"] == kind)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


# --- accessors and measures
def dimension(shape: Column) -> Column:
    """0, 1 or 2: that of its parts of the highest; a shape without points has that of its kind, an empty collection none."""
    rank = lambda k: F.when(k.endswith("POLYGON"), 2).when(k.endswith("LINESTRING"), 1).otherwise(0)
    return F.array_max(F.transform(shape["members"], lambda m: rank(m["kind"])))


@_once
def accessors(shape: Column) -> Column:
    """struct(type, dims, dim, num_points, num_parts, num_holes, x, y, z, is_empty, is_closed, is_ring, start, end).

    ``x``, ``y`` and ``z`` are those of a point; ``is_closed``, ``is_ring`` (closed and not crossing itself), ``start`` and ``end`` those of a line.
    """
    from lodestream.operators.overlay import diagnostics

    all_points, line = F.flatten(F.flatten(F.transform(_parts(shape), lambda p: p["rings"]))), path_of(shape)
    only = lambda kind, v: F.when((shape["kind"] == kind) & (F.size(all_points) > 0), v)
    first, last = F.get(all_points, F.lit(0)), F.get(all_points, F.size(all_points) - 1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    out = {
        "type": shape["kind"], "dims": shape["dims"], "dim": dimension(shape), "num_points": F.size(all_points), "num_parts": F.size(parts(shape)),
        "num_holes": _sum(F.transform(_of_kind(shape, "POLYGON"), lambda p: F.greatest(F.size(p["rings"]) - 1, F.lit(0)).cast("double"))).cast("int"),
        "x": only("POINT", first["x"]), "y": only("POINT", first["y"]), "z": only("POINT", first["z"]), "is_empty": F.size(all_points) == 0,
        "is_closed": only("LINESTRING", closed), "is_ring": only("LINESTRING", closed & ~diagnostics(line)["crosses_itself"]), "start": only("LINESTRING", first), "end": only("LINESTRING", last),
    }
    return F.when(shape.isNotNull(), F.struct(*(v.alias(k) for k, v in out.items())))


def bounds(shape: Column) -> Column:
    from lodestream.operators.geo import bounds as of_path

    return of_path(points_of(shape))


@_once
def area(shape: Column) -> Column:
    """Planar area: shells less their holes; no part of another kind counts."""
    of_part = lambda p: F.aggregate(F.transform(p["rings"], lambda r, i: F.when(i == 0, _ring_area(path(r))).otherwise(-_ring_area(path(r)))), F.lit(0.0), lambda s, v: s + v)
    return F.when(shape.isNotNull(), _sum(F.transform(_of_kind(shape, "POLYGON"), of_part)))


@_once
def _total_length(shape: Column, kind: str) -> Column:
    rings = F.flatten(F.transform(_of_kind(shape, kind), lambda p: p["rings"]))
    return F.when(shape.isNotNull(), _sum(F.transform(rings, lambda r: _sum(F.transform(_segments(path(r)), lambda s: distance(s["a"], s["b"]))))))


def perimeter(shape: Column) -> Column:
    """Length of all shells and holes."""
    return _total_length(shape, "POLYGON")


def length(shape: Column) -> Column:
    """Length of all lines."""
    return _total_length(shape, "LINESTRING")


@_once
def boundary(shape: Column) -> Column:
    """Of polygons their rings as lines; of lines the places where an odd number of them end; of points, and of collections, an empty collection."""
    rings = F.flatten(F.transform(_of_kind(shape, "POLYGON"), lambda p: p["rings"]))
    lines = F.transform(_of_kind(shape, "LINESTRING"), lambda p: F.get(p["rings"], F.lit(0)))
    ends = F.flatten(F.transform(lines, lambda r: F.when(F.size(r) > 0, F.array(F.get(r, F.lit(0)), F.get(r, F.size(r) - 1))).otherwise(F.array().cast(f"array<{POINT}>"))))
    odd = _let(ends, lambda all_: F.filter(F.array_distinct(all_), lambda p: F.size(F.filter(all_, lambda q: (q["x"] == p["x"]) & (q["y"] == p["y"]))) % 2 == 1))
    of_rings = F.when(F.size(rings) == 1, _shape("LINESTRING", F.array(rings), shape["dims"])).otherwise(_shape("MULTILINESTRING", F.transform(rings, lambda r: F.array(r)), shape["dims"]))
    of_lines = _shape("MULTIPOINT", F.transform(odd, lambda p: F.array(F.array(p))), shape["dims"])
    nothing = F.struct(F.lit(COLLECTION).alias("kind"), shape["dims"].alias("dims"), F.array().cast(f"array<{MEMBER}>").alias("members"))
    return F.when(shape["kind"].endswith("POLYGON"), of_rings).when(shape["kind"].endswith("LINESTRING"), of_lines).when(shape.isNotNull(), nothing)


@_once
def contains_point(shape: Column, p: Column, on_boundary: bool = True) -> Column:
    """Whether a polygonal shape has ``p`` inside: in a shell and in none of its holes. A hole's edge is the shape's boundary."""
    def of_part(part: Column) -> Column:
        shell, holes = path(F.get(part["rings"], F.lit(0))), F.slice(part["rings"], F.lit(2), F.greatest(F.size(part["rings"]) - 1, F.lit(0)))
        return covers_point(shell, p, on_boundary) & ~F.exists(holes, lambda h: covers_point(path(h), p, not on_boundary))

    return F.when(shape.isNotNull() & p.isNotNull(), F.exists(F.filter(_of_kind(shape, "POLYGON"), lambda z: F.size(z["rings"]) > 0), of_part))


def collected(df: DataFrame, by: list[str], shape: str, output: str = "shape") -> DataFrame:
    """One MULTI shape or collection of each group, in order of text. A group is one row, as a geometry is; nothing is merged."""
    grouped = df.where(F.col(shape).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(to_wkt(F.col(shape)).alias("t"), F.col(shape).alias("s")))).alias("_all"))
    return grouped.select(*by, multi(F.transform("_all", lambda z: z["s"])).alias(output))
