"""WKB, EWKB and WKT of points, lines and polygons, as array columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT, LINE, POLYGON = 1, 2, 3
NAMES = {POINT: "POINT", LINE: "LINESTRING", POLYGON: "POLYGON"}
RINGS = "array<array<struct<x:double,y:double>>>"


def read(data: bytes) -> tuple[int, int | None, list[list[tuple[float, float]]]]:
    """Kind, SRID (null in plain WKB) and rings; a line or a point is a single ring. Z and M aren't read."""
    order = "<" if data[0] else ">"
    (kind,) = struct.unpack_from(order + "I", data, 1)
    at, srid = 5, None
    if kind & 0xD0000000 & ~0x20000000 or kind & 0xFF not in NAMES:
        raise ValueError(f"geometry of kind {kind:#x}")
    if kind & 0x20000000:
        (srid,) = struct.unpack_from(order + "I", data, at)
        at += 4
    kind &= 0xFF

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        at += 16 * n
        return list(zip(flat[::2], flat[1::2], strict=True))

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    if kind == POINT:
        return kind, srid, [points(1)]
    if kind == LINE:
        return kind, srid, [points(count())]
    return kind, srid, [points(count()) for _ in range(count())]


def write(kind: int, rings: list[list[tuple[float, float]]], srid: int | None = None) -> bytes:
    out = [struct.pack("<BI", 1, kind | (0x20000000 if srid is not None else 0))]
    if srid is not None:
        out.append(struct.pack("<I", srid))
    if kind == POLYGON:
        out.append(struct.pack("<I", len(rings)))
    for ring in rings:
        if kind != POINT:
            out.append(struct.pack("<I", len(ring)))
        out += [struct.pack("<2d", *p) for p in ring]
    return b"".join(out)


def to_text(kind: int, rings: list[list[tuple[float, float]]]) -> str:
    lists = ["(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings]
    return f"{NAMES[kind]}({', '.join(lists)})" if kind == POLYGON else f"{NAMES[kind]}{lists[0]}"


def from_text(text: str) -> tuple[int, list[list[tuple[float, float]]]]:
    name, _, rest = text.strip().partition("(")
    kind = {v: k for k, v in NAMES.items()}[name.strip().upper()]
    body = rest.rstrip()[:-1]
    lists = body.strip()[1:-1].split("),") if kind == POLYGON else [body]
    return kind, [[tuple(map(float, p.split())) for p in ring.strip().strip("()").split(",")] for ring in lists]


def rings_of(column: str | Column) -> Column:
    """The rings of a binary WKB or EWKB column; null stays null."""

    @F.pandas_udf(RINGS)
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [[{"x": x, "y": y} for x, y in ring] for ring in read(bytes(v))[2]])

    return decode(column)


def srid_of(column: str | Column) -> Column:
    """The SRID of an EWKB column; null in plain WKB."""

    @F.pandas_udf("int")
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else read(bytes(v))[1] for v in values], dtype="Int32")

    return decode(column)


def text_of(column: str | Column) -> Column:
    """WKT of a column of a polygon's rings."""

    @F.pandas_udf("string")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else to_text(POLYGON, [[(p["x"], p["y"]) for p in ring] for ring in v]))

    return encode(column)


def polygons_of(column: str | Column, srid: int | None = None) -> Column:
    """WKB (EWKB with an SRID) of a column of rings."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else write(POLYGON, [[(p["x"], p["y"]) for p in ring] for ring in v], srid))

    return encode(column)


def read_copy_text(spark, path: str, schema: str, geometry: str) -> DataFrame:
    """Tab-separated rows with the geometry as hex; `schema` has it as a string, the result as rings."""
    rows = spark.read.csv(path, sep="\t", schema=schema, nullValue="\\N")
    return rows.withColumn(geometry, rings_of(F.unhex(F.col(geometry))))


def geojson(rings: Column, digits: int = 10) -> Column:
    """A GeoJSON polygon as text."""
    pair = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, pair)).alias("coordinates")))
