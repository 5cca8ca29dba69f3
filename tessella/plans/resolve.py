"""resolve(): a polygon layer with overlaps and gaps as a planar partition with attributes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import chaikin
from tessella.functions.kernels import contains_point
from tessella.operators import faces as faces_
from tessella.operators.lines import chains, merged_lines, simplified
from tessella.operators.noding import ENDS, crossings, fine_cell, node, segments_of, touched, whole_lines
from tessella.operators.overlap import assign
from tessella.operators.tables import written

STAGES = ("segments", "nodes", "faces", "attributes")


@dataclass(frozen=True)
class TopologySpec:
    """Snap tolerance in units of the layer; the lattice has tolerance / parts_of_tolerance as its step."""

    tolerance: float
    parts_of_tolerance: int = 20
    srid: int = 0

    @property
    def step(self) -> float:
        return self.tolerance / self.parts_of_tolerance


@dataclass(frozen=True)
class CleanSpec:
    """min_area: smaller faces join the neighbour across their longest edge (0: none do). In square units of the layer.

    simplify_tolerance: lines between nodes lose points nearer to them (0: none do), unless the mean distance of points
    would exceed simplify_max_average_vertex_length (0: no limit). chaikin_rounds: sharp vertices are cut as often; the
    limits are those of functions.geometry.sharp. Nodes where other than two lines meet stay where they are.
    """

    min_area: float = 0.0
    simplify_tolerance: float = 0.0
    simplify_max_average_vertex_length: float = 0.0
    chaikin_rounds: int = 0
    chaikin_max_length: float = 40.0
    chaikin_min_degrees: float = 120.0
    chaikin_max_degrees: float = 240.0
    chaikin_min_steep_degrees: float = 40.0
    chaikin_max_steep_degrees: float = 320.0


@dataclass(frozen=True)
class RunOptions:
    """stop_after: a stage's name; later results stay None. Cells of the joins: cells_across over the longer side at
    least, and more where there are many segments."""

    stop_after: str = "attributes"
    cells_across: int = 64


@dataclass
class Result:
    edges: DataFrame | None = None
    faces: DataFrame | None = None
    attributes: DataFrame | None = None
    rejects: DataFrame | None = None
    origin: tuple[float, float] = (0.0, 0.0)
    options: RunOptions = field(default_factory=RunOptions)


def resolve(polygons: DataFrame, topology: TopologySpec, clean: CleanSpec | None = None, options: RunOptions | None = None, *, pk: str = "pk", rings: str = "rings", fixed: DataFrame | None = None) -> Result:
    """polygons: pk, rings (array of closed rings of points, shell first) and any other columns.

    fixed: points (x, y) that stay nodes when lines are simplified and smoothed.

    Returns faces, edges with the faces at their sides, and attributes: per face all columns of the polygon that covers
    most of its area, if that is over half of it (the largest pk among equals), `others` (pks of further ones over half), `input_is_valid` (true where one covers it,
    false where only the box of an invalid polygon meets it, else null). Rows whose rings are null are read over; rows
    of an invalid ring (not closed, or under four points) lend their lines but never cover a face.
    """
    clean, options = clean or CleanSpec(), options or RunOptions()
    if options.stop_after not in STAGES:
        raise ValueError(f"stop_after is one of {STAGES}")
    source = polygons.where(F.col(rings).isNotNull())
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    box = source.agg(F.min(F.array_min(xs)).alias("x0"), F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(xs)).alias("x1"), F.max(F.array_max(ys)).alias("y1")).first()
    result = Result(options=options)
    if box["x0"] is None:
        box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    x0, y0, step = box["x0"], box["y0"], topology.step
    result.origin = (x0, y0)
    cell = max(1, int(max(box["x1"] - x0, box["y1"] - y0) / step / options.cells_across) + 1)
    lines = segments_of(source.select(F.col(rings).alias("rings")), step, x0, y0)
    if options.stop_after == "segments":
        result.edges = lines
        return result
    lines = written(lines)
    cell = fine_cell(lines, cell)
    noded, result.rejects = node(lines, cell)
    whole, changed = noded, clean.min_area > 0 or clean.simplify_tolerance > 0 or clean.chaikin_rounds > 0
    if clean.simplify_tolerance > 0 or clean.chaikin_rounds > 0:
        # a line between nodes borders two faces at most, so both see the same new line
        noded, result.rejects = node(reshaped(noded, clean, step, fixed_nodes(fixed, x0, y0, step)), cell)
    result.edges = noded
    if options.stop_after == "nodes":
        return result
    cycled = written(faces_.cycles(noded))
    result.faces = written(faces_.faces(cycled, cell))
    result.edges = written(faces_.edges_of(cycled))
    while clean.min_area > 0:
        edges = merge_small(result, clean.min_area / step / step)
        if edges is None:
            break
        cycled = written(faces_.cycles(edges))
        result.faces = written(faces_.faces(cycled, cell))
        result.edges = written(faces_.edges_of(cycled))
    if options.stop_after == "faces":
        return result
    atoms = None
    if changed:
        # faces no longer lie wholly in or outside a polygon: the lines of both part them into pieces that do
        overlay, _ = node(whole.select(*ENDS).unionAll(result.edges.select(*ENDS)).distinct(), cell)
        atoms = written(faces_.faces(written(faces_.cycles(overlay)), cell))
    result.attributes = attributes(result, source, step, cell, pk=pk, rings=rings, atoms=atoms)
    return result


def fixed_nodes(fixed: DataFrame | None, x0: float, y0: float, step: float) -> DataFrame | None:
    """Points (x, y) in units of the layer as nodes of the lattice."""
    if fixed is None:
        return None
    return fixed.select(F.rint((F.col("x") - x0) / step).cast("long").alias("x"), F.rint((F.col("y") - y0) / step).cast("long").alias("y")).distinct()


def reshaped(segments: DataFrame, clean: CleanSpec, step: float, fixed: DataFrame | None = None) -> DataFrame:
    """The segments of the healed lines, simplified and smoothed, on the lattice."""
    lines = merged_lines(chains(segments, fixed))
    if clean.simplify_tolerance > 0:
        lines = simplified(lines, clean.simplify_tolerance / step, clean.simplify_max_average_vertex_length / step)
    if clean.chaikin_rounds > 0:
        limits = {"max_length": clean.chaikin_max_length / step, "min_degrees": clean.chaikin_min_degrees, "max_degrees": clean.chaikin_max_degrees, "min_steep": clean.chaikin_min_steep_degrees, "max_steep": clean.chaikin_max_steep_degrees}
        lines = written(lines.select("chain", "pts")).withColumn("pts", chaikin(F.col("pts"), clean.chaikin_rounds, **limits))
    return written(segments_of(lines.select(F.array("pts").alias("rings")), 1.0))


def merge_small(result: Result, least: float, keep: DataFrame | None = None) -> DataFrame | None:
    """Segments without the longest edge of each face under `least` (lattice units); null when there is none to remove.

    A longest edge between a face and the outside goes as well: the face is then no face any more, and its area is lost.
    keep: faces (column face) that are never removed.
    """
    small = result.faces.where(F.col("area2") < 2 * least).select("face", "area2")
    if keep is not None:
        small = small.join(keep.select("face"), "face", "left_anti")
    length = F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2))
    sides = result.edges.where("left <> right")
    sides = sides.select("x1", "y1", "x2", "y2", F.col("left").alias("face"), length.alias("l")).unionAll(sides.select("x1", "y1", "x2", "y2", "right", length))
    longest = sides.join(small, "face").groupBy("face").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("l", (-F.col("x1")).alias("a"), (-F.col("y1")).alias("b"), (-F.col("x2")).alias("c"), (-F.col("y2")).alias("d"))).alias("e"))
    longest = written(longest)
    if longest.isEmpty():
        return None
    return written(result.edges.select("x1", "y1", "x2", "y2").join(longest.select("e.*").distinct(), ["x1", "y1", "x2", "y2"], "left_anti"))


def lattice_polygons(source: DataFrame, step: float, origin: tuple[float, float], *, pk: str, rings: str) -> DataFrame:
    """pk, rings (flat, on the lattice), sound (closed rings of four points at least) and box of every polygon."""
    x0, y0 = origin
    lattice = F.transform(rings, lambda r: F.flatten(F.transform(r, lambda p: F.array(F.rint((p["x"] - x0) / step), F.rint((p["y"] - y0) / step)))))
    sound = ~F.exists(rings, lambda r: (F.size(r) < 4) | (F.get(r, 0) != F.element_at(r, -1)))
    p = source.select(F.col(pk).alias("pk"), lattice.alias("rings"), sound.alias("sound"))
    xs, ys = F.flatten(F.transform("rings", lambda r: F.filter(r, lambda v, i: i % 2 == 0))), F.flatten(F.transform("rings", lambda r: F.filter(r, lambda v, i: i % 2 == 1)))
    return p.select("pk", "rings", "sound", F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def in_boxes(rows: DataFrame, cell: int) -> DataFrame:
    """Rows once for each cell that their box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return rows.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))


def holders(points: DataFrame, areas: DataFrame, cell: int, name: str, *, alike: bool = False) -> DataFrame:
    """points (face, ix, iy) with `name` of every area (name, flat rings, box) that has the point inside.

    alike: many areas have the same rings, which are looked at once.
    """
    at = points.select("face", "ix", "iy", F.floor(F.col("ix") / cell).alias("cx"), F.floor(F.col("iy") / cell).alias("cy"))
    form = ("rings", "xmin", "ymin", "xmax", "ymax")
    shapes = areas.select(name, *form)
    if alike:
        shapes = written(shapes.groupBy(*form).agg(F.collect_set(name).alias("names")))
    near = at.join(in_boxes(shapes, cell), ["cx", "cy"]).where("ix between xmin and xmax and iy between ymin and ymax")
    if alike:
        return near.where(contains_point("rings", "ix", "iy")).select("face", F.explode("names").alias(name)).distinct()
    return near.where(contains_point("rings", "ix", "iy")).select("face", name).distinct()


def shares(faces: DataFrame, polygons: DataFrame, cell: int, atoms: DataFrame | None = None) -> DataFrame:
    """face, pk, share of the face's area that the polygons of that pk cover, where they cover some.

    atoms: faces of the noded lines of both, each of which lies in one face and wholly in or outside each polygon. Without
    them the faces are those of the polygons' own noded lines.
    """
    covered = holders(faces if atoms is None else atoms, polygons.where("sound"), cell, "pk", alike=True)
    if atoms is None:
        return covered.withColumn("share", F.lit(1.0))
    flat = faces.select(F.col("face").alias("of"), F.col("rings").cast("array<array<double>>").alias("rings"), "xmin", "ymin", "xmax", "ymax")
    placed = holders(atoms, flat, cell, "of").join(atoms.select("face", "area2"), "face").join(covered, "face")
    sums = placed.groupBy(F.col("of").alias("face"), "pk").agg(F.sum("area2").alias("part"))
    return sums.join(faces.select("face", "area2"), "face").select("face", "pk", (F.col("part") / F.col("area2")).alias("share"))


def attributes(result: Result, source: DataFrame, step: float, cell: int, *, pk: str, rings: str, atoms: DataFrame | None = None) -> DataFrame:
    p = lattice_polygons(source, step, result.origin, pk=pk, rings=rings)
    best = assign(shares(result.faces, p, cell, atoms))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    invalid = in_boxes(p.where("not sound"), cell).select("cx", "cy", F.col("xmin").alias("a"), F.col("ymin").alias("b"), F.col("xmax").alias("c"), F.col("ymax").alias("d"))
    boxes = result.faces.select("face", "xmin", "ymin", "xmax", "ymax").withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    bad = boxes.join(invalid, ["cx", "cy"]).where("xmin <= c and xmax >= a and ymin <= d and ymax >= b").select("face").distinct().withColumn("bad", F.lit(True))
    out = result.faces.select("face", (F.col("area2") / 2 * step * step).alias("area"), "rings").join(best, "face", "left").join(bad, "face", "left")
    valid = F.when(F.col("pk").isNotNull(), True).when(F.col("bad"), False)
    out = out.select("face", "area", F.col("rings").alias("lattice_rings"), F.col("pk").alias("_pk"), "others", valid.alias("input_is_valid"))
    rest = source.drop(rings).dropDuplicates([pk])
    return out.join(rest, F.col("_pk") == rest[pk], "left").drop("_pk")


def routed(result: Result, *, attribute_mode: bool) -> dict[str, DataFrame]:
    """The tables that a run writes: with attributes at faces and edges face_attributes alone, else one result."""
    return {"face_attributes": result.attributes} if attribute_mode else {"result": result.attributes}


def validate(edges: DataFrame) -> DataFrame:
    """Violations of a noded layer, one row each: segments that cross or touch inside (kind, x1, y1, x2, y2)."""
    rows = written(edges.select("x1", "y1", "x2", "y2"))
    ends = rows.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionAll(rows.select("x2", "y2")).distinct()
    widest = rows.agg(F.max(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or 1
    cell = fine_cell(rows, widest)
    cut = touched(rows, ends, cell).select(F.lit("an end point inside a segment").alias("kind"), "x1", "y1", "x2", "y2")
    zero = F.lit(None).cast("long")
    # where segments of two lines cross, whichever these are
    crossed = crossings(written(whole_lines(rows, joined=False)), cell).select(F.lit("a crossing").alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), zero.alias("x2"), zero.alias("y2"))
    return cut.unionAll(crossed)
