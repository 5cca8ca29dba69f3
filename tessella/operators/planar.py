"""Overlaps and gaps of polygons of any shape, from the faces of their noded lines.

A face of the noded lines lies wholly in or outside each polygon, so which polygons cover its inner point decides all
areas. With the sides of grid cells among the lines, each face lies in one cell as well.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import BOX, box_ring, envelope
from tessella.functions.kernels import clipped_area, flat
from tessella.operators import faces as faces_
from tessella.operators.noding import fine_cell, node, segments_of
from tessella.operators.tables import written


def atoms(polygons: DataFrame, step: float = 1.0, *, cells_across: int = 64, cells: DataFrame | None = None) -> DataFrame:
    """face, area, ix, iy (inner point) and pks (sorted, of the polygons that cover it) of every face.

    polygons: pk and rings. cells: boxes whose sides cut the faces too.
    """
    from tessella.plans.resolve import holders, lattice_polygons

    lines = polygons.select("rings")
    if cells is not None:
        lines = lines.unionAll(cells.select(F.array(box_ring([F.col(c) for c in BOX])).alias("rings")))
    segments = written(segments_of(lines, step))
    far = segments.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in segments.columns]))).first()[0] or 1
    cell = fine_cell(segments, max(1, int(2 * far / cells_across)))
    noded, _ = node(segments, cell)
    whole = written(faces_.faces(written(faces_.cycles(noded)), cell))
    covers = holders(whole, lattice_polygons(polygons, step, (0.0, 0.0), pk="pk", rings="rings").where("sound"), cell, "pk", alike=True)
    lists = covers.groupBy("face").agg(F.sort_array(F.collect_set("pk")).alias("pks"))
    none = F.array().cast(lists.schema["pks"].dataType)
    rows = whole.join(lists, "face", "left").select("face", (F.col("area2") / 2 * step * step).alias("area"), (F.col("ix") * step).alias("ix"), (F.col("iy") * step).alias("iy"), F.coalesce("pks", none).alias("pks"))
    return written(rows)


def in_cell(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with the cell that has their inner point, by way of a lattice as fine as the smallest cell is wide."""
    side = cells.agg(F.min(F.least(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)))
    spread = cells.select("cell", *BOX).withColumn("kx", span("xmin", "xmax")).withColumn("ky", span("ymin", "ymax"))
    at = rows.withColumn("kx", F.floor(F.col("ix") / side)).withColumn("ky", F.floor(F.col("iy") / side))
    return at.join(spread, ["kx", "ky"]).where("ix > xmin and ix < xmax and iy > ymin and iy < ymax").drop("kx", "ky", *BOX)


#: Faces of a tile on an average and of one product, and polygons of one product's rows.
TILE_FACES, BLOCK = 256, 1024


def shared_areas(pks: list, area: np.ndarray):
    """a, b (a < b) and area, in blocks, of those in the lists of faces with these areas."""
    for k in range(0, len(area), TILE_FACES):
        lists, part = pks[k : k + TILE_FACES], np.asarray(area[k : k + TILE_FACES], float)
        names, at = np.unique(np.concatenate(lists), return_inverse=True)
        over = np.zeros((len(names), len(part)))
        over[at, np.repeat(np.arange(len(part)), [len(x) for x in lists])] = 1
        for i in range(0, len(names), BLOCK):
            both = (over[i : i + BLOCK] * part) @ over[i:].T
            x, y = np.nonzero(both)
            x, y = x[x < y], y[x < y]
            yield names[i + x], names[i + y], both[x, y]


def overlap_areas(faces: DataFrame, *by: str) -> DataFrame:
    """a < b (and the columns `by`) with the area that both cover.

    Each tile of the plane adds up its faces, as products of the matrix of polygons and faces, before anything is shuffled.
    """
    rows = faces.where(F.size("pks") > 1).select(*by, "area", "ix", "iy", "pks")
    box = faces.agg(F.count(F.lit(1)).alias("n"), F.min("ix"), F.min("iy"), F.max("ix"), F.max("iy")).first()
    n = max(box["n"], 1)
    tile = max(math.sqrt(((box[3] or 0) - (box[1] or 0)) * ((box[4] or 0) - (box[2] or 0)) / n * TILE_FACES), 1e-9) if box["n"] else 1.0
    kinds = dict(faces.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"{c} {kinds['pks'][6:-1]}" for c in ("a", "b")] + ["area double"])
    names = [*by, "a", "b", "area"]
    place = [*by, "tx", "ty"]

    def run(batches):
        batches = [b.to_pandas() for b in batches if b.num_rows]
        if not batches:
            return
        for key, group in pd.concat(batches).groupby(place, sort=False, dropna=False):
            for a, b, area in shared_areas(group["pks"].tolist(), group["area"].to_numpy()):
                if len(a):
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({**{c: [v] * len(a) for c, v in zip(by, key, strict=False)}, "a": a, "b": b, "area": area})[names], preserve_index=False)

    tiles = rows.select(*by, F.floor(F.col("ix") / tile).alias("tx"), F.floor(F.col("iy") / tile).alias("ty"), "area", "pks")
    found = tiles.repartition(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place).mapInArrow(run, schema)
    return found.groupBy(*by, "a", "b").agg(F.sum("area").alias("area"))


def alike(pieces: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """pieces with one pk for those that cover the same faces of a `by`; and by, pk, own (area) and num (of those alike)."""
    over = pieces.select(by, "face", "area", F.explode("pks").alias("pk"))
    kinds = over.groupBy(by, "pk").agg(F.sort_array(F.collect_list("face")).alias("faces"), F.sum("area").alias("own"))
    kinds = written(kinds.groupBy(by, "faces").agg(F.min("pk").alias("pk"), F.count(F.lit(1)).alias("num"), F.max("own").alias("own")))
    lists = kinds.select(by, "pk", F.explode("faces").alias("face")).groupBy(by, "face").agg(F.sort_array(F.collect_list("pk")).alias("pks"))
    return written(pieces.select(by, "face", "area", "ix", "iy").join(lists, [by, "face"])), kinds.drop("faces")


def find(polygons: DataFrame, cells: DataFrame, step: float = 1.0, *, include_containment: bool = False) -> dict[str, DataFrame]:
    """The detector for polygons of any shape: boundary, overlap, gap and counts by cell (cells: cell and box).

    overlap: cell, a, b, area; pairs of which, inside the cell, one covers the other only with include_containment. gap:
    faces of a cell that no polygon covers; the part of a cell outside the data counts as a gap. counts: per cell both
    numbers, as a text too, the areas, and ok_exit where there is neither.
    """
    pieces = written(in_cell(atoms(polygons, step, cells=cells), cells))
    pairs = overlap_areas(pieces, "cell")
    if not include_containment:
        own = pieces.select("cell", "area", F.explode("pks").alias("pk")).groupBy("cell", "pk").agg(F.sum("area").alias("own"))
        pairs = pairs.join(own.toDF("cell", "a", "own_a"), ["cell", "a"]).join(own.toDF("cell", "b", "own_b"), ["cell", "b"]).where("area < least(own_a, own_b)").select("cell", "a", "b", "area")
    gaps = pieces.where(F.size("pks") == 0).select("cell", "face", "area", "ix", "iy")
    # counted by those that cover the same faces of a cell
    first, kinds = alike(pieces, "cell")
    of = lambda k: kinds.select("cell", F.col("pk").alias(k), F.col("own").alias(f"own_{k}"), F.col("num").alias(f"num_{k}"))
    met = overlap_areas(first, "cell").join(of("a"), ["cell", "a"]).join(of("b"), ["cell", "b"]).select("cell", "area", F.least("own_a", "own_b").alias("own"), (F.col("num_a") * F.col("num_b")).alias("num"))
    if include_containment:
        met = met.unionAll(kinds.where("num > 1").select("cell", F.col("own").alias("area"), "own", F.expr("num * (num - 1) div 2")))
    else:
        met = met.where("area < own")
    over = met.groupBy("cell").agg(F.sum("num").alias("num_overlap"), F.sum(F.col("area") * F.col("num")).alias("overlap_area"))
    none = gaps.groupBy("cell").agg(F.count(F.lit(1)).alias("num_gap"), F.sum("area").alias("gap_area"))
    counts = cells.select("cell").join(over, "cell", "left").join(none, "cell", "left").na.fill(0)
    counts = counts.withColumn("ok_exit", (F.col("num_overlap") == 0) & (F.col("num_gap") == 0)).withColumn("summary", F.format_string("num_rows_overlap:%d, num_rows_gap:%d", "num_overlap", "num_gap"))
    return {"boundary": pieces.where(F.size("pks") > 0), "overlap": pairs, "gap": gaps, "counts": counts}


def clip(polygons: DataFrame, side: float) -> DataFrame:
    """pk, cx, cy and area of every polygon's part in every cell of a lattice where it has an area."""
    rows = polygons.select("pk", flat("rings").alias("rings"), *[c.alias(n) for c, n in zip(envelope(F.flatten("rings")), BOX, strict=True)])
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)))
    rows = rows.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    low, high = lambda c: F.col(c) * side, lambda c: (F.col(c) + 1) * side
    return rows.select("pk", "cx", "cy", clipped_area("rings", low("cx"), low("cy"), high("cx"), high("cy")).alias("area")).where("area > 0")


def equal_groups(polygons: DataFrame) -> DataFrame:
    """first (the smallest pk) and num of every group of polygons whose shells are equal, wherever and whichever way they start."""
    def turned(pts):
        open_ = F.slice(pts, 1, F.size(pts) - 1)
        n = F.size(open_)
        at = F.array_position(open_, F.array_min(open_)).cast("int")
        ahead = F.concat(F.slice(open_, at, n), F.slice(open_, 1, at - 1))
        back = F.reverse(open_)
        at = n + 1 - at
        return F.least(F.to_json(ahead), F.to_json(F.concat(F.slice(back, at, n), F.slice(back, 1, at - 1))))

    shell = F.transform(F.get("rings", 0), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return polygons.select("pk", turned(shell).alias("form")).groupBy("form").agg(F.min("pk").alias("first"), F.count(F.lit(1)).alias("num")).drop("form")
