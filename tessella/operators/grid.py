"""Content-balanced quadtree grids and spatial joins by grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import BOX, boxes_meet

#: A quadtree deeper than this has cells of a millionth of the extent's side.
DEEPEST = 20


def extent(df: DataFrame) -> DataFrame:
    """One row: the box of all boxes."""
    return df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def balanced_grid(df: DataFrame, max_rows: int, min_side: float | None = None, deepest: int = DEEPEST) -> DataFrame:
    """Cells (cell, level, num_rows, box) of a quadtree over df's boxes.

    A cell is split in four while max_rows or more boxes meet it and neither side is below min_side. Boxes on a border
    count in all cells that they touch. Without a min_side it is the mean of the boxes' longer sides: smaller cells don't
    part boxes that lie on each other, and could be far more than the boxes. The boxes are read once for all levels that a round covers: a round counts the
    boxes of the open cells' children only, and they are
    joined to the boxes by their place in the level's lattice.
    """
    spark, box = df.sparkSession, extent(df).first()
    schema = "path string, level int, num_rows long, xmin double, ymin double, xmax double, ymax double"
    if box is None or box["xmin"] is None:
        return spark.createDataFrame([], schema).withColumn("cell", F.lit(0))
    x0, y0, x1, y1 = (float(box[c]) for c in BOX)
    if min_side is None:
        min_side = float(df.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0])
    boxes = df.select(*[F.col(c).cast("double").alias(c) for c in BOX])
    done, opened, counts = [], {(0, 0): ""}, {(0, 0): df.count()}
    for level in range(deepest + 1):
        n = 1 << level
        w, h = (x1 - x0) / n, (y1 - y0) / n
        split = {}
        for (i, j), path in opened.items():
            rows = counts.get((i, j), 0)
            cell = (path, level, rows, x0 + i * w, y0 + j * h, x0 + (i + 1) * w, y0 + (j + 1) * h)
            if rows < max_rows or w < min_side or h < min_side or w == 0 or h == 0 or level == deepest:
                done.append(cell)
            else:
                split |= {(2 * i, 2 * j): path + "0", (2 * i + 1, 2 * j): path + "1", (2 * i, 2 * j + 1): path + "2", (2 * i + 1, 2 * j + 1): path + "3"}
        if not split:
            break
        opened, n = split, 2 * n
        w, h = (x1 - x0) / n, (y1 - y0) / n
        places = boxes.select(F.explode(lattice("xmin", "xmax", x0, w, n)).alias("i"), "ymin", "ymax").select("i", F.explode(lattice("ymin", "ymax", y0, h, n)).alias("j"))
        wanted = spark.createDataFrame(list(opened), "i long, j long")
        counts = {(r.i, r.j): r["count"] for r in places.join(wanted, ["i", "j"], "left_semi").groupBy("i", "j").count().collect()}
    # cells in order of their paths: south-west, south-east, north-west, north-east
    return spark.createDataFrame([(k, *c) for k, c in enumerate(sorted(done), 1)], "cell int, " + schema).drop("path")


def lattice(low: str, high: str, origin: float, side: float, n: int) -> Column:
    """Numbers of the cells that an interval touches, borders included."""
    first = F.ceil((F.col(low) - origin) / side).cast("long") - 1
    last = F.floor((F.col(high) - origin) / side).cast("long")
    return F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1)))


def cells_of(df: DataFrame, side: float) -> DataFrame:
    """Each row once for every cell (cx, cy) of a regular lattice through 0 that its box meets, lower borders included."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor(F.col(b) / side).cast("long")))
    return df.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))


def spatial_join(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """Pairs (aliases a and b) whose boxes meet: an equi-join on lattice cells.

    A pair is taken in one cell only, that of the corner where both boxes begin, so nothing needs to be made distinct.
    """
    a, b = cells_of(left, side).alias("a"), cells_of(right, side).alias("b")
    ca, cb = [F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX]
    home = (F.floor(F.greatest(ca[0], cb[0]) / side) == F.col("a.cx")) & (F.floor(F.greatest(ca[1], cb[1]) / side) == F.col("a.cy"))
    return a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & boxes_meet(ca, cb) & home)
