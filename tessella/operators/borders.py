"""Lines along grid cells: who owns them, which edges lie on attributed lines, frames of cells, and grids over grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.grid import balanced_grid, cells_of
from tessella.operators.noding import in_cells, spread
from tessella.operators.tables import written

ENDS = ("x1", "y1", "x2", "y2")


def boxed(lines: DataFrame, by: float = 0.0) -> DataFrame:
    """Segments with their boxes, grown by a distance."""
    low, high = lambda a, b: F.least(a, b) - by, lambda a, b: F.greatest(a, b) + by
    return lines.select("*", low("x1", "x2").alias("xmin"), low("y1", "y2").alias("ymin"), high("x1", "x2").alias("xmax"), high("y1", "y2").alias("ymax"))


def left_over_borders(lines: DataFrame, side: float, *, across: int) -> DataFrame:
    """The segments that lie in more than one cell of a lattice, with the cell of the smallest number as their owner."""
    rows = cells_of(boxed(lines), side).groupBy(*ENDS).agg(F.min(F.col("cy") * across + F.col("cx")).alias("owner"), F.count(F.lit(1)).alias("num_cells"))
    return rows.where("num_cells > 1")


def split_lines(lines: DataFrame, side: float, *, inside: bool) -> DataFrame:
    """Distinct segments with both ends in one lattice cell (inside) or in several; the cell is that of the first end."""
    cell = lambda c: F.floor(F.col(c) / side)
    together = (cell("x1") == cell("x2")) & (cell("y1") == cell("y2"))
    return lines.where(together if inside else ~together).select(*ENDS, cell("x1").alias("cx"), cell("y1").alias("cy")).distinct()


def off_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length)))
    return F.sqrt(F.pow(x - x1 - t * dx, F.lit(2)) + F.pow(y - y1 - t * dy, F.lit(2)))


def edge_attributes(edges: DataFrame, lines: DataFrame, tolerance: float, side: float, *, pk: str = "pk") -> DataFrame:
    """Edges with the columns of a line that lies within the tolerance of both ends and the middle: the smallest pk's.

    lines: segments with pk and any other columns (none of them called x1, y1, x2 or y2 but the segment's ends). Edges
    without such a line are left out.
    """
    names = [c for c in lines.columns if c not in ENDS]
    line = F.struct(pk, *[n for n in names if n != pk])
    # of lines on each other the smallest pk's alone can be an edge's
    lines = written(lines.groupBy(*ENDS).agg(F.min(line).alias("line")))
    edges = edges.select(*ENDS).distinct()
    # an edge meets its lines where it starts: the cell of that point, and those that a line passes
    mean = lines.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or side
    cell = max(min(side, mean / 4), 2 * tolerance) or side
    first = edges.select(F.struct(*ENDS).alias("e"), F.floor(F.col("x1") / cell).alias("cx"), F.floor(F.col("y1") / cell).alias("cy"))
    s = [F.col(c) for c in ENDS]
    e = [F.col(f"e.{c}") for c in ENDS]
    near = lambda x, y: off_segment(x, y, *s) <= tolerance
    # a cheap test of boxes comes before the distances
    apart = lambda c, a, b: (c >= F.least(a, b) - tolerance) & (c <= F.greatest(a, b) + tolerance)
    boxes = apart(e[0], s[0], s[2]) & apart(e[2], s[0], s[2]) & apart(e[1], s[1], s[3]) & apart(e[3], s[1], s[3])
    pairs = spread(in_cells(lines, cell, grow=tolerance)).join(first, ["cx", "cy"])
    pairs = pairs.where(boxes & near(e[0], e[1]) & near(e[2], e[3]) & near((e[0] + e[2]) / 2, (e[1] + e[3]) / 2))
    return pairs.groupBy("e").agg(F.min("line").alias("line")).select("e.*", "line.*")


def carried(lines: DataFrame, geometry: list[str]) -> DataFrame:
    """The geometry columns and all others as one JSON text, `bag`."""
    return lines.select(*geometry, F.to_json(F.struct(*[F.col(f"`{c}`") for c in lines.columns if c not in geometry])).alias("bag"))


def unpacked(rows: DataFrame, schema: str, *, bag: str = "bag") -> DataFrame:
    """The columns of a bag again, beside the others."""
    return rows.withColumn("_bag", F.from_json(bag, schema)).select(*[c for c in rows.columns if c != bag], "_bag.*")


def in_frame(x: Column, y: Column, side: float, width: float) -> Column:
    """Whether a point is in its cell's frame: in the cell, but not strictly in the box that is smaller by width on all sides."""
    ax, ay = F.pmod(x, F.lit(side)), F.pmod(y, F.lit(side))
    return ~((ax > width) & (ax < side - width) & (ay > width) & (ay < side - width))


def meta_grids(cells: DataFrame, *, most: int = 10, rows: int = 20, least: int = 4) -> list[DataFrame]:
    """Grids over the centres of a grid's cells, each coarser than the one before; one of as many cells is skipped."""
    out, now = [], cells
    for _ in range(most):
        n = now.count()
        if n <= 1:
            break
        centres = now.select(((F.col("xmin") + F.col("xmax")) / 2).alias("xmin"), ((F.col("ymin") + F.col("ymax")) / 2).alias("ymin")).select("*", F.col("xmin").alias("xmax"), F.col("ymin").alias("ymax"))
        further = balanced_grid(centres, max(least, min(n, rows)), 0.0)
        if further.count() < n:
            out.append(further)
            now = further
        rows -= 1
        if rows < least:
            break
    return out


def workers(cells: DataFrame, n: int, order: Column, *, name: str = "worker") -> DataFrame:
    """Cells with their number in an order and the worker, from 1 to n, whose turn it is."""
    rows = cells.withColumn("id", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    return rows.withColumn(name, F.pmod(F.col("id") - 1, F.lit(n)) + 1)


def schema_of(df: DataFrame, geometry: str) -> DataFrame:
    """name and type of every column but the geometry."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema if f.name != geometry], "name string, type string")
