"""The detector: overlaps and gaps of a polygon layer, counted by grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import BOX, box_area, shared_box
from tessella.operators.grid import balanced_grid, extent
from tessella.operators.overlap import cover_counts, overlap_pairs


def find_overlaps(df: DataFrame, max_rows: int = 5000, *, side: float, include_containment: bool = False) -> dict[str, DataFrame]:
    """grid, boundary, overlap, gap and counts of a layer of axis-parallel integer boxes with column pk.

    overlap: pairs with the box they share; pairs of which one covers the other count only with include_containment.
    gap: unit squares inside the extent that no box covers. counts: per cell of the balanced grid the overlaps that begin
    there, the gap squares, and ok_exit where there is neither.
    """
    cells = balanced_grid(df, max_rows)
    pairs = overlap_pairs(df, side, include_containment=include_containment)
    covered = cover_counts(df)
    box = extent(df)
    wide = box.select(F.explode(F.sequence("xmin", F.col("xmax") - 1)).alias("x"), "ymin", "ymax")
    gaps = wide.select("x", F.explode(F.sequence("ymin", F.col("ymax") - 1)).alias("y")).join(covered.select("x", "y"), ["x", "y"], "left_anti")
    # cells of a quadtree don't overlap but for borders: each place belongs to the cell that it isn't at the upper end of
    at = lambda x, y: (F.col(x) >= F.col("g.xmin")) & (F.col(y) >= F.col("g.ymin")) & (F.col(x) < F.col("g.xmax")) & (F.col(y) < F.col("g.ymax"))
    grid = cells.alias("g")
    found = pairs.select(F.col("xmin").alias("px"), F.col("ymin").alias("py"), "area")
    overlaps = found.join(grid, at("px", "py")).groupBy("g.cell").agg(F.count(F.lit(1)).alias("num_overlap"), F.sum("area").alias("overlap_area"))
    holes = gaps.join(grid, at("x", "y")).groupBy("g.cell").agg(F.count(F.lit(1)).alias("num_gap"))
    counts = cells.join(overlaps, "cell", "left").join(holes, "cell", "left").na.fill(0, ["num_overlap", "overlap_area", "num_gap"])
    counts = counts.withColumn("ok_exit", (F.col("num_overlap") == 0) & (F.col("num_gap") == 0)).withColumn("summary", F.format_string("num_rows_overlap:%d, num_rows_gap:%d", "num_overlap", "num_gap"))
    return {"grid": cells, "boundary": covered.select("x", "y"), "overlap": pairs, "gap": gaps, "counts": counts}


def lock_envelope(df: DataFrame, by: float = 1.0) -> DataFrame:
    """One row: the box of all boxes, grown by a distance; null where there are no rows."""
    box = extent(df)
    return box.select((F.col("xmin") - by).alias("xmin"), (F.col("ymin") - by).alias("ymin"), (F.col("xmax") + by).alias("xmax"), (F.col("ymax") + by).alias("ymax"))


def shared_area(a: str, b: str):
    """The area that the boxes of two join sides share."""
    return box_area(shared_box([F.col(f"{a}.{c}") for c in BOX], [F.col(f"{b}.{c}") for c in BOX]))
