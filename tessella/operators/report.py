"""Before and after figures of a resolved layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame, smallest: int) -> DataFrame:
    """description, num_before, num_after; before: boxes with pk, after: unit squares with their owner and the others."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    one = F.lit(1)
    old = before.agg(F.count(one).alias("polygons"), (5 * F.count(one)).alias("points"), F.sum(area).alias("area"), F.count_if(area < smallest).alias("below"))
    owners = after.groupBy("pk").agg(F.count(one).alias("n"), F.count_if(F.size("others") > 0).alias("twice"))
    new = owners.agg(F.count(one).alias("polygons_after"), (4 * F.coalesce(F.sum("n"), F.lit(0))).alias("points_after"), F.sum("n").alias("area_after"), F.count_if(F.col("n") < smallest).alias("below_after"), F.sum("twice").alias("twice"))
    both = old.crossJoin(F.broadcast(new))  # one row each
    row = lambda name, a, b: F.struct(F.lit(name).alias("description"), F.col(a).cast("long").alias("num_before"), (F.col(b) if isinstance(b, str) else b).cast("long").alias("num_after"))
    rows = F.array(row("polygons", "polygons", "polygons_after"), row("points", "points", "points_after"), row("area", "area", "area_after"), row(f"polygons below {smallest}", "below", "below_after"), row("overlap area", "twice", F.lit(0)))
    return both.select(F.explode(rows).alias("r")).select("r.*")
