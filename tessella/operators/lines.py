"""Healing: chains of segments through nodes of degree two become one line.

A chain is a component of segments that share a node with exactly two ends. Its half-edges, which turn round at its ends,
make one cycle, or two where it is closed, so chains are named as the cycles of faces are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.faces import named, tasks_for
from tessella.operators.noding import ENDS
from tessella.operators.tables import written


def degrees(segments: DataFrame) -> DataFrame:
    """x, y, degree."""
    ends = segments.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionAll(segments.select("x2", "y2"))
    return ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))


def chains(segments: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """The segments with `chain`, the number of the healed line they belong to. fixed: nodes (x, y) that stay ends."""
    rows = written(segments.select(*ENDS).distinct().withColumn("h", F.monotonically_increasing_id() * 2))
    both = rows.toDF("ux", "uy", "vx", "vy", "h").unionAll(rows.select("x2", "y2", "x1", "y1", F.col("h") + 1))
    stays = F.lit(False)
    if fixed is not None:
        both = both.join(fixed.select(F.col("x").alias("ux"), F.col("y").alias("uy"), F.lit(True).alias("stays")).distinct(), ["ux", "uy"], "left")
        stays = F.coalesce("stays", F.lit(False))
    node = Window.partitionBy("ux", "uy")
    # what comes into a node goes on with the other of two, and else turns round
    on = F.when((F.count(F.lit(1)).over(node) == 2) & ~stays, F.sum("h").over(node) - F.col("h")).otherwise(F.col("h"))
    half = both.withColumn("next", on).select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), "next", F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    of = lambda c: F.max(F.when(F.col("h") % 2 == 0, F.col(c)))
    found = named(half).groupBy(F.expr("h div 2").alias("s")).agg(of("ux").alias("x1"), of("uy").alias("y1"), of("vx").alias("x2"), of("vy").alias("y2"), F.min("face").alias("chain"))
    return found.select(*ENDS, "chain")


def ordered(chain: np.ndarray, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of half-edges, those of segment k at 2 k and 2 k + 1, the chains and, in order, their points (chains, sizes, x, y)."""
    n = len(chain)
    order = np.lexsort((vy, vx, y, x, chain))
    c, a, b = chain[order], x[order], y[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    at = np.flatnonzero(new)
    degree = np.diff(np.r_[at, n])
    # the other way out of a node that has two, for each half-edge out of it
    other = np.full(n, -1)
    two = at[degree == 2]
    other[order[two]], other[order[two + 1]] = order[two + 1], order[two]
    # a chain starts at its smallest end, or smallest point, and there towards the smaller neighbour
    rank = np.lexsort((np.arange(len(at)), degree != 1, c[at]))
    nodes = c[at][rank]
    first = order[at[rank[np.r_[True, nodes[1:] != nodes[:-1]]]]]
    ahead = other[np.arange(n) ^ 1]
    stop = ahead < 0
    start = np.zeros(n, bool)
    start[first] = True
    stop |= start[np.maximum(ahead, 0)] & (ahead >= 0)
    stop[first ^ 1] = True
    to, left = np.where(stop, np.arange(n), ahead), np.where(stop, 0, 1)
    while True:
        then = to[to]
        if (then == to).all():
            break
        left, to = left + left[to], then
    # those that end in the way back to the start run the other way
    back = np.zeros(n, bool)
    back[first ^ 1] = True
    row = np.flatnonzero(~back[to])
    row = row[np.lexsort((-left[row], chain[row]))]
    ends = np.r_[chain[row][1:] != chain[row][:-1], True]
    names = chain[row][ends]
    size = np.diff(np.r_[0, np.flatnonzero(ends) + 1]) + 1
    last = np.cumsum(size) - 1
    is_last = np.zeros(int(size.sum()), bool)
    is_last[last] = True
    px, py = np.empty(len(is_last)), np.empty(len(is_last))
    px[~is_last], py[~is_last], px[last], py[last] = x[row], y[row], vx[row[ends]], vy[row[ends]]
    return names, size, px, py


def merged_lines(chained: DataFrame) -> DataFrame:
    """chain, pts: the points of each healed line in order, from its smaller end; a closed one starts at its smallest point."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        chain, *xy = (table[c].to_numpy() for c in ("chain", *ENDS))
        both = lambda a, b: np.stack([a, b], 1).ravel()
        names, size, x, y = ordered(both(chain, chain), both(xy[0], xy[2]), both(xy[1], xy[3]), both(xy[2], xy[0]), both(xy[3], xy[1]))
        pts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays([x, y], fields=list(point)))
        yield from pa.table([pa.array(names), pts], names=["chain", "pts"]).to_batches(max_chunksize=10_000)

    rows = written(chained.select("chain", *ENDS))
    return rows.repartition(tasks_for(rows, rows.count()), "chain").mapInArrow(run, "chain long, pts array<struct<x:double,y:double>>")


def simplify(pts: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker: both ends stay, and a closed line keeps four points."""
    keep, stack = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    if len(pts) > 3 and pts[0] == pts[-1]:
        # a ring's ends are one point: the two farthest points hold it open
        far = max(range(len(pts)), key=lambda i: (pts[i][0] - pts[0][0]) ** 2 + (pts[i][1] - pts[0][1]) ** 2)
        off = max((i for i in range(1, len(pts) - 1) if i != far), key=lambda i: away(pts[i], pts[0], pts[far]))
        marks = sorted({0, far, off, len(pts) - 1})
        keep, stack = set(marks), list(zip(marks[:-1], marks[1:], strict=True))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        k = max(range(a + 1, b), key=lambda i: away(pts[i], pts[a], pts[b]))
        if away(pts[k], pts[a], pts[b]) > tolerance:
            keep.add(k)
            stack += [(a, k), (k, b)]
    return [pts[i] for i in sorted(keep)]


def away(p: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    """Distance from a point to a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = 0.0 if length == 0 else min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length))
    return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5


def simplified(lines: DataFrame, tolerance: float, max_mean_side: float = 0.0, tries: int = 6) -> DataFrame:
    """chain, pts, status: the simplified line and 1, or the line as it was and 0.

    Like a change of an edge that is refused, a result whose mean distance of points exceeds max_mean_side (if that is
    over 0) is tried again with the tolerance divided by 2, 3, ... up to `tries`.
    """

    def one(line) -> tuple[list[dict], int]:
        pts = [(p["x"], p["y"]) for p in line]
        for k in range(1, tries + 1):
            got = simplify(pts, tolerance / k) if len(pts) > 2 else pts
            length = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(got[:-1], got[1:], strict=True))
            if got == pts:
                return list(line), 0
            if max_mean_side <= 0 or length / len(got) <= max_mean_side:
                return [{"x": x, "y": y} for x, y in got], 1
        return list(line), 0

    @F.pandas_udf("pts array<struct<x:double,y:double>>, status int")
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in lines], columns=["pts", "status"])

    return lines.select("chain", run("pts").alias("r")).select("chain", "r.pts", "r.status")
