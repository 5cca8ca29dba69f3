"""Steps whose cost must not grow faster than their rows, and their results on odd input."""

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.kernels import clipped_area, contains_point
from tessella.operators import faces as faces_
from tessella.operators import overlap, planar
from tessella.operators.borders import edge_attributes
from tessella.operators.lines import chains, merged_lines
from tessella.operators.noding import crossings, node, segments_of, whole_lines

SEGMENT = "x1 long, y1 long, x2 long, y2 long"


def squares(spark, rows):
    """Lattice segments of boxes (xmin, ymin, xmax, ymax)."""
    df = spark.createDataFrame(rows, "xmin long, ymin long, xmax long, ymax long")
    return segments_of(df.select(F.array(G.box_ring([F.col(c) for c in G.BOX])).alias("rings")), 1.0)


def test_stacked_lines_are_put_together(spark):
    stack = [(0, 0, k, 0) for k in range(1, 30)] + [(k, 0, k + 40, 0) for k in range(20)] + [(0, 0, 3, 6), (1, 2, 4, 8), (70, 0, 80, 0), (80, 0, 90, 0), (5, -3, 5, 3), (30, -3, 30, 3)]
    df = spark.createDataFrame(stack, SEGMENT)
    assert sorted(map(tuple, whole_lines(df).collect())) == [(0, 0, 4, 8), (0, 0, 59, 0), (5, -3, 5, 3), (30, -3, 30, 3), (70, 0, 90, 0)]
    apart = sorted(map(tuple, whole_lines(df, joined=False).collect()))
    assert (70, 0, 80, 0) in apart and (80, 0, 90, 0) in apart and len(apart) == 6
    assert sorted(map(tuple, crossings(whole_lines(df, joined=False), 8).collect())) == [(5, 0), (30, 0)]
    noded, rejects = node(df, 8)
    level = sorted((r.x1, r.x2) for r in noded.collect() if r.y1 == r.y2 == 0)
    # every end of a segment is still a node, and so are both crossings
    ends = sorted({x for a, b, c, d in stack for x, y in ((a, b), (c, d)) if y == 0} | {5, 30})
    assert level == [(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if a != 59] and rejects.isEmpty()


def test_cycles_across_tiles(spark, monkeypatch):
    """Ways that leave a tile go on in further rounds: the same faces as those that one task finds."""
    rows = [(x, y, x + 4, y + 7) for x in range(0, 40, 3) for y in range(0, 40, 5)]
    noded, _ = node(squares(spark, rows), 16)
    area = lambda: sorted((r.area2, len(r.rings), r.xmin, r.ymin) for r in faces_.faces(faces_.cycles(noded), 16).collect())
    whole = area()
    monkeypatch.setattr(faces_, "LAST", 40)
    monkeypatch.setattr(faces_, "PER_TILE", 50)
    assert area() == whole and sum(a for a, *_ in whole) == 2 * 43 * 42


def test_sides_of_an_island(spark):
    """An island in a closed gap has a bounded face on both sides: its own and the gap."""
    frame = [(0, 0, 10, 2), (0, 8, 10, 10), (0, 2, 2, 8), (8, 2, 10, 8)]
    noded, _ = node(squares(spark, [*frame, (4, 4, 6, 6), (20, 0, 22, 2)]), 16)
    cycled = faces_.cycles(noded)
    found = {r.cycle for r in faces_.bounded(cycled, 16).collect()}
    one = [(r.x1, r.y1) for r in faces_.edges_of(cycled).collect() if (r.left in found) != (r.right in found)]
    assert len([p for p in one if p[0] >= 20]) == 4 and not [p for p in one if 4 <= p[0] <= 6 and 4 <= p[1] <= 6]
    assert len(one) == 4 + 8


def test_chains_across_tiles(spark, monkeypatch):
    """Long chains, rings and a ring that starts and ends at a node of three lines."""
    monkeypatch.setattr(faces_, "LAST", 10)
    monkeypatch.setattr(faces_, "PER_TILE", 10)
    steps = lambda pts: [(*min(a, b), *max(a, b)) for a, b in zip(pts[:-1], pts[1:], strict=True)]
    wave = [(k, k * 7 % 5) for k in range(200)]
    ring = [(x, 50) for x in range(60)] + [(x, 51) for x in range(59, -1, -1)] + [(0, 50)]
    loop = [(10, 80), (12, 82), (8, 82), (10, 80)]
    df = spark.createDataFrame(steps(wave) + steps(ring) + steps(loop) + steps([(10, 70), (10, 80)]), SEGMENT)
    got = sorted([(p.x, p.y) for p in r.pts] for r in merged_lines(chains(df)).collect())
    # a closed line starts at its smallest point, towards the smaller neighbour
    assert got == sorted([wave, ring[::-1], [(8, 82), (10, 80), (12, 82), (8, 82)], [(10, 70), (10, 80)]])


def test_edges_on_sloping_and_stacked_lines(spark):
    lines = [(9, 0, 0, 30, 10, "a"), (7, 0, 0, 30, 10, "b"), (8, 0, 0, 30, 10, "c"), (3, 100, 0, 100, 50, "d"), (4, 101, 0, 101, 50, "e")]
    df = spark.createDataFrame(lines, "pk long, x1 long, y1 long, x2 long, y2 long, name string")
    edges = spark.createDataFrame([(3, 1, 27, 9), (101, 10, 101, 20), (102, 10, 102, 20), (0, 0, 3, 9), (100, 49, 100, 52)], SEGMENT)
    got = sorted(map(tuple, edge_attributes(edges, df, 1.0, 16).collect()))
    assert got == [(3, 1, 27, 9, 7, "b"), (101, 10, 101, 20, 3, "d"), (102, 10, 102, 20, 4, "e")]


def test_contains_and_clips(spark):
    """A shell with a hole and sloping sides, against plain arithmetic; null rings stay null."""
    rings = [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 0.0], [5.0, 1.0, 6.0, 1.0, 6.0, 2.0, 5.0, 2.0, 5.0, 1.0]]
    df = spark.createDataFrame([(1, rings), (2, None)], "k int, rings array<array<double>>")
    clip = lambda *b: [r.a for r in df.select("k", clipped_area("rings", *[F.lit(float(v)) for v in b]).alias("a")).orderBy("k").collect()]
    assert clip(0, 0, 10, 10) == [49.0, None] and clip(2, 0, 4, 20) == [6.0, None]
    assert clip(5, 0, 6, 2) == [1.0, None] and clip(20, 20, 30, 30) == [0.0, None]
    at = lambda x, y: [r.a for r in df.select("k", contains_point("rings", F.lit(x), F.lit(y)).alias("a")).orderBy("k").collect()]
    assert at(5.5, 1.5) == [False, False] and at(4.5, 1.5) == [True, False] and at(4.5, 8.5) == [False, False]


def test_overlaps_of_stacks(spark, monkeypatch):
    """Many rows at one place, in several lists; keys that repeat, null keys and boxes that touch or are equal."""
    monkeypatch.setattr(overlap, "LIST", 3)
    boxes = [(0, 0, 4, 4), (2, 2, 6, 6), (1, 1, 3, 3), (4, 0, 8, 4)]
    rows = [(None if k == 11 else k // 2 if k < 6 else k, *boxes[k * 7 % 4 if k % 3 else 0]) for k in range(40)]
    df = spark.createDataFrame(rows, "pk long, xmin long, ymin long, xmax long, ymax long")
    share = lambda a, b: max(min(a[3], b[3]) - max(a[1], b[1]), 0) * max(min(a[4], b[4]) - max(a[2], b[2]), 0)
    covers = lambda a, b: a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[4] >= b[4]
    for contained in (True, False):
        want = sorted((a[0], b[0], share(a, b)) for a in rows for b in rows if a[0] is not None and b[0] is not None and a[0] < b[0] and share(a, b) and (contained or not covers(a, b) and not covers(b, a)))
        got = overlap.overlap_pairs(df, 2, include_containment=contained).select("a", "b", "area")
        assert sorted(map(tuple, got.collect())) == want
        places = overlap.overlap_counts(df, 2, include_containment=contained).collect()
        assert sum(r.num for r in places) == len(want) and sum(r.num * r.area for r in places) == sum(r[2] for r in want)


def test_shared_areas_in_blocks(monkeypatch):
    """Products in blocks of faces and polygons add up to every pair's faces."""
    monkeypatch.setattr(planar, "TILE_FACES", 3)
    monkeypatch.setattr(planar, "BLOCK", 2)
    lists = [[1, 2, 5], [2, 5, 9], [1, 9], [5], [1, 2, 5, 9], [2, 9], [1, 5]]
    want: dict = {}
    for k, pks in enumerate(lists):
        for i, a in enumerate(pks):
            for b in pks[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 2**k
    got: dict = {}
    for a, b, area in planar.shared_areas(lists, np.array([2.0**k for k in range(len(lists))])):
        for x, y, s in zip(a.tolist(), b.tolist(), area.tolist(), strict=True):
            got[x, y] = got.get((x, y), 0) + s
    assert got == want
