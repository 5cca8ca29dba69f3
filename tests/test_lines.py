"""Chains, merged lines, simplification, and the detector."""

from tessella.operators.find import find_overlaps, lock_envelope
from tessella.operators.lines import chains, merged_lines, simplified, simplify


def test_chains(spark):
    # a path of six segments, a ring apart, and a star whose centre has three ends
    path = [(k, 0, k + 1, 0) for k in range(6)]
    ring = [(100, 0, 101, 0), (101, 0, 101, 1), (100, 1, 101, 1), (100, 0, 100, 1)]
    star = [(200, 0, 201, 1), (201, 1, 202, 0), (201, 1, 201, 5)]
    df = spark.createDataFrame(path + ring + star, "x1 long, y1 long, x2 long, y2 long")
    rows = chains(df)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.chain, set()).add((r.x1, r.y1, r.x2, r.y2))
    assert sorted(map(len, groups.values())) == [1, 1, 1, 4, 6]
    lines = {len(r.pts): [(p.x, p.y) for p in r.pts] for r in merged_lines(rows).collect()}
    assert lines[7] == [(float(k), 0.0) for k in range(7)]
    assert lines[5][0] == lines[5][-1] == (100.0, 0.0)
    fixed = spark.createDataFrame([(3, 0)], "x long, y long")
    assert chains(df, fixed).select("chain").distinct().count() == 6


def test_simplify(spark):
    line = [(0.0, 0.0), (1.0, 0.1), (2.0, -0.1), (3.0, 5.0), (4.0, 6.0), (5.0, 7.0), (6.0, 8.1), (7.0, 9.0)]
    assert simplify(line, 1.0) == [(0.0, 0.0), (2.0, -0.1), (3.0, 5.0), (7.0, 9.0)]
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    assert len(simplify(ring, 100.0)) >= 4 and simplify(ring, 0.0) == ring
    df = spark.createDataFrame([("a", [{"x": x, "y": y} for x, y in line]), ("b", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}])], "chain string, pts array<struct<x:double,y:double>>")
    got = {r.chain: (len(r.pts), r.status) for r in simplified(df, 1.0).collect()}
    assert got == {"a": (4, 1), "b": (2, 0)}
    assert {r.chain: r.status for r in simplified(df, 1.0, max_mean_side=0.5).collect()}["a"] == 0


def test_find(spark):
    boxes = [(1, 0, 0, 4, 4), (2, 2, 2, 6, 6), (3, 2, 2, 3, 3)]
    df = spark.createDataFrame(boxes, "pk long, xmin long, ymin long, xmax long, ymax long")
    out = find_overlaps(df, 2, side=4)
    assert [(r.a, r.b, r.area) for r in out["overlap"].collect()] == [(1, 2, 4)]
    assert out["gap"].count() == 36 - 16 - 16 + 4
    counts = out["counts"].collect()
    assert sum(r.num_overlap for r in counts) == 1 and sum(r.num_gap for r in counts) == 8
    assert find_overlaps(df, 2, side=4, include_containment=True)["overlap"].count() == 3
    assert tuple(lock_envelope(df).first()) == (-1.0, -1.0, 7.0, 7.0)
