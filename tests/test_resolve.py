"""The partition of four municipalities, and of random rectangles against unit squares."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.plans.resolve import CleanSpec, RunOptions, TopologySpec, resolve, validate
from tessella.sources import wkb

FOUR = {
    834: "7.111150850066444 59.75744523483054, 7.232910937110598 59.96271423265012, 7.646000629292045 60.12685195556568, 8.099381399098585 60.03968431845895, 8.188948754792309 59.93191532799707, 8.160950866077092 59.853555466030066, 8.324791407150729 59.828612658236985, 8.206493073732696 59.70631849860428, 8.262631118338577 59.57282320902607, 8.001227168738016 59.56325052966717, 7.966214047611933 59.487252312791654, 7.845696353949614 59.595532289335196, 7.551555994780552 59.58662462709492, 7.110080317094002 59.70060335642799, 7.111150850066444 59.75744523483054",
    633: "7.6097520210706975 60.244094521130194, 7.692095094967417 60.41262989820954, 8.195539663384338 60.34585692839751, 8.572988868765147 60.40387067010572, 8.62249595535793 60.44235754819199, 8.47018081885776 60.485622920123895, 8.681447238308868 60.51207158022704, 9.14895488405222 60.36394643042364, 9.217847162884587 60.1524471091104, 9.052690196470888 60.07099370204801, 8.722863585959656 60.183106909892345, 7.48826179898824 60.09892921140938, 7.6097520210706975 60.244094521130194",
    1233: "6.842481706627035 60.5965238212976, 6.837792604318476 60.67446177584251, 6.9858680857991855 60.740840259008394, 7.635850779852665 60.632906901062235, 7.732114725875593 60.52097043097572, 7.28184373212984 60.59202846040726, 6.751087986248417 60.485327919569, 6.842481706627035 60.5965238212976",
    1231: "6.529652965581314 60.34759975766233, 6.383186782024355 60.39063035981991, 6.852577715962366 60.48156609031728, 7.037505296217075 60.40941504083341, 6.982398769802253 60.348334600490084, 7.2437815234623395 60.268180220048315, 7.165448491146858 60.25937764027581, 7.223027172129728 60.13376151651067, 7.48826179898824 60.09892921140938, 7.436428853521463 60.019227615748676, 7.230127396400071 60.00140275901316, 6.7362869687877485 60.18031166104505, 6.56155915572995 60.16282334292303, 6.416313637306576 60.296244525054334, 6.529652965581314 60.34759975766233",
}


@pytest.fixture(scope="module")
def four(spark):
    rows = [(k, f"name {k}", wkb.write(*wkb.from_text(f"POLYGON(({t}))"), srid=4258)) for k, t in FOUR.items()]
    return spark.createDataFrame(rows, "pk int, c2 string, geom binary").withColumn("rings", wkb.rings_of("geom"))


def test_four_polygons(spark, four):
    out = resolve(four, TopologySpec(1e-5))
    rows = out.attributes.collect()
    assert len(rows) == 7
    assert sorted((r.pk for r in rows), key=str) == sorted([633, 834, 834, 1231, 1231, 1233, None], key=str)
    want = [(0.001014, 834), (0.001214, 1231), (0.002364, None), (0.116755, 1233), (0.236127, 1231), (0.423049, 633), (0.482092, 834)]
    got = sorted((r.area, r.pk) for r in rows)
    assert [p for _, p in got] == [p for _, p in want] and [a for a, _ in got] == pytest.approx([a for a, _ in want], abs=2e-6)  # the lattice moves corners
    assert sorted(str((r.pk, r.others)) for r in rows if r.others) == ["(1231, [834])", "(834, [633])"]
    assert [r.input_is_valid for r in rows if r.pk is None] == [None] and all(r.input_is_valid and r.c2 == f"name {r.pk}" for r in rows if r.pk)
    assert out.rejects.isEmpty() and validate(out.edges).isEmpty()


def test_small_faces_join_neighbours(spark, four):
    out = resolve(four, TopologySpec(1e-5), CleanSpec(min_area=0.0015))
    got = sorted(a for (a,) in out.attributes.select("area").collect())
    assert len(got) == 5 and sum(got) == pytest.approx(1.262615, abs=1e-5) and got[0] == pytest.approx(0.002364, abs=2e-6)


def test_simplified_and_smoothed(spark, four):
    clean = CleanSpec(simplify_tolerance=2e-3, chaikin_rounds=1, chaikin_max_length=0.05)
    out = resolve(four, TopologySpec(1e-5), clean)
    assert sorted((r.pk for r in out.attributes.collect()), key=str) == sorted([633, 834, 834, 1231, 1231, 1233, None], key=str)
    assert validate(out.edges).isEmpty()


def test_random_rectangles(spark):
    rng = random.Random(5)
    boxes = [(k, x := rng.randrange(30), y := rng.randrange(30), x + rng.randint(1, 12), y + rng.randint(1, 12)) for k in range(40)]
    df = spark.createDataFrame([(k, [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (X, y), (X, Y), (x, Y), (x, y))]]) for k, x, y, X, Y in boxes], f"pk int, rings {wkb.RINGS}")
    out = resolve(df, TopologySpec(1.0, parts_of_tolerance=1), options=RunOptions(cells_across=5))
    area = {r.pk: r.area for r in out.attributes.where("pk is not null").groupBy("pk").agg(F.sum("area").alias("area")).collect()}
    want: dict = {}
    for x in range(50):
        for y in range(50):
            over = [k for k, a, b, c, d in boxes if a <= x < c and b <= y < d]
            if over:
                want[max(over)] = want.get(max(over), 0) + 1
    assert area == want
    assert validate(out.edges).isEmpty()


def test_holes_and_islands(spark):
    ring = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    df = spark.createDataFrame([(1, [ring(0, 20), ring(5, 15)]), (2, [ring(8, 12)])], f"pk int, rings {wkb.RINGS}")
    got = sorted((r.area, r.pk) for r in resolve(df, TopologySpec(1.0, parts_of_tolerance=1)).attributes.collect())
    assert got == [(16.0, 2), (84.0, None), (300.0, 1)]


def test_codecs():
    for kind, rings in ((wkb.POINT, [[(1.5, -2.0)]]), (wkb.LINE, [[(0.0, 0.0), (1.0, 2.0)]]), (wkb.POLYGON, [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (1.0, 1.0)]])):
        assert wkb.read(wkb.write(kind, rings, 25833)) == (kind, 25833, rings)
        assert wkb.read(wkb.write(kind, rings)) == (kind, None, rings)
        assert wkb.from_text(wkb.to_text(kind, rings)) == (kind, rings)
