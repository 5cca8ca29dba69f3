"""Registered queries over the driver's tables and their SQL.

Tables hold no geometry, so layers are derived from them with integer coordinates (tessella.sources.layers); every query
runs over the whole of its layers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import grid, overlap
from tessella.sources.layers import PARCELS, PARTS, POINTS, TRACKS, parcels, parts, points, track_points, tracks

#: Lattice cells of the joins and of the fixed grids, in units of the layers.
SIDE, CELL = 10, 100
BOX_SQL = "xmin, ymin, xmax, ymax"
MEET = "a.xmin <= b.xmax and a.xmax >= b.xmin and a.ymin <= b.ymax and a.ymax >= b.ymin"
SHARED = "greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0)"
UNITS = f"(select pk, attribute, unnest(range(xmin, xmax)) as x, ymin, ymax from {PARCELS})"
SQUARES = f"(select pk, attribute, x, unnest(range(ymin, ymax)) as y from {UNITS})"
CELLS = f"(select cx, cy, cx * {CELL} as xmin, cy * {CELL} as ymin, (cx + 1) * {CELL} as xmax, (cy + 1) * {CELL} as ymax from range(0, 11) r(cx), range(0, 11) s(cy))"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"select min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from (select {BOX_SQL} from {PARCELS} union all select {BOX_SQL} from {PARTS})")
def table_extent(spark, d):
    return grid.extent(parcels(spark, d).select(*G.BOX).unionByName(parts(spark, d).select(*G.BOX)))


GRID_ROWS, GRID_DEEPEST = 400, 6


@query(f"""
with recursive p as (select * from {PARCELS}),
g(level, n, xmin, ymin, xmax, ymax) as (
  select 0, count(*), min(xmin)::double, min(ymin)::double, max(xmax)::double, max(ymax)::double from p
  union all
  select c.level, sum(case when p.xmin <= c.xmax and p.xmax >= c.xmin and p.ymin <= c.ymax and p.ymax >= c.ymin then 1 else 0 end)::bigint, c.xmin, c.ymin, c.xmax, c.ymax
  from (select level + 1 as level, xmin + i * (xmax - xmin) / 2 as xmin, ymin + j * (ymax - ymin) / 2 as ymin, xmin + (i + 1) * (xmax - xmin) / 2 as xmax, ymin + (j + 1) * (ymax - ymin) / 2 as ymax
        from g, range(0, 2) r(i), range(0, 2) s(j) where n >= {GRID_ROWS} and level < {GRID_DEEPEST}) c, p
  group by c.level, c.xmin, c.ymin, c.xmax, c.ymax)
select level, n as num_rows, xmin, ymin, xmax, ymax from g where n < {GRID_ROWS} or level = {GRID_DEEPEST}""")
def balanced_grid(spark, d):
    return grid.balanced_grid(parcels(spark, d), GRID_ROWS, 0.0, deepest=GRID_DEEPEST).drop("cell")


@query(f"select x // {CELL} as cx, y // {CELL} as cy, count(*) as num_polygons from (select pk, unnest(range(xmin // {CELL} * {CELL}, xmax + 1, {CELL})) as x, ymin, ymax from {PARCELS}) t, lateral (select unnest(range(ymin // {CELL} * {CELL}, ymax + 1, {CELL})) as y) u group by all")
def grid_counts(spark, d):
    return grid.cells_of(parcels(spark, d), CELL).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("num_polygons"))


@query(f"""
select cx, cy, thread, row_number() over (partition by thread order by d desc, cx, cy) as n
from (select cx, cy, cx // 4 * 10 + cy // 4 as thread, (cx * {CELL} + {CELL // 2} - 500) * (cx * {CELL} + {CELL // 2} - 500) + (cy * {CELL} + {CELL // 2} - 500) * (cy * {CELL} + {CELL // 2} - 500) as d
  from (select distinct xmin // {CELL} as cx, ymin // {CELL} as cy from {PARCELS}))""")
def grid_row_number(spark, d):
    cells = parcels(spark, d).select(F.expr(f"xmin div {CELL}").alias("cx"), F.expr(f"ymin div {CELL}").alias("cy")).distinct()
    away = lambda c: F.pow(F.col(c) * CELL + CELL // 2 - 500, F.lit(2))
    rows = cells.select("cx", "cy", F.expr("cx div 4 * 10 + cy div 4").alias("thread"), (away("cx") + away("cy")).alias("d"))
    return rows.select("cx", "cy", "thread", F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("d"), "cx", "cy")).cast("long").alias("n"))


@query(f"select a.pk as a, b.pk as b from {PARCELS} a, {PARTS} b where {MEET}")
def bbox_join(spark, d):
    return grid.spatial_join(parcels(spark, d), parts(spark, d), 40).select(F.col("a.pk").alias("a"), F.col("b.pk").alias("b"))


@query(f"select pk, xmin // {CELL} as cx, ymin // {CELL} as cy from {PARCELS} where xmin // {CELL} = (xmax - 1) // {CELL} and ymin // {CELL} = (ymax - 1) // {CELL}")
def covered_by_cell(spark, d):
    inside = f"xmin div {CELL} = (xmax - 1) div {CELL} and ymin div {CELL} = (ymax - 1) div {CELL}"
    return parcels(spark, d).where(inside).selectExpr("pk", f"xmin div {CELL} as cx", f"ymin div {CELL} as cy")


@query(f"select pk, min(ymin // {CELL} * 11 + xmin // {CELL}) as cell from {PARCELS} group by pk")
def owner_cell(spark, d):
    return grid.cells_of(parcels(spark, d), CELL).groupBy("pk").agg(F.min(F.col("cy") * 11 + F.col("cx")).alias("cell"))


#: Parcels of other widths and heights, so that some overlap without one covering the other.
WIDE = f"(select pk, xmin, ymin, xmax + pk % 13 as xmax, ymax + pk // 1000 % 5 as ymax from {PARCELS})"
COVERS = "(a.xmin <= b.xmin and a.ymin <= b.ymin and a.xmax >= b.xmax and a.ymax >= b.ymax)"
COVERED = "(b.xmin <= a.xmin and b.ymin <= a.ymin and b.xmax >= a.xmax and b.ymax >= a.ymax)"


@query(f"select a.pk as a, b.pk as b, {SHARED} as area from {PARCELS} a, {PARCELS} b where {MEET} and a.pk < b.pk and {SHARED} > 0")
def overlap_pairs(spark, d):
    return overlap.overlap_pairs(parcels(spark, d), SIDE, include_containment=True).select("a", "b", "area")


@query(f"select a.pk as a, b.pk as b, {SHARED} as area from {WIDE} a, {WIDE} b where {MEET} and a.pk < b.pk and {SHARED} > 0 and not {COVERS} and not {COVERED}")
def overlap_excl_equal_or_contained(spark, d):
    wide = parcels(spark, d).selectExpr("pk", "xmin", "ymin", "xmax + pk % 13 as xmax", "ymax + pk div 1000 % 5 as ymax")
    return overlap.overlap_pairs(wide, 2 * SIDE).select("a", "b", "area")


@query(f"select greatest(a.xmin, b.xmin) // {CELL} as cx, greatest(a.ymin, b.ymin) // {CELL} as cy, count(*) as num_overlaps, sum({SHARED})::bigint as area from {PARCELS} a, {PARCELS} b where {MEET} and a.pk < b.pk and {SHARED} > 0 group by all")
def overlap_area_by_cell(spark, d):
    places = overlap.overlap_counts(parcels(spark, d), SIDE, include_containment=True)
    return places.groupBy(F.expr(f"xmin div {CELL}").alias("cx"), F.expr(f"ymin div {CELL}").alias("cy")).agg(F.sum("num").alias("num_overlaps"), F.sum(F.col("num") * F.col("area")).alias("area"))


@query(f"select covers, count(*) as area from (select x, y, count(*) as covers from {SQUARES} group by x, y) group by covers")
def cover_count_area(spark, d):
    return overlap.cover_counts(parcels(spark, d)).groupBy("covers").agg(F.count(F.lit(1)).alias("area"))


@query(f"select x // {CELL} as cx, y // {CELL} as cy, {CELL * CELL} - count(distinct (x, y)) as gap_area, count(distinct (x, y)) filter (c > 1) as overlap_area, count(distinct (x, y)) filter (c > 1) = 0 as ok_exit from (select x, y, count(*) as c from {SQUARES} group by x, y) group by all")
def gap_cells(spark, d):
    cell = [F.expr(f"x div {CELL}").alias("cx"), F.expr(f"y div {CELL}").alias("cy")]
    twice = F.count_if(F.col("covers") > 1)
    return overlap.cover_counts(parcels(spark, d)).groupBy(*cell).agg((F.lit(CELL * CELL) - F.count(F.lit(1))).alias("gap_area"), twice.alias("overlap_area"), (twice == 0).alias("ok_exit"))


@query(f"select b.pk, a.cx, a.cy, greatest(a.xmin, b.xmin) as xmin, greatest(a.ymin, b.ymin) as ymin, least(a.xmax, b.xmax) as xmax, least(a.ymax, b.ymax) as ymax from {CELLS} a, {PARCELS} b where {SHARED} > 0")
def clip_to_cell(spark, d):
    return overlap.clip(parcels(spark, d), CELL)


#: Faces: the parcels by place and size; several polygons can cover one by more than half.
FACES = f"(select min(pk) as pk, {BOX_SQL} from {PARCELS} group by {BOX_SQL})"
BEST = f"(select a.pk as face, b.pk as pk, row_number() over (partition by a.pk order by round({SHARED} / ((a.xmax - a.xmin) * (a.ymax - a.ymin)), 9) desc, b.pk desc) as n, {SHARED} / ((a.xmax - a.xmin) * (a.ymax - a.ymin)) as share from {FACES} a, {PARCELS} b where {MEET} and {SHARED} / ((a.xmax - a.xmin) * (a.ymax - a.ymin)) > 0.5)"


def faces(spark, d):
    return parcels(spark, d).groupBy(*G.BOX).agg(F.min("pk").alias("pk"))


def assigned(spark, d):
    return overlap.assign(overlap.coverage(faces(spark, d), parcels(spark, d), SIDE))


@query(f"select face, pk from {BEST} where n = 1")
def coverage_assign(spark, d):
    return assigned(spark, d).select("face", "pk")


@query(f"select face, coalesce(string_agg(pk::varchar, ',' order by n) filter (n > 1), '') as others, count(*) - 1 as num_others from {BEST} group by face")
def other_intersect_list(spark, d):
    return assigned(spark, d).select("face", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"), F.size("others").cast("long").alias("num_others"))


@query(f"select b.face, b.pk, p.attribute, p.xmax - p.xmin as width from {BEST} b join {PARCELS} p using (pk) where n = 1")
def attribute_join(spark, d):
    source = parcels(spark, d).select("pk", "attribute", (F.col("xmax") - F.col("xmin")).alias("width"))
    return assigned(spark, d).select("face", "pk").join(source, "pk")


RING = f"(select pk, unnest([0, 1, 2, 3, 4]) as n, unnest([xmin, xmax, xmax, xmin, xmin])::double as x, unnest([ymin, ymin, ymax, ymax, ymin])::double as y from {PARCELS})"
NEXT = "lead(x) over (partition by pk order by n) as ex, lead(y) over (partition by pk order by n) as ey"
SEGMENTS = f"(select * from (select pk, n, x as sx, y as sy, {NEXT} from {RING}) where ex is not null)"


def rings(spark, d):
    return parcels(spark, d).select("pk", G.box_ring([F.col(c) for c in G.BOX]).alias("pts"))


def segments(lines):
    return lines.select("pk", F.posexplode(G.line_parts(F.col("pts"))).alias("n", "s")).select("pk", F.col("n").cast("long").alias("n"), F.col("s.a.x").alias("sx"), F.col("s.a.y").alias("sy"), F.col("s.b.x").alias("ex"), F.col("s.b.y").alias("ey"))


@query(f"select pk, n::bigint as n, x, y from {RING}")
def ring_dump(spark, d):
    return rings(spark, d).select("pk", F.posexplode("pts").alias("n", "p")).select("pk", F.col("n").cast("long").alias("n"), "p.x", "p.y")


@query(f"select pk, n::bigint as n, sx, sy, ex, ey from {SEGMENTS}")
def segment_dump(spark, d):
    return segments(rings(spark, d))


TRACK_NEXT = f"(select * from (select pk, n, x as sx, y as sy, {NEXT} from {TRACKS}) where ex is not null)"


@query(f"select pk, n - 1 as n, sx, sy, ex, ey from {TRACK_NEXT}")
def line_parts(spark, d):
    return segments(tracks(spark, d))


@query(f"select x, y, count(*) as degree from (select sx as x, sy as y from {SEGMENTS} union all select ex, ey from {SEGMENTS}) group by x, y")
def node_degree(spark, d):
    rows = segments(rings(spark, d))
    return rows.select(F.col("sx").alias("x"), F.col("sy").alias("y")).unionAll(rows.select("ex", "ey")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))


UNDIRECTED = f"(select distinct least((sx, sy), (ex, ey)) as p, greatest((sx, sy), (ex, ey)) as q from (select sx, sy, ex, ey from {TRACK_NEXT} where (sx, sy) <> (ex, ey)))"


@query(f"select s[1]::double as x, s[2]::double as y from (select [p[1], p[2]] as s from {UNDIRECTED} union all select [q[1], q[2]] from {UNDIRECTED}) group by s having count(*) = 2")
def heal_candidates(spark, d):
    s = segments(tracks(spark, d)).select(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")).alias("p"), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")).alias("q")).where("p <> q")
    s = s.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    ends = s.select("p").unionAll(s.select("q")).groupBy("p").count().where("count = 2")
    return ends.select(F.col("p.x"), F.col("p.y"))


@query(f"select pk, n, round_even(x / 5, 0) * 5 as x, round_even(y / 5, 0) * 5 as y from {TRACKS}")
def snap_to_grid(spark, d):
    n = F.row_number().over(Window.partitionBy("pk").orderBy("ts", "event_id")).cast("long").alias("n")
    return track_points(spark, d).select("pk", n, (F.rint(F.col("x") / 5) * 5).alias("x"), (F.rint(F.col("y") / 5) * 5).alias("y"))


@query(f"select pk, count(*) as num_points from (select pk, n, x, y, lag(x) over w as lx, lag(y) over w as ly from (select pk, n, round_even(x / 500, 0) * 500 as x, round_even(y / 500, 0) * 500 as y from {TRACKS}) window w as (partition by pk order by n)) where lx is null or lx <> x or ly <> y group by pk")
def remove_repeated(spark, d):
    return tracks(spark, d).select("pk", F.size(G.snap(F.col("pts"), 500.0)).cast("long").alias("num_points"))


@query(f"select pk, coalesce(round(sum(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))), 3), 0.0) as length from {TRACKS} t left join {TRACK_NEXT} using (pk, n) group by pk")
def line_length(spark, d):
    return tracks(spark, d).select("pk", F.round(G.line_length(F.col("pts")), 3).alias("length"))


AZIMUTH = "case when ex = sx and ey = sy then null when atan2(ex - sx, ey - sy) < 0 then atan2(ex - sx, ey - sy) + 2 * pi() else atan2(ex - sx, ey - sy) end"


@query(f"select pk, n - 1 as n, round(degrees({AZIMUTH}), 6) as azimuth from {TRACK_NEXT}")
def azimuth_angle(spark, d):
    rows = segments(tracks(spark, d))
    return rows.select("pk", "n", F.round(F.degrees(G.azimuth(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")))), 6).alias("azimuth"))


LIMITS = {"max_length": 3000.0, "min_degrees": 120.0, "max_degrees": 240.0, "min_steep": 40.0, "max_steep": 320.0}


def turn(sx: str, sy: str, ex: str, ey: str) -> str:
    t = f"atan2({ex} - {sx}, {ey} - {sy})"
    return f"(case when {ex} = {sx} and {ey} = {sy} then null when {t} < 0 then {t} + 2 * pi() else {t} end)"


AROUND = f"(select pk, n, x, y, lag(x) over w as px, lag(y) over w as py, lead(x) over w as nx, lead(y) over w as ny from {TRACKS} window w as (partition by pk order by n))"
ANGLES = f"(select *, abs(degrees({turn('x', 'y', 'px', 'py')} - {turn('x', 'y', 'nx', 'ny')})) as angle, sqrt((x - px) * (x - px) + (y - py) * (y - py)) as d1, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) as d2 from {AROUND})"
SHARP = f"(select *, coalesce(px is not null and nx is not null and (((d1 < 3000 and d2 < 3000) and (angle <= 120 or angle >= 240)) or angle <= 40 or angle >= 320), false) as s from {ANGLES})"


@query(f"select pk, count(*) filter (s) as num_sharp from {SHARP} group by pk")
def sharp_vertices(spark, d):
    p = F.col("pts")
    flags = F.transform(p, lambda q, i: F.when((i > 0) & (i < F.size("pts") - 1), G.sharp(F.get("pts", i - 1), q, F.get("pts", i + 1), **LIMITS)).otherwise(False))
    return tracks(spark, d).select("pk", F.size(F.filter(flags, lambda x: x)).cast("long").alias("num_sharp"))


@query(f"""
with s as (select *, coalesce(lag(s) over w, false) as ps, coalesce(lead(s) over w, false) as ns, count(*) over (partition by pk) as total from {SHARP} window w as (partition by pk order by n)),
raw as (
  select pk, n * 2 - 1 as o, case when s or ps then x + 0.25 * (nx - x) else x end as x, case when s or ps then y + 0.25 * (ny - y) else y end as y from s where nx is not null
  union all select pk, n * 2, case when s or ns then x + 0.75 * (nx - x) else nx end, case when s or ns then y + 0.75 * (ny - y) else ny end from s where nx is not null
  union all select pk, 0, x, y from s where n = 1 union all select pk, total * 2 + 1, x, y from s where n = total and total > 1),
few as (select *, lag(x) over (partition by pk order by o) as lx, lag(y) over (partition by pk order by o) as ly from raw),
kept as (select * from few where lx is null or lx <> x or ly <> y)
select pk, count(*) as num_points, round(sum(x), 3) as sum_x, round(sum(y), 3) as sum_y from kept group by pk having (select count(*) from {TRACKS} t where t.pk = kept.pk) >= 3""")
def chaikin_iter1(spark, d):
    pts = G.chaikin(F.col("pts"), 1, **LIMITS)
    rows = tracks(spark, d).where(F.size("pts") >= 3).select("pk", F.explode(pts).alias("p"))
    return rows.groupBy("pk").agg(F.count(F.lit(1)).alias("num_points"), F.round(F.sum("p.x"), 3).alias("sum_x"), F.round(F.sum("p.y"), 3).alias("sum_y"))


ENDS = f"(select pk, arg_min(x, n) as sx, arg_min(y, n) as sy, arg_max(x, n) as ex, arg_max(y, n) as ey from {TRACKS} group by pk)"


@query(f"select pk, round(sx - 7 * (ex - sx) / l, 6) as x1, round(sy - 7 * (ey - sy) / l, 6) as y1, round(ex + 7 * (ex - sx) / l, 6) as x2, round(ey + 7 * (ey - sy) / l, 6) as y2 from (select *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) as l from {ENDS}) where l > 0")
def extend_line(spark, d):
    rows = tracks(spark, d).select("pk", G.extend_line(F.col("pts"), 7.0).alias("e")).where("e is not null")
    return rows.select("pk", *[F.round(F.col("e")[k][c], 6).alias(f"{c}{k + 1}") for k in (0, 1) for c in ("x", "y")])


@query(f"select pk, ((xmax - xmin) * (ymax - ymin))::double as area from {PARCELS}")
def polygon_area(spark, d):
    return rings(spark, d).select("pk", G.ring_area(F.col("pts")).alias("area"))


@query(f"select pk, round((xmin + xmax) / 2, 6) as x, round((ymin + ymax) / 2, 6) as y from {PARCELS}")
def centroid(spark, d):
    return rings(spark, d).select("pk", G.ring_centroid(F.col("pts")).alias("c")).select("pk", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(f"select pk, ((xmax - xmin) * (ymax - ymin))::double as area from {PARCELS} where (xmax - xmin) * (ymax - ymin) < 6")
def face_filter_small(spark, d):
    return rings(spark, d).select("pk", G.ring_area(F.col("pts")).alias("area")).where("area < 6")


@query(f"select pk, arg_min(n, (-l, n)) as n, max(l) as length from (select pk, n::bigint as n, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) as l from {SEGMENTS}) group by pk")
def longest_edge(spark, d):
    rows = segments(rings(spark, d)).select("pk", "n", F.sqrt(F.pow(F.col("ex") - F.col("sx"), F.lit(2)) + F.pow(F.col("ey") - F.col("sy"), F.lit(2))).alias("l"))
    return rows.groupBy("pk").agg(F.min_by("n", F.struct(-F.col("l"), "n")).alias("n"), F.max("l").alias("length"))


@query(f"select sx, sy, ex, ey from (select least((sx, sy), (ex, ey)) as p, greatest((sx, sy), (ex, ey)) as q from {SEGMENTS}) t, lateral (select p[1] as sx, p[2] as sy, q[1] as ex, q[2] as ey) u group by all")
def union_distinct_lines(spark, d):
    s = segments(rings(spark, d)).select(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")).alias("p"), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")).alias("q"))
    return s.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct().select(F.col("p.x").alias("sx"), F.col("p.y").alias("sy"), F.col("q.x").alias("ex"), F.col("q.y").alias("ey"))


CROSSING = f"(xmin // {CELL} <> xmax // {CELL} or ymin // {CELL} <> ymax // {CELL})"


@query(f"select distinct b.pk from {PARCELS} a, {PARCELS} b where {MEET} and {CROSSING.replace('xm', 'a.xm').replace('ym', 'a.ym')} and not {CROSSING.replace('xm', 'b.xm').replace('ym', 'b.ym')}")
def touch_lines(spark, d):
    """Parcels inside one cell that touch a parcel which crosses a cell border."""
    crossing = f"(xmin div {CELL} <> xmax div {CELL} or ymin div {CELL} <> ymax div {CELL})"
    rows = parcels(spark, d).withColumn("crosses", F.expr(crossing))
    # copies at one place touch alike
    border = rows.where("crosses").select(*G.BOX).distinct()
    return grid.spatial_join(border, rows.where("not crosses"), SIDE).select(F.col("b.pk").alias("pk")).distinct()


INVALID = f"(select * from {PARTS} where (xmax - xmin) % 7 = 0)"


@query(f"select b.pk, case when bool_or(a.pk is not null) then false end as input_is_valid from {PARCELS} b left join {INVALID} a on {MEET} group by b.pk")
def invalid_flag(spark, d):
    """False for parcels whose box meets an invalid polygon's (squares of a side divisible ey 7 stand for these), else null."""
    bad = parts(spark, d).where("(xmax - xmin) % 7 = 0").select(*G.BOX)
    met = grid.spatial_join(parcels(spark, d).select("pk", *G.BOX), bad, 40).select(F.col("a.pk").alias("pk")).distinct().withColumn("met", F.lit(False))
    return parcels(spark, d).select("pk").join(met, "pk", "left").select("pk", F.col("met").alias("input_is_valid"))


@query(f"""
with s as (select x, y, max(pk) as pk, count(*) as c from {SQUARES} group by x, y)
select 'polygons' as description, (select count(*) from {PARCELS}) as num_before, (select count(distinct pk) from s) as num_after
union all select 'points', (select 5 * count(*) from {PARCELS}), (select 4 * count(*) from s)
union all select 'area', (select sum((xmax - xmin) * (ymax - ymin))::bigint from {PARCELS}), (select count(*) from s)
union all select 'polygons below 6', (select count(*) from {PARCELS} where (xmax - xmin) * (ymax - ymin) < 6), (select count(*) from (select pk from s group by pk having count(*) < 6))
union all select 'overlap area', (select count(*) from s where c > 1), 0""")
def compare_report(spark, d):
    from tessella.operators.report import compare

    return compare(parcels(spark, d), overlap.resolve_squares(parcels(spark, d)), smallest=6)


@query(f"select floor(x / 100)::bigint as x, floor(y / 100)::bigint as y, case when (x + y) % 2 = 0 then 'even' else 'odd' end as attribute, count(*) as n from {POINTS} group by all")
def point_cells(spark, d):
    rows = points(spark, d).select(F.floor(F.col("x") / 100).alias("x"), F.floor(F.col("y") / 100).alias("y"), F.when((F.col("x") + F.col("y")) % 2 == 0, "even").otherwise("odd").alias("attribute"))
    return rows.groupBy("x", "y", "attribute").agg(F.count(F.lit(1)).alias("n"))



@query(f"select s.pk, p.attribute, s.area, s.squares_shared from (select pk, count(*) as area, count(*) filter (c > 1) as squares_shared from (select x, y, max(pk) as pk, count(*) as c from {SQUARES} group by x, y) group by pk) s join {PARCELS} p using (pk)")
def resolve_parcels(spark, d):
    """Flagship: the partition of all parcels, as the area that each polygon is left with."""
    rows = overlap.unit_squares(parcels(spark, d), "pk").groupBy("x", "y").agg(F.max("pk").alias("pk"), F.count(F.lit(1)).alias("c"))
    left = rows.groupBy("pk").agg(F.count(F.lit(1)).alias("area"), F.count_if(F.col("c") > 1).alias("squares_shared"))
    return left.join(parcels(spark, d).select("pk", "attribute"), "pk").select("pk", "attribute", "area", "squares_shared")
