"""Queries on joins by place, neighbourhoods, grids, shapes and composites."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import joins as J
from ..operators import raster as R
from .registry import query
from .roles import CELLS, PTS, REFL, SEG, cells, points, reflectance, rounded, segments, table


@query(f"""WITH {PTS}, a AS (SELECT point_id, x AS lon, y AS lat, z AS h FROM pts WHERE label % 2 = 0), b AS (SELECT point_id, x + 0.0000001 AS lon, y AS lat, label AS h FROM pts)
SELECT a.lon, a.lat, a.point_id AS point_id_x, a.h AS h_x, b.point_id AS point_id_y, b.h AS h_y FROM a JOIN b ON round(a.lon, 4) = round(b.lon, 4) AND round(a.lat, 4) = round(b.lat, 4)""")
def coordinate_join(spark, sf_dir):
    """Points of two tables that agree to four decimals, columns with a suffix for each side."""
    p = points(spark, sf_dir)
    a = p.filter("label % 2 = 0").select("point_id", F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("z").alias("h"))
    b = p.select("point_id", (F.col("x") + 0.0000001).alias("lon"), F.col("y").alias("lat"), F.col("label").alias("h"))
    return J.suffixed(a, b, ["lon", "lat"], decimals=4)


@query("SELECT s_nationkey AS tile_num, a.n AS n_old, b.n AS n_new FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) a JOIN (SELECT c_nationkey AS s_nationkey, count(*) AS n FROM customer GROUP BY 1) b USING (s_nationkey)")
def suffixed_join(spark, sf_dir):
    n = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("tile_num")).agg(F.count("*").alias("n"))
    return J.suffixed(n("supplier", "s_nationkey"), n("customer", "c_nationkey"), ["tile_num"], ("_old", "_new"))


_BOXES = "a AS (SELECT point_id AS id, x - 0.02 AS x0, x + 0.02 AS x1, y - 0.01 AS y0, y + 0.03 AS y1 FROM pts), b AS (SELECT point_id AS id, x - 0.004 AS x0, x + 0.004 AS x1, y - 0.004 AS y0, y + 0.004 AS y1 FROM pts)"


def _boxes(spark, sf_dir, left, right, down, up):
    x, y = F.col("x"), F.col("y")
    return points(spark, sf_dir).select(F.col("point_id").alias("id"), (x - left).alias("xmin"), (x + right).alias("xmax"), (y - down).alias("ymin"), (y + up).alias("ymax"))


@query(f"""WITH {PTS}, {_BOXES} SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
WHERE NOT (a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1) AND NOT (b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1)""")
def crossing_boxes(spark, sf_dir):
    return J.crossing(_boxes(spark, sf_dir, 0.02, 0.02, 0.01, 0.03), _boxes(spark, sf_dir, 0.004, 0.004, 0.004, 0.004), 0.1)


@query(f"WITH {PTS}, {_BOXES} SELECT id FROM a WHERE EXISTS (SELECT 1 FROM pts WHERE label = 1 AND a.x0 <= x + 0.001 AND x <= a.x1 AND a.y0 <= y + 0.001 AND y <= a.y1)")
def intersecting_boxes(spark, sf_dir):
    """Boxes that meet any of some small ones: candidates by grid cell, then the exact test."""
    small = points(spark, sf_dir).filter("label = 1").select(F.col("point_id").alias("id"), F.col("x").alias("xmin"), (F.col("x") + 0.001).alias("xmax"), F.col("y").alias("ymin"), (F.col("y") + 0.001).alias("ymax"))
    return G.intersecting(_boxes(spark, sf_dir, 0.02, 0.02, 0.01, 0.03), small, 0.1).select("id")


@query("SELECT o_custkey AS tile_num, min(o_orderkey) AS path FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders) WHERE o_orderdate = newest GROUP BY 1")
def latest_stack(spark, sf_dir):
    """The most recent file of each tile."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tile_num"), F.col("o_orderkey").alias("path"), "o_orderdate")
    return J.latest_file(o, "tile_num", "path", "o_orderdate")


_LAYER = "l{k} AS (SELECT CAST(floor((8 - y) / {s}) AS INTEGER) AS row, CAST(floor((x + 8) / {s}) AS INTEGER) AS col, nullif(max(label), 3) AS top, avg(z) AS z FROM pts WHERE {w} GROUP BY 1, 2)"


@query(f"WITH {PTS}, {_LAYER.format(k=1, s=0.05, w='label < 6')}, {_LAYER.format(k=2, s=0.05, w='label > 2')} SELECT point_id, l1.top AS first_top, l2.top AS second_top, round(l2.z, 8) AS second_z FROM (SELECT *, CAST(floor((8 - y) / 0.05) AS INTEGER) AS row, CAST(floor((x + 8) / 0.05) AS INTEGER) AS col FROM pts) p LEFT JOIN l1 USING (row, col) LEFT JOIN l2 USING (row, col)")
def layers_at_points(spark, sf_dir):
    """Several layers sampled at points, a missing value's code as null."""
    p = points(spark, sf_dir)
    layer = lambda where: p.filter(where).withColumns(J.pixel_of(F.col("x"), F.col("y"), (-8, 8), 0.05)).groupBy("row", "col").agg(F.max("label").alias("top"), F.avg("z").alias("z"))
    out = J.sample_layers(p, {"first": layer("label < 6"), "second": layer("label > 2")}, "x", "y", (-8, 8), 0.05, nodata=3)
    return out.select("point_id", "first_top", "second_top", F.round("second_z", 8).alias("second_z"))


@query(f"WITH {PTS}, f AS (SELECT DISTINCT CAST(floor(y * 16) AS INTEGER) AS row, CAST(floor(x * 16) AS INTEGER) AS col FROM pts), c AS (SELECT CAST(floor(y * 4) AS INTEGER) AS r, CAST(floor(x * 4) AS INTEGER) AS k, max(label) AS top FROM pts WHERE label < 7 GROUP BY 1, 2) SELECT row, col, top FROM f JOIN c ON r = CAST(floor(row / 4) AS INTEGER) AND k = CAST(floor(col / 4) AS INTEGER)")
def coarse_on_fine(spark, sf_dir):
    """A coarse layer brought to a finer grid and stacked on it."""
    p = points(spark, sf_dir)
    grid = lambda n: {"row": F.floor(F.col("y") * n).cast("int"), "col": F.floor(F.col("x") * n).cast("int")}
    fine = p.withColumns(grid(16)).select("row", "col").distinct()
    coarse = p.filter("label < 7").withColumns(grid(4)).groupBy("row", "col").agg(F.max("label").alias("top"))
    return fine.join(R.refined(coarse, 4), ["row", "col"])


@query("WITH a AS (SELECT DISTINCT s_nationkey AS tile_num, 'a' || CAST(s_nationkey AS VARCHAR) AS p FROM supplier), b AS (SELECT DISTINCT c_nationkey AS tile_num, 'b' || CAST(c_nationkey AS VARCHAR) AS p FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT n_nationkey AS tile_num, n_name AS p FROM nation) SELECT tile_num, a.p AS a_path, b.p AS b_path, c.p AS c_path FROM a JOIN b USING (tile_num) JOIN c USING (tile_num)")
def tile_file_tuples(spark, sf_dir):
    """Files of the tiles that three indices share."""
    index = lambda t, k, p: table(spark, sf_dir, t).select(F.col(k).alias("tile_num"), F.concat(F.lit(p), F.col(k).cast("string")).alias("path")).distinct()
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile_num"), F.col("n_name").alias("path"))
    return J.tile_files({"a": index("supplier", "s_nationkey", "a"), "b": index("customer", "c_nationkey", "b").join(table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("tile_num")).distinct(), "tile_num"), "c": named}, "tile_num", "path")


@query(f"WITH {SEG}, z AS (SELECT tile_num, sum(agb) AS total FROM seg GROUP BY 1) SELECT s_suppkey, n_name, round(total, 6) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN z ON tile_num = s_suppkey")
def zone_attributes(spark, sf_dir):
    """Results joined to their zones by the zones' own number, and names to the zones."""
    z = segments(spark, sf_dir).groupBy(F.col("tile_num").alias("s_suppkey")).agg(F.sum("agb").alias("total"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(s.join(z, "s_suppkey", "left").select("s_suppkey", "n_name", "total"))


@query(f"WITH {CELLS} SELECT a.row, a.col, round(a.value, 6) AS value, round((SELECT avg(b.value) FROM cells b WHERE abs(a.row - b.row) <= 5 AND abs(a.col - b.col) <= 5), 6) AS focal_mean FROM cells a")
def focal_mean_11(spark, sf_dir):
    return rounded(R.focal_mean(cells(spark, sf_dir).drop("top"), "value"))


@query(f"WITH {CELLS}, m AS (SELECT a.row, a.col, b.top, count(*) AS n FROM cells a JOIN cells b ON abs(a.row - b.row) <= 5 AND abs(a.col - b.col) <= 5 GROUP BY 1, 2, 3) SELECT row, col, top AS focal_mode FROM m QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, top) = 1")
def focal_mode_11(spark, sf_dir):
    return R.focal_mode(cells(spark, sf_dir).drop("value"), "top").select("row", "col", "focal_mode")


@query(f"WITH {CELLS} SELECT a.row, a.col, round(a.value - (SELECT avg(b.value) FROM cells b WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)), 6) AS tpi FROM cells a")
def position_index(spark, sf_dir):
    return rounded(R.position_index(cells(spark, sf_dir).drop("top"), "value").select("row", "col", "tpi"))


_HORN = f"""h AS (SELECT g.row, g.col, {", ".join(f"max(CASE WHEN n.row = g.row + {i} AND n.col = g.col + {j} THEN n.z END) AS z{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))} FROM g JOIN g n ON abs(n.row - g.row) <= 1 AND abs(n.col - g.col) <= 1 GROUP BY 1, 2),
d AS (SELECT row, col, ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / 240 AS dx, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / 240 AS dy FROM h)"""


@query(f"""WITH {PTS}, g AS (SELECT CAST(floor(y * 12) AS INTEGER) AS row, CAST(floor(x * 12) AS INTEGER) AS col, 100 * avg(z) AS z FROM pts GROUP BY 1, 2), {_HORN},
s AS (SELECT row, col, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN dx <> 0 OR dy <> 0 THEN ((degrees(atan2(-dx, dy)) % 360) + 360) % 360 END AS aspect FROM d)
SELECT row, col, round(slope, 5) AS slope, round(aspect, 4) AS aspect, round(255 * (sin(radians(45)) * cos(radians(slope)) + cos(radians(45)) * sin(radians(slope)) * cos(radians(315 - aspect)) + 1) / 2, 4) AS shade FROM s""")
def terrain_of_cells(spark, sf_dir):
    """Slope, aspect and hillshade of a surface of gathered points."""
    p = points(spark, sf_dir)
    g = p.groupBy(F.floor(F.col("y") * 12).cast("int").alias("row"), F.floor(F.col("x") * 12).cast("int").alias("col")).agg((100 * F.avg("z")).alias("z"))
    t = R.terrain(g, "z", 30.0)
    return t.select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"), F.round(R.hillshade(F.col("slope"), F.col("aspect")), 4).alias("shade"))


_DIAMONDS = ((1, 0.0503, 0.0307, 0.1111), (2, 0.3031, -0.2013, 0.5017), (3, -0.1107, 0.1203, 0.2311))


@query(f"WITH {PTS}, c AS (SELECT DISTINCT CAST(floor((8 - y) / 0.02) AS INTEGER) AS row, CAST(floor((x + 8) / 0.02) AS INTEGER) AS col FROM pts), d(zone, cx, cy, r) AS (VALUES {', '.join(map(str, _DIAMONDS))}) SELECT row, col, coalesce(min(zone), 0) AS zone FROM (SELECT *, -8 + (col + 0.5) * 0.02 AS px, 8 - (row + 0.5) * 0.02 AS py FROM c) LEFT JOIN d ON abs(px - cx) + abs(py - cy) < r GROUP BY 1, 2")
def rasterised_zones(spark, sf_dir):
    """Polygons as a raster of their numbers, nothing as 0."""
    rings = [(i, [{"x": x, "y": y} for x, y in ((cx - r, cy), (cx, cy + r), (cx + r, cy), (cx, cy - r), (cx - r, cy))], cx - r, cx + r, cy - r, cy + r) for i, cx, cy, r in _DIAMONDS]
    polygons = spark.createDataFrame(rings, "polygon_id int, ring array<struct<x:double,y:double>>, xmin double, xmax double, ymin double, ymax double")
    c = points(spark, sf_dir).select(*[v.alias(k) for k, v in J.pixel_of(F.col("x"), F.col("y"), (-8, 8), 0.02).items()]).distinct()
    return G.rasterised(c, polygons, (-8, 8), 0.02)


@query(f"WITH {CELLS}, b AS (SELECT CAST(floor(row / 3) AS INTEGER) AS r, CAST(floor(col / 3) AS INTEGER) AS c, row, col, top FROM cells) SELECT r AS row, c AS col, min(top) AS low, max(top) AS high, sum(top) AS total, median(top) AS middle, max(CASE WHEN (row % 3 + 3) % 3 = 1 AND (col % 3 + 3) % 3 = 1 THEN top END) AS nearest FROM b GROUP BY 1, 2")
def resampled_blocks(spark, sf_dir):
    """Blocks of three by three pixels by several rules."""
    g, out = cells(spark, sf_dir).drop("value"), None
    for name, method in (("low", "min"), ("high", "max"), ("total", "sum"), ("middle", "median"), ("nearest", "nearest")):
        part = R.resampled(g, "top", 3, method).withColumnRenamed("top", name)
        out = part if out is None else out.join(part, ["row", "col"], "left")
    return out


@query(f"WITH {SEG} SELECT CAST(floor((part % 300) / 75) * 4 + floor((granule % 300) / 75) AS INTEGER) AS piece, count(*) AS n FROM seg GROUP BY 1")
def raster_pieces(spark, sf_dir):
    s = segments(spark, sf_dir).select((F.col("part") % 300).alias("row"), (F.col("granule") % 300).alias("col"))
    return R.pieces(s, 300, 300, 4).groupBy("piece").agg(F.count("*").alias("n"))


@query(f"WITH {SEG}, a AS (SELECT tile_num, 0.09 * 1000 * count(*) AS area FROM seg GROUP BY 1), t AS (SELECT tile_num, CAST(greatest(1, ceil(sqrt(area / 0.09) / 100)) AS INTEGER) AS stride FROM a) SELECT tile_num, stride, count(*) FILTER (part % stride = 0 AND granule % stride = 0) AS sampled FROM seg JOIN t USING (tile_num) GROUP BY 1, 2")
def adaptive_resolution(spark, sf_dir):
    """How coarsely large zones would be read; off by default elsewhere, as it changes answers."""
    s = segments(spark, sf_dir)
    strides = s.groupBy("tile_num").agg((F.count("*") * 90.0).alias("area")).select("tile_num", R.zone_stride(F.col("area"), 0.09, 100).alias("stride"))
    read = (F.col("part") % F.col("stride") == 0) & (F.col("granule") % F.col("stride") == 0)
    return s.join(strides, "tile_num").groupBy("tile_num", "stride").agg(F.count(F.when(read, 1)).alias("sampled"))


_P1, _P2, _P0 = math.radians(50), math.radians(70), math.radians(40)
_N = (math.sin(_P1) + math.sin(_P2)) / 2
_C = math.cos(_P1) ** 2 + 2 * _N * math.sin(_P1)
_R = 6371007.181
_RHO0 = _R * math.sqrt(_C - 2 * _N * math.sin(_P0)) / _N
_ALBERS = f"al AS (SELECT *, {_R!r} * sqrt(CAST({_C!r} AS DOUBLE) - CAST({2 * _N!r} AS DOUBLE) * sin(radians(lat))) / CAST({_N!r} AS DOUBLE) AS rho, CAST({_N!r} AS DOUBLE) * radians(CASE WHEN lon >= 0 THEN lon - 180 ELSE lon + 180 END) AS turn FROM ll)"


@query(f"WITH {PTS}, ll AS (SELECT point_id, x * 400 AS lon, 55 + y * 30 AS lat FROM pts), {_ALBERS} SELECT point_id, round(rho * sin(turn), 3) AS px, round(CAST({_RHO0!r} AS DOUBLE) - rho * cos(turn), 3) AS py, round(lon, 7) AS lon, round(lat, 7) AS lat FROM al")
def projected_points(spark, sf_dir):
    """Points to the equal-area projection, and back onto the turn that their longitudes were given on."""
    p = points(spark, sf_dir).withColumns({"lon0": F.col("x") * 400, "lat0": 55 + F.col("y") * 30})
    xy = R.to_albers(F.col("lon0"), F.col("lat0"))
    p = p.withColumns({"px": xy["x"], "py": xy["y"]})
    back = R.from_albers(F.col("px"), F.col("py"), F.col("lon0"))
    return p.select("point_id", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), *[F.round(F.round(back[c], digits), 7).alias(c) for c, digits in (("lon", 12), ("lat", 13))])  # first back to the digits that the way there and back keeps, so that ties are ties again


@query(f"WITH {PTS}, {_BOXES}, w AS (SELECT id, x0 - 0.01 AS x0, y0 - 0.01 AS y0, x1 + 0.01 AS x1, y1 + 0.01 AS y1 FROM a), c AS (SELECT id, greatest(x0, -0.1) AS x0, greatest(y0, -0.08) AS y0, least(x1, 0.12) AS x1, least(y1, 0.1) AS y1 FROM w) SELECT id, round(x0, 9) AS xmin, round(y0, 9) AS ymin, round(x1, 9) AS xmax, round(y1, 9) AS ymax FROM c WHERE x0 < x1 AND y0 < y1")
def buffered_and_clipped(spark, sf_dir):
    b = G.buffered(_boxes(spark, sf_dir, 0.02, 0.02, 0.01, 0.03), 0.01).withColumns({"x0": F.lit(-0.1), "y0": F.lit(-0.08), "x1": F.lit(0.12), "y1": F.lit(0.1)})
    return rounded(G.clipped(b, ("x0", "y0", "x1", "y1")).select("id", "xmin", "ymin", "xmax", "ymax"), 9)


@query("SELECT n_nationkey AS tile_num, n_nationkey * 90000.0 AS xmin, (n_nationkey % 5) * 90000.0 AS ymin, n_nationkey * 90000.0 - 300 AS buffered_xmin, (n_nationkey % 5) * 90000.0 + 90300 AS buffered_ymax, TRUE AS covers FROM nation")
def tile_parts(spark, sf_dir):
    """A tile's box, the buffered one, and the lon/lat box around that: the centre lies within."""
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(k.alias("tile_num"), (k * 90000.0).alias("xmin"), ((k % 5) * 90000.0).alias("ymin"), (k * 90000.0 + 90000).alias("xmax"), ((k % 5) * 90000.0 + 90000).alias("ymax"))
    centre = R.from_albers((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    covers = centre["lon"].between(F.col("lon0"), F.col("lon1")) & centre["lat"].between(F.col("lat0"), F.col("lat1"))
    across = F.col("lon1") - F.col("lon0") > 180  # a box over the antimeridian
    return G.tile_parts(t, 300.0).select("tile_num", "xmin", "ymin", "buffered_xmin", "buffered_ymax", (covers | across).alias("covers"))


@query("WITH b AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS x0, CASE WHEN c_custkey * 7 % 360 - 180 + 20 > 180 THEN c_custkey * 7 % 360 - 520 ELSE c_custkey * 7 % 360 - 160 END AS x1 FROM customer) SELECT id * 100 AS id, x0 AS xmin, CAST(CASE WHEN x0 > x1 THEN 180 ELSE x1 END AS DOUBLE) AS xmax, 50.0 AS ymin, 60.0 AS ymax FROM b UNION ALL SELECT id * 100 + 1, -180.0, x1, 50.0, 60.0 FROM b WHERE x0 > x1")
def dateline_split(spark, sf_dir):
    x0 = (F.col("c_custkey") * 7 % 360 - 180).cast("double")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x0.alias("xmin"), F.when(x0 + 20 > 180, x0 - 340).otherwise(x0 + 20).alias("xmax"), F.lit(50.0).alias("ymin"), F.lit(60.0).alias("ymax"))
    return R.at_dateline(b)


_RINGS = "r AS (SELECT point_id, label, x, y, abs(z) + 0.01 AS w FROM pts)"


def _rings(spark, sf_dir):
    """Right triangles at points, their legs as long as w."""
    x, y, w = F.col("x"), F.col("y"), F.abs("z") + 0.01
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return points(spark, sf_dir).select("point_id", "label", "x", "y", F.array(corner(x, y), corner(x + w, y), corner(x, y + w), corner(x, y)).alias("ring"))


@query(f"WITH {PTS}, {_RINGS} SELECT point_id, round(w * w / 2, 9) AS area, round(x + w / 3, 7) AS cx, round(y + w / 3, 7) AS cy, x + w AS second_lon, y AS second_lat FROM r")
def ring_shapes(spark, sf_dir):
    """Area, centroid and {lat, lon} points of rings."""
    r, ring = _rings(spark, sf_dir), F.col("ring")
    c = R.ring_centroid(ring)
    return r.select("point_id", F.round(R.ring_area(ring), 9).alias("area"), F.round(c["x"], 7).alias("cx"), F.round(c["y"], 7).alias("cy"), G.ring_points(ring)[1]["lon"].alias("second_lon"), G.ring_points(ring)[1]["lat"].alias("second_lat"))


@query(f"WITH {PTS}, {_RINGS} SELECT label, min(point_id) AS point_id, count(*) AS parts, round(min(x), 8) AS min_x, round(max(y), 8) AS max_y, round(avg(x), 8) AS mean_x FROM r GROUP BY 1")
def dissolved_shapes(spark, sf_dir):
    """Rings of a class as one shape with its first attributes, taken apart again, and extents of their places."""
    r = _rings(spark, sf_dir)
    parts = G.parts(G.dissolved(r, "label", ["point_id"], "ring", "point_id"), "parts").groupBy("label", "point_id").agg(F.count("*").alias("parts"))
    extent = G.centroid_extent(r, ["label"], "x", "y").select("label", *[F.round(c, 8).alias(c) for c in ("min_x", "max_y", "mean_x")])
    return parts.join(extent, "label")


@query(f"WITH {SEG} SELECT tile_num, month, arg_min(h_can, (granule, line, part)) AS h_can FROM seg WHERE slope > 20 GROUP BY 1, 2")
def first_valid_mosaic(spark, sf_dir):
    s = segments(spark, sf_dir).withColumns({"h_can": F.when(F.col("slope") > 20, F.col("h_can")), "priority": F.struct("granule", "line", "part")})
    return R.first_valid(s, ["tile_num", "month"], "h_can", "priority")


@query(f"WITH {SEG}, a AS (SELECT tile_num, kendall, max(h_can) AS h_can, max(slope) AS slope FROM seg WHERE year = 1996 AND line < 3 GROUP BY 1, 2), b AS (SELECT tile_num, kendall, max(h_can) AS h_can, max(slope) AS slope FROM seg WHERE year = 1999 GROUP BY 1, 2) SELECT tile_num, kendall, coalesce(a.h_can, b.h_can) AS h_can, coalesce(a.slope, b.slope) AS slope FROM a FULL JOIN b USING (tile_num, kendall)")
def backfilled_composite(spark, sf_dir):
    s = segments(spark, sf_dir)
    at = lambda where: s.filter(where).groupBy("tile_num", "kendall").agg(F.max("h_can").alias("h_can"), F.max("slope").alias("slope"))
    return R.backfilled(at("year = 1996 AND line < 3"), at("year = 1999"), ["tile_num", "kendall"], ["h_can", "slope"])


@query(f"WITH {SEG} SELECT tile_num, kendall, max(agb) AS agb FROM seg GROUP BY 1, 2")
def overlap_maximum(spark, sf_dir):
    return R.mosaic_max(segments(spark, sf_dir), ["tile_num", "kendall"], "agb")


@query(f"WITH {REFL}, s AS (SELECT vec_id, vec_id % 60 AS px, (nir - red) / (nir + red) AS ndvi, red, vec_id % 365 + 1 AS doy, 2015 + vec_id % 8 AS year FROM refl), b AS (SELECT px, count(*) AS n_valid, arg_max(vec_id, (ndvi, -vec_id)) AS vec_id FROM s WHERE red BETWEEN 0.02 AND 0.6 GROUP BY 1) SELECT b.px, n_valid, CASE WHEN n_valid >= 5 THEN round(s.ndvi, 8) END AS ndvi, CAST(CASE WHEN n_valid >= 5 THEN s.doy END AS INTEGER) AS doy, CAST(CASE WHEN n_valid >= 5 THEN s.year END AS INTEGER) AS year FROM b JOIN s USING (vec_id)")
def dated_composite(spark, sf_dir):
    """The greenest scene's index and date, from its name, of pixels with enough scenes."""
    k = F.col("vec_id")
    name = F.concat(F.lit("HLS.S30.T01."), 2015 + k % 8, F.lpad((k % 365 + 1).cast("string"), 3, "0"), F.lit("T1."), k, F.lit(".tif"))
    ndvi = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red"))
    s = R.scene_dates(reflectance(spark, sf_dir).withColumns({"px": k % 60, "name": name, "ndvi": F.when(F.col("red").between(0.02, 0.6), ndvi)}), "name", "HLS")
    out = R.composite(s, ["px"], "ndvi", ["doy", "year"], "vec_id")
    return rounded(R.enough_scenes(out, 5, ["ndvi", "doy", "year"]).select("px", "n_valid", "ndvi", "doy", "year"), 8)
